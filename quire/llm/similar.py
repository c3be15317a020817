"""Near-duplicates by SimHash with an exact check, and the groups that they link: all pairs of documents whose five-word
shingle sets have a Jaccard similarity of 0.8 or more.

First come the pairs that `op2_simhash` links: fingerprints of three-word shingles within 3 of 64 bits, found by
pigeonring filtering (`simhash.links`; of equal fingerprints each with the least node, of linked ones the least nodes of
both). They are confirmed on the whole sets. SimHash misses many pairs near 0.8, so an exact way finds the
rest: pigeonring filtering of the sets between the groups that SimHash has found.

Shingles are those of `simhash`; a set holds each once (as XXH64, seed 42), a blank text has none. Sets x and y
are similar if 9 |x & y| >= 4 (|x| + |y|), so they differ in at most (|x| + |y|) / 9 shingles, and neither is more than a
quarter larger than the other. Sizes are cut into classes of that ratio, and a set joins its own class and the next, so similar
sets meet in one at least. A class whose largest size is U allows tau = 2 U // 9 differences. The shingles are dealt by hash into
m > tau parts around a ring; as a difference spoils one part, at least m - tau parts of similar sets are equal.
Each set leaves out its m - tau - 1 lightest parts (fewest shingles, then least content, an order that is the same for
all sets), so one equal part stays in both: every similar pair shares a key. Nothing is sampled or capped, and
the keys of a set are about half as many as its shingles.

Candidates are confirmed by comparing the whole sets. Under a key, first all members of other groups are compared with its
least; then, where a key's members are still in several groups, all its pairs across groups that pass exact lower
bounds on the difference (sizes, and counts of shingles in `BINS` bins). Keys with more than `MEMBERS` members are dealt
in pairs of blocks over many tasks, so that no task holds more than two blocks. Equal sets are one node.

Null, empty or blank texts: the empty set, one node. Very long texts are read whole. Null ids, repeated rows and ties: see
`simhash.one_of_each`. An empty table gives no groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import small_batches, staged
from quire.llm.components import components
from quire.llm.simhash import fingerprint, links, remixed, shingle_hashes

BINS = 256
#: Members of a large key that are compared with all others in one go (BLOCK * BLOCK * BINS differences at once).
BLOCK = 128
#: Members of a key that one task holds; larger keys are dealt in blocks of this many.
MEMBERS = 4096
#: Marks that a member carries, its least ones, so that a pair is made once and not under every key that it shares.
MARKS = 32


def shingle_set(text: str | None, n_words: int) -> np.ndarray:
    """Distinct shingle hashes in order."""
    return np.unique(shingle_hashes(text, n_words))


def node_of(found: np.ndarray) -> int:
    """A digest of the set as a signed long."""
    return xxhash.xxh64_intdigest(found.tobytes(), 7) - (1 << 63)


def bins_of(found: np.ndarray) -> bytes:
    """Shingles in each bin, 65535 at most: the sum of differences is never above that of the sets."""
    return np.minimum(np.bincount((found >> np.uint64(40)).astype(np.int64) % BINS, minlength=BINS), 65535).astype("<u2").tobytes()


@cache
def classes(size: int) -> tuple[int, int, int]:
    """(number, largest size of the class, largest size of the next) of the class that holds `size`."""
    k, low = 0, 1
    while size > low * 5 // 4:
        k, low = k + 1, low * 5 // 4 + 1
    top = low * 5 // 4
    return k, top, (top + 1) * 5 // 4


def keys_of(found: np.ndarray) -> np.ndarray:
    """The keys of a set, of which similar sets share one at least."""
    if not len(found):
        return np.zeros(0, np.int64)
    number, own, following = classes(len(found))
    out = []
    with np.errstate(over="ignore"):
        for k, top in ((number, own), (number + 1, following)):
            tau = 2 * top // 9
            m = (tau + 1) * 5 // 4 + 6
            mixed = remixed(found, 1)
            part = ((mixed >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            weight = np.bincount(part, minlength=m)
            filled = np.flatnonzero(weight)
            content = np.zeros(m, np.uint64)
            content[filled] = np.add.reduceat(mixed[order], np.cumsum(weight[filled]) - weight[filled])
            heaviest = np.lexsort((content, weight))[m - tau - 1 :]
            out.append(remixed(content[heaviest] * np.uint64(2 * 4096 + 1) + (heaviest * 4096 + k).astype(np.uint64), 2))
    return np.concatenate(out).view(np.int64)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    return 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))


def _nodes(docs: DataFrame, keep: tuple[str, ...], n_words: int) -> DataFrame:
    """The columns in `keep`, fp (the node), n (shingles), bins and print (the SimHash fingerprint as a signed long). Row by
    row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), n_words) for t in batch["text"]]
            made = [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([bins_of(s) for s in sets], pa.binary())]
            prints = np.array([fingerprint(t.as_py())[0] for t in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *made, pa.array(prints)], names=[*keep, "fp", "n", "bins", "print"])

    kinds = [f"`{c}` {t}" for c, t in docs.select(*keep).dtypes]
    return docs.select(*{*keep, "text"}).mapInArrow(run, ", ".join([*kinds, "fp long, n long, bins binary, print long"]))


def _keyed(docs: DataFrame, n_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys = [], []
            for text in batch["text"]:
                found = shingle_set(text.as_py(), n_words)
                keys.append(keys_of(found))
                fps.append(np.full(len(keys[-1]), node_of(found), np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(fps)), pa.array(np.concatenate(keys))], names=["fp", "key"])

    return docs.select("text").mapInArrow(run, "fp long, key long")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams (key, fp) sorted by key. Of each key with several nodes: (least, node) pairs without a set; if there are
    more than two, also (set, node), where equal sets of nodes have one number."""
    key, held = None, []

    def finish(out: list[np.ndarray]) -> None:
        nodes = np.unique(np.concatenate(held)) if held else []
        if len(nodes) > 1:
            out.append(np.stack([np.zeros(len(nodes) - 1, np.int64), np.full(len(nodes) - 1, nodes[0]), nodes[1:]]))
        if len(nodes) > 2:
            mark = (xxhash.xxh64_intdigest(nodes.tobytes(), 11) >> 1) + 1
            out.append(np.stack([np.full(len(nodes), mark), nodes, nodes]))

    def emit(out: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], names=["mark", "a", "b"])

    for batch in batches:
        keys, fps = (batch[c].to_numpy(zero_copy_only=False) for c in ("key", "fp"))
        if not len(keys):
            continue
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
        out: list[np.ndarray] = []
        alone = ends - starts == 1
        alone[0] = alone[-1] = False
        for s, e in zip(starts[~alone].tolist(), ends[~alone].tolist(), strict=True):
            if keys[s] != key:
                finish(out)
                key, held = keys[s], []
            held.append(fps[s:e])
        if out:
            yield emit(out)
    out = []
    finish(out)
    if out:
        yield emit(out)


def _possible(n: np.ndarray, bins: np.ndarray, n2: np.ndarray, bins2: np.ndarray) -> np.ndarray:
    """Which rows against which can be similar, by sizes and by bins."""
    most = (n + n2) // 9
    ok = np.abs(n - n2) <= most
    at = np.nonzero(ok)
    ok[at] = np.abs(np.broadcast_to(bins, (*ok.shape, BINS))[at] - np.broadcast_to(bins2, (*ok.shape, BINS))[at]).sum(axis=-1) <= most[at]
    return ok


def _bins(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, BINS).astype(np.int32)


def _pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = ((batch[f"n{s}"].to_numpy(), _bins(batch[f"bins{s}"])) for s in ("a", "b"))
        yield batch.select(["a", "b"]).filter(pa.array(_possible(*one, *two)))


def marked(rows: DataFrame) -> DataFrame:
    """Members (mark, node and more) with low: the `MARKS` least marks of the node."""
    low = staged(rows.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("mark")), 1, MARKS).alias("low")), "low")
    return rows.join(low.hint("merge"), "node")


def _below(column: pa.Array, mark: int) -> np.ndarray:
    """A row of `MARKS` for each list: its marks below `mark`, else -1."""
    out = np.full((len(column), MARKS), -1, np.int64)
    lengths = column.value_lengths().to_numpy()
    out[np.arange(MARKS) < lengths[:, None]] = column.flatten().to_numpy()
    out[out >= mark] = -1
    return out


def _earlier(low: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs (x, y) of rows have a mark in common."""
    out = np.zeros(len(x), bool)
    for s in range(0, len(x), 4096):
        a, b = low[x[s : s + 4096]], low[y[s : s + 4096]]
        out[s : s + 4096] = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(axis=(1, 2))
    return out


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams members sorted by mark and pair of blocks (i, j): possible pairs of members of different parts; where i and j
    differ, of different blocks. Where members have their least marks (`low`), a pair is left to a lesser mark that both
    have: the least mark that two members share always makes their pair."""
    held: list[pa.RecordBatch] = []

    def finish() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        node, part, n, block = (rows[c].to_numpy() for c in ("node", "part", "n", "block"))
        low = _below(rows["low"], rows["mark"][0].as_py()) if "low" in rows.schema.names else None
        bins, mixed = _bins(rows["bins"]), rows["i"][0].as_py() != rows["j"][0].as_py()
        for at in range(0, len(node), BLOCK):
            for to in range(at, len(node), BLOCK):
                i, j = slice(at, at + BLOCK), slice(to, to + BLOCK)
                apart = part[i, None] != part[None, j]
                if mixed:
                    apart &= block[i, None] != block[None, j]
                if at == to:
                    apart = np.triu(apart, 1)
                if apart.any():
                    x, y = np.nonzero(apart & _possible(n[i, None], bins[i, None], n[None, j], bins[None, j]))
                    if low is not None:
                        first = ~_earlier(low, x + at, y + to)
                        x, y = x[first], y[first]
                    a, b = node[i][x], node[j][y]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    now = None
    for batch in batches:
        marks = np.stack([batch[c].to_numpy() for c in ("mark", "i", "j")], axis=1)
        cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if s == e:
                continue
            if held and now != marks[s].tolist():
                yield from finish()
                held.clear()
            now = marks[s].tolist()
            held.append(batch.slice(s, e - s))
    if held:
        yield from finish()


def dealt(rows: DataFrame, most: int) -> DataFrame:
    """Members with block, i and j: a key's members in blocks of about `most`, each for every pair (i, j) of blocks that has its own."""
    blocks = staged(rows.groupBy("mark").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("n_blocks")), "blocks")
    rows = rows.join(blocks.hint("merge"), "mark").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return rows.select("mark", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "part", "n", "bins", *({"low"} & {*rows.columns}))


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (fp, print) that SimHash links: each with the least of equal print, and the least of two prints within
    3 bits. They grow with the nodes, not with the square of a group."""
    least = staged(nodes.groupBy("print").agg(F.min("fp").alias("least")), "least")
    equal = nodes.select("fp", "print").join(least.hint("merge"), "print").where("least <> fp").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    near = staged(links(least.select(F.col("print").alias("fp")), direct=True).select(F.least("a", "b").alias("pa"), F.greatest("a", "b").alias("pb")).distinct(), "near")
    side = lambda s: least.select(F.col("print").alias(f"p{s}"), F.col("least").alias(s)).hint("merge")
    return equal.unionAll(near.join(side("a"), "pa").join(side("b"), "pb").select("a", "b"))


def _confirmed(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, n_words: int) -> DataFrame:
    """Pairs (a, b) of nodes whose sets are similar. firsts: fp and the doc_id and text hash of one of its rows."""
    need = staged(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "need")
    which = firsts.join(need.hint("merge"), "fp").select("fp", F.col("first.d").alias("_d"), F.col("first.t").alias("_t")).hint("merge")
    text = docs.select("doc_id", "text")
    text = text.join(which, text["doc_id"].eqNullSafe(which["_d"]) & (F.xxhash64(text["text"]) == which["_t"])).select("fp", "text").dropDuplicates(["fp"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["fp"], pa.array([shingle_set(t.as_py(), n_words).tobytes() for t in batch["text"]], pa.binary())], names=["fp", "held"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    known = staged(text.mapInArrow(sets, "fp long, held binary"), "sets")
    one, two = known.select(F.col("fp").alias("a"), F.col("held").alias("x")).hint("merge"), known.select(F.col("fp").alias("b"), F.col("held").alias("y")).hint("merge")
    return staged(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "similar")


def grouped(docs: DataFrame, keep: tuple[str, ...], n_words: int) -> DataFrame:
    """The columns in `keep`, fp, and part: the least node reachable over similar pairs. `docs`: doc_id and text, `keep` with _text,
    the text's hash."""
    small_batches(docs.sparkSession)
    prints = staged(_nodes(docs, keep, n_words), "nodes")
    firsts = staged(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").alias("d"), F.col("_text").alias("t"))).alias("first"), F.min("n").alias("n"), F.min("bins").alias("bins"), F.min("print").alias("print")), "firsts")
    sized = firsts.select("fp", "n", "bins")
    linked = by_fingerprint(firsts)
    side = lambda s: sized.select(*(F.col(c).alias(x) for c, x in (("fp", s), ("n", f"n{s}"), ("bins", f"bins{s}")))).hint("merge")
    linked = linked.join(side("a"), "a").join(side("b"), "b").mapInArrow(_pruned, "a long, b long")
    edges = _confirmed(staged(linked, "linked"), docs, firsts, n_words)
    parts = staged(components(edges), "parts")

    nodes = staged(sized.join(parts.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "n", "bins", F.coalesce("component", "fp").alias("part")), "nodes")
    found = staged(_keyed(docs, n_words).repartition("key").sortWithinPartitions("key").mapInArrow(_members, "mark long, a long, b long").distinct(), "members")

    side = lambda s: nodes.select(*(F.col(c).alias(x) for c, x in (("fp", s), ("n", f"n{s}"), ("bins", f"bins{s}"), ("part", f"part{s}")))).hint("merge")
    pairs = found.where("mark = 0").select("a", "b").join(side("a"), "a").join(side("b"), "b").where("parta <> partb").select("a", "b", "na", "nb", "binsa", "binsb")
    edges = edges.unionAll(_confirmed(staged(pairs.mapInArrow(_pruned, "a long, b long"), "pairs"), docs, firsts, n_words))
    parts = staged(components(edges), "parts")

    members = found.where("mark <> 0").select("mark", F.col("b").alias("fp")).join(parts.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("mark", "fp", F.coalesce("component", "fp").alias("part"))
    members = staged(members, "members")
    several = staged(members.groupBy("mark").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select("mark"), "several")
    if not several.isEmpty():
        shared = staged(members.join(several.hint("merge"), "mark").select("mark", F.col("fp").alias("node"), "part"), "shared")
        rest = staged(marked(shared).join(sized.withColumnRenamed("fp", "node").hint("merge"), "node").select("mark", "node", "part", "n", "bins", "low"), "rest")
        keys = ["mark", "i", "j"]
        more = staged(dealt(rest, MEMBERS).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_across, "a long, b long").distinct(), "pairs")
        edges = edges.unionAll(_confirmed(more, docs, firsts, n_words))
        parts = components(edges)
    return prints.select(*keep, "fp").join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(*keep, "fp", F.coalesce("component", "fp").alias("part"))
