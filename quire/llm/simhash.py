"""SimHash near-duplicates, with pigeonring filtering of candidates.

Words are runs without ASCII white space after lower-casing A-Z; shingles are `n_words` words joined by
spaces, repeats included (fewer words: the whole sequence). A fingerprint bit is set if it is set in over
half of the shingles' XXH64 hashes (seed 42). Fingerprints within 3 bits are linked.

Pigeonring: cut 64 bits into a ring of 8 segments. If two fingerprints differ in at most 3 bits, then
from some segment on, the differences of the first l segments stay within l * 3 / 8 for every l. So
the first two segments are equal, and the first five differ in one bit at most, hence two of the third to
fifth are equal too. Each fingerprint gets 8 * 3 keys of 4 equal segments (32 bits); within a key, pairs
are pruned by the whole chain before the full check.

With `families` above 1, further fingerprints are made from the same shingles with remixed hashes, and a pair
is linked if any family's fingerprints are within 3 bits. Measured on edited copies with five-word shingles, one
family finds 14 % of pairs at a similarity of 0.9 and 43 % at 0.95, eight find 69 % and 99 %.

Equal fingerprints are one node, so groups of copies cost one row. A key's fingerprints are streamed; each
connected part found under a key gives one edge a member to its least, so edges stay linear in the rows.
Keys with more than `BUCKET` fingerprints are dealt again as pairs of blocks over many tasks: nothing is
capped. Null, empty or blank texts: fingerprint zero, linked like any other. Null doc_id: not the
smallest of its group unless all are null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import small_batches, staged
from quire.llm.components import components

BITS, SEGMENTS, TAU, SEED = 64, 8, 3, 42
#: Fingerprints compared in one go under a key; larger keys are dealt in blocks of this many.
BUCKET = 2048


def remixed(hashes: np.ndarray, family: int) -> np.ndarray:
    """Another hash of the same shingles; family 0 is XXH64 itself."""
    if not family:
        return hashes
    with np.errstate(over="ignore"):
        x = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * family & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, n_words: int) -> np.ndarray:
    """XXH64 of every shingle in order; none of a blank text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    joined, n = b" ".join(words), len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < n_words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: n - n_words + 1].tolist(), ends[n_words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, n_words: int = 3, families: int = 1) -> list[int]:
    """One fingerprint for each family."""
    hashes = shingle_hashes(text, n_words)
    if not len(hashes):
        return [0] * families
    out = []
    for family in range(families):
        counts = np.zeros(BITS, np.int64)
        for at in range(0, len(hashes), 65536):
            part = remixed(hashes[at : at + 65536], family).astype(">u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big"))
    return out


#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), n_words: int = 3, families: int = 1) -> DataFrame:
    """The columns in `keep`, and fp, fp1, ... (a family's fingerprint as a signed long). Row by row, no shuffle."""
    names = _families(families)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), n_words, families) for t in batch["text"]], dtype=np.uint64).reshape(-1, families).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *(pa.array(found[:, k]) for k in range(families))], names=[*keep, *names])

    kinds = [f"`{c}` {t}" for c, t in docs.select(*keep).dtypes]
    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*kinds, *(f"{x} long" for x in names)]))


def _families(n: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, n))]


def _chains() -> list[tuple[int, tuple[int, ...]]]:
    """(first segment, segments that must be equal) of each key."""
    return [(i, (i % SEGMENTS, (i + 1) % SEGMENTS, (i + a) % SEGMENTS, (i + b) % SEGMENTS)) for i in range(SEGMENTS) for a, b in combinations((2, 3, 4), 2)]


def _keys() -> F.Column:
    """An array of each fingerprint's keys: the family's and chain's number above its 4 equal segments."""
    seg = lambda s: F.shiftrightunsigned(F.col("fp"), 8 * (SEGMENTS - 1 - s)).bitwiseAND(F.lit(255).cast("long"))
    out = []
    for n, (_, equal) in enumerate(_chains()):
        key = F.col("family").cast("long") * len(_chains()) + n
        for s in equal:
            key = F.shiftleft(key, 8).bitwiseOR(seg(s))
        out.append(key)
    return F.array(*out)


_WIDTH = BITS // SEGMENTS
#: masks[i][l - 1]: the first l segments from segment i on.
_MASKS = [[np.uint64(sum(((1 << _WIDTH) - 1) << (_WIDTH * (SEGMENTS - 1 - (i + j) % SEGMENTS)) for j in range(l))) for l in range(1, SEGMENTS + 1)] for i in range(SEGMENTS)]


def chain_holds(x: np.ndarray, first: int) -> np.ndarray:
    """Which XORs stay within the chain's budgets from segment `first` on; the last step is the full check."""
    ok = np.ones(x.shape, bool)
    for l in (2, 5, 6, 8):  # where l * 3 // 8 rises by the next step; the steps between follow from these
        budget = l * TAU // SEGMENTS
        ok &= np.bitwise_count(x & _MASKS[first][l - 1]) <= budget
    return ok


def stars(fps: np.ndarray, first: int, direct: bool = False) -> list[tuple[int, int]]:
    """(least member, member) of each connected part of the graph that one key's chain finds; with `direct`, as many pairs
    (member, member reached from it), each within 3 bits."""
    rest, out = fps.view(np.uint64), []
    while len(rest) > 1:
        part, tree, frontier, rest = [int(rest[0])], [], [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            hit = chain_holds(rest ^ at, first)
            if hit.any():
                new = rest[hit]
                rest = rest[~hit]
                frontier.extend(new)
                part.extend(map(int, new))
                if direct:
                    tree.extend((at, x) for x in new)
        if direct:
            out.extend(map(tuple, np.array(tree, np.uint64).reshape(-1, 2).view(np.int64).tolist()))
        elif len(part) > 1:
            part = np.array(part, np.uint64).view(np.int64)
            low = int(part.min())
            out.extend((low, int(x)) for x in part if x != low)
    return out


#: An edge: a, b and its family; or a member of a large key: a, null and the key.
_EDGES = "a long, b long, key long"


def _runs(most: int, direct: bool = False) -> object:
    """Streams (key, fp) sorted by key: the edges of each key, or its members if they are more than `most`."""
    chains = _chains()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, large = None, [], False
        n = 0

        def emit(a: list, b: list, k: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(k, pa.int64())], names=["a", "b", "key"])

        def finish() -> list[tuple]:
            if held_key is None or large or n < 2:
                return []
            fps = np.unique(np.concatenate(held))
            family, chain = divmod(held_key[0] >> 32, len(chains))
            return [(a, b, family) for a, b in stars(fps, chains[chain][0], direct)]

        for batch in batches:
            names = [c for c in batch.schema.names if c != "fp"]
            cols = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in names], axis=1)
            fps = batch["fp"].to_numpy(zero_copy_only=False)
            if not len(fps):
                continue
            cuts = np.flatnonzero((cols[1:] != cols[:-1]).any(axis=1)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fps)]])
            out: list[tuple] = []
            # runs of one row that neither continue the last key nor end the batch can't make a link
            alone = ends - starts == 1
            alone[0] = alone[-1] = False
            for s, e in zip(starts[~alone].tolist(), ends[~alone].tolist(), strict=True):
                key = tuple(cols[s].tolist())
                if key != held_key:
                    out.extend(finish())
                    held_key, held, large, n = key, [], False, 0
                n += e - s
                if large:
                    out.extend((x, None, key[0]) for x in fps[s:e].tolist())
                    continue
                held.append(fps[s:e])
                if n > most:
                    out.extend((x, None, key[0]) for part in held for x in part.tolist())
                    held, large = [], True
            if out:
                yield emit(*map(list, zip(*out, strict=True)))
        if last := finish():
            yield emit(*map(list, zip(*last, strict=True)))

    return run


def links(fps: DataFrame, bucket: int = BUCKET, direct: bool = False) -> DataFrame:
    """Edges (a, b, family) that connect all distinct fingerprints (fp, in families if there is such a column)
    within 3 bits of each other, transitively; with `direct`, each edge is itself within 3 bits."""
    family = F.col("family") if "family" in fps.columns else F.lit(0)
    keyed = fps.select("fp", family.alias("family")).select("fp", F.explode(_keys()).alias("key"))
    found = staged(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_runs(bucket, direct), _EDGES), "links")
    edges, members = found.where("b is not null"), found.where("b is null").select("key", F.col("a").alias("fp"))
    if not members.isEmpty():
        blocks = members.groupBy("key").agg(F.ceil(F.count("*") * 2 / F.lit(bucket)).cast("int").alias("n"))
        dealt = members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("key", F.least("block", "other").cast("long").alias("i"), F.greatest("block", "other").cast("long").alias("j"), "fp")
        edges = edges.unionAll(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_runs(1 << 30, direct), _EDGES))
    return edges.select("a", "b", F.col("key").alias("family"))


def _edges(prints: DataFrame, families: int) -> DataFrame:
    """Edges between first fingerprints that any family links: those with an equal fingerprint of it, and the
    least ones behind two linked fingerprints."""
    if families == 1:
        return links(prints.select("fp").distinct()).select("a", "b")
    every = F.array(*_families(families))
    views = staged(prints.select(*_families(families)).distinct().select(F.col("fp").alias("node"), F.posexplode(every).alias("family", "fp")).distinct(), "views")
    least = staged(views.groupBy("family", "fp").agg(F.min("node").alias("least")), "least")
    equal = views.join(least, ["family", "fp"]).where("least <> node").select(F.col("least").alias("a"), F.col("node").alias("b"))
    one, two = least.select("family", F.col("fp").alias("a"), F.col("least").alias("na")), least.select("family", F.col("fp").alias("b"), F.col("least").alias("nb"))
    return equal.unionAll(links(least.select("family", "fp")).join(one, ["family", "a"]).join(two, ["family", "b"]).select("na", "nb"))


def _grouped(docs: DataFrame, keep: tuple[str, ...], n_words: int, families: int) -> DataFrame:
    """The columns in `keep`, fp, and part: the least fingerprint reachable over links."""
    small_batches(docs.sparkSession)
    prints = staged(fingerprints(docs, keep, n_words, families), "fingerprints")
    parts = components(_edges(prints, families))
    return prints.select(*keep, "fp").join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(*keep, "fp", F.coalesce("component", "fp").alias("part"))


def near_duplicates(docs: DataFrame, n_words: int = 3, families: int = 1) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links)."""
    rows = staged(_grouped(docs, ("doc_id",), n_words, families), "groups")
    # staged, so that both sides of the join are plain exchanges and a large group's rows can be split
    least = staged(rows.groupBy("part").agg(F.min("doc_id").alias("component_id")), "least")
    return rows.join(least, "part").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, n_words: int = 3, families: int = 1) -> DataFrame:
    """`docs` with one row of each group of linked fingerprints (see `one_of_each`)."""
    return one_of_each(docs, lambda keyed, keep: _grouped(keyed, keep, n_words, families))


def one_of_each(docs: DataFrame, grouped: Callable[[DataFrame, tuple[str, ...]], DataFrame]) -> DataFrame:
    """`docs` with one row of each group, with all its columns, whatever their names: that of the least doc_id (null ids last;
    ties: the least hash of the text). A row is known by its doc_id and text; of rows that are equal in both, the one stays whose
    other columns are least."""
    # the columns of `docs` are kept in one struct, so that their names clash with none of these
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "doc_id", F.xxhash64("text").alias("_text"))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_text"))
    rows = staged(grouped(keyed, ("doc_id", "_text")), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("_text").alias("t")))
    each = staged(rows.groupBy("doc_id", "_text").agg(F.min("part").alias("part"), F.count("*").alias("n")), "each")
    firsts = staged(rows.groupBy("part").agg(first.alias("first")), "first")
    stays = F.col("first.d").eqNullSafe(F.col("doc_id")) & (F.col("first.t") == F.col("_text"))
    found = staged(each.join(firsts, "part").select("doc_id", "_text", "n", stays.alias("stays")), "kept")

    def only(df: DataFrame, which: DataFrame, how: str) -> DataFrame:
        # what goes grows with the table: never broadcast, so that the plan is the same at every size
        w = which.select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t")).hint("merge")
        return df.join(w, df["doc_id"].eqNullSafe(w["_d"]) & (df["_text"] == w["_t"]), how)

    kept = only(held, found.where("not stays"), "left_anti")
    again = found.where("stays and n > 1")
    if again.isEmpty():
        return kept.select("doc.*")
    once = only(kept, again, "left_semi").groupBy("doc_id", "_text").agg(F.min("doc").alias("doc"))
    return only(kept, again, "left_anti").select("doc").unionAll(once.select("doc")).select("doc.*")
