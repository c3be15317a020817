"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A block is one occurrence of a document in the mix. Each source's blocks are its documents in a
hashed permutation, repeated for whole passes, then a partial pass that ends where the target is
reached: of its last document only the words that the target still needs are taken. The exact block quotas of all
sources are split among output shards by a binary tree: at each node the left half's share is a
multivariate hypergeometric draw from the node's quotas, as if its blocks were dealt from a shuffled
deck. A leaf's quotas become disjoint runs of each source's permuted blocks; inside a shard a hashed
key gives the local order. What a document gives to the mix is the sum of its blocks in the shards.

The driver holds one row a source and shard (`max_sources` bounds them; more raise an error, none is dropped).
Null text: no words. A null source is a source of its own, the last in order. Documents without
words occur in whole passes and take nothing. Very long texts count whole. Repeated rows are documents of their own; where a
run ends between rows of equal doc_id and text, it may be any of them (they are alike). Equal shuffle keys: by block. Other
columns are carried by `repeat` and not read. An empty table gives an empty mix. Equal seeds give equal mixes.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import WORD, staged

#: Documents of a cell of the permutation, and the most cells of a source.
CELL_ROWS, MOST_CELLS = 512, 4096
#: Blocks of a cell of a shard's local order, and the most bits of such a cell.
CELL_BLOCKS, MOST_CELL_BITS = 1024, 14
#: numpy draws hypergeometric numbers from fewer than this many blocks.
MOST_BLOCKS = 500_000_000


def weights_by_order(n: int, cycle: tuple[int, ...] = (5, 2, 1)) -> list[float]:
    return [float(cycle[i % len(cycle)]) for i in range(n)]


def fill_targets(sizes: list[int], weights: list[float], most_repeats: int = 3) -> list[float]:
    """Shares of the sum of all sizes by weight; a source stops at `most_repeats` times its size and
    the excess goes to the others by weight, until none is above."""
    total = float(sum(sizes))
    caps = [float(most_repeats * s) for s in sizes]
    held: set[int] = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in held]
        rest, weight = total - sum(caps[i] for i in held), sum(weights[i] for i in free)
        shares = {i: rest * weights[i] / weight for i in free}
        over = {i for i in free if shares[i] > caps[i]}
        if not over:
            return [caps[i] if i in held else shares[i] for i in range(len(sizes))]
        held |= over


def splitting_tree(quotas: list[int], shards: int, rng: np.random.Generator) -> np.ndarray:
    """[shards, sources] block counts whose columns sum to the quotas."""
    quotas = np.asarray(quotas, dtype=np.int64)
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    total = int(quotas.sum())
    drawn = rng.multivariate_hypergeometric(quotas, total * left // shards, method="marginals") if total else quotas
    return np.concatenate([splitting_tree(drawn, left, rng), splitting_tree(quotas - drawn, shards - left, rng)])


def keyed(docs: DataFrame, seed: int) -> DataFrame:
    """`docs` with what decides its place in a permutation; computed alike wherever it is needed."""
    return docs.withColumn("_mix_key", F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text")))


class Mix:
    """The plan of a mix: a bounded table with one row a source, and the ranked documents."""

    def __init__(self, docs: DataFrame, shards: int = 16, most_repeats: int = 3, seed: int = 7, max_sources: int = 10_000):
        self.spark, self.seed, self.shards = docs.sparkSession, seed, shards
        rows = keyed(docs.select("doc_id", "text", "source"), seed).select(
            "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), "_mix_key")
        rows = staged(rows, "mix-sizes")
        found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(max_sources + 1).collect()
        if len(found) > max_sources:
            raise ValueError(f"more than {max_sources} sources")
        found.sort(key=lambda r: (r.source is None, r.source or ""))
        targets = fill_targets([r.size for r in found], weights_by_order(len(found)), most_repeats) if found else []
        self.sources = []
        for r, target in zip(found, targets, strict=True):
            passes = min(most_repeats, math.floor(target / r.size)) if r.size else 0
            self.sources.append({"source": r.source, "source_size": r.size, "n_docs": r.n, "target": target, "passes": passes,
                                 "rest": round(target - passes * r.size) if passes < most_repeats else 0, "cells": max(1, min(MOST_CELLS, r.n // CELL_ROWS))})
        self._rank(rows)
        self._fill()
        self._split()

    def _table(self, *names: str) -> DataFrame:
        kinds = {"source": "string", "target": "double", "starts": "array<long>"}
        schema = ", ".join(f"`_p_{x}` {kinds.get(x, 'long')}" for x in names)
        return F.broadcast(self.spark.createDataFrame([tuple(s[x] for x in names) for s in self.sources], schema))

    def _with(self, rows: DataFrame, *names: str) -> DataFrame:
        plan = self._table("source", *names)
        return rows.join(plan, rows["source"].eqNullSafe(plan["_p_source"])).drop("_p_source")

    def _rank(self, rows: DataFrame) -> None:
        """rank (from 0) and upto (words up to and with it) in each source's permutation, by cells."""
        rows = self._with(rows, "cells").withColumn("cell", F.pmod("_mix_key", F.col("_p_cells"))).drop("_p_cells")
        sums = rows.groupBy("source", "cell").agg(F.sum("size").alias("w"), F.count("*").alias("n"))
        before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        first = sums.select(F.col("source").alias("_s"), F.col("cell").alias("_c"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("_w"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"))
        here = Window.partitionBy("source", "cell").orderBy("_mix_key", "doc_id")
        ranked = rows.withColumn("rank", F.row_number().over(here) - 1).withColumn("upto", F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0)))
        ranked = ranked.join(first, F.col("source").eqNullSafe(F.col("_s")) & (F.col("cell") == F.col("_c")))
        self.ranked = staged(ranked.select("doc_id", "source", "size", "_mix_key", "cell", (F.col("rank") + F.col("_n")).alias("rank"), (F.col("upto") + F.col("_w")).alias("upto")), "mix-ranked")

    def _fill(self) -> None:
        """Documents that a partial pass takes whole, and the words it takes of the next one."""
        inside = F.col("upto") <= F.col("_p_rest")
        got = {r.source: r for r in self._with(self.ranked, "rest").groupBy("source").agg(
            F.sum(F.when(inside, F.col("size"))).alias("words"), F.count(F.when(inside, 1)).alias("n")).collect()}
        for s in self.sources:
            r = got.get(s["source"])
            s["partial"], s["gap"] = (r.n, s["rest"] - (r.words or 0)) if s["rest"] > 0 else (0, 0)
            s["quota"] = s["passes"] * s["n_docs"] + s["partial"] + (s["gap"] > 0)

    def _split(self) -> None:
        total = sum(s["quota"] for s in self.sources)
        self.run = max(1, -(-total // MOST_BLOCKS))  # blocks drawn together
        leaves = splitting_tree([-(-s["quota"] // self.run) for s in self.sources], self.shards, np.random.default_rng(self.seed)) if self.sources else np.zeros((self.shards, 0), np.int64)
        starts = np.cumsum(leaves, axis=0) - leaves
        for i, s in enumerate(self.sources):
            s["starts"] = starts[:, i].tolist()

    def _drawn(self) -> DataFrame:
        """Each document with `draws`: an array of (pass, block, words, shard, shuffle_key), at most one more than passes."""
        rows = self._with(self.ranked, "source_size", "target", "passes", "n_docs", "partial", "gap", "starts")
        none = F.array().cast("array<bigint>")
        passes = F.when(F.col("_p_passes") > 0, F.sequence(F.lit(0).cast("long"), F.col("_p_passes") - 1)).otherwise(none)
        last = (F.col("rank") < F.col("_p_partial")) | ((F.col("rank") == F.col("_p_partial")) & (F.col("_p_gap") > 0))
        passes = F.concat(passes, F.when(last, F.array(F.col("_p_passes"))).otherwise(none))

        def draw(p: F.Column) -> F.Column:
            block = p * F.col("_p_n_docs") + F.col("rank")
            cut = (p == F.col("_p_passes")) & (F.col("rank") == F.col("_p_partial"))
            shard = F.size(F.filter("_p_starts", lambda x: x <= F.floor(block / self.run))) - 1
            return F.struct(p.alias("pass"), block.alias("block"), F.when(cut, F.col("_p_gap")).otherwise(F.col("size")).alias("words"), shard.alias("shard"), self._shuffle_key(p).alias("shuffle_key"))

        return rows.select("doc_id", "source", "rank", "size", F.col("_p_source_size").alias("source_size"), F.col("_p_target").alias("target"), F.transform(passes, draw).alias("draws"))

    def _shuffle_key(self, p: F.Column) -> F.Column:
        return F.xxhash64(F.lit(self.seed + 1), "doc_id", "_mix_key", p)

    def _cell(self, key: F.Column) -> F.Column:
        """A run of the local order: the key's first bits."""
        blocks = sum(s["quota"] for s in self.sources) // self.shards
        return F.shiftright(key, 64 - max(1, min(MOST_CELL_BITS, (blocks // CELL_BLOCKS).bit_length())))

    def occurrences(self) -> DataFrame:
        """One row a block: doc_id, source, rank, pass, block, words, shard, shuffle_key, place (from 0, its place in
        the shard's local shuffle). Places are numbered in cells of the key, so no shard is one task's work."""
        rows = self._drawn().select("doc_id", "source", "rank", F.inline("draws")).withColumn("cell", self._cell(F.col("shuffle_key")))
        rows = staged(rows, "mix-blocks")
        counts = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))  # shards << MOST_CELL_BITS rows at most
        before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        here = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("shuffle_key", "source", "block")) - 1
        first = counts.select("shard", "cell", before.alias("first"))
        return rows.withColumn("here", here).join(first, ["shard", "cell"]).select(
            "doc_id", "source", "rank", "pass", "block", "words", "shard", "shuffle_key", (F.col("first") + F.col("here")).alias("place"))

    def documents(self) -> DataFrame:
        """doc_id, source, size, source_size, target, taken (words that all its blocks bring into the shards), and the
        blocks' shards and places (arrays, in order of the passes)."""
        blocks = self.occurrences().groupBy("source", "rank").agg(
            F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("pass", "shard", "place"))).alias("blocks"))  # one row a pass
        blocks = blocks.select(F.col("source").alias("_s"), F.col("rank").alias("_r"), "taken", "blocks")
        rows = self._with(self.ranked, "source_size", "target")
        rows = rows.join(blocks, rows["source"].eqNullSafe(blocks["_s"]) & (rows["rank"] == blocks["_r"]), "left")
        none = F.array()
        return rows.select("doc_id", "source", "size", F.col("_p_source_size").alias("source_size"), F.col("_p_target").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
                           F.coalesce("blocks.shard", none.cast("array<int>")).alias("shards"), F.coalesce("blocks.place", none.cast("array<long>")).alias("places"))

    def repeat(self, docs: DataFrame) -> DataFrame:
        """Rows of `docs` as often as the mix takes them, with their columns: 0 to most_repeats times; the document
        of which only a part is taken counts if that is half of it. Rows come by shard, in the shard's local shuffle (a partition
        holds whole cells of it). A row's passes and shards follow from its hash and the places in its source's permutation
        where the tree cuts, so the text is shuffled once, to its shard."""
        cuts = []
        for s in self.sources:
            edge = s["partial"] if s["gap"] > 0 else s["partial"] - 1
            blocks = [x * self.run for x in s["starts"]]
            cuts.append({"source": s["source"], "at": sorted({b % s["n_docs"] for b in blocks if s["n_docs"]} | ({edge, edge - 1} if s["rest"] > 0 else set()))})
        place = "struct<cell:bigint,_mix_key:bigint,doc_id:bigint>"
        wanted = F.broadcast(self.spark.createDataFrame([(c["source"], x) for c in cuts for x in c["at"] if x >= 0], "_s string, _at long"))  # max_sources * (shards + 2) rows at most
        here = self.ranked.join(wanted, self.ranked["source"].eqNullSafe(wanted["_s"]) & (self.ranked["rank"] == wanted["_at"]))
        at = {(r.source, r.rank): r for r in here.select("source", "rank", "size", F.struct("cell", "_mix_key", "doc_id").alias("place")).collect()}
        table = []
        for s in self.sources:
            last = at.get((s["source"], s["partial"]))
            if not (s["gap"] > 0 and last and 2 * s["gap"] >= last["size"]):
                last = at.get((s["source"], s["partial"] - 1)) if s["rest"] > 0 else None
            begins = [(b // s["n_docs"], at[s["source"], b % s["n_docs"]].place) for b in (x * self.run for x in s["starts"]) if (s["source"], b % s["n_docs"]) in at]
            table.append((s["source"], s["passes"], s["cells"], last and last.place, begins))
        plan = F.broadcast(self.spark.createDataFrame(table, f"_p_source string, _p_passes long, _p_cells long, _p_edge {place}, _p_begins array<struct<pass:bigint,place:{place}>>"))
        # the columns of `docs` are kept in one struct, so that their names clash with none of these
        rows = keyed(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "doc_id", "text", "source"), self.seed)
        rows = rows.join(plan, rows["source"].eqNullSafe(plan["_p_source"]))
        here = F.struct(F.pmod("_mix_key", F.col("_p_cells")).alias("cell"), F.col("_mix_key"), F.col("doc_id").cast("long").alias("doc_id"))
        rows = rows.withColumn("place", here).withColumn("times", F.col("_p_passes") + F.coalesce(F.col("place") <= F.col("_p_edge"), F.lit(False)).cast("long"))
        rows = rows.where("times > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
        begun = F.filter("_p_begins", lambda b: b <= F.struct("pass", "place"))
        rows = rows.select("doc", (F.greatest(F.size(begun), F.lit(1)) - 1).alias("shard"), self._shuffle_key(F.col("pass")).alias("key"))
        rows = rows.withColumn("cell", self._cell(F.col("key"))).repartition("shard", "cell").sortWithinPartitions("shard", "key")
        return rows.select("doc.*")
