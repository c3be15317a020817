"""Sharding: minimax contiguous partition of documents into shards, by binary search and greedy checks.

Documents with equal text are one atomic group. Groups are ordered by the 64-bit hash of their text;
a shard is a contiguous run of that order. The smallest capacity for which a greedy left-to-right
filling needs no more than `n_shards` runs is found exactly, without sorting or collecting groups:
the driver sees sums over hash ranges (cells), a few thousand at first, and asks for finer cells only
where a cut may fall. Treating an unresolved cell as divisible gives a lower bound of the capacity,
treating it as atomic an upper bound; cells are refined until both meet.

Everything on the data path is DataFrame expressions. Null text: no bytes, a group of its own. An
empty table gives an empty result. Fewer groups than shards: the last shards stay empty. Two texts
whose hashes collide count as one group, which keeps equal texts together all the same.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import staged

#: Bits of the group hash in the first cells, and further bits in each refinement.
FIRST_BITS, MORE_BITS = 12, 8
#: Cells refined at once; more are left to the next round.
REFINED_AT_ONCE = 1024
#: Rows of a cell of slots, and the most cells of a shard.
SLOT_ROWS, MOST_SLOT_CELLS = 200_000, 4096


class Cells:
    """Ordered cells (lowest hash, bytes, atomic?) and greedy fillings of them."""

    def __init__(self, cells: list[tuple[int, int, bool]]):
        self.cells = sorted(cells)
        self.ends = [0, *accumulate(c[1] for c in self.cells)]
        self.total = self.ends[-1]

    def atomic_reach(self, capacity: int, shards: int) -> list[int]:
        """Bytes in front of each cut when no cell may be split."""
        at, out = 0, []
        for _ in range(shards):
            at = bisect_right(self.ends, self.ends[at] + capacity) - 1
            out.append(self.ends[at])
        return out

    def divided_reach(self, capacity: int, shards: int) -> list[int]:
        """The same when cells of several groups may be split anywhere: never less than what is possible."""
        x, out = 0, []
        for _ in range(shards):
            y = min(x + capacity, self.total)
            k = bisect_right(self.ends, y) - 1
            if k < len(self.cells) and self.cells[k][2] and self.ends[k] < y:
                y = max(x, self.ends[k])
            x = y
            out.append(x)
        return out

    def smallest(self, reach, shards: int) -> int:
        low, high = -(-self.total // shards), max(self.total, 1)
        while low < high:
            mid = (low + high) // 2
            if reach(mid, shards)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def touched(self, low: int, high: int, shards: int) -> list[int]:
        """Indexes of the divisible cells in which a cut of the best filling may fall."""
        out: dict[int, None] = {}
        for x in self.divided_reach(low, shards):  # at least these
            k = bisect_right(self.ends, x) - 1
            if k < len(self.cells) and not self.cells[k][2] and self.ends[k] < x:
                out[k] = None
        for a, b in zip(self.atomic_reach(low, shards), self.divided_reach(high, shards), strict=True):
            for k in range(bisect_right(self.ends, a) - 1, min(bisect_left(self.ends, b), len(self.cells))):
                if not self.cells[k][2]:
                    out[k] = None
                if len(out) >= REFINED_AT_ONCE:
                    return list(out)
        return list(out)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size (bytes plus 1), text_crc32 and the group's hash."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64("text").alias("grp"))


def _cells(rows: DataFrame, bits: int, within: list[int] | None, parent_bits: int) -> list[tuple]:
    if within is not None:
        rows = rows.where(F.shiftright("grp", 64 - parent_bits).isin(within) if parent_bits < 64 else F.col("grp").isin(within))
    cell = F.shiftright("grp", 64 - bits) if bits < 64 else F.col("grp")
    found = rows.groupBy(cell.alias("cell")).agg(F.sum("size").alias("bytes"), F.min("grp").alias("low"), F.max("grp").alias("high"), F.count("*").alias("n"))
    return [(r.low, r.bytes, r.low == r.high, r.cell, bits, r.n) for r in found.collect()]


def minimax_cuts(rows: DataFrame, n_shards: int) -> tuple[int, list[int], int]:
    """The smallest feasible capacity, the lowest hash of each shard but the first, and the row count.
    `rows` has grp and size; it is read once a round."""
    known = {c[0]: c for c in _cells(rows, FIRST_BITS, None, 0)}
    n = sum(c[5] for c in known.values())
    while True:
        skeleton = Cells([c[:3] for c in known.values()])
        low, high = skeleton.smallest(skeleton.divided_reach, n_shards), skeleton.smallest(skeleton.atomic_reach, n_shards)
        if low == high or not known:
            break
        chosen = [known[skeleton.cells[k][0]] for k in skeleton.touched(low, high, n_shards)]
        for bits in {c[4] for c in chosen}:
            mine = [c for c in chosen if c[4] == bits]
            for c in mine:
                del known[c[0]]
            known |= {c[0]: c for c in _cells(rows, min(64, bits + MORE_BITS), [c[3] for c in mine], bits)}
    cuts = []
    for x in skeleton.atomic_reach(high, n_shards)[:-1]:
        k = bisect_left(skeleton.ends, x)
        if k < len(skeleton.cells):
            cuts.append(skeleton.cells[k][0])
    return high, cuts, n


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: every document once, groups whole, the largest shard as
    small as an ordered partition allows, slots gapless in each shard.

    The text is read in one pass; what follows reads a staged table of 28 bytes a document. Slots are
    numbered in cells of hashed ids, so that neither a shard nor a group is one task's work."""
    rows = staged(sizes(docs), "shard-sizes")
    _, cuts, n = minimax_cuts(rows, n_shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("grp") >= F.lit(cut)).cast("int")
    cells = max(64, min(MOST_SLOT_CELLS, n // SLOT_ROWS // n_shards))
    placed = rows.withColumn("shard", shard).withColumn("cell", F.pmod(F.xxhash64("doc_id", "grp"), F.lit(cells)))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))  # n_shards * cells rows at most
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("shard", "cell", before.alias("first"))
    here = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "grp"))
    return placed.withColumn("here", here).join(F.broadcast(first), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("here") - 1).alias("slot"))
