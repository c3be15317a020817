"""Exact top-k inner products of quantised vectors with a bit-sliced index.

Components become integers floor(256 * x). Rows are dealt by hash into blocks; in a block each component is
stored as bit slices: bitmaps over the rows, of the high bits of component - minimum. A query's weights are
rounded to a few signed binary digits, and the score of all rows is summed as bitmaps, slice by slice, with
carry-save adders (a negative digit adds the complement). The k-th best approximate score is found from the
most significant slice down. The rounding errors have a proven bound (Cauchy-Schwarz over the residuals), so
all rows that could be among the best are those within twice the bound: these boundary rows are selected by
one more comparison from the most significant slice down, and resolved by exact integer products.

A block's index is built once; the queries of the whole table are streamed past it, and a block sends k rows a query.

The result is exact; ties go to the smaller vec_id. Null ids or vectors, null or non-finite components, and vectors
that are not as long as most: no part. Scores must fit in a long. Fewer candidates than k: all of them. Rows with the
same vec_id are candidates each, none of them for a query of that id, and ask once (the least vector). Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import staged
from quire.llm.vectors import asked, blocks_meet, dealt, matrix, valid_vectors

#: Rows of a block, and the least number of blocks (for parallel work on small tables).
ROWS, LEAST_BLOCKS = 16384, 12
#: Most bit slices of a component and most bits of a query weight.
SLICES, WEIGHT_BITS = 9, 6


def signed_digits(x: int) -> list[tuple[int, int]]:
    """Non-adjacent form: (position, +1 or -1) of each digit."""
    out, at = [], 0
    while x:
        if x & 1:
            d = 2 - (x & 3)
            out.append((at, d))
            x -= d
        x >>= 1
        at += 1
    return out


#: Digits of every rounded weight: (weight's place in a query, position, 1 if negative) are looked up here.
DIGITS = {w: signed_digits(w) for w in range(-(1 << WEIGHT_BITS), (1 << WEIGHT_BITS) + 1)}


class BitSliced:
    def __init__(self, ids: np.ndarray, values: np.ndarray):
        """values: [rows, components] integers; rows in ascending order of id."""
        self.ids, self.values = ids, values
        self.n, self.width = values.shape
        self.low = values.min(axis=0)
        span = int((values.max(axis=0) - self.low).max())
        self.shift = max(0, span.bit_length() - SLICES)
        self.bits = max(1, (span >> self.shift).bit_length())
        high = (values - self.low) >> self.shift
        rest = values - self.low - (high << self.shift) - ((1 << self.shift) - 1) / 2
        self.rest_norm = float(np.sqrt((rest**2).sum(axis=1).max()))
        self.norm = float(np.sqrt(((values - values.mean(axis=0)) ** 2).sum(axis=1).max()))
        pad = -self.n % 64
        self.every = self._bitmap(np.ones(self.n, bool), pad)
        self.none = np.zeros_like(self.every)
        slices = np.stack([self._bitmap((high[:, d] >> b) & 1 == 1, pad) for d in range(self.width) for b in range(self.bits)])
        #: [2 * components * bits, words]: the slices, then their complements
        self.slices = np.concatenate([slices, self.every & ~slices])

    @staticmethod
    def _bitmap(rows: np.ndarray, pad: int) -> np.ndarray:
        return np.packbits(np.concatenate([rows, np.zeros(pad, bool)]), bitorder="little").view(np.uint64)

    def sums(self, weights: list[int]) -> list[np.ndarray]:
        """Slices of the approximate score, lowest first: all bitmaps of one binary position are added together, three
        at a time, by carry-save adders; their carries go to the next position."""
        digits = np.array([(at, d + self.width * (sign < 0)) for d, w in enumerate(weights) for at, sign in DIGITS[w]], np.int64).reshape(-1, 2)
        place = (digits[:, :1] + np.arange(self.bits)).reshape(-1)
        which = (digits[:, 1:] * self.bits + np.arange(self.bits)).reshape(-1)
        out, carries, at, last = [], [], 0, int(place.max(initial=-1))
        while at <= last or carries:
            column = np.concatenate([self.slices[which[place == at]], *carries])
            carries = []
            while len(column) > 2:
                third = len(column) // 3
                a, b, c = column[:third], column[third : 2 * third], column[2 * third : 3 * third]
                x = a ^ b
                carries.append((a & b) | (x & c))
                column = np.concatenate([x ^ c, column[3 * third :]])
            if len(column) == 2:
                carries.append((column[0] & column[1])[None])
                column = column[:1] ^ column[1:]
            out.append(column[0] if len(column) else self.none)
            at += 1
        return out

    def at_least(self, sums: list[np.ndarray], bound: int) -> np.ndarray:
        """Bitmap of the rows whose sum is `bound` or more."""
        if bound <= 0:
            return self.every
        if bound.bit_length() > len(sums):
            return self.none
        more, equal = self.none, self.every
        for b in range(len(sums) - 1, -1, -1):
            if bound >> b & 1:
                equal = equal & sums[b]
            else:
                more, equal = more | (equal & sums[b]), equal & ~sums[b]
        return more | equal

    def kth(self, sums: list[np.ndarray], k: int) -> int:
        """The k-th largest sum, from the most significant slice down."""
        value, above, equal = 0, 0, self.every
        for b in range(len(sums) - 1, -1, -1):
            ones = equal & sums[b]
            n = int(np.bitwise_count(ones).sum())
            if above + n >= k:
                value, equal = value | (1 << b), ones
            else:
                above, equal = above + n, equal & ~sums[b]
        return value

    def boundary(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that can be among the k best."""
        most = int(np.abs(query).max(initial=0))
        shift = max(0, most.bit_length() - WEIGHT_BITS)
        weights = (query + (1 << shift >> 1)) >> shift
        sums = self.sums(weights.tolist())
        scale = 1 << (shift + self.shift)
        slack = float(np.sqrt(((weights << shift).astype(float) ** 2).sum())) * self.rest_norm + float(np.sqrt(((query - (weights << shift)).astype(float) ** 2).sum())) * self.norm
        bound = self.kth(sums, min(self.n, k)) - int(2 * slack * (1 + 1e-9) / scale) - 1
        chosen = self.at_least(sums, bound)
        words = np.flatnonzero(chosen)
        bits = np.unpackbits(chosen[words].view(np.uint8), bitorder="little").reshape(len(words), 64)
        word, bit = np.nonzero(bits)
        return words[word] * 64 + bit

    def top(self, query: np.ndarray, own: int | None, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows, own id left out, best first."""
        copies = 0 if own is None else int(np.searchsorted(self.ids, own, "right") - np.searchsorted(self.ids, own))
        chosen = self.boundary(query, k + copies)
        scores, ids = self.values[chosen] @ query, self.ids[chosen]
        if copies:
            keep = ids != own
            scores, ids = scores[keep], ids[keep]
        order = np.lexsort((ids, -scores))[:k]
        return list(zip(scores[order].tolist(), ids[order].tolist(), strict=True))


def top_inner_products(table: DataFrame, query_every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id `query_every` divides, the k best of all other rows."""
    rows = staged(valid_vectors(table, nonzero=False).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v")), "quantised")
    blocks = max(LEAST_BLOCKS, -(-rows.count() // ROWS))
    none = F.lit(0).cast("long").alias("row"), F.lit(None).cast("binary").alias("extra")
    left = rows.select(dealt(1, blocks).alias("block"), F.col("vec_id").alias("id"), "v", *none)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    right = asked(rows, query_every).select("query_id", "q", every).select("block", F.col("query_id").alias("id"), F.col("q").alias("v"), *none)

    def build(mine: pa.Table) -> BitSliced:
        return BitSliced(mine["id"].to_numpy(), matrix(mine["v"]))

    def answer(index: BitSliced, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = [(own, i, s) for own, q in zip(queries["id"].to_pylist(), matrix(queries["v"]), strict=True) for s, i in index.top(q, own, k)]
        found = np.array(out, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, c]) for c in range(3)], names=["query_id", "vec_id", "score"])

    found = blocks_meet(left, right, blocks, build, answer, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
