"""Approximate nearest neighbours: inverted lists of coarse centroids, product-quantised residuals,
asymmetric distance tables, exact reranking.

Centroids and codebooks are fitted by k-means on a bounded sample (`SAMPLE` rows of least hash, a documented
bound); every row is indexed. There are about as many lists as the square root of the rows, `MOST_LISTS` at most. A row
goes to the list of its nearest centroid, and its residual is coded in `PARTS` bytes. A query probes the nearest
lists: as many as hold `COVER` of the true neighbours of sample queries within the sample.

With centroid c and decoded residual r, the squared distance of q is |q - c|^2 + (|r|^2 + 2 c r) - 2 q r: the middle
term is kept with the row, and q r is a sum over one asymmetric table [parts, codes] of the query, the same for all lists.
Over all its lists a query keeps the `SHORT` rows that are nearest by it (ties: smaller id); only
these are ranked anew, by exact Euclidean distances in double precision.

Lists are put together into blocks of at most `BLOCK` rows, or cut into several by hash. A block's rows are shuffled once
and held; the queries that probe its lists are streamed past it. `COVER = 1` probes every list, and `short` not below the number of
rows ranks all rows exactly: together they give the exact result.

Null ids or vectors, null or non-finite components, zero vectors, and vectors that are not as long as most: no part. Fewer
candidates than k: all (a small table has one list). Rows with the same vec_id are candidates each, none of them for a query of
that id, and ask once (the least vector). Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import staged
from quire.llm.vectors import asked, blocks_meet, matrix, valid_vectors

SAMPLE, MOST_LISTS, PARTS, CODES = 65536, 2048, 32, 256
COVER, SHORT = 0.985, 96
#: Rows of a block, the least number of blocks (for parallel work on small tables), and queries that meet a block at once.
BLOCK, LEAST_BLOCKS, QUERIES = 8192, 12, 256
#: Copies of queries that are sent at once.
SENT = 4096


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[rows of a, rows of b] squared distances."""
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :], 0)


def nearest(x: np.ndarray, centers: np.ndarray, step: int = 4096) -> np.ndarray:
    """The nearest center of each row."""
    norms = (centers * centers).sum(axis=1)
    return np.concatenate([(norms - 2 * (x[at : at + step] @ centers.T)).argmin(axis=1) for at in range(0, max(1, len(x)), step)])


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centers)
        counts, order = np.bincount(own, minlength=len(centers)), np.argsort(own, kind="stable")
        full = counts > 0
        centers[full] = np.add.reduceat(x[order], (np.cumsum(counts) - counts)[full], axis=0) / counts[full, None]
        centers[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centers


@dataclass
class Index:
    centers: np.ndarray  # [lists, d]
    books: np.ndarray  # [parts, codes, d / parts], d padded with zeros
    probes: int

    def cut(self, x: np.ndarray) -> np.ndarray:
        """[rows, parts, width]"""
        parts, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of each row."""
        lists = nearest(x, self.centers)
        cut = self.cut(x - self.centers[lists])
        codes = np.stack([nearest(cut[:, p], self.books[p]) for p in range(len(self.books))], axis=1)
        return lists, codes.astype(np.uint8)

    def row_terms(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """|r|^2 + 2 c r of each row."""
        c = self.cut(self.centers)
        out = np.zeros(len(lists), np.float32)
        for p, book in enumerate(self.books):
            r = book[codes[:, p]]
            out += (r * (r + 2 * c[lists, p])).sum(axis=1)
        return out

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """[parts, codes, queries]: inner products of the queries' parts with all codewords."""
        return np.einsum("pcw,qpw->pcq", self.books, self.cut(queries), optimize=True)

    def probed(self, queries: np.ndarray) -> np.ndarray:
        """[queries, probes] the nearest lists."""
        return np.argsort(squared(queries, self.centers), axis=1, kind="stable")[:, : self.probes]


def fit(x: np.ndarray, n_rows: int, k: int, seed: int = 5, cover: float = COVER) -> Index:
    """Fit on a sample of `n_rows` rows."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    lists = max(1, min(MOST_LISTS, len(x) // 32, round(math.sqrt(n_rows))))
    centers = k_means(x, lists, rng)
    parts = min(PARTS, x.shape[1])
    width = -(-x.shape[1] // parts)
    index = Index(centers, np.zeros((parts, 1, width), np.float32), 1)
    own = nearest(x, centers)
    some = np.sort(rng.choice(len(x), min(len(x), 64 * CODES), replace=False))
    cut = index.cut(x[some] - centers[own[some]])
    index.books = np.stack([k_means(np.ascontiguousarray(cut[:, p]), min(CODES, len(cut)), rng, 8) for p in range(parts)])
    # the lists in which the true neighbours of sample queries are, by how near the list is to the query
    asked = x[rng.choice(len(x), min(256, len(x)), replace=False)]
    far = squared(asked, x)
    place = np.argsort(np.argsort(squared(asked, centers), axis=1), axis=1)
    near = np.argpartition(far, min(k, len(x) - 1), axis=1)[:, : k + 1]
    index.probes = min(len(centers), int(np.quantile(np.take_along_axis(place, own[near], axis=1), cover)) + 1)
    # and never so few that the smallest lists hold less than k other rows of the sample
    smallest = np.cumsum(np.sort(np.bincount(own, minlength=len(centers))))
    index.probes = max(index.probes, min(len(centers), int(np.searchsorted(smallest, k + 1)) + 1))
    return index


def chained(centers: np.ndarray) -> list[int]:
    """The lists in an order in which near ones follow each other."""
    left, order = set(range(1, len(centers))), [0]
    while left:
        rest = np.fromiter(left, np.int64)
        order.append(int(rest[((centers[rest] - centers[order[-1]]) ** 2).sum(axis=1).argmin()]))
        left.remove(order[-1])
    return order


def deal_blocks(counts: dict[int, int], centers: np.ndarray) -> tuple[list[int], list[int], int]:
    """The first block and the number of blocks of each list, and the number of all blocks."""
    most = max(1, min(BLOCK, -(-sum(counts.values()) // LEAST_BLOCKS)))
    first, pieces, block, room = [0] * len(centers), [1] * len(centers), -1, 0
    for at in chained(centers):
        n = counts.get(at, 0)
        if n > most:
            pieces[at] = -(-n // most)
            first[at], block, room = block + 1, block + pieces[at], 0
        else:
            if n > room or block < 0:
                block, room = block + 1, most
            first[at], room = block, room - n
    return first, pieces, block + 1


class Block:
    """The rows of a block, in order of id."""

    def __init__(self, index: Index, ids: np.ndarray, rows: np.ndarray, codes: np.ndarray, lists: np.ndarray):
        self.index, self.ids, self.rows, self.codes = index, ids, rows, codes
        self.lists, self.of = np.unique(lists, return_inverse=True)
        self.terms = index.row_terms(lists, codes)

    def shortlist(self, q_ids: np.ndarray, queries: np.ndarray, probed: list[np.ndarray], short: int) -> tuple[np.ndarray, ...]:
        """(query, row's number, id, approximate squared distance) of each query's best rows of its lists."""
        tables, base = self.index.tables(queries), squared(queries, self.index.centers[self.lists])
        for i, mine in enumerate(probed):
            base[i, ~np.isin(self.lists, mine)] = np.inf
        far = np.zeros((len(self.ids), len(queries)), np.float32)
        for p in range(len(tables)):
            far += tables[p][self.codes[:, p]]
        far = base[:, self.of] + self.terms - 2 * far.T
        far[q_ids[:, None] == self.ids[None, :]] = np.inf
        if len(self.ids) > short:
            edge = np.partition(far, short - 1, axis=1)[:, short - 1 : short]
            below, equal = far < edge, far == edge
            keep = below | (equal & (np.cumsum(equal, axis=1) <= short - below.sum(axis=1, keepdims=True)))
            keep &= np.isfinite(far)
        else:
            keep = np.isfinite(far)
        q, row = np.nonzero(keep)
        return q_ids[q], self.rows[row], self.ids[row], far[q, row]


def search(table: DataFrame, query_every: int = 100, k: int = 10, short: int = SHORT, cover: float = COVER) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id `query_every` divides, the k nearest found among all others."""
    spark = table.sparkSession
    rows = staged(valid_vectors(table, nonzero=True).select("vec_id", F.col("embedding").alias("v"), F.monotonically_increasing_id().alias("row")), "vectors")
    n = rows.count()
    # the hash thins the table before it is sorted
    thin = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(4)), F.lit(1 << 30)) < F.lit(min(1 << 30, (SAMPLE * 5 // 4 << 30) // max(1, n))))
    sample = thin.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id", "row").limit(SAMPLE).select("v").toArrow()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(matrix(sample["v"]), n, k, cover=cover)
    shared = spark.sparkContext.broadcast(index)  # MOST_LISTS centroids and PARTS * CODES codewords at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists, codes = shared.value.encode(matrix(batch["v"]).astype(np.float32))
                coded = [a + c.tobytes() for a, c in zip(map(bytes, lists.astype("<i4").view(np.uint8).reshape(-1, 4)), codes, strict=True)]
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["row"], pa.array(lists, pa.int32()), pa.array(coded, pa.binary())], names=["vec_id", "row", "list", "coded"])

    kind = dict(rows.dtypes)["v"]
    placed = staged(rows.mapInArrow(place, "vec_id long, row long, list int, coded binary"), "lists")
    counts = {r.list: r.n for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # MOST_LISTS rows at most
    first, pieces, blocks = deal_blocks(counts, index.centers)
    queries = asked(rows, query_every)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> pa.RecordBatch:
            who = pa.array(row, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), part["query_id"].take(who), part["q"].take(who), pa.array(extra, pa.binary())], names=["block", "id", "v", "extra"])

        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                row, block, extra = [], [], []
                for i, near in enumerate(shared.value.probed(matrix(part["q"]).astype(np.float32)).tolist()):
                    mine: dict[int, list[int]] = {}
                    for x in near:
                        for b in range(first[x], first[x] + pieces[x]):
                            mine.setdefault(b, []).append(x)
                    for b, lists in mine.items():
                        row.append(i)
                        block.append(b)
                        extra.append(np.array(lists, "<i4").tobytes())
                        if len(row) == SENT:
                            yield sent()
                            row, block, extra = [], [], []
                if row:
                    yield sent()

    at = F.col("list") + 1
    begin, parts = F.element_at(F.lit(first), at), F.element_at(F.lit(pieces), at)
    where = (begin + F.pmod(F.xxhash64("row"), parts)).cast("int")
    left = placed.select(where.alias("block"), F.col("vec_id").alias("id"), "row", F.array().cast(kind).alias("v"), F.col("coded").alias("extra"))

    def build(mine: pa.Table) -> Block:
        coded = np.frombuffer(b"".join(mine["extra"].to_pylist()), np.uint8).reshape(len(mine), -1)
        return Block(shared.value, mine["id"].to_numpy(), mine["row"].to_numpy(), coded[:, 4:], np.ascontiguousarray(coded[:, :4]).view("<i4")[:, 0])

    def answer(block: Block, some: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, some.num_rows, QUERIES):
            part = some.slice(at, QUERIES)
            probed = [np.frombuffer(x.as_py(), "<i4") for x in part["extra"]]
            found = block.shortlist(part["id"].to_numpy(), matrix(part["v"]).astype(np.float32), probed, short)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "row", "vec_id", "far"])

    right = queries.mapInArrow(probe, f"block int, id long, v {kind}, extra binary").withColumn("row", F.lit(0).cast("long"))
    met = blocks_meet(left, right, blocks, build, answer, "query_id long, row long, vec_id long, far float")
    near = Window.partitionBy("query_id").orderBy("far", "vec_id", "row")
    chosen = met.withColumn("n", F.row_number().over(near)).where(F.col("n") <= short).select("query_id", "row")
    both = chosen.join(rows.hint("merge"), "row").join(queries.hint("merge"), "query_id").select("query_id", "vec_id", "v", "q")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = np.sqrt(((matrix(batch["v"]).astype(float) - matrix(batch["q"]).astype(float)) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch["query_id"], batch["vec_id"], pa.array(far)], names=["query_id", "vec_id", "score"])

    found = both.mapInArrow(exact, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
