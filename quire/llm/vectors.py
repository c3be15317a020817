"""Shared by the vector operators: which vectors take part, and meeting blocks of rows with streams of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(table: DataFrame, nonzero: bool) -> DataFrame:
    """vec_id and embedding of rows whose id and vector are given, without null or non-finite components, of
    the length that most of these have (ties: the greater), and if asked for not all zero."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null and size(embedding) > 0").where(~bad)
    if nonzero:
        rows = rows.where(F.exists(x, lambda v: v != 0))
    common = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("embedding") == (common.d if common else 0))


def asked(rows: DataFrame, query_every: int) -> DataFrame:
    """query_id and q (its vector) of the rows whose vec_id `query_every` divides; of rows with the same vec_id the
    least vector asks."""
    return rows.where(F.col("vec_id") % query_every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))


def matrix(column: pa.Array) -> np.ndarray:
    """[rows, components] of a list column whose lists are equally long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def dealt(seed: int, groups: int) -> F.Column:
    """A group number by the hash of vec_id."""
    return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(groups)).cast("int")


def blocks_meet(rows: DataFrame, queries: DataFrame, blocks: int, build: Callable, answer: Callable, schema: str) -> DataFrame:
    """`build(rows of a block)` makes a block's index once; `answer(index, queries)` is then called for one batch of
    its queries after the other, so a block's rows are held and its queries are streamed. Both tables have the columns
    block (int, from 0), id and row (long), v (an array) and extra (binary); rows come in order of id. Each row is
    shuffled once, to its block; `answer` gives record batches of `schema`."""
    one, two = (df.select("block", F.lit(kind).alias("kind"), "id", "row", "v", "extra") for kind, df in enumerate((rows, queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for batch in batches:
            mark = np.stack([batch[c].to_numpy() for c in ("block", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((mark[1:] != mark[:-1]).any(axis=1)) + 1).tolist(), len(mark)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                part, (block, kind) = batch.slice(s, e - s), mark[s].tolist()
                if block != now:
                    now, held, index = block, [], None
                if kind == 0:
                    held.append(part)
                elif held or index is not None:
                    if index is None:
                        index, held = build(pa.Table.from_batches(held)), []
                    yield from answer(index, part)

    return one.unionAll(two).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind", "id", "row").mapInArrow(run, schema)
