"""Shared helpers: the folder that all executors see, staged tables, constants."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: The white space of all word contracts: space and \t \n \v \f \r, nothing else.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session (tests) gets a temporary folder; on a
    cluster, whose executors would each write to a disk of their own, that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_quire_shared", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="quire-shared-")
        spark._quire_shared = where
    return where.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back: lineage ends there, and
    later passes survive lost executors without computing it anew. How many files it has is left to Spark's adaptive
    merging of shuffle partitions by their bytes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


_staged: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _staged:
        _staged.remove(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files behind a staged table that nothing reads any more."""
    _delete(df.sparkSession, df._quire_path)


def clear_staged(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Delete all tables that this process has staged but those at the paths in `keep`; results that read them must
    have been written before."""
    for path in [p for p in _staged if p not in keep]:
        _delete(spark, path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The result of `make` as a staged table; the tables that were staged on the way to it are deleted."""
    before = tuple(_staged)
    out = staged(make(), name)
    clear_staged(out.sparkSession, (*before, out._quire_path))
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000, megabytes: int = 16) -> None:
    """Bound an Arrow batch in rows and bytes, so that a batch of long texts fits in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


_held: dict[str, Any] = {}


def held(key: str, make: Callable[[], Any]) -> Any:
    """What a worker process remembers between batches and tasks. Workers are used again by later stages, so
    only one such object is kept: asking for another frees it."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]
