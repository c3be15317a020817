"""A training-data pipeline over `documents`: each stage works on all that its predecessor kept.

Toxic documents go, documents of unknown language go, one document of each near-duplicate group
stays, the mix takes each source's documents as often as its target asks, and the rest is packed into
sequences. Stages are written as Parquet and read again by `run`, which then deletes what the stage staged on its way and the
table before it. There is no SQL form: the first two stages are trained networks.

All stages take tables without rows (the result has none), nulls in any column, empty and very long texts (read whole), repeated
rows, and further columns of any name, which all but the last keep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import langid, mixing, packing, similar, simhash, toxicity
from quire.llm.common import drop_staged, settled, small_batches, table

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; learned from `labels`. Null, empty and wordless texts score 0 and stay, so
    do all documents where no label is known. Repeated rows are judged each, all alike."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; learned from their own lang. Null and letterless texts are unknown and go, and all go
    where no row has a lang. Ties of two languages: the first by code point. Repeated rows are judged each, all alike."""
    small_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs of similarity 0.8 or more link: the SimHash links of `op2_simhash`, each confirmed on
    the whole texts' shingles, and by an exact way those that fingerprints miss. That of the least doc_id stays (null ids last;
    ties: the least hash of the text; of rows equal in both, the one whose other columns are least). Texts without words are one group."""
    return simhash.one_of_each(docs, lambda keyed, keep: similar.grouped(keyed, keep, SHINGLE))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 3 times, by shard and in the shard's local shuffle. A null source is one of
    its own; documents without words occur in whole passes; the document that a source's target cuts counts if half of it is taken."""
    return mixing.Mix(docs).repeat(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences. Null text: the end id alone. Repeated rows are packed each."""
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("language_id", language_filter),
    ("simhash_near_dedup", near_duplicate_filter),
    ("mixing", source_mix),
    ("best_fit_packing", sequence_packing),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = settled(lambda: stage(spark, docs, sf_dir), name)  # noqa: B023
        if last is not None:
            drop_staged(last)
        last = docs
    return docs
