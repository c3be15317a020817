"""The hook for external models: ordered chunk translation, acceptance, resumable work (family K, J10)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import predicates as P
from quire.functions import text as T

Translator = Callable[[str], str]


def identity(text: str) -> str:
    return text


def dictionary(entries: dict[str, str]) -> Translator:
    """Replaces whole terms, the longest first."""
    ordered = sorted(entries, key=lambda k: (-len(k), k))

    def run(text: str) -> str:
        for k in ordered:
            text = text.replace(k, entries[k])
        return text

    return run


def translate(chunks: DataFrame, translator: Translator = identity, version: str = "mock") -> DataFrame:
    """`chunks` with translated, fingerprint and quality_error. Rows keep their index, so order needs no gathering."""
    columns = [c for c in chunks.columns if c not in ("translated", "fingerprint", "quality_error")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(translated=[translator(t or "") for t in pdf["text"]])

    kinds = ", ".join(f"`{c}` {t}" for c, t in chunks.select(*columns).dtypes)
    out = chunks.select(*columns).mapInPandas(run, f"{kinds}, translated string")
    return out.withColumns({"fingerprint": T.fingerprint(version, F.lit("[]"), F.lit(""), F.col("text")), "quality_error": P.quality_error(F.col("text"), F.col("translated"))})


def resume(chunks: DataFrame, cache: DataFrame, translator: Translator = identity, version: str = "mock") -> DataFrame:
    """Only chunks whose fingerprint isn't cached are translated; a lost run starts from what was written."""
    keyed = chunks.withColumn("fingerprint", T.fingerprint(version, F.lit("[]"), F.lit(""), F.col("text")))
    known = cache.dropDuplicates(["fingerprint"]).select("fingerprint", "translated")
    hits = keyed.join(known, "fingerprint").withColumn("cached", F.lit(True))
    misses = translate(keyed.join(known.select("fingerprint"), "fingerprint", "left_anti").drop("fingerprint"), translator, version).drop("quality_error").withColumn("cached", F.lit(False))
    return hits.unionByName(misses.select(*hits.columns))
