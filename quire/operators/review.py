"""Review of text pairs: alignment, issues, reports, completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import predicates as P
from quire.functions import text as T

#: Severity of each issue type.
SEVERITY = {"translation_failed_open": "high", "missing_translation": "high", "possibly_incomplete": "high", "untranslated": "high", "mixed_english": "medium", "glossary_drift": "low"}


def pairs(turns: DataFrame) -> DataFrame:
    """A user's turn and the assistant's next one: conv_id, turn, source_text, translated_text (null: none)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    out = turns.withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)}).where("role = 'user'")
    return out.select("conv_id", "turn", F.col("text").alias("source_text"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("translated_text"))


def issue(source: Column, output: Column, preserve: bool = False) -> Column:
    """The first issue that holds; null if none."""
    out = F.coalesce(output, F.lit(""))
    rules = [(out.contains("<!-- fail-open"), "translation_failed_open"), (T.strip(out) == "", "missing_translation")]
    if preserve:
        rules.append(((F.length(source) >= 200) & (F.length(out) * 2 < F.length(source)), "possibly_incomplete"))
    else:
        rules += [((F.length(source) >= 80) & (T.letters(out) > 80) & (T.cjk(out) < 20), "untranslated"),
                  ((F.length(source) >= 500) & ((T.cjk(out) + F.floor(T.letters(out) * 35 / 100)) * 100 < F.length(source) * 16), "possibly_incomplete"), (P.mixed_words(out) >= 4, "mixed_english")]
    return P.first_match(rules)


def exemption(source: Column) -> Column:
    """The first reason for which a segment needs no review; null if none."""
    s = T.strip(source)
    return P.first_match([(s == "", "empty"), (F.length(s) < 12, "too_short"), (s.rlike(r"^!\[[^\]]*\]\([^)]*\)$"), "image"), (s.rlike(r"^(?:[0-9]+|[ivxlcdm]+)[.)]?$"), "page_number"),
                          (F.regexp_count(s, F.lit("https?://")) >= 2, "links"), (s.rlike(r"^[A-Z][A-Za-z .-]{2,40}, [0-9]{4}"), "bibliographic")])


def items(rows: DataFrame, preserve: bool = False) -> DataFrame:
    """Review items with severity and ids `review-0001` in order of conversation."""
    kind = issue(F.col("source_text"), F.col("translated_text"), preserve)
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    found = rows.withColumns({"issue_type": kind, "exempt": exemption(F.col("source_text"))}).where("issue_type is not null and exempt is null").drop("exempt")
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return found.withColumn("severity", severity[F.col("issue_type")]).withColumn("item_id", F.concat_ws("-", F.lit("review"), F.lpad(F.col("conv_id").cast("string"), 4, "0"), F.lpad(number.cast("string"), 4, "0")))


def pre_review(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Counts by issue type beside the totals."""
    total = rows.agg(F.count("*").alias("total"))
    flagged = found.agg(F.count("*").alias("flagged"))
    by = found.groupBy("issue_type", "severity").agg(F.count("*").alias("n"))
    return by.crossJoin(total).crossJoin(flagged).withColumn("clean", F.greatest(F.col("total") - F.col("flagged"), F.lit(0)))  # two one-row tables


def completion(scope: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Distinct ids in scope, reviewed, pending rewrites, and the percentage in whole numbers."""
    done = scope.select(key).distinct().join(decisions, key, "left")
    out = done.agg(F.count("*").alias("scope"), F.sum(F.col("status").isin("approved", "resolved").cast("long")).alias("reviewed"), F.sum((F.col("action") == "model_rewrite").cast("long")).alias("pending"))
    return out.na.fill(0).withColumn("percent", F.when(F.col("scope") > 0, F.floor(100 * F.col("reviewed") / F.col("scope"))).otherwise(100).cast("long"))


def chapters(segments: DataFrame, keys: list[str], pos: str, text: str) -> DataFrame:
    """Segments joined back, blank ones left out, in order."""
    rows = segments.where(F.trim(text) != "").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(pos, text))).alias("_s"))
    return rows.select(*keys, F.array_join(F.transform("_s", lambda x: x[text]), "\n\n").alias("markdown"), F.size("_s").alias("blocks"))
