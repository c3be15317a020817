"""Job and workspace rules as projections: resumption, progress, gates, statuses, versions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import predicates as P
from quire.functions.text import CONTROL


def resume_decision(jobs: DataFrame, now: Column, cooldown: int = 120, attempts: int = 3) -> DataFrame:
    """Whether a job may be resumed by itself, and why not (J06). jobs: locked, human_gate, retryable, auto_attempts, failed_at."""
    age = F.unix_seconds(now) - F.unix_seconds("failed_at")
    return jobs.withColumn("decision", P.first_match([(F.col("locked"), "locked"), (F.col("human_gate"), "needs_human"), (~F.col("retryable"), "permanent"), (F.col("auto_attempts") >= attempts, "exhausted"), (age < cooldown, "cooling_down")], "resume"))


def merged_progress(a: Column, b: Column, c: Column, total: Column, base: int = 0, span: int = 100) -> Column:
    """The overall percentage from the most advanced of three sources."""
    done = F.least(F.greatest(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0)), F.coalesce(c, F.lit(0))), total)
    return F.when(total > 0, base + F.floor(done * span / total)).otherwise(base)


def may_translate(active_terms: Column, stage: Column) -> Column:
    return (active_terms >= 1) & stage.isin("glossary_ready", "translating", "translated", "review")


def pacing(rpm: Column, tpm: Column, tokens: Column) -> Column:
    """Seconds between requests."""
    return F.greatest(60 / rpm, 60 * tokens / tpm)


def stale(status: Column, updated: Column, now: Column, minutes: int = 20) -> Column:
    return (status == "running") & (F.unix_seconds(now) - F.unix_seconds(updated) > 60 * minutes)


def repair_action(runs: DataFrame) -> DataFrame:
    """What becomes of failed runs (J15): reset while tried less than three times, removed if a newer run of the same
    40-character prefix exists, else left."""
    newer = F.max("updated").over(Window.partitionBy(F.substring("name", 1, 40))) > F.col("updated")
    return runs.withColumn("action", P.first_match([(F.col("status") != "failed", "none"), (newer, "remove"), (F.col("retryable") & (F.col("resets") < 3), "reset")], "leave"))


def oldest_first(queue: DataFrame, lane: str) -> DataFrame:
    """The next entry of each lane: least time, then path."""
    return queue.groupBy(lane).agg(F.min(F.struct("time", "path")).alias("_m")).select(lane, "_m.time", "_m.path")


def last_positions(reads: DataFrame) -> DataFrame:
    """The last write of each book."""
    return reads.groupBy("book").agg(F.max(F.struct("ts", "seq", "position")).alias("_m")).select("book", "_m.ts", "_m.position")


def snapshots(log: DataFrame, key: str) -> DataFrame:
    """State and revision of each key from an append-only log (B05): its last row, and how many there are."""
    return log.groupBy(key).agg(F.max(F.struct("seq", "state")).alias("_m"), F.count("*").alias("revision")).select(key, "_m.state", "_m.seq", "revision")


def write_version(df: DataFrame, path: str, version: str, parent: str | None) -> None:
    """One version beside the others (B06); names are checked."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}", version):
        raise ValueError(f"no version name: {version!r}")
    df.withColumns({"version": F.lit(version), "parent_version": F.lit(parent).cast("string")}).write.partitionBy("version").mode("append").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def pick_draft(*sources: tuple[DataFrame, str], key: str) -> DataFrame:
    """Rows of the best source that has any for a key, in order of precedence."""
    every = None
    for rank, (df, name) in enumerate(sources):
        tagged = df.withColumns({"origin": F.lit(name), "_rank": F.lit(rank)})
        every = tagged if every is None else every.unionByName(tagged)
    best = every.groupBy(key).agg(F.min("_rank").alias("_rank"))
    return every.join(best, [key, "_rank"]).drop("_rank")


def to_printed(pdf_page: Column, offset: Column) -> Column:
    return pdf_page - offset


def accepted(missing: Column, reading_text: Column) -> Column:
    return (F.size(missing) == 0) & (F.length(F.trim(reading_text)) > 0)


def review_mode(flagged: Column) -> Column:
    return F.when(flagged > 0, "issues_only").otherwise("full")


def pipeline_status(state: Column, artifacts: Column) -> Column:
    """The workspace's status by ordered rules."""
    has = lambda x: F.array_contains(artifacts, x)
    return P.first_match([(state == "failed", "failed"), (state.isin("running", "queued"), "processing"), (has("export"), "exported"), (has("reviewed"), "reviewed"), (has("translated"), "needs_review"), (has("glossary"), "ready_to_translate"), (has("book"), "needs_glossary")], "new")


def project_rollup(items: DataFrame, versions: DataFrame) -> DataFrame:
    """Totals, pending rewrites and status of each project."""
    totals = items.groupBy("project").agg(F.count("*").alias("total"), F.sum(F.col("status").isin("approved", "resolved").cast("long")).alias("done"), F.sum((F.col("action") == "model_rewrite").cast("long")).alias("pending"))
    last = versions.groupBy("project").agg(F.max(F.struct("created", "version")).alias("_m")).select("project", F.col("_m.version").alias("latest"))
    out = totals.join(last, "project", "left")
    return out.withColumn("status", P.first_match([(F.col("latest").isNotNull(), "exported"), (F.col("done") == F.col("total"), "reviewed"), (F.col("done") > 0, "in_review")], "unreviewed"))


def split_excluded(candidates: DataFrame, excluded: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Candidates that are shown and those that are excluded."""
    names = excluded.select(on).distinct()
    return candidates.join(names, on, "left_anti"), candidates.join(names, on, "left_semi")


def constraints(selected: DataFrame) -> DataFrame:
    """Terms of each chunk, and nothing twice."""
    return selected.distinct().groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("source", "target"))).alias("terms"))


def quarantine(blocks: DataFrame) -> DataFrame:
    """Suspect blocks and how each is resolved (L08): text seen three times with controls, or a fifth of controls and
    no letter, is noise; other suspects stay out of the flow."""
    reasons = P.ocr_reasons(F.col("text"))
    suspect = blocks.withColumn("score", P.ocr_score(reasons)).where(F.col("score") >= 82)
    seen = suspect.groupBy("text").agg(F.count("*").alias("_n"))
    controls = F.regexp_count("text", F.lit(CONTROL))
    noise = ((F.col("_n") >= 3) & (controls > 0)) | ((controls * 5 >= F.length("text")) & ~F.col("text").rlike("[A-Za-z]"))
    return suspect.join(seen, "text").withColumn("resolution", F.when(noise, "noise").otherwise("excluded_from_flow")).drop("_n")
