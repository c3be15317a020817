"""Event logs, as batches and as streams: progress folds, stalls, rates, quotas, windows (family J)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

#: Event types and the state in which they leave a chunk; others leave it as it was.
STATES = {"attempt_start": "running", "attempt_success": "completed", "cache_hit": "completed", "attempt_failure": "failed", "attempt_retry": "retrying"}


def chunk_state(events: DataFrame) -> DataFrame:
    """The last state of each chunk: job, chunk, state, attempts, cache_hit (J03). A completed chunk stays so."""
    state = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])[F.col("event")]
    rows = events.where(F.col("event").isin(*STATES)).withColumn("s", state)
    last = F.max(F.struct(F.col("seq"), F.col("s")))
    done = F.max((F.col("s") == "completed").cast("int")) == 1
    return rows.groupBy("job", "chunk").agg(F.when(done, "completed").otherwise(last["s"]).alias("state"), F.sum((F.col("event") == "attempt_start").cast("long")).alias("attempts"), F.max((F.col("event") == "cache_hit").cast("int")).alias("cache_hit"))


def progress(events: DataFrame, total: Column) -> DataFrame:
    """Completed, failed, running, remaining and cache hits of each job; elapsed seconds; the ETA in whole seconds."""
    count = lambda s: F.sum((F.col("state") == s).cast("long"))
    by_job = chunk_state(events).groupBy("job").agg(*[count(s).alias(s) for s in ("completed", "failed", "running", "retrying")], F.sum("cache_hit").cast("long").alias("cache_hits"))
    span = events.groupBy("job").agg((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))).alias("us"))
    out = by_job.join(span, "job").withColumn("elapsed", F.floor(F.col("us") / 1_000_000)).drop("us")
    out = out.withColumn("remaining", F.greatest(total - F.col("completed") - F.col("failed"), F.lit(0)).cast("long"))
    return out.withColumn("eta", F.when(F.col("completed") > 0, F.floor(F.col("elapsed") * F.col("remaining") / F.col("completed"))))


def activity(last: DataFrame, now: Column) -> DataFrame:
    """active, waiting, stalled, failed or unknown by the age of a job's last event."""
    age = (F.unix_micros(now) - F.unix_micros("ts")) / 1_000_000
    return last.withColumn("activity", F.when(F.col("event") == "attempt_failure", "failed").when(F.col("ts").isNull(), "unknown").when(age <= 120, "active").when((F.col("event") == "attempt_start") & (age <= 600), "waiting").when(age <= 180, "active").otherwise("stalled"))


def trailing_count(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """Events of the same key in the trailing seconds, itself included."""
    w = Window.partitionBy(key).orderBy(F.unix_micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("trailing", F.count("*").over(w))


def monthly_quota(events: DataFrame, amount: Column, budget: float) -> DataFrame:
    """The running sum of each key and month and whether it is within the budget."""
    w = Window.partitionBy("key", "month").orderBy("ts", "seq")
    return events.withColumn("month", F.date_format("ts", "yyyy-MM")).withColumn("used", F.sum(amount).over(w)).withColumn("within", F.col("used") <= budget)


def live(entries: DataFrame, now: Column, hours: int = 168) -> DataFrame:
    """Entries that are no older than their time to live."""
    return entries.where(F.unix_micros(now) - F.unix_micros("ts") <= hours * 3_600_000_000)


def stage_durations(events: DataFrame) -> DataFrame:
    """Microseconds until the key's next event, by event."""
    w = Window.partitionBy("key").orderBy("ts", "seq")
    rows = events.withColumn("us", F.unix_micros(F.lead("ts").over(w)) - F.unix_micros("ts"))
    return rows.groupBy("event").agg(F.count("us").alias("n"), F.sum("us").alias("us"), F.max("us").alias("longest"))


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    return events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).drop("w")


def bar(done: Column, total: Column, width: int = 28) -> Column:
    """A progress bar."""
    full = F.floor(done * width / F.greatest(total, F.lit(1))).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), F.lit(width) - full))


def windowed_counts(stream: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and event of a stream with a watermark; late rows are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", every), "event").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


PROGRESS_OUT = "job long, completed long, failed long, running long, cache_hits long"
#: Of each chunk: the greatest seq seen, the state it left, and whether a cache hit occurred.
_STATE = "chunks map<long,struct<seq:long,state:string,hit:boolean>>"


def progress_stream(stream: DataFrame, idle: str = "24 hours") -> DataFrame:
    """Progress of each job, updated as events arrive: one state a job (J03), the same as the batch form for any order and any cut into
    micro-batches: a chunk is in the state that its event of greatest seq left, completed ones stay so, and a cache hit
    counts once a chunk. Events more than `idle` behind the latest are too late; a job without events for that long ends and its
    state is freed."""
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        chunks = {k: tuple(v) for k, v in state.get[0].items()} if state.exists else {}
        latest = state.getCurrentWatermarkMs()
        for pdf in batches:
            latest = max(latest, int(pdf["ts"].max().timestamp() * 1000))
            for chunk, event, seq in pdf[["chunk", "event", "seq"]].itertuples(index=False):
                if event not in STATES:
                    continue
                last, now, hit = chunks.get(chunk, (-1, None, False))
                if now != "completed" and (seq > last or STATES[event] == "completed"):
                    now = STATES[event]
                chunks[chunk] = (max(int(seq), last), now, hit or event == "cache_hit")
        state.update((chunks,))
        state.setTimeoutTimestamp(latest + wait)
        seen, hits = [s for _, s, _ in chunks.values()], sum(h for *_, h in chunks.values())
        yield pd.DataFrame([(key[0], seen.count("completed"), seen.count("failed"), seen.count("running"), hits)], columns=["job", "completed", "failed", "running", "cache_hits"])

    return stream.withWatermark("ts", idle).groupBy("job").applyInPandasWithState(fold, PROGRESS_OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
