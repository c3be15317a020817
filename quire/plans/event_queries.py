"""Queries over `events`, `pages` and `conversations`, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import html as H
from quire.operators import lines as L
from quire.operators import translate as X
from quire.sources.tables import table
from quire.streaming import events as E

NAMES = {"error": "attempt_failure", "purchase": "attempt_success", "signup": "job_started", "click": "attempt_start", "view": "cache_hit"}
#: The moment from which ages are taken.
NOW = "2024-01-02 00:00:00"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a job's log."""
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("user_id").alias("key"), F.get_json_object("props", "$.k").cast("long").alias("chunk"), names[F.col("event_type")].alias("event"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "value")


def chunk_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.chunk_state(log(spark, sf_dir))


def progress_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.progress(log(spark, sf_dir), F.lit(100))


def stall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = log(spark, sf_dir).groupBy("job").agg(F.max(F.struct("ts", "seq", "event")).alias("m")).select("job", "m.ts", "m.event")
    return E.activity(last, F.lit(NOW).cast("timestamp")).select("job", "activity")


def rate_limit_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.trailing_count(log(spark, sf_dir), "key", 3600).groupBy("key").agg(F.max("trailing").alias("most"), F.sum((F.col("trailing") > 1).cast("long")).alias("over_limit"))


def month_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long")
    return E.monthly_quota(log(spark, sf_dir), cents, 50_000).groupBy("key", "month").agg(F.max("used").alias("used"), F.sum(F.col("within").cast("long")).alias("within"))


def ttl_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.live(log(spark, sf_dir), F.lit("2024-01-09 00:00:00").cast("timestamp"), 168).groupBy("event").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.stage_durations(log(spark, sf_dir))


def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event").agg(F.count("*").alias("n")).select(F.unix_seconds(F.col("w.start")).alias("start"), "event", "n")


def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.unix_seconds(F.col("w.start")).alias("start"), "n")


def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sessions(log(spark, sf_dir), "key", "30 minutes").select("key", "n", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


def progress_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = E.progress(log(spark, sf_dir), F.lit(100))
    return p.select("job", E.bar(F.col("completed"), F.lit(100)).alias("bar"), F.concat(F.floor(F.col("eta") / 60).cast("string"), F.lit("m "), F.lpad((F.col("eta") % 60).cast("string"), 2, "0"), F.lit("s")).alias("eta"))


def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.functions.predicates import error_class

    text = F.element_at(F.array(*[F.lit(x) for x in ("HTTP 401", "429 rate limit", "Timeout", "broken chunk", "")]), (F.col("seq") % 5 + 1).cast("int"))
    return log(spark, sf_dir).where("event = 'attempt_failure'").groupBy(error_class(text).alias("class")).agg(F.count("*").alias("n")).select(F.coalesce("class", F.lit("none")).alias("class"), "n")


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.links(table(spark, sf_dir, "pages")).select("page_id", F.col("pos").cast("long").alias("pos"), "href", "label")


def url_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = H.links(table(spark, sf_dir, "pages"))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), H.resolve(F.col("url"), F.col("href")).alias("link"))


def toc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.first_labels(H.links(table(spark, sf_dir, "pages")))


def href_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = H.links(table(spark, sf_dir, "pages"))
    targets = found.where("page_id % 2 = 0").select("href")
    return H.validation(found, targets, "href")


def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", H.title(F.col("html")).alias("title"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("items"))


def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.markdown(F.col("html")).alias("m")).select("page_id", F.length("m").cast("long").alias("chars"), F.md5("m").alias("digest"))


def mock_translate_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = L.chunks(table(spark, sf_dir, "documents"), 2000)
    return X.translate(chunks).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("translated")).cast("long").alias("chars"))


def resumable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    cache = X.translate(turns.where("conv_id % 2 = 0")).select("fingerprint", "translated")
    return X.resume(turns, cache).groupBy("cached").agg(F.count("*").alias("n"), F.sum(F.length("translated")).cast("long").alias("chars"))


QUERIES = {f.__name__: f for f in (chunk_state, progress_by_job, stall_status, rate_limit_hits, month_quota, ttl_live, stage_durations, events_tumbling, events_sliding, events_session, progress_format, error_classes,
                                   html_links, url_resolve, toc_labels, href_validation, html_headings, html_main_text, mock_translate_ordered, resumable_chunks)}

LOG = "lg AS (SELECT user_id AS job, user_id AS key, json_extract(props, '$.k')::bigint AS chunk, CASE event_type WHEN 'error' THEN 'attempt_failure' WHEN 'purchase' THEN 'attempt_success' WHEN 'signup' THEN 'job_started' WHEN 'click' THEN 'attempt_start' WHEN 'view' THEN 'cache_hit' END AS event, event_id AS seq, ts, value FROM events)"
CHUNKS = LOG + """, s AS (SELECT *, CASE event WHEN 'attempt_start' THEN 'running' WHEN 'attempt_success' THEN 'completed' WHEN 'cache_hit' THEN 'completed' WHEN 'attempt_failure' THEN 'failed' END AS s FROM lg WHERE event <> 'job_started'), cs AS (SELECT job, chunk, CASE WHEN bool_or(s = 'completed') THEN 'completed' ELSE arg_max(s, seq) END AS state, sum((event = 'attempt_start')::int)::bigint AS attempts, max((event = 'cache_hit')::int) AS cache_hit FROM s GROUP BY ALL)"""
PROGRESS = CHUNKS + """, j AS (SELECT job, sum((state = 'completed')::int)::bigint AS completed, sum((state = 'failed')::int)::bigint AS failed, sum((state = 'running')::int)::bigint AS running, 0::bigint AS retrying, sum(cache_hit)::bigint AS cache_hits FROM cs GROUP BY 1), sp AS (SELECT job, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000)::bigint AS elapsed FROM lg GROUP BY 1),
 pg AS (SELECT j.*, elapsed, greatest(100 - completed - failed, 0) AS remaining, CASE WHEN completed > 0 THEN floor(elapsed * greatest(100 - completed - failed, 0) / completed)::bigint END AS eta FROM j JOIN sp USING (job))"""
LINK = H.LINK.replace("'", "''")
LINKS = f"""r AS (SELECT page_id, url, regexp_extract_all(html, '{LINK}', 1) AS hrefs, regexp_extract_all(html, '{LINK}', 2) AS raws FROM pages),
 u AS (SELECT page_id, url, unnest(hrefs) AS quoted, unnest(raws) AS tagged, generate_subscripts(hrefs, 1) - 1 AS pos FROM r)"""
UNESCAPE = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"


LINKS += f""", a AS (SELECT page_id, url, pos, {UNESCAPE.format("regexp_replace(quoted, '^[\"'']|[\"'']$', '', 'g')")} AS href, {UNESCAPE.format("regexp_replace(tagged, '<[^>]*>', '', 'g')")} AS label FROM u)"""


def _markdown_sql() -> str:
    x = "html"
    for tag in ("script", "style", "nav", "header", "footer", "aside"):
        x = f"regexp_replace({x}, '(?s)<{tag}[ >].*?</{tag}>', '', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', '', 'g'), '(?s)<div class=\"ad\">.*?</div>', '', 'g')"
    for tag, mark in (("h1", "## "), ("h2", "### "), ("h3", "#### "), ("h4", "##### "), ("blockquote", "> "), ("li", "- "), ("p", "")):
        x = f"regexp_replace({x}, '<{tag}(?: [^>]*)?>', chr(10) || chr(10) || '{mark}', 'g')"
    x = f"regexp_replace({x}, '([a-z])-<br ?/?>([a-z])', '\\1\\2', 'g')"
    for pattern, mark in (("<br ?/?>", "chr(10)"), ("</?(?:b|strong)>", "'**'"), ("</?(?:i|em)>", "'*'"), ("</?code>", "'`'"), ("<[^>]+>", "''")):
        x = f"regexp_replace({x}, '{pattern}', {mark}, 'g')"
    return f"trim(regexp_replace(regexp_replace({UNESCAPE.format(x)}, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"


ORACLES = {
    "chunk_state": f"WITH {CHUNKS} SELECT * FROM cs",
    "progress_by_job": f"WITH {PROGRESS} SELECT * FROM pg",
    "stall_status": f"WITH {LOG}, m AS (SELECT job, max({{'ts': ts, 'seq': seq, 'event': event}}) AS m FROM lg GROUP BY 1), a AS (SELECT job, m.event AS event, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(m.ts)) / 1000000 AS age FROM m) SELECT job, CASE WHEN event = 'attempt_failure' THEN 'failed' WHEN age <= 120 THEN 'active' WHEN event = 'attempt_start' AND age <= 600 THEN 'waiting' WHEN age <= 180 THEN 'active' ELSE 'stalled' END AS activity FROM a",
    "rate_limit_hits": f"WITH {LOG}, t AS (SELECT key, count(*) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS tr FROM lg) SELECT key, max(tr) AS most, sum((tr > 1)::int)::bigint AS over_limit FROM t GROUP BY 1",
    "month_quota": f"WITH {LOG}, u AS (SELECT key, strftime(ts, '%Y-%m') AS month, sum(round(value * 100)::bigint) OVER (PARTITION BY key, strftime(ts, '%Y-%m') ORDER BY ts, seq)::bigint AS used FROM lg) SELECT key, month, max(used) AS used, sum((used <= 50000)::int)::bigint AS within FROM u GROUP BY ALL",
    "ttl_live": f"WITH {LOG} SELECT event, count(*) AS n, min(seq) AS first FROM lg WHERE epoch_us(TIMESTAMP '2024-01-09 00:00:00') - epoch_us(ts) <= 168 * 3600000000 GROUP BY 1",
    "stage_durations": f"WITH {LOG}, d AS (SELECT event, epoch_us(lead(ts) OVER (PARTITION BY key ORDER BY ts, seq)) - epoch_us(ts) AS us FROM lg) SELECT event, count(us) AS n, sum(us)::bigint AS us, max(us) AS longest FROM d GROUP BY 1",
    "events_tumbling": f"WITH {LOG} SELECT epoch(date_trunc('hour', ts))::bigint AS start, event, count(*) AS n FROM lg GROUP BY ALL",
    "events_sliding": f"WITH {LOG}, s AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM lg) SELECT epoch(w)::bigint AS start, count(*) AS n FROM s GROUP BY 1",
    "events_session": f"WITH {LOG}, g AS (SELECT key, ts, coalesce((ts - lag(ts) OVER (PARTITION BY key ORDER BY ts) >= INTERVAL 30 MINUTE)::int, 1) AS nw FROM lg), i AS (SELECT *, sum(nw) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT key, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM i GROUP BY key, s",
    "progress_format": f"WITH {PROGRESS} SELECT job, repeat('#', floor(completed * 28 / 100)::int) || repeat('-', 28 - floor(completed * 28 / 100)::int) AS bar, (eta // 60)::varchar || 'm ' || lpad((eta % 60)::varchar, 2, '0') || 's' AS eta FROM pg",
    "error_classes": f"WITH {LOG}, e AS (SELECT CASE seq % 5 WHEN 0 THEN 'permanent' WHEN 1 THEN 'transient' WHEN 2 THEN 'transient' WHEN 3 THEN 'retryable' ELSE 'none' END AS class FROM lg WHERE event = 'attempt_failure') SELECT class, count(*) AS n FROM e GROUP BY 1",
    "html_links": f"WITH {LINKS} SELECT page_id, pos, href, label FROM a",
    "url_resolve": f"""WITH {LINKS}, o AS (SELECT *, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM a),
 f AS (SELECT *, CASE WHEN starts_with(href, '/') THEN '' ELSE regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') END || regexp_replace(href, '[?#].*$', '') AS target FROM o),
 s AS (SELECT *, regexp_replace('/' || regexp_replace(target, '^/', ''), '/[.]$', '/') AS t FROM f)
 SELECT page_id, pos, CASE WHEN starts_with(lower(href), 'javascript:') THEN NULL WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-z]+:)', 1) || href WHEN href = '' THEN regexp_replace(url, '#.*$', '')
  WHEN starts_with(href, '#') THEN regexp_replace(url, '#.*$', '') || href WHEN starts_with(href, '?') THEN origin || path || href ELSE origin || t || regexp_extract(href, '([?#].*)$', 1) END AS link FROM s""",
    "toc_labels": f"WITH {LINKS}, m AS (SELECT href, min({{'p': page_id, 's': pos, 'l': label}}) AS m, count(*) AS n FROM a GROUP BY 1) SELECT href, m.l AS label, n FROM m",
    "href_validation": f"WITH {LINKS}, t AS (SELECT DISTINCT href AS t FROM a WHERE page_id % 2 = 0), j AS (SELECT a.page_id, a.href, t FROM a LEFT JOIN t ON a.href = t) SELECT page_id, count(*) AS links, sum((t IS NOT NULL)::int)::bigint AS resolved, coalesce(array_to_string(list_sort(list_distinct(list(href) FILTER (WHERE t IS NULL)))[1:50], ','), '') AS missing FROM j GROUP BY 1",
    "html_headings": f"SELECT page_id, {UNESCAPE.format('''regexp_replace(regexp_extract(html, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1\\s*>', 1), '<[^>]*>', '', 'g')''')} AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<li>')) AS items FROM pages",
    "html_main_text": f"WITH m AS (SELECT page_id, {_markdown_sql()} AS m FROM pages) SELECT page_id, length(m) AS chars, md5(m) AS digest FROM m",
}
