"""Queries of the page, control and rewrite operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import control as C
from quire.operators import glossary as G
from quire.operators import html as H
from quire.operators import pages as G2
from quire.operators import rewrite as W
from quire.operators.review import pairs
from quire.plans.event_queries import LINKS, LOG, log
from quire.plans.relation_queries import CAND, PAIRS
from quire.sources.tables import table


def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    n = F.lit(1000)
    kinds = d.select("source", "doc_id", G2.page_kind(F.split("text", "\n"), F.col("doc_id") % 1000, n, G2.chapter_title(F.split("text", "\n"))).alias("kind"))
    return kinds.groupBy("source", "kind").agg(F.count("*").alias("n"))


def majority_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").select("source", "lang", "doc_id")
    return G2.majority_kind(p, ["source"], "lang", "doc_id")


def chapter_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 20).alias("chapter"), F.col("conv_id").alias("page"), F.col("turn").alias("pos"), F.col("text").alias("line"))
    return G2.assemble(lines, ["chapter"], trace=True).select("chapter", F.md5("markdown").alias("digest"), "page_start", "page_end")


def note_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark rows as notes; the last digit of their page is the marker."""
    d = table(spark, sf_dir, "documents").select(F.lit("b").alias("book"), F.col("doc_id").alias("page"), F.lit(0).alias("pos"), "text")
    notes = table(spark, sf_dir, "benchmark").select(F.lit("b").alias("book"), F.col("item_id").alias("note_id"), (F.col("item_id") * 3 + 2).alias("page"), F.lit("1").alias("marker"))
    return G2.backlinks(notes, d, "book").select("note_id", "link_page", F.col("link_pos").cast("long").alias("link_pos"))


def toc_page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 20).alias("page"), F.transform(F.split("text", "\n"), lambda x: F.when(F.length(x) % 3 == 0, F.concat(x, F.lit(" .... 12"))).otherwise(x)).alias("lines"))
    return G2.toc_pages(p, "source")


def toc_depth_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book"), (F.col("l_partkey") % 4 + 1).alias("depth"), "l_linenumber")
    return G2.toc_depth(e, "book", 2).groupBy("book").agg(F.count("*").alias("entries"), F.max("depth").alias("deepest"))


def outline_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("book"), F.col("l_linenumber").alias("page"), (F.col("l_partkey") % 3).alias("level"), F.col("l_returnflag").alias("title"))
    return G2.outline_rows(e, "book")


def id_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return G2.id_coverage(d, ["source"], "quality")


def resume_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = log(spark, sf_dir).select("seq", (F.col("seq") % 7 == 0).alias("locked"), (F.col("seq") % 11 == 0).alias("human_gate"), (F.col("event") != "attempt_failure").alias("retryable"), (F.col("chunk") % 5).alias("auto_attempts"), F.col("ts").alias("failed_at"))
    return C.resume_decision(jobs, F.lit("2024-01-15 00:00:00").cast("timestamp"), 864_000).groupBy("decision").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


def merged_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", C.merged_progress(F.col("doc_id") % 50, F.when(F.col("doc_id") % 3 == 0, F.length("text") % 120), F.lit(None).cast("long"), F.lit(100), 10, 80).cast("long").alias("percent"))


def oldest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = log(spark, sf_dir).select(F.col("key").alias("lane"), F.unix_micros("ts").alias("time"), F.col("seq").cast("string").alias("path"))
    return C.oldest_first(q, "lane")


def last_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = log(spark, sf_dir).select(F.col("key").alias("book"), F.unix_micros("ts").alias("ts"), "seq", F.col("chunk").alias("position"))
    return C.last_positions(r)


def log_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.snapshots(log(spark, sf_dir).select("key", "seq", F.col("event").alias("state")), "key")


def review_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumnRenamed("source", "project")
    items = d.select("project", F.when(F.col("quality") == 1, "approved").otherwise("open").alias("status"), F.when(F.col("toxic") == 1, "model_rewrite").otherwise("keep").alias("action"))
    versions = d.where("quality = 0").select("project", F.col("doc_id").alias("created"), F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("version"))
    return C.project_rollup(items, versions)


def workspace_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    arts = F.filter(F.array(*[F.when(F.col("doc_id") % k == 0, F.lit(a)) for k, a in ((2, "book"), (3, "glossary"), (5, "translated"), (7, "reviewed"), (11, "export"))]), lambda x: x.isNotNull())
    state = F.when(F.col("doc_id") % 13 == 0, "failed").when(F.col("doc_id") % 17 == 0, "running").otherwise("idle")
    return d.select(C.pipeline_status(state, arts).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def excluded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.candidates(table(spark, sf_dir, "documents"))
    shown, hidden = C.split_excluded(found, found.where("length(phrase) % 2 = 0"), "phrase")
    return shown.agg(F.count("*").alias("n")).withColumn("part", F.lit("shown")).unionByName(hidden.agg(F.count("*").alias("n")).withColumn("part", F.lit("hidden")))


def candidate_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the first words of lines can't be terms."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("l")).select(F.regexp_extract("l", r"^([A-Za-z]+ [A-Za-z]+)", 1).alias("p")).where("p <> ''")
    return w.select(F.coalesce(W.bad_candidate(F.col("p")), F.lit("ok")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def missing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(table(spark, sf_dir, "conversations")).where("translated_text is not null").select("conv_id", F.col("translated_text").alias("translated"))
    terms = p.select("conv_id", F.explode(F.array(F.lit("the"), F.lit("la"), F.lit("und"))).alias("target")).distinct()
    return W.missing_targets(p, terms, "conv_id").groupBy("target").agg(F.count("*").alias("n"))


def suggestion_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    c = docs.select(F.col("doc_id").cast("string").alias("source"), F.when(F.col("doc_id") % 4 == 0, "old").alias("target"))
    s = docs.where("doc_id % 3 = 0").select((F.col("doc_id") % 300).cast("string").alias("source"), F.concat(F.lit("new"), F.col("doc_id").cast("string")).alias("target"), F.col("doc_id").alias("seq"))
    return W.merge_suggestions(c, s, docs.where("doc_id % 5 = 0").select(F.col("doc_id").cast("string").alias("source")))


def link_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = H.links(table(spark, sf_dir, "pages"))
    files = found.where("page_id % 2 = 0").select(F.regexp_extract("href", "^([^#]*)", 1).alias("path")).distinct().withColumn("output", F.concat(F.lit("out"), F.col("path")))
    return W.rewrite_links(found.select("page_id", F.col("pos").cast("long").alias("pos"), "href"), files).drop("href")


QUERIES = {f.__name__: f for f in (page_kinds, majority_kind, chapter_assembly, note_backlinks, toc_page_range, toc_depth_filter, outline_dedupe, id_coverage, resume_decisions, merged_progress, oldest_first, last_positions, log_snapshots, review_projects,
                                   workspace_status, excluded_terms, candidate_integrity, missing_targets, suggestion_merge, link_rewrite)}
T = "trim(x, ' ' || chr(9) || chr(10) || chr(13))"
NW = "len(regexp_extract_all({}, '[^ \\t\\n\\r]+'))"
ORACLES = {
    "majority_kind": "WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS p FROM documents GROUP BY ALL) SELECT source, lang FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, p) = 1",
    "chapter_assembly": "WITH p AS (SELECT conv_id % 20 AS chapter, conv_id AS page, string_agg(text, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY ALL) SELECT chapter, md5(string_agg('[[page: ' || page || ']]' || chr(10) || t, chr(10) || chr(10) ORDER BY page)) AS digest, min(page) AS page_start, max(page) AS page_end FROM p GROUP BY 1",
    "note_backlinks": "WITH n AS (SELECT item_id AS note_id, item_id * 3 + 2 AS page FROM benchmark) SELECT note_id, max(doc_id) AS link_page, CASE WHEN max(doc_id) IS NOT NULL THEN 0 END::bigint AS link_pos FROM n LEFT JOIN documents ON doc_id BETWEEN page - 2 AND page AND regexp_matches(text, '(?:\\[1\\]|[a-z.,;]1(?:[^0-9]|$)|\\^1)') GROUP BY 1",
    "toc_page_range": f"""WITH l AS (SELECT source, doc_id // 20 AS page, doc_id, unnest(string_split(text, chr(10))) AS r, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), m AS (SELECT *, CASE WHEN length(r) % 3 = 0 THEN r || ' .... 12' ELSE r END AS x FROM l), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m WHERE {T} <> ''),
 s AS (SELECT source, page, doc_id, count(*) AS n, sum(regexp_matches({T}, '\\.{{2,}}[ \\t]*[0-9]+$|^[0-9]+[ \\t]+[A-Z].*[0-9]+$')::int) AS h, bool_or(k <= 5 AND regexp_matches(lower(x), '^\\s*(?:table of )?contents\\s*$')) AS hd FROM f GROUP BY ALL), g AS (SELECT source, page FROM s WHERE page <= 35 AND h * 100 + CASE WHEN hd THEN 25 * n ELSE 0 END >= 18 * n),
 st AS (SELECT source, min(page) AS start FROM g GROUP BY 1), e AS (SELECT source, start, max(page) AS e FROM g JOIN st USING (source) WHERE page <= start + 6 GROUP BY ALL) SELECT source, start, CASE WHEN e - start + 1 > 4 THEN start + 3 ELSE e END AS "end" FROM e""",
    "toc_depth_filter": "WITH e AS (SELECT l_orderkey AS book, l_partkey % 4 + 1 AS depth FROM lineitem), k AS (SELECT *, sum((depth <= 2)::int) OVER (PARTITION BY book) AS k FROM e) SELECT book, count(*) AS entries, max(depth) AS deepest FROM k WHERE depth <= 2 OR k = 0 GROUP BY 1",
    "outline_dedupe": "WITH m AS (SELECT l_orderkey % 100 AS book, l_linenumber AS page, lower(l_returnflag) AS t, min({'level': l_partkey % 3, 'title': l_returnflag}) AS m FROM lineitem GROUP BY ALL) SELECT book, page, m.level AS level, m.title AS title FROM m",
    "id_coverage": "SELECT source, count(*) AS rows, count(quality) AS given FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1",
    "resume_decisions": f"WITH {LOG}, d AS (SELECT seq, CASE WHEN seq % 7 = 0 THEN 'locked' WHEN seq % 11 = 0 THEN 'needs_human' WHEN event = 'attempt_failure' THEN 'permanent' WHEN chunk % 5 >= 3 THEN 'exhausted' WHEN epoch(TIMESTAMP '2024-01-15 00:00:00')::bigint - floor(epoch_us(ts) / 1000000)::bigint < 864000 THEN 'cooling_down' ELSE 'resume' END AS decision FROM lg) SELECT decision, count(*) AS n, max(seq) AS last FROM d GROUP BY 1",
    "merged_progress": "SELECT doc_id, (10 + floor(least(greatest(doc_id % 50, CASE WHEN doc_id % 3 = 0 THEN length(text) % 120 ELSE 0 END), 100) * 80 / 100))::bigint AS percent FROM documents",
    "oldest_first": f"WITH {LOG}, m AS (SELECT key AS lane, min({{'time': epoch_us(ts), 'path': seq::varchar}}) AS m FROM lg GROUP BY 1) SELECT lane, m.time AS time, m.path AS path FROM m",
    "last_positions": f"WITH {LOG}, m AS (SELECT key AS book, max({{'ts': epoch_us(ts), 'seq': seq, 'p': chunk}}) AS m FROM lg GROUP BY 1) SELECT book, m.ts AS ts, m.p AS position FROM m",
    "log_snapshots": f"WITH {LOG} SELECT key, arg_max(event, seq) AS state, max(seq) AS seq, count(*) AS revision FROM lg GROUP BY 1",
    "review_projects": """WITH d AS (SELECT source AS project, documents.doc_id, quality, toxic FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id), t AS (SELECT project, count(*) AS total, sum(coalesce(quality = 1, false)::int)::bigint AS done, sum(coalesce(toxic = 1, false)::int)::bigint AS pending FROM d GROUP BY 1), v AS (SELECT project, 'v' || max(doc_id) AS latest FROM d WHERE quality = 0 GROUP BY 1)
 SELECT t.*, latest, CASE WHEN latest IS NOT NULL THEN 'exported' WHEN done = total THEN 'reviewed' WHEN done > 0 THEN 'in_review' ELSE 'unreviewed' END AS status FROM t LEFT JOIN v ON t.project = v.project""",
    "workspace_status": "SELECT CASE WHEN doc_id % 13 = 0 THEN 'failed' WHEN doc_id % 17 = 0 THEN 'processing' WHEN doc_id % 11 = 0 THEN 'exported' WHEN doc_id % 7 = 0 THEN 'reviewed' WHEN doc_id % 5 = 0 THEN 'needs_review' WHEN doc_id % 3 = 0 THEN 'ready_to_translate' WHEN doc_id % 2 = 0 THEN 'needs_glossary' ELSE 'new' END AS status, count(*) AS n FROM documents GROUP BY 1",
    "excluded_terms": f"WITH {CAND} SELECT 'shown' AS part, count(*) AS n FROM cand WHERE length(phrase) % 2 = 1 UNION ALL SELECT 'hidden', count(*) FROM cand WHERE length(phrase) % 2 = 0",
    "candidate_integrity": """WITH l AS (SELECT unnest(string_split(text, chr(10))) AS l FROM documents), w AS (SELECT regexp_extract(l, '^([A-Za-z]+ [A-Za-z]+)', 1) AS p FROM l), r AS (SELECT CASE WHEN regexp_matches(p, '^(?:See|Cf|Ibid|Vol|No|Ed|Eds|Trans)\\b') THEN 'bibliographic' WHEN regexp_matches(p, '\\b[IVX] [a-z]') THEN 'malformed_numeral' WHEN regexp_matches(p, '^(?:When|While|Although|Because|If|As|After|Before|Since)\\b') THEN 'clause_lead'
 WHEN regexp_matches(lower(p), '\\b(?:of|and|the|in|on|for|from|with|to|at|by|or|as|an|a)$') THEN 'dangling' WHEN regexp_matches(lower(p), '^\\S+ centur(?:y|ies)$') THEN 'century' WHEN regexp_matches(lower(p), '^(?:far|near|middle|upper|lower|central|northern|southern|eastern|western) (?:east|west|north|south|africa|asia|europe)$') THEN 'compass' ELSE 'ok' END AS reason FROM w WHERE p <> '') SELECT reason, count(*) AS n FROM r GROUP BY 1""",
    "missing_targets": f"WITH {PAIRS}, t AS (SELECT DISTINCT conv_id, unnest(['the', 'la', 'und']) AS target FROM p WHERE out IS NOT NULL) SELECT target, count(*) AS n FROM t JOIN p USING (conv_id) WHERE out IS NOT NULL AND NOT contains(out, target) GROUP BY 1",
    "suggestion_merge": "WITH s AS (SELECT (doc_id % 300)::varchar AS source, arg_max('new' || doc_id, doc_id) AS t FROM documents WHERE doc_id % 3 = 0 GROUP BY 1) SELECT doc_id::varchar AS source, CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 4 = 0 THEN 'old' END ELSE coalesce(t, CASE WHEN doc_id % 4 = 0 THEN 'old' END) END AS target FROM documents LEFT JOIN s ON s.source = doc_id::varchar",
    "link_rewrite": f"WITH {LINKS}, f AS (SELECT DISTINCT regexp_extract(href, '^([^#]*)', 1) AS path FROM a WHERE page_id % 2 = 0) SELECT page_id, pos, CASE WHEN path IS NOT NULL THEN 'out' || path || regexp_extract(href, '(#.*)$', 1) ELSE href END AS target FROM a LEFT JOIN f ON path = regexp_extract(href, '^([^#]*)', 1)",
}
