"""Queries of the lookup, ordered, glossary and review operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators import glossary as G
from quire.operators import lookup as K
from quire.operators import ordered as O
from quire.operators import review as R
from quire.sources.tables import table

#: `documents` as a book's pages: a source is a book, ids in order are its pages.
PAGES = "SELECT source AS book, doc_id AS page_no, length(text) >= 400 AS has_content, CASE WHEN doc_id % 13 = 0 THEN 'notice' END AS skip_reason FROM documents"
OWNED = "SELECT source AS book, doc_id % 7 AS chapter_index, doc_id % 7 = 3 AS resource_only, doc_id AS page_no FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT source, 90 + doc_id % 3, doc_id % 2 = 0, doc_id FROM documents WHERE doc_id % 17 = 0"


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    pages = docs.select(F.col("source").alias("book"), F.col("doc_id").alias("page_no"), (F.length("text") >= 400).alias("has_content"), F.when(F.col("doc_id") % 13 == 0, "notice").alias("skip_reason"))
    first = docs.where("doc_id % 11 <> 0").select(F.col("source").alias("book"), (F.col("doc_id") % 7).alias("chapter_index"), (F.col("doc_id") % 7 == 3).alias("resource_only"), F.col("doc_id").alias("page_no"))
    second = docs.where("doc_id % 17 = 0").select(F.col("source").alias("book"), (90 + F.col("doc_id") % 3).alias("chapter_index"), (F.col("doc_id") % 2 == 0).alias("resource_only"), F.col("doc_id").alias("page_no"))
    return pages, first.unionAll(second)


def page_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.page_ledger(*_pages(spark, sf_dir))


def chapter_page_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.ledger_summary(K.page_ledger(*_pages(spark, sf_dir)))


def uncovered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of content pages without an owner."""
    pages, owned = _pages(spark, sf_dir)
    open_pages = pages.where("has_content").join(owned.select("book", "page_no").distinct(), ["book", "page_no"], "left_anti")
    numbered = open_pages.withColumn("n", F.floor(F.col("page_no") / 20))
    return K.islands(numbered.select("book", "n").distinct(), ["book"], "n")


def integrity_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = page_ledger(spark, sf_dir)
    labels = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumnRenamed("source", "book")
    dims = ledger.groupBy("book").agg(F.sum((~F.col("missing")).cast("long")).alias("covered"), F.count("*").alias("total")).withColumn("dimension", F.lit("pages")).unionByName(
        labels.groupBy("book").agg(F.sum("quality").cast("long").alias("covered"), F.count("*").alias("total")).withColumn("dimension", F.lit("reviews")))
    failures = ledger.where("missing and page_no % 5 = 0").select("book", F.lit("missing_pages").alias("failure"), F.format_string("p%08d", "page_no").alias("id")).unionByName(
        labels.where("toxic = 1").select("book", F.lit("unresolved_review").alias("failure"), F.format_string("r%08d", "doc_id").alias("id")))
    return K.integrity(dims, failures)


def outline_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines between an order's outline entries: start <= line < next later start."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("page"), "l_quantity")
    outline = table(spark, sf_dir, "lineitem").where("l_linenumber % 3 = 1").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("start"))
    return K.outline_pages(outline, items, "k", "start", "page").groupBy("k", "start").agg(F.count("*").alias("pages"), F.max("page").alias("last"))


def outline_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends and parents of entries with levels."""
    e = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey")).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 3).alias("level"), (F.col("l_linenumber") * 10).alias("start"))
    ends = K.interval_ends(e, "k", "pos", "level", "start", F.lit(999))
    return ends.join(K.parents(e, "k", "pos", "level").select("k", "pos", "parent"), ["k", "pos"]).select("k", "pos", "start", F.col("end").cast("long").alias("end"), "parent")


def chapter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters and flags by book, with a translate-only sum."""
    docs = table(spark, sf_dir, "documents")
    n, t = F.length("text"), F.col("lang") != "en"
    return docs.groupBy(F.col("source").alias("book")).agg(F.count("*").alias("chapters"), F.sum(n).cast("long").alias("chars"), F.sum(F.when(t, n).otherwise(0)).cast("long").alias("translate_chars"), F.sum(F.ceil(n / 5000)).cast("long").alias("chunks"), F.sum((n > 9000).cast("long")).alias("long_chapters"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` as layout blocks: an order is a page."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"), F.max("l_quantity").alias("l_quantity"))
    return items.select(F.col("l_orderkey").alias("page_no"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 560).cast("double").alias("left"), (F.col("l_suppkey") * 37 % 700).cast("double").alias("top"),
                                                   F.when(F.col("l_linenumber") == 1, "section_header").otherwise("text").alias("label"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("text"))


def column_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.column_clusters(_blocks(spark, sf_dir), ["page_no"]).select("page_no", "cluster", F.round(F.col("center") * 60).cast("long").alias("center_60"), "blocks")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir)
    return O.flows(O.nearest_column(b, O.column_clusters(b, ["page_no"]), ["page_no"]), ["page_no"])


def page_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, label and action of each page."""
    features = O.page_features(_placed(spark, sf_dir), ["page_no"]).withColumn("picture", F.lit(0.0))
    labelled = features.withColumn("label", O.content_label("magazine", F.lit(1 << 40)))
    return labelled.withColumn("action", O.page_action("magazine")).select("page_no", "chars", "blocks", "headers", "columns", "flows", "largest_flow", "label", "action")


def document_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_profiles(spark, sf_dir).withColumn("doc", F.col("page_no") % 50)
    return O.document_profile(pages, "doc", "magazine").select("doc", "pages", "accept", "assist", "skip_content", "reject_structure", (F.col("median_columns") * 2).cast("long").alias("median_columns_2"), "decision")


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = O.reading_order(_placed(spark, sf_dir), ["page_no"])
    return ordered.select("page_no", "pos", F.col("order").cast("long").alias("place"))


def title_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of an event stream: a signup begins one."""
    e = table(spark, sf_dir, "events")
    return O.title_islands(e, "user_id", "event_id", F.col("event_type") == "signup").groupBy("user_id", "chapter").agg(F.count("*").alias("pages"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def mark_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("start"))
    return O.mark_groups(marks, "user_id", "start", F.lit(10_000_000)).groupBy("user_id").agg(F.count("*").alias("groups"), F.max("count").cast("long").alias("longest"), F.sum("count").cast("long").alias("covered"))


def reading_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").select("doc_id", O.reading_units(F.transform(F.split("text", "\n"), F.length), 600).alias("u"))
    return sizes.select("doc_id", F.posexplode("u").alias("unit", "x")).select("doc_id", "unit", F.col("x.size").alias("size"), F.col("x.parts").cast("long").alias("parts"))


def boundary_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.col("l_partkey") % 15 - 2).alias("end"))
    return O.boundary_quality(b, "k", "start", "end")


def pending_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return O.pending_neighbours(turns, "conv_id", "turn", F.length("text") > 300).select("conv_id", "turn", "next_pending", "previous_pending")


def term_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.candidates(table(spark, sf_dir, "documents"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.statistics(term_candidates(spark, sf_dir)).withColumn("score", G.score(G.POLICIES["social"]))


def term_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def term_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chars = docs.groupBy("source").agg(F.sum(F.length("text")).alias("chars"))
    shown = G.ranked(_scored(spark, sf_dir).join(chars, "source"), G.Policy(least_score=-6.0), F.col("chars"))
    return shown.select("source", "key", "score", "rank")


def term_overlap_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chars = docs.groupBy("source").agg(F.sum(F.length("text")).alias("chars"))
    return G.without_contained(G.ranked(_scored(spark, sf_dir).join(chars, "source"), G.Policy(least_score=-6.0), F.col("chars")))


def pair_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.pairs(table(spark, sf_dir, "conversations"))
    return p.select("conv_id", "turn", F.length("source_text").cast("long").alias("source_chars"), F.length("translated_text").cast("long").alias("translated_chars"))


def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.items(R.pairs(table(spark, sf_dir, "conversations"))).select("conv_id", "turn", "item_id", "issue_type", "severity")


def pre_review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.pairs(table(spark, sf_dir, "conversations"))
    return R.pre_review(p, R.items(p))


def review_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "approved").otherwise("open").alias("status"), F.when(F.col("toxic") == 1, "model_rewrite").otherwise("keep").alias("action"))
    return R.completion(table(spark, sf_dir, "documents"), d, "doc_id")


def exemption_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return rows.select(R.exemption(F.col("line")).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def segments_to_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.chapters(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")
    return c.select("conv_id", F.md5("markdown").alias("digest"), F.col("blocks").cast("long").alias("blocks"))


def order_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected ids against a list that lost and swapped some."""
    t = table(spark, sf_dir, "conversations")
    want = t.select("conv_id", F.col("turn").alias("pos"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    got = t.where("(conv_id + turn) % 9 <> 0").select("conv_id", F.when(F.col("conv_id") % 5 == 0, F.col("turn") + 1).otherwise(F.col("turn")).alias("pos"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return K.conservation(want, got, "conv_id")


def first_missing_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "lineitem").where("l_partkey % 4 <> 0").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") - 1).alias("idx"))
    return K.first_missing(have, "k", "idx").select("k", F.col("first_missing").cast("long").alias("first_missing"))


def page_offset_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), "doc_id", F.md5(F.split("text", "\n")[0]).alias("key"))
    pages = d.select("book", F.col("doc_id").alias("page"), "key")
    entries = d.where("doc_id % 3 = 0").select("book", F.col("doc_id").alias("pos"), (F.col("doc_id") - F.col("doc_id") % 5).alias("printed"), "key")
    return K.page_offset(entries, pages, "book")


def latest_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return K.latest(e, ["user_id", "k"], ["event_id"], "event_type")


def glossary_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels updated by later decisions (L04, L19): changed keys are replaced, new ones appended."""
    base = table(spark, sf_dir, "labels").select("doc_id", "quality")
    changes = table(spark, sf_dir, "documents").where("doc_id % 10 = 0").select("doc_id", F.lit(9).alias("quality"))
    return K.upsert(base, changes.withColumn("quality", F.col("quality").cast(base.schema["quality"].dataType)), ["doc_id"])


def glossary_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates, active and blank entries by source."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("candidates"), F.sum((F.col("quality") == 1).cast("long")).alias("active"), F.sum(F.col("quality").isNull().cast("long")).alias("undecided"))


def workspace_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best version of each source and language, and its history."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    prio = F.when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    return d.groupBy("source", "lang").agg(F.max(F.struct(prio.alias("p"), F.col("doc_id").alias("d"))).alias("m"), F.count("*").alias("history")).select("source", "lang", F.col("m.p").alias("priority"), F.col("m.d").alias("best"), "history")


def note_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark notes placed into the chapter of their page (F19, E16): page lists expand, then an equi-join."""
    notes = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") * 7 % 200).alias("page"))
    spans = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 10).alias("chapter")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    chapters = spans.select("chapter", F.explode(F.sequence("a", "b")).alias("page"))
    return notes.join(chapters, "page").select("item_id", "chapter", "page")


QUERIES = {f.__name__: f for f in (page_ledger, chapter_page_ledger, uncovered_pages, integrity_ledger, outline_interval_join, outline_depths, chapter_report, column_clusters, page_profiles, document_profile, reading_order, title_islands, mark_groups,
                                   reading_units, boundary_quality, pending_neighbours, term_candidates, term_scores, term_topk, term_overlap_suppressed, pair_alignment, review_items, pre_review_report, review_completion, exemption_hist,
                                   segments_to_chapters, order_conservation, first_missing_index, page_offset_vote, latest_decision, glossary_upsert, glossary_status, workspace_grouping, note_injection)}

LEDGER = f"""p AS ({PAGES}), c AS ({OWNED}), o AS (SELECT book, page_no, min({{'r': resource_only::int, 'c': chapter_index}}) AS o, sum((NOT resource_only)::int)::bigint AS bodies FROM c GROUP BY ALL),
 ledger AS (SELECT p.book, p.page_no, o.o.c AS owner, has_content AND o.o IS NULL AND skip_reason IS NULL AS missing, coalesce(bodies, 0) > 1 AS duplicate, CASE WHEN skip_reason IS NOT NULL THEN 'skipped' WHEN has_content AND o.o.r = 1 THEN 'resource' WHEN has_content THEN 'content' ELSE 'blank' END AS disposition FROM p LEFT JOIN o ON p.book = o.book AND p.page_no = o.page_no)"""
BLOCKS = "b AS (SELECT l_orderkey AS page_no, l_linenumber AS pos, (min(l_partkey) % 560)::double AS lft, (min(l_suppkey) * 37 % 700)::double AS top, CASE WHEN l_linenumber = 1 THEN 'section_header' ELSE 'text' END AS label, max(l_quantity)::int AS chars FROM lineitem GROUP BY l_orderkey, l_linenumber)"
CLUSTERS = BLOCKS + """, e AS (SELECT *, coalesce((lft - lag(lft) OVER (PARTITION BY page_no ORDER BY lft) > 90)::int, 0) AS nw FROM b), g AS (SELECT *, sum(nw) OVER (PARTITION BY page_no ORDER BY lft)::int AS cluster FROM e), cl AS (SELECT page_no, cluster, avg(lft) AS center, count(*) AS blocks FROM g GROUP BY ALL)"""
PLACED = CLUSTERS + """, n AS (SELECT b.*, cl.cluster AS col FROM b JOIN cl USING (page_no) QUALIFY row_number() OVER (PARTITION BY page_no, pos ORDER BY abs(center - lft), cl.cluster) = 1),
 f AS (SELECT *, coalesce((lag(top) OVER (PARTITION BY page_no, col ORDER BY top DESC, pos) - top > 115)::int, 0) AS dr FROM n), fl AS (SELECT *, sum(dr) OVER (PARTITION BY page_no, col ORDER BY top DESC, pos) AS flow FROM f)"""
PROFILES = PLACED + """, pf AS (SELECT page_no, col, flow, sum(chars)::bigint AS c, count(*) AS n, sum((label = 'section_header')::int)::bigint AS h FROM fl GROUP BY ALL), ft AS (SELECT page_no, sum(c)::bigint AS chars, sum(n)::bigint AS blocks, sum(h)::bigint AS headers, count(DISTINCT col) AS columns, count(*) AS flows, max(c) AS largest_flow, sum((c < 40)::int)::bigint AS small FROM pf GROUP BY page_no),
 lb AS (SELECT *, CASE WHEN chars = 0 THEN 'visual_only' WHEN page_no <= 10 AND headers >= 2 AND chars < 700 AND flows <= 4 THEN 'front_matter' WHEN headers >= 3 AND chars < 650 AND blocks <= 4 THEN 'toc_or_listing' WHEN chars >= 250 THEN 'article' ELSE 'short_text' END AS label FROM ft),
 pr AS (SELECT *, CASE WHEN label IN ('visual_only', 'front_matter', 'toc_or_listing') THEN 'skip_content' WHEN flows >= 10 OR (columns >= 5 AND flows >= 5) OR (small * 4 >= flows * 3 AND flows >= 5) OR (largest_flow * 100 < chars * 22 AND flows >= 8 AND columns >= 4 AND chars >= 250) THEN 'reject_structure' WHEN label = 'article' AND (columns >= 3 OR flows >= 5) THEN 'assist' WHEN label = 'short_text' AND flows >= 5 THEN 'assist' ELSE 'accept' END AS action FROM lb)"""
PAIRS = """p AS (SELECT conv_id, turn, text AS source_text, CASE WHEN nr = 'assistant' THEN nt END AS out FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user')"""
S_STRIP = "trim(source_text, ' ' || chr(9) || chr(10) || chr(13))"
EXEMPT = """CASE WHEN {0} = '' THEN 'empty' WHEN length({0}) < 12 THEN 'too_short' WHEN regexp_matches({0}, '^!\\[[^\\]]*\\]\\([^)]*\\)$') THEN 'image' WHEN regexp_matches({0}, '^(?:[0-9]+|[ivxlcdm]+)[.)]?$') THEN 'page_number' WHEN len(regexp_extract_all({0}, 'https?://')) >= 2 THEN 'links' WHEN regexp_matches({0}, '^[A-Z][A-Za-z .-]{{2,40}}, [0-9]{{4}}') THEN 'bibliographic' END"""
ITEMS = PAIRS + f""", q AS (SELECT *, coalesce(out, '') AS t, len(regexp_extract_all(coalesce(out, ''), '[A-Za-z]')) AS a FROM p), i AS (SELECT conv_id, turn, CASE WHEN trim(t, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'missing_translation' WHEN length(source_text) >= 80 AND a > 80 THEN 'untranslated' WHEN length(source_text) >= 500 AND floor(a * 35 / 100) * 100 < length(source_text) * 16 THEN 'possibly_incomplete' END AS issue_type, {EXEMPT.format(S_STRIP)} AS ex FROM q),
 it AS (SELECT conv_id, turn, issue_type, 'high' AS severity, 'review-' || lpad(conv_id::varchar, 4, '0') || '-' || lpad((row_number() OVER (PARTITION BY conv_id ORDER BY turn))::varchar, 4, '0') AS item_id FROM i WHERE issue_type IS NOT NULL AND ex IS NULL)"""
CAND = f"""cand AS (SELECT source, doc_id, phrase, count(*) AS n FROM (SELECT source, doc_id, unnest(list_concat(regexp_extract_all(text, '{G.PHRASE}'), regexp_extract_all(text, '{G.CONNECTED}'))) AS phrase FROM documents) GROUP BY ALL)"""
MARKS = " + ".join(f"contains(key, '{m}')::int" for m in G.DOMAIN_MARKERS)
EVENTS = " OR ".join(f"contains(key, '{m}')" for m in G.EVENT_MARKERS)
SCORED = CAND + f""", bd AS (SELECT source, lower(phrase) AS key, doc_id, sum(n)::bigint AS n, min(phrase) AS ph FROM cand GROUP BY ALL), vr AS (SELECT source, lower(phrase) AS key, count(DISTINCT phrase) AS variants FROM cand GROUP BY ALL), st AS (SELECT source, key, sum(n)::bigint AS occurrences, count(*) AS chapters, min(ph) AS phrase FROM bd GROUP BY ALL),
 m AS (SELECT st.*, variants, {MARKS} AS marks, ({EVENTS}) AS ev, len(string_split(phrase, ' ')) AS words FROM st JOIN vr USING (source, key)),
 sc AS (SELECT source, key, occurrences, chapters, variants, phrase, (CASE WHEN occurrences >= 8 THEN 60 WHEN occurrences >= 4 THEN 40 WHEN occurrences >= 2 THEN 20 ELSE -20 END) + (CASE WHEN chapters >= 4 THEN 50 WHEN chapters >= 2 THEN 30 ELSE -15 END) + least(40, 15 * marks)
  + (CASE WHEN words = 1 THEN 25 WHEN words >= 3 THEN 20 WHEN ev THEN 15 WHEN regexp_matches(phrase, '^[A-Z][a-z]+(?: [A-Z][a-z]+){{1,2}}$') AND marks = 0 THEN -10 ELSE -5 END) + (CASE WHEN regexp_matches(phrase, '(?:Press|University|Institute)$') THEN -40 ELSE 0 END) + (CASE WHEN words = 2 AND marks = 0 AND occurrences <= 3 AND chapters <= 2 THEN -30 ELSE 0 END) AS score FROM m)"""

ORACLES = {
    "page_ledger": f"WITH {LEDGER} SELECT * FROM ledger",
    "chapter_page_ledger": f"""WITH {LEDGER} SELECT book, sum((disposition = 'content')::int)::bigint AS content, sum((disposition = 'resource')::int)::bigint AS resource, sum((disposition = 'skipped')::int)::bigint AS skipped, sum((disposition = 'blank')::int)::bigint AS blank, sum(missing::int)::bigint AS missing, sum(duplicate::int)::bigint AS duplicate, sum((disposition IN ('content', 'resource') AND NOT missing)::int)::bigint AS covered, sum(missing::int) = 0 AND sum(duplicate::int) = 0 AS ready FROM ledger GROUP BY book""",
    "uncovered_pages": f"WITH p AS ({PAGES}), c AS ({OWNED}), n AS (SELECT DISTINCT book, page_no // 20 AS n FROM p WHERE has_content AND NOT EXISTS (SELECT 1 FROM c WHERE c.book = p.book AND c.page_no = p.page_no)), i AS (SELECT *, n - row_number() OVER (PARTITION BY book ORDER BY n) AS i FROM n) SELECT book, min(n) AS first, max(n) AS last, count(*) AS n FROM i GROUP BY book, i",
    "integrity_ledger": f"""WITH {LEDGER}, lb AS (SELECT source AS book, doc_id, quality, toxic FROM documents JOIN labels USING (doc_id)), d AS (SELECT book, sum((NOT missing)::int) AS covered, count(*) AS total FROM ledger GROUP BY 1 UNION ALL SELECT book, sum(quality), count(*) FROM lb GROUP BY 1),
 f AS (SELECT book, 'missing_pages' AS failure, printf('p%08d', page_no) AS id FROM ledger WHERE missing AND page_no % 5 = 0 UNION ALL SELECT book, 'unresolved_review', printf('r%08d', doc_id) FROM lb WHERE toxic = 1), g AS (SELECT book, sum((failure <> 'unresolved_review')::int)::bigint AS blocking, count(*) AS failures, array_to_string(list_sort(list_distinct(list(id)))[1:8], ',') AS sample FROM f GROUP BY 1), cov AS (SELECT book, count(*) AS dimensions, sum((covered < total)::int)::bigint AS open_dimensions FROM d GROUP BY 1)
 SELECT cov.book, dimensions, open_dimensions, coalesce(blocking, 0) AS blocking, coalesce(failures, 0) AS failures, coalesce(sample, '') AS sample, coalesce(blocking, 0) = 0 AS technical_ready, coalesce(failures, 0) = 0 AS approved_ready FROM cov LEFT JOIN g ON cov.book = g.book""",
    "outline_interval_join": "WITH o AS (SELECT l_orderkey AS k, l_linenumber AS start FROM lineitem WHERE l_linenumber % 3 = 1), d AS (SELECT k, start, lead(start) OVER (PARTITION BY k ORDER BY start) AS nx FROM (SELECT DISTINCT * FROM o)), s AS (SELECT o.k, o.start, nx FROM o JOIN d ON o.k = d.k AND o.start = d.start) SELECT s.k, start, count(*) AS pages, max(l_linenumber) AS last FROM s JOIN lineitem l ON l.l_orderkey = s.k AND l_linenumber >= start AND (nx IS NULL OR l_linenumber < nx) GROUP BY ALL",
    "outline_depths": "WITH e AS (SELECT l_orderkey AS k, l_linenumber AS pos, min(l_partkey) % 3 AS level, l_linenumber * 10 AS start FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT k, pos, start, coalesce((SELECT min(x.start) FROM e x WHERE x.k = e.k AND x.pos > e.pos AND x.level <= e.level) - 1, 999)::bigint AS end, (SELECT max(x.pos) FROM e x WHERE x.k = e.k AND x.pos < e.pos AND x.level < e.level) AS parent FROM e",
    "chapter_report": "SELECT source AS book, count(*) AS chapters, sum(length(text))::bigint AS chars, sum(CASE WHEN lang <> 'en' THEN length(text) ELSE 0 END)::bigint AS translate_chars, sum(ceil(length(text) / 5000.0))::bigint AS chunks, sum((length(text) > 9000)::int)::bigint AS long_chapters FROM documents GROUP BY 1",
    "column_clusters": f"WITH {CLUSTERS} SELECT page_no, cluster, round(center * 60)::bigint AS center_60, blocks FROM cl",
    "page_profiles": f"WITH {PROFILES} SELECT page_no, chars, blocks, headers, columns, flows, largest_flow, label, action FROM pr",
    "document_profile": f"""WITH {PROFILES}, d AS (SELECT page_no % 50 AS doc, count(*) AS pages, sum((action = 'accept')::int)::bigint AS accept, sum((action = 'assist')::int)::bigint AS assist, sum((action = 'skip_content')::int)::bigint AS skip_content, sum((action = 'reject_structure')::int)::bigint AS reject_structure, (median(columns) * 2)::bigint AS median_columns_2 FROM pr GROUP BY 1) SELECT *, CASE WHEN reject_structure * 100 > pages * 40 THEN 'reject' WHEN assist * 5 > pages THEN 'review' ELSE 'accept' END AS decision FROM d""",
    "reading_order": f"WITH {PLACED}, h AS (SELECT *, top >= 560 AND (label = 'section_header' OR chars <= 60) AS hd FROM fl) SELECT page_no, pos, row_number() OVER (PARTITION BY page_no ORDER BY CASE WHEN hd THEN 0 ELSE 1 END, CASE WHEN hd THEN 0 ELSE col END, top DESC, lft, pos) - 1 AS place FROM h",
    "title_islands": "WITH c AS (SELECT *, sum((event_type = 'signup')::int) OVER (PARTITION BY user_id ORDER BY event_id)::bigint AS chapter FROM events) SELECT user_id, chapter, count(*) AS pages, min(event_id) AS first, max(event_id) AS last FROM c GROUP BY ALL",
    "mark_groups": "WITH m AS (SELECT user_id, event_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 10000000) - event_id AS n FROM events WHERE event_type = 'purchase') SELECT user_id, count(*) AS groups, max(n)::bigint AS longest, sum(n)::bigint AS covered FROM m GROUP BY 1",
    "reading_units": """WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS c FROM documents), w AS (SELECT doc_id, 1 AS i, 0 AS unit, c[1] AS size, 1 AS parts, c FROM l UNION ALL SELECT doc_id, i + 1, CASE WHEN size >= 600 THEN unit + 1 ELSE unit END, CASE WHEN size >= 600 THEN c[i + 1] ELSE size + c[i + 1] END, CASE WHEN size >= 600 THEN 1 ELSE parts + 1 END, c FROM w WHERE i < len(c)) SELECT doc_id, unit, max(size)::bigint AS size, max(parts)::bigint AS parts FROM w GROUP BY ALL""",
    "boundary_quality": 'WITH b AS (SELECT l_orderkey AS k, l_linenumber * 10 AS s, l_linenumber * 10 + l_partkey % 15 - 2 AS e FROM lineitem), p AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM b) SELECT k, sum((e < s)::int)::bigint AS invalid, sum(coalesce(pe >= s, false)::int)::bigint AS overlap, sum(coalesce(s > pe + 1, false)::int)::bigint AS gap FROM p GROUP BY k',
    "pending_neighbours": "WITH p AS (SELECT conv_id, turn, CASE WHEN length(text) > 300 THEN turn END AS p FROM conversations) SELECT conv_id, turn, coalesce(min(p) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(p) OVER (PARTITION BY conv_id)) AS next_pending, coalesce(max(p) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), max(p) OVER (PARTITION BY conv_id)) AS previous_pending FROM p",
    "term_candidates": f"WITH {CAND} SELECT * FROM cand",
    "term_scores": f"WITH {SCORED} SELECT * FROM sc",
    "term_topk": f"""WITH {SCORED}, ch AS (SELECT source, sum(length(text)) AS chars FROM documents GROUP BY 1), g AS (SELECT sc.*, chars, count(*) OVER (PARTITION BY sc.source) AS n, max(score) OVER (PARTITION BY sc.source) AS top, row_number() OVER (PARTITION BY sc.source ORDER BY score DESC, occurrences DESC, key) AS rank FROM sc JOIN ch ON sc.source = ch.source WHERE score >= -60)
 SELECT source, key, score, rank FROM g WHERE (score >= CASE WHEN n <= 30 THEN -60 ELSE greatest(-60, least(65, top - 40)) END OR rank <= 15) AND rank <= least(200, greatest(20, 20 + floor(chars / 12000)))""",
    "pair_alignment": f"WITH {PAIRS} SELECT conv_id, turn, length(source_text) AS source_chars, length(out) AS translated_chars FROM p",
    "review_items": f"WITH {ITEMS} SELECT * FROM it",
    "pre_review_report": f"WITH {ITEMS}, t AS (SELECT count(*) AS total FROM p), f AS (SELECT count(*) AS flagged FROM it) SELECT issue_type, severity, count(*) AS n, any_value(total) AS total, any_value(flagged) AS flagged, greatest(any_value(total) - any_value(flagged), 0) AS clean FROM it, t, f GROUP BY ALL",
    "review_completion": "SELECT count(*) AS scope, coalesce(sum((quality = 1)::int), 0)::bigint AS reviewed, coalesce(sum((toxic = 1)::int), 0)::bigint AS pending, floor(100 * coalesce(sum((quality = 1)::int), 0) / count(*))::bigint AS percent FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "exemption_hist": f"WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT {EXEMPT.format('''trim(line, ' ' || chr(9) || chr(10) || chr(13))''')} AS reason, count(*) AS n FROM l GROUP BY 1 HAVING reason IS NOT NULL",
    "segments_to_chapters": "SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest, count(*) AS blocks FROM conversations WHERE trim(text) <> '' GROUP BY 1",
    "order_conservation": "WITH a AS (SELECT conv_id, turn AS pos, conv_id * 1000 + turn AS id FROM conversations), b AS (SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN turn + 1 ELSE turn END AS pos, conv_id * 1000 + turn AS id FROM conversations WHERE (conv_id + turn) % 9 <> 0), j AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.pos, b.pos) AS pos, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'extra' WHEN a.id <> b.id THEN 'order' END AS problem FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.pos = b.pos) SELECT * FROM j WHERE problem IS NOT NULL",
    "first_missing_index": "WITH h AS (SELECT DISTINCT l_orderkey AS k, l_linenumber - 1 AS i FROM lineitem WHERE l_partkey % 4 <> 0), g AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS g FROM h) SELECT k, coalesce(min(CASE WHEN i <> g THEN g END), max(g) + 1)::bigint AS first_missing FROM g GROUP BY k",
    "page_offset_vote": "WITH d AS (SELECT source AS book, doc_id, md5(string_split(text, chr(10))[1]) AS key FROM documents), f AS (SELECT book, key, min(doc_id) AS page FROM d GROUP BY ALL), h AS (SELECT d.book, page - (doc_id - doc_id % 5) AS o FROM d JOIN f ON d.book = f.book AND d.key = f.key WHERE doc_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY d.book ORDER BY doc_id) <= 6) SELECT book, trunc(median(o))::bigint AS \"offset\", count(*) AS votes FROM h GROUP BY book",
    "latest_decision": "SELECT user_id, json_extract(props, '$.k')::int AS k, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY ALL",
    "glossary_upsert": "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 10 = 0) UNION ALL SELECT doc_id, 9 FROM documents WHERE doc_id % 10 = 0",
    "glossary_status": "SELECT source, count(*) AS candidates, sum((quality = 1)::int)::bigint AS active, sum((quality IS NULL)::int)::bigint AS undecided FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1",
    "workspace_grouping": "WITH d AS (SELECT source, lang, documents.doc_id, CASE WHEN quality = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END AS p FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id), m AS (SELECT source, lang, max({'p': p, 'd': doc_id}) AS m, count(*) AS history FROM d GROUP BY ALL) SELECT source, lang, m.p AS priority, m.d AS best, history FROM m",
    "note_injection": "WITH s AS (SELECT doc_id // 10 AS chapter, min(doc_id) AS a, max(doc_id) AS b FROM documents GROUP BY 1), c AS (SELECT chapter, unnest(range(a, b + 1)) AS page FROM s) SELECT item_id, chapter, page FROM (SELECT item_id, item_id * 7 % 200 AS page FROM benchmark) n JOIN c USING (page)",
}
