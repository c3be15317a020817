"""Queries of the draft operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import drafts as D
from quire.sources.tables import table


def boundary_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each order's boundary; some boundaries run backwards or have no end."""
    li = table(spark, sf_dir, "lineitem")
    start, end = F.min("l_partkey") % 9, F.max("l_partkey") % 9
    chapters = li.groupBy(F.col("l_orderkey").alias("book")).agg(start.alias("page_start"), end.alias("page_end"))
    pages = li.select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").cast("long").alias("page")).distinct()
    return D.pages_between(chapters, pages, "book").select("book", "page", "page_start", "page_end")


def part_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored parts of even conversations, the whole of odd ones."""
    c = table(spark, sf_dir, "conversations")
    even = F.when(F.col("conv_id") % 2 == 0, F.array(F.struct(F.col("role").alias("source"), F.col("text").alias("translation")), F.struct(F.col("text").alias("source"), F.col("role").alias("translation"))))
    return D.aligned_parts(c.select("conv_id", "turn", F.col("role").alias("source"), F.col("text").alias("translation"), even.alias("parts")))


def adopted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("t"), (F.col("doc_id") % 500).cast("string"))
    candidates = d.select(name.alias("source"), F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("s"), F.col("doc_id").cast("string"))).alias("target_suggestion"), F.col("doc_id").alias("pos"))
    active = d.where("doc_id % 7 = 0").select(name.alias("source"), F.lit("x").alias("target"), F.when(F.col("doc_id") % 2 == 0, "active").otherwise("open").alias("status"))
    decisions = d.where("doc_id % 5 = 0").select(name.alias("source"), F.when(F.col("doc_id") % 3 == 0, "rejected").otherwise("active").alias("status"), F.col("doc_id").alias("seq"))
    return D.adopt_pending(candidates, active, decisions)


def segment_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    name = (F.col("event_id") % 211).cast("string")
    marks = e.select(F.col("user_id").alias("book"), name.alias("segment_id"), F.col("event_type").alias("title"), F.col("event_id").cast("string").alias("mark_id"), F.col("event_id").alias("seq"))
    segments = e.select(F.col("user_id").alias("book"), name.alias("segment_id")).distinct().where("cast(segment_id as int) % 3 > 0").withColumn("segment_index", F.col("segment_id").cast("long"))
    return D.chapter_marks(marks, segments, "book")


def untranslated_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    chapters = d.select(F.col("doc_id").alias("chapter_index"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("title"), F.col("text").alias("markdown"), (F.col("doc_id") % 2 == 0).alias("toc"))
    return D.passthrough(chapters).select("chapter_index", "title", F.length("markdown").cast("long").alias("chars"), F.md5(F.col("markdown").cast("binary")).alias("digest"))


def salvaged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks of a conversation, of which every third is there; the translator refuses texts over 400 characters."""

    def short(text: str) -> str:
        if len(text) > 400:
            raise ValueError("too long")
        return text.upper()

    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("index"), "text")
    saved, _ = D.salvage(c, c.where("(book + index) % 3 = 0").select("book", "index"), (short,), "book")
    return saved.select("book", "index", "attempt", F.md5(F.col("translated").cast("binary")).alias("digest"))


QUERIES = {f.__name__: f for f in (boundary_pages, part_alignment, adopted_terms, segment_marks, untranslated_chapters, salvaged_chunks)}
_BLANK = "' ' || chr(9) || chr(10) || chr(13)"
ORACLES = {
    "boundary_pages": """WITH c AS (SELECT l_orderkey AS book, min(l_partkey) % 9 AS page_start, max(l_partkey) % 9 AS page_end FROM lineitem GROUP BY 1),
 p AS (SELECT DISTINCT l_orderkey AS book, l_linenumber::bigint AS page FROM lineitem)
 SELECT book, page, page_start, page_end FROM c JOIN p USING (book)
 WHERE page_start > 0 AND page_end > 0 AND ((page >= page_start AND page <= page_end) OR (page >= page_end AND page <= page_start))""",
    "part_alignment": """SELECT conv_id, turn, 0 AS part, role AS source, text AS translation FROM conversations
 UNION ALL SELECT conv_id, turn, 1, text, role FROM conversations WHERE conv_id % 2 = 0""",
    "adopted_terms": """WITH d AS (SELECT *, 't' || (doc_id % 500) AS name FROM documents),
 last AS (SELECT name, CASE WHEN max(doc_id) % 3 = 0 THEN 'rejected' ELSE 'active' END AS status FROM d WHERE doc_id % 5 = 0 GROUP BY 1),
 s AS (SELECT name, min(doc_id) FILTER (WHERE doc_id % 4 > 0) AS first FROM d GROUP BY 1)
 SELECT name AS source, 's' || first AS target, CASE WHEN first IS NULL THEN 'skipped' ELSE 'confirmed' END AS outcome FROM s
 WHERE name NOT IN (SELECT name FROM last WHERE status = 'rejected') AND name NOT IN (SELECT name FROM d WHERE doc_id % 14 = 0)""",
    "segment_marks": """WITH m AS (SELECT user_id AS book, (event_id % 211)::varchar AS segment_id, event_type, event_id FROM events WHERE trim(event_type) <> '')
 SELECT book, segment_id, arg_min(event_id::varchar, event_id) AS mark_id, arg_max(trim(event_type), event_id) AS title, count(*) AS writes, segment_id::bigint AS segment_index
 FROM m WHERE segment_id::int % 3 > 0 GROUP BY 1, 2""",
    "untranslated_chapters": f"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND coalesce(source, '') <> '' THEN source ELSE 'Chapter ' || doc_id END AS title, trim(coalesce(text, ''), {_BLANK}) AS body FROM documents),
 h AS (SELECT *, '# ' || title || chr(10) || chr(10) || ltrim(array_to_string(list_filter(string_split(body, chr(10)), lambda x: NOT regexp_matches(x, '^#[ \\t]')), chr(10)), chr(10)) AS headed FROM c),
 m AS (SELECT doc_id, title, CASE WHEN body = '' THEN '' WHEN doc_id % 2 = 0 THEN trim(headed, {_BLANK}) || chr(10) ELSE body || chr(10) END AS markdown FROM h)
 SELECT doc_id AS chapter_index, title, length(markdown)::bigint AS chars, md5(markdown) AS digest FROM m""",
}
