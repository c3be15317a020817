"""Chapters from text and plans: detection, sections, canonical plans, reviewed unions, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import predicates as P
from quire.functions import text as T
from quire.operators.lines import blocks, lines


def detected(docs: DataFrame, least: int = 2000) -> DataFrame:
    """Chapters of each document at lines that look like a chapter's start (E12): chapter, title, chars, confidence.
    A part shorter than `least` joins the part before it."""
    rows = lines(docs)
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = rows.withColumn("confidence", P.chapter_line(F.col("line")))
    rows = rows.withColumn("part", F.sum(F.col("confidence").isNotNull().cast("int")).over(order))
    parts = rows.groupBy("doc_id", "part").agg(F.sum(F.length("line") + 1).alias("chars"), F.min(F.struct("pos", "line")).getField("line").alias("title"), F.max("confidence").alias("confidence"))
    parts = parts.withColumn("chapter", F.sum(((F.col("chars") >= least) | (F.col("part") == 0)).cast("int")).over(Window.partitionBy("doc_id").orderBy("part")))
    first = F.min(F.struct("part", "title", "confidence"))
    return parts.groupBy("doc_id", "chapter").agg(first.alias("_f"), F.sum("chars").alias("chars")).select("doc_id", "chapter", T.strip(F.col("_f.title")).alias("title"), "chars", F.col("_f.confidence").alias("confidence"))


def sections(docs: DataFrame) -> DataFrame:
    """Parts of each text under its top-level headings."""
    rows = lines(docs)
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = rows.withColumn("section", F.sum(F.col("line").startswith("# ").cast("int")).over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("doc_id", "section").agg(text.alias("markdown"))


def planned(plan: DataFrame, pages: DataFrame, book: str) -> DataFrame:
    """Chapters of a user's plan with the pages in their range, in order (F13): blank pages go, and pages that no
    chapter holds make chapters of their own, a run of pages each. plan: index, title, first, last; pages: page, text."""
    spans = plan.select(book, "index", "title", F.explode(F.sequence("first", "last")).alias("page"))
    full = pages.where(T.strip(F.col("text")) != "")
    owned = full.join(spans, [book, "page"])
    free = full.join(spans.select(book, "page").distinct(), [book, "page"], "left_anti")
    free = free.withColumn("_i", F.col("page") - F.row_number().over(Window.partitionBy(book).orderBy("page")))
    firsts = plan.groupBy(book).agg(F.min("first").alias("_first"))
    free = free.join(firsts, book, "left").withColumn("title", F.when(F.col("page") < F.col("_first"), "Front matter").otherwise("Supplementary"))
    both = owned.select(book, F.concat(F.lit("p"), F.col("index").cast("string")).alias("_c"), "title", "page", "text").unionByName(free.select(book, F.concat(F.lit("u"), F.col("_i").cast("string")).alias("_c"), "title", "page", "text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n")
    grouped = both.groupBy(book, "_c", "title").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), text.alias("markdown"))
    return grouped.withColumn("chapter_index", F.row_number().over(Window.partitionBy(book).orderBy("page_start", "page_end", "_c"))).drop("_c")


def with_resources(reviewed: DataFrame, base: DataFrame, book: str) -> DataFrame:
    """Reviewed chapters and the resource chapters that share no page with them, renumbered (F11). Both: chapter_index,
    source_pages; base has resource_only."""
    taken = reviewed.select(book, F.explode("source_pages").alias("_p")).distinct()
    shares = base.where("resource_only").select(book, "chapter_index", F.explode_outer("source_pages").alias("_p")).join(taken, [book, "_p"], "left_semi").select(book, "chapter_index").distinct()
    extra = base.where("resource_only").join(shares, [book, "chapter_index"], "left_anti")
    both = reviewed.select(book, "chapter_index", "source_pages").withColumn("_o", F.lit(0)).unionByName(extra.select(book, "chapter_index", "source_pages").withColumn("_o", F.lit(1)))
    return both.withColumn("new_index", F.row_number().over(Window.partitionBy(book).orderBy("_o", "chapter_index"))).drop("_o")


def with_notes(chapters: DataFrame, base: DataFrame, keys: list[str], mark: str = "\n## Notes\n") -> DataFrame:
    """The base chapter's notes at the end of a chapter that has lost them."""
    notes = base.withColumn("_at", F.instr("markdown", mark)).where("_at > 0").select(*keys, F.expr("substring(markdown, _at)").alias("_n"))
    out = chapters.join(notes, keys, "left")
    return out.withColumn("markdown", F.when(F.col("_n").isNotNull() & ~F.col("markdown").contains(mark), F.concat("markdown", "_n")).otherwise(F.col("markdown"))).drop("_n")


def detect_profile(books: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """The profile of each book by listed keywords, with its confidence (G17): keyword lists are a parameter. A year or
    century counts for humanities, tables in titles for science, and logic words weigh more from four on.
    books: book, text, titles (array)."""
    low = F.lower("text")
    hits = {k: sum(low.contains(w).cast("int") for w in ws) for k, ws in keywords.items()}
    titled = F.size(F.filter("titles", lambda x: F.lower(x).contains("table")))
    bonus = {"humanities": F.when(low.rlike(r"(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)|[0-9a-z]+th century"), 5).otherwise(0), "science": F.when(titled >= 2, 3).otherwise(0), "logic": F.when(hits.get("logic", F.lit(0)) >= 4, 6).otherwise(0)}
    scores = F.array(*[F.struct((-(hits[k] + bonus.get(k, F.lit(0)))).alias("s"), F.lit(k).alias("k")) for k in keywords])
    out = books.select("book", F.array_sort(scores).alias("_r"))
    top, second = -F.col("_r")[0]["s"], -F.col("_r")[1]["s"]
    margin = (top - second) / F.greatest(top, F.lit(1))
    return out.select("book", F.when((top <= 0) | (margin < 0.15), "social").otherwise(F.col("_r")[0]["k"]).alias("profile"),
                      F.when(top <= 0, 0.35).when(margin < 0.15, 0.45).otherwise(F.least(F.lit(0.98), 0.5 + 0.5 * margin + 0.02 * F.least(top, F.lit(20)))).alias("confidence"))


def sensitivity(text: Column, phrases: dict[str, int]) -> Column:
    """The summed weights of phrases that occur (G18); 4 is high."""
    low = F.lower(text)
    return sum((F.when(low.contains(p), w).otherwise(0) for p, w in phrases.items()), F.lit(0))


def polished(rows: DataFrame, cache: DataFrame, reject) -> DataFrame:
    """Lines replaced by their polished form where the cache has one and it isn't rejected."""
    known = cache.groupBy(T.strip(F.col("line")).alias("_k")).agg(F.max_by("polished", "seq").alias("_p"))
    out = rows.join(known, T.strip(F.col("line")) == F.col("_k"), "left")
    ok = F.col("_p").isNotNull() & reject(F.col("line"), F.col("_p")).isNull()
    return out.withColumn("line", F.when(ok, F.col("_p")).otherwise(F.col("line"))).drop("_k", "_p")


def review_segments(docs: DataFrame) -> DataFrame:
    """Blocks as review segments `doc:s001`."""
    rows = blocks(docs)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("block"))
    return rows.withColumn("segment_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.concat(F.lit("s"), F.lpad(number.cast("string"), 3, "0")))).select("doc_id", "block", "segment_id", "text")
