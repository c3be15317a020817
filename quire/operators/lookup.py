"""Joins and ledgers: page ownership, intervals, overlays, conservation (families F and G)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def next_starts(outline: DataFrame, key: str, start: str) -> DataFrame:
    """Each distinct start of `key` with the next strictly later one; duplicate starts share it."""
    distinct = outline.select(key, start).distinct()
    return distinct.withColumn("next_start", F.lead(start).over(Window.partitionBy(key).orderBy(start)))


def outline_pages(outline: DataFrame, pages: DataFrame, key: str, start: str, page: str) -> DataFrame:
    """Pages with start <= page < next start, joined on the key and the interval."""
    spans = outline.join(next_starts(outline, key, start), [key, start])
    p = pages.withColumnRenamed(key, "_key")
    return spans.join(p, (F.col(key) == F.col("_key")) & (F.col(page) >= F.col(start)) & (F.col("next_start").isNull() | (F.col(page) < F.col("next_start")))).drop("_key")


def interval_ends(entries: DataFrame, key: str, pos: str, level: str, start: str, last: Column) -> DataFrame:
    """End of each entry: one before the start of the next entry that is no deeper (F06). One fold over a
    key's entries in order, from the last, keeping the nearest start of each level."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(level).alias("l"), F.col(start).alias("s"))))
    grouped = entries.groupBy(key).agg(rows.alias("_r"))
    next_start = lambda e: F.get(F.filter("_r", lambda x: (x["p"] > e["p"]) & (x["l"] <= e["l"])), F.lit(0))["s"]
    later = F.transform("_r", lambda e: F.struct(e["p"].alias(pos), e["l"].alias(level), e["s"].alias(start), next_start(e).alias("_next")))
    return grouped.select(key, F.inline(later)).withColumn("end", F.coalesce(F.col("_next") - 1, last)).drop("_next")


def parents(entries: DataFrame, key: str, pos: str, level: str) -> DataFrame:
    """Parent of each entry: the nearest previous one of a lower level."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    before = F.collect_list(F.struct(F.col(level).alias("l"), F.col(pos).alias("p"))).over(w)
    lower = F.filter(before, lambda x: x["l"] < F.col(level))
    return entries.withColumn("parent", F.when(F.size(lower) > 0, F.element_at(lower, -1)["p"]))


def page_ledger(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """Owner and disposition of each page (F01, G08). pages: book, page_no, has_content, skip_reason; chapters:
    book, chapter_index, resource_only, page_no (a row a page). The first chapter that is no resource owns a page,
    else the first; two such owners are a duplicate; content without owner is missing unless skipped."""
    owner = chapters.groupBy("book", "page_no").agg(
        F.min(F.struct(F.col("resource_only").cast("int").alias("r"), F.col("chapter_index").alias("c"))).alias("_o"), F.sum((~F.col("resource_only")).cast("long")).alias("_bodies"))
    out = pages.join(owner, ["book", "page_no"], "left")
    skipped = F.col("skip_reason").isNotNull()
    return out.select(
        "book", "page_no", F.col("_o.c").alias("owner"), (F.col("has_content") & F.col("_o").isNull() & ~skipped).alias("missing"), (F.coalesce("_bodies", F.lit(0)) > 1).alias("duplicate"),
        F.when(skipped, "skipped").when(F.col("has_content") & (F.col("_o.r") == 1), "resource").when(F.col("has_content"), "content").otherwise("blank").alias("disposition"))


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """One row a book: counts by disposition, failures, coverage in whole numbers."""
    count = lambda c: F.sum(c.cast("long"))
    return ledger.groupBy("book").agg(
        *[count(F.col("disposition") == d).alias(d) for d in ("content", "resource", "skipped", "blank")], count(F.col("missing")).alias("missing"), count(F.col("duplicate")).alias("duplicate"),
        count((F.col("disposition").isin("content", "resource")) & ~F.col("missing")).alias("covered")).withColumn("ready", (F.col("missing") == 0) & (F.col("duplicate") == 0))


def islands(rows: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Runs of consecutive integers: first, last, length."""
    grouped = rows.withColumn("_i", F.col(n) - F.row_number().over(Window.partitionBy(*keys).orderBy(n)))
    return grouped.groupBy(*keys, "_i").agg(F.min(n).alias("first"), F.max(n).alias("last"), F.count("*").alias("n")).drop("_i")


def integrity(dims: DataFrame, failures: DataFrame) -> DataFrame:
    """Readiness of each book (G09, G10). dims: book, dimension, covered, total; failures: book, failure, id. A
    dimension's ratio is 1 if it is empty; only unresolved reviews leave a book technically ready."""
    cover = dims.groupBy("book").agg(F.count("*").alias("dimensions"), F.sum((F.col("covered") < F.col("total")).cast("long")).alias("open_dimensions"))
    bad = failures.groupBy("book").agg(F.sum((F.col("failure") != "unresolved_review").cast("long")).alias("blocking"), F.count("*").alias("failures"), F.slice(F.array_sort(F.collect_set("id")), 1, 8).alias("sample"))
    out = cover.join(bad, "book", "left").na.fill(0, ["blocking", "failures"])
    return out.withColumns({"technical_ready": F.col("blocking") == 0, "approved_ready": F.col("failures") == 0}).withColumn("sample", F.concat_ws(",", "sample"))


def conservation(expected: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Positions at which two ordered id lists differ: missing, extra or order (H12). Both have key, pos, id."""
    a, b = expected.select(key, "pos", F.col("id").alias("want")), processed.select(F.col(key).alias("_k"), F.col("pos").alias("_p"), F.col("id").alias("got"))
    both = a.join(b, (F.col(key) == F.col("_k")) & (F.col("pos") == F.col("_p")), "full_outer")
    kind = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("got") != F.col("want"), "order")
    return both.select(F.coalesce(key, "_k").alias(key), F.coalesce("pos", "_p").alias("pos"), kind.alias("problem")).where("problem is not null")


def latest(rows: DataFrame, keys: list[str], by: list[str], *keep: str) -> DataFrame:
    """The last row of each key (I05): a struct maximum, aggregated before the shuffle."""
    return rows.groupBy(*keys).agg(F.max(F.struct(*by, *keep)).alias("_m")).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in (*by, *keep)])


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `base` whose key isn't changed, and the changes."""
    return base.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def first_missing(have: DataFrame, key: str, index: str) -> DataFrame:
    """The first index from 0 that a key lacks."""
    w = Window.partitionBy(key).orderBy(index)
    gap = have.select(key, index).distinct().withColumn("_g", F.row_number().over(w) - 1)
    return gap.groupBy(key).agg(F.coalesce(F.min(F.when(F.col(index) != F.col("_g"), F.col("_g"))), F.max("_g") + 1).alias("first_missing"))


def page_offset(entries: DataFrame, pages: DataFrame, book: str, votes: int = 6) -> DataFrame:
    """Offset of a book's printed pages (F15): the median of page - printed over its first `votes` entries that
    match, cut to a whole number. entries: book, pos, printed, key; pages: book, page, key."""
    first = pages.groupBy(book, "key").agg(F.min("page").alias("page"))
    hits = entries.join(first, [book, "key"]).withColumn("_n", F.row_number().over(Window.partitionBy(book).orderBy("pos"))).where(F.col("_n") <= votes)
    return hits.groupBy(book).agg(F.median(F.col("page") - F.col("printed")).cast("long").alias("offset"), F.count("*").alias("votes"))
