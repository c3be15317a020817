"""Ordered operators: column clustering, flows, reading order, islands of titles, units (families H and D12-D13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Gap between columns, gap between flows, height of the header band (points), least characters of a main block.
COLUMN_GAP, FLOW_GAP, HEADER_TOP, MAIN_CHARS = 90.0, 115.0, 560.0, 40
#: Limits of a page profile.
SPECS = {"magazine": {"reject_ratio": 0.40, "skip": True, "front": 10, "back": 8, "assist_columns": 3, "assist_flows": 5, "reject_columns": 5, "reject_flows": 8, "hard": 10, "weak": 0.22},
         "book": {"reject_ratio": 0.18, "skip": False, "front": 4, "back": 4, "assist_columns": 2, "assist_flows": 4, "reject_columns": 4, "reject_flows": 8, "hard": 10, "weak": 0.24}}


def column_clusters(blocks: DataFrame, page: list[str], left: str = "left", gap: float = COLUMN_GAP) -> DataFrame:
    """Columns of each page: sorted left edges, a new cluster after a gap, the mean as centre."""
    w = Window.partitionBy(*page).orderBy(left)
    edges = blocks.withColumn("_new", F.coalesce((F.col(left) - F.lag(left).over(w) > gap).cast("int"), F.lit(0)))
    edges = edges.withColumn("cluster", F.sum("_new").over(w))
    return edges.groupBy(*page, "cluster").agg(F.avg(left).alias("center"), F.count("*").alias("blocks"))


def nearest_column(blocks: DataFrame, clusters: DataFrame, page: list[str], left: str = "left") -> DataFrame:
    """Each block's nearest centre, ties to the lowest index. A page has few columns: they travel as one array."""
    centers = clusters.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("cluster", "center"))).alias("_c"))
    best = F.array_min(F.transform("_c", lambda c: F.struct(F.abs(c["center"] - F.col(left)).alias("d"), c["cluster"].alias("i"))))["i"]
    return blocks.join(centers, page).withColumn("column", best).drop("_c")


def flows(blocks: DataFrame, page: list[str], top: str = "top", gap: float = FLOW_GAP) -> DataFrame:
    """Flow number of each block: in a column by falling top, a new flow after a drop."""
    w = Window.partitionBy(*page, "column").orderBy(F.desc(top), "pos")
    drop = F.lag(top).over(w) - F.col(top) > gap
    return blocks.withColumn("flow", F.sum(F.coalesce(drop, F.lit(False)).cast("int")).over(w))


def reading_order(blocks: DataFrame, page: list[str]) -> DataFrame:
    """Position of each block on its page: the header band first, then columns from the top."""
    header = (F.col("top") >= HEADER_TOP) & (F.col("label").isin("section_header", "caption") | (F.length("text") <= 60))
    w = Window.partitionBy(*page).orderBy(F.when(header, 0).otherwise(1), F.when(header, F.lit(0)).otherwise(F.col("column")), F.desc("top"), "left", "pos")
    return blocks.withColumn("order", F.row_number().over(w) - 1)


def page_features(blocks: DataFrame, page: list[str]) -> DataFrame:
    """Characters, blocks, columns, flows and the largest flow of each page, from blocks with column and flow."""
    chars = F.length("text")
    per_flow = blocks.groupBy(*page, "column", "flow").agg(F.sum(chars).alias("c"), F.count("*").alias("n"), F.sum((F.col("label") == "section_header").cast("long")).alias("h"))
    return per_flow.groupBy(*page).agg(F.sum("c").alias("chars"), F.sum("n").alias("blocks"), F.sum("h").alias("headers"), F.count_distinct("column").alias("columns"), F.count("*").alias("flows"),
                                       F.max("c").alias("largest_flow"), F.sum((F.col("c") < MAIN_CHARS).cast("long")).alias("small_flows"))


def content_label(spec: str, last_page: Column) -> Column:
    """The label of a page by its features."""
    s, c = SPECS[spec], F.col("chars")
    rules = F.when(c == 0, "visual_only")
    if s["skip"]:
        front, back = F.col("page_no") <= s["front"], F.col("page_no") > last_page - s["back"]
        rules = rules.when((F.col("picture") >= 0.78) & (c < 220) & (F.col("blocks") <= 3), "ad_or_visual").when(front & (F.col("headers") >= 2) & (c < 700) & (F.col("flows") <= 4), "front_matter")
        rules = rules.when(back & (c < 900) & (F.col("picture") >= 0.35), "back_matter").when((F.col("headers") >= 3) & (c < 650) & (F.col("blocks") <= 4), "toc_or_listing")
    return rules.when(c >= 250, "article").otherwise("short_text")


def page_action(spec: str) -> Column:
    """accept, assist, skip_content or reject_structure (D13). Ratios are compared as products of whole numbers."""
    s, f = SPECS[spec], F.col("flows")
    skip = F.col("label").isin("visual_only", "ad_or_visual", "front_matter", "back_matter", "toc_or_listing")
    reject = (f >= s["hard"]) | ((F.col("columns") >= s["reject_columns"]) & (f >= s["assist_flows"])) | ((F.col("small_flows") * 4 >= f * 3) & (f >= s["assist_flows"]))
    reject |= (F.col("largest_flow") * 100 < F.col("chars") * round(100 * s["weak"])) & (f >= s["reject_flows"]) & (F.col("columns") >= s["reject_columns"] - 1) & (F.col("chars") >= 250)
    assist = (F.col("label") == "article") & ((F.col("columns") >= s["assist_columns"]) | (f >= s["assist_flows"])) | ((F.col("label") == "short_text") & (f >= s["assist_flows"]))
    return F.when(skip, "skip_content" if s["skip"] else "assist").when(reject, "reject_structure").when(assist, "assist").otherwise("accept")


def document_profile(pages: DataFrame, doc: str, spec: str) -> DataFrame:
    """Rollup and decision of each document."""
    count = lambda a: F.sum((F.col("action") == a).cast("long"))
    out = pages.groupBy(doc).agg(F.count("*").alias("pages"), *[count(a).alias(a) for a in ("accept", "assist", "skip_content", "reject_structure")], F.median("columns").alias("median_columns"))
    return out.withColumn("decision", F.when(F.col("reject_structure") * 100 > F.col("pages") * round(100 * SPECS[spec]["reject_ratio"]), "reject").when(F.col("assist") * 5 > F.col("pages"), "review").otherwise("accept"))


def title_islands(rows: DataFrame, key: str, pos: str, is_title: Column) -> DataFrame:
    """Chapter number of each row: a title row begins one."""
    return rows.withColumn("chapter", F.sum(is_title.cast("int")).over(Window.partitionBy(key).orderBy(pos)))


def mark_groups(marks: DataFrame, key: str, start: str, total: Column) -> DataFrame:
    """[start, next start) of each mark and its count."""
    w = Window.partitionBy(key).orderBy(start)
    return marks.withColumn("stop", F.coalesce(F.lead(start).over(w), total)).withColumn("count", F.col("stop") - F.col(start))


def reading_units(sizes: Column, least: int = 1500) -> Column:
    """Greedy units of ordered sizes: a unit closes when it reaches `least`; an array of (size, parts)."""
    zero = F.expr("array(struct(cast(0 as bigint) as size, 0 as parts))")

    def put(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        new = F.struct(x.cast("bigint").alias("size"), F.lit(1).alias("parts"))
        grown = F.struct((last["size"] + x).cast("bigint").alias("size"), (last["parts"] + 1).alias("parts"))
        return F.when(last["size"] >= least, F.concat(acc, F.array(new))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown)))

    return F.filter(F.aggregate(sizes, zero, put), lambda u: u["parts"] > 0)


def boundary_quality(boundaries: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Invalid ranges, overlaps and gaps of ordered page ranges."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = boundaries.withColumns({"invalid": F.col(start).isNull() | F.col(end).isNull() | (F.col(end) < F.col(start)), "overlap": F.coalesce(before >= F.col(start), F.lit(False)), "gap": F.coalesce(F.col(start) > before + 1, F.lit(False))})
    return out.groupBy(key).agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("invalid", "overlap", "gap")])


def pending_neighbours(issues: DataFrame, key: str, pos: str, pending: Column) -> DataFrame:
    """Next and previous pending issue of each, around the end."""
    w = Window.partitionBy(key).orderBy(pos)
    every = Window.partitionBy(key)
    p = F.when(pending, F.col(pos))
    after = F.min(p).over(w.rowsBetween(1, Window.unboundedFollowing))
    before = F.max(p).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return issues.withColumns({"next_pending": F.coalesce(after, F.min(p).over(every)), "previous_pending": F.coalesce(before, F.max(p).over(every))})
