"""Pages of a book: layout blocks, page kinds, titles, items, notes, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import predicates as P
from quire.functions.text import strip

LAYOUT = "doc_id string, body struct<children: array<struct<`$ref`: string>>>, texts array<struct<label: string, text: string, prov: array<struct<page_no: int, bbox: struct<l: double, t: double, r: double, b: double>>>>>"


def flatten_layout(docs: DataFrame) -> DataFrame:
    """Blocks of nested layout documents in body order: each child refers to a text by index, and the text's first
    place counts (E01). The lookup is by array index, so nothing is joined."""
    refs = docs.select("doc_id", "texts", F.posexplode("body.children").alias("pos", "child"))
    index = F.regexp_extract(F.col("child.`$ref`"), r"^#/texts/([0-9]+)$", 1)
    found = refs.where(index != "").withColumn("t", F.get(F.col("texts"), index.cast("int"))).where("t is not null")
    place = F.get(F.col("t.prov"), F.lit(0))
    return found.select("doc_id", "pos", F.col("t.label").alias("label"), F.col("t.text").alias("text"), place["page_no"].alias("page_no"), place["bbox"]["l"].alias("left"), place["bbox"]["t"].alias("top"), place["bbox"]["b"].alias("bottom"))


def markdown_block(label: Column, text: Column) -> Column:
    return F.when(label == "section_header", F.concat(F.lit("## "), text)).when(label == "caption", F.concat(F.lit("> "), text)).otherwise(text)


def magazine_noise(label: Column, text: Column, top: Column) -> Column:
    """Footers, bare numbers, credits, short headers in the top band, spaced capitals."""
    s = strip(text)
    return (label == "page_footer") | s.rlike(r"^[0-9]+$") | F.lower(s).rlike(r"^(?:photo(?:graph)?s? by|illustration by|image credit|advertisement)") | ((label == "page_header") & (top >= 560) & (F.length(s) <= 60)) | s.rlike(r"^(?:[A-Z] ){3,}[A-Z]$")


def book_noise(label: Column, text: Column) -> Column:
    """Headers always, footers unless they read like notes or are long."""
    return (label == "page_header") | ((label == "page_footer") & ~P.note_line(text) & (F.length(text) < 80))


def _some(lines: Column, n: int, test) -> Column:
    return F.size(F.filter(F.slice(lines, 1, n), test))


def page_kind(lines: Column, page: Column, total: Column, title: Column) -> Column:
    """The kind of a page by its lines, first rule that holds."""
    full = F.filter(F.transform(lines, strip), lambda x: x != "")
    low = F.transform(full, F.lower)
    n, chars = F.size(full), F.aggregate(full, F.lit(0), lambda a, x: a + F.length(x))
    early = page <= F.least(F.lit(12), F.greatest(F.floor(total / 8), F.lit(1)))
    refs = _some(low, 4, lambda x: x.rlike(r"^(?:further reading|references|bibliography|works cited)$"))
    cited = _some(full, 20, lambda x: x.rlike(r"(?:^|[^0-9])(?:1[5-9]|20)[0-9]{2}(?:[^0-9]|$)") & (P.words(x) >= 6))
    entry = lambda x: x.rlike(r"(?i)^.+,\s*(?:[ivxlcdm]+|[0-9]+)(?:[-,–]\s*(?:[ivxlcdm]+|[0-9]+))*$")
    entries = _some(full, 25, entry)
    page_refs = F.aggregate(F.slice(full, 1, 25), F.lit(0), lambda a, x: a + F.regexp_count(x, F.lit(r",\s*[0-9]+")))
    back = _some(low, 25, lambda x: x.contains("written by"))
    # the contents rules read the first 20 lines, without heading and quote marks
    top = F.transform(F.slice(low, 1, 20), lambda x: F.regexp_replace(x, r"^[#>\s]+", ""))
    short = F.size(F.filter(top, lambda x: (P.words(x) >= 1) & (P.words(x) <= 8) & ~x.endswith(".")))
    long = F.size(F.filter(top, lambda x: (P.words(x) >= 18) & x.endswith(".")))
    apparatus = F.regexp_count(F.array_join(top, " "), F.lit(r"\b(?:notes|references|bibliography|index)\s+[0-9]+\b"))
    rules = [
        (chars == 0, "visual_only"),
        (F.array_join(top, " ").contains("table of contents") | F.exists(F.slice(top, 1, 3), lambda x: x == "contents") | (_some(full, 20, P.toc_line) >= 4), "toc"),
        (early & ((apparatus >= 2) | ((short >= 8) & (long == 0))), "toc"),
        ((refs > 0) | (~early & ((cited >= 5) | ((page * 100 >= total * 85) & (cited >= 2)))), "references"),
        ((_some(low, 4, lambda x: x == "index") > 0) | ((n <= 4) & (entries >= 1) & (page_refs >= 4)) | (entries >= 8) | (page_refs >= 14), "index"),
        ((n >= 4) & (_some(full, 20, lambda x: (F.regexp_count(x, F.lit("[0-9]")) >= 6) | x.contains("|") | x.contains("\t")) >= 4), "table_heavy"),
        ((n >= 6) & (_some(full, 20, P.note_line) >= 5), "notes_heavy"),
        ((page >= total - 3) & (back >= 2), "back_matter"),
        (title.isNotNull(), "body"),
        ((total >= 12) & (chars < 260) & (page <= F.least(F.lit(6), F.greatest(F.floor(total / 8), F.lit(1)))), "front_matter"),
        ((total >= 12) & (chars < 260) & (page >= total - 3), "back_matter"),
    ]
    return P.first_match(rules, "body")


def chapter_title(lines: Column) -> Column:
    """The title among a page's first lines: a section word, a chapter marker with the next line, a numbered title."""
    full = F.slice(F.filter(F.transform(lines, strip), lambda x: (x != "") & (P.words(x) <= 12)), 1, 4)
    first, second = F.get(full, F.lit(0)), F.get(full, F.lit(1))
    marker = first.rlike(r"(?i)^(?:chapter|part)\s+(?:[0-9]+|[IVXLCDM]+|one|two|three|four|five|six|seven|eight|nine|ten)$")
    return (F.when(first.rlike(r"(?i)^(?:preface|acknowledge?ments|introduction|prologue|epilogue|notes|bibliography|references)$"), first).when(marker & second.isNotNull(), F.concat_ws(": ", first, second)).when(marker, first)
            .when(first.rlike(r"^[0-9]{1,3}\s+[A-Z][A-Z0-9'’&,:;/()\-–— ]{2,}$"), first).when((P.words(first) >= 3) & first.rlike(r"^[A-Z][A-Z ]+$"), first))


def majority_kind(pages: DataFrame, chapter: list[str], kind: str, pos: str) -> DataFrame:
    """Each chapter's most frequent page kind, first seen wins ties (F16)."""
    counts = pages.groupBy(*chapter, kind).agg(F.count("*").alias("_n"), F.min(pos).alias("_p"))
    return counts.groupBy(*chapter).agg(F.max(F.struct("_n", (-F.col("_p")).alias("_q"), F.col(kind).alias("k"))).alias("_m")).select(*chapter, F.col("_m.k").alias(kind))


def assemble(lines: DataFrame, chapter: list[str], trace: bool = False) -> DataFrame:
    """Chapters from page lines in order, with page marks if asked for (E17). lines: page, pos, line."""
    pages = lines.groupBy(*chapter, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    text = F.concat(F.lit("[[page: "), F.col("page").cast("string"), F.lit("]]\n"), F.col("text")) if trace else F.col("text")
    return pages.groupBy(*chapter).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", text.alias("text")))), lambda x: x["text"]), "\n\n").alias("markdown"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))


def numbered_items(items: DataFrame, page: list[str]) -> DataFrame:
    """Running numbers of figures and tables on a page and the caption each is given."""
    w = Window.partitionBy(*page, "kind").orderBy("pos")
    after = F.first(F.when(F.col("kind") == "caption", F.col("text")), ignorenulls=True).over(Window.partitionBy(*page).orderBy("pos").rowsBetween(1, 2))
    return items.withColumns({"number": F.row_number().over(w), "caption": after}).where(F.col("kind").isin("figure", "table"))


def between(blocks: DataFrame, first: tuple[int, float], last: tuple[int, float]) -> DataFrame:
    """Blocks from one (page, y) to another, y falling down a page."""
    at = F.struct(F.col("page_no").cast("int").alias("p"), (-F.col("top")).cast("double").alias("y"))
    edge = lambda p, y: F.struct(F.lit(p).alias("p"), F.lit(-y).cast("double").alias("y"))
    return blocks.where((at >= edge(*first)) & (at < edge(*last)))


def picture_share(pictures: DataFrame, sizes: DataFrame, page: list[str]) -> DataFrame:
    """The part of each page that pictures cover, 1 at most."""
    area = pictures.groupBy(*page).agg(F.sum(F.abs((F.col("r") - F.col("l")) * (F.col("t") - F.col("b")))).alias("_a"))
    return sizes.join(area, page, "left").select(*page, F.least(F.lit(1.0), F.coalesce(F.col("_a"), F.lit(0.0)) / (F.col("width") * F.col("height"))).alias("picture"))


def trailing_notes(blocks: DataFrame, page: list[str]) -> DataFrame:
    """Marks the last blocks of a page that are all heavy with notes."""
    w = Window.partitionBy(*page).orderBy(F.desc("pos"))
    return blocks.withColumn("note", F.min(P.footnote_heavy(F.col("text")).cast("int")).over(w) == 1)


def backlinks(notes: DataFrame, blocks: DataFrame, book: str) -> DataFrame:
    """The nearest page, from a note's own to two before, with a block that carries its marker (F07). The three
    candidate pages of a note are equi-joined to blocks; no range join."""
    asked = notes.select(book, "note_id", "marker", F.col("page").alias("_from"), F.explode(F.sequence(F.col("page") - 2, F.col("page"))).alias("page"))
    hits = asked.join(blocks, [book, "page"]).where(F.expr("text rlike concat('(?:\\\\[', marker, '\\\\]|[a-z.,;]', marker, '(?:[^0-9]|$)|\\\\^', marker, ')')"))
    best = hits.groupBy(book, "note_id").agg(F.max(F.struct("page", (-F.col("pos")).alias("p"))).alias("_b"))
    return notes.join(best, [book, "note_id"], "left").select(book, "note_id", F.col("_b.page").alias("link_page"), (-F.col("_b.p")).alias("link_pos"))


def toc_pages(pages: DataFrame, book: str) -> DataFrame:
    """First and last page of the table of contents: the share of its lines that look like entries, a quarter more
    for a heading, on the first 35 pages; the range is cut short (F21, D27). pages: page, lines."""
    full = F.filter("lines", lambda x: strip(x) != "")
    hits = F.size(F.filter(full, P.toc_line)) * 100 + F.when(F.size(F.filter(F.slice(full, 1, 5), lambda x: F.lower(x).rlike(r"^\s*(?:table of )?contents\s*$"))) > 0, 25 * F.size(full)).otherwise(0)
    good = pages.where((F.col("page") <= 35) & (F.size(full) > 0)).where(hits >= 18 * F.size(full)).select(book, "page")
    start = good.groupBy(book).agg(F.min("page").alias("start"))
    end = good.join(start, book).where(F.col("page") <= F.col("start") + 6).groupBy(book, "start").agg(F.max("page").alias("end"))
    return end.withColumn("end", F.when(F.col("end") - F.col("start") + 1 > 4, F.col("start") + 3).otherwise(F.col("end")))


def toc_depth(entries: DataFrame, book: str, most: int) -> DataFrame:
    """Entries no deeper than asked for; all of a book's if none is left."""
    kept = (F.col("depth") == 0) | (F.col("depth") <= most)
    return entries.withColumn("_k", F.sum(kept.cast("int")).over(Window.partitionBy(book))).where(kept | (F.col("_k") == 0)).drop("_k")


def outline_rows(entries: DataFrame, book: str) -> DataFrame:
    """Native outline rows, the first of each page and title in lower case."""
    first = F.min(F.struct("level", "title")).alias("_m")
    return entries.groupBy(book, "page", F.lower("title").alias("_t")).agg(first).select(book, "page", "_m.level", "_m.title")


def id_coverage(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows, and those in which a column is given."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.count(column).alias("given"))
