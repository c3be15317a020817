"""Artifacts of a run: JSON in either of two shapes, manifests, spines as book relations, covers, log tails by offset, EPUB files
(A04, A09, A16, A18, A21, A22, B02, J01)."""

from __future__ import annotations

import html
import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHAPTER = "struct<chapter_id: string, title: string, markdown: string, translate: boolean>"


def chapters(spark: SparkSession, path: str) -> DataFrame:
    """Translated chapters, whether a file holds a list or an object with `chapters` (A16). Each file is one row of text."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    listed = F.from_json("value", f"array<{CHAPTER}>")
    wrapped = F.from_json("value", f"struct<chapters: array<{CHAPTER}>>")["chapters"]
    rows = F.when(F.trim("value").startswith("["), listed).otherwise(wrapped)
    return text.select("file", F.posexplode(rows).alias("pos", "c")).select("file", "pos", "c.*").withColumn("translate", F.coalesce("translate", F.lit(True)))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Validation cases, a list or an object with `cases`; a case without source_pdf or mode is an error."""
    case = "struct<source_pdf: string, mode: string, profile: string>"
    text = spark.read.text(path, wholetext=True)
    rows = F.when(F.trim("value").startswith("["), F.from_json("value", f"array<{case}>")).otherwise(F.from_json("value", f"struct<cases: array<{case}>>")["cases"])
    out = text.select(F.explode(rows).alias("c")).select("c.*")
    bad = F.col("source_pdf").isNull() | F.coalesce(F.col("mode") != "profile", F.lit(True))
    return out.withColumn("mode", F.when(bad, F.raise_error(F.lit("a case needs source_pdf and mode profile"))).otherwise(F.col("mode")))


def tail(log: DataFrame, since: int, limit: int) -> tuple[DataFrame, int]:
    """Rows of a log from byte offset `since`, at most `limit`, and the offset after them; a shorter log than `since` is read
    from its start (J01). log: offset (where a line begins), bytes, and the line."""
    size = log.agg(F.max(F.col("offset") + F.col("bytes")).alias("n")).first().n or 0
    since = since if since <= size else 0
    rows = log.where(F.col("offset") >= since).orderBy("offset").limit(limit)
    end = rows.agg(F.max(F.col("offset") + F.col("bytes")).alias("n")).first().n
    return rows, end if end is not None else since


def clean_wrappers(c: Column) -> Column:
    """Lines that are only a stray p, div or span tag go, and entities are read."""
    kept = F.filter(F.split(c, "\n"), lambda x: ~F.trim(x).rlike(r"^</?(?:p|div|span)(?: [^>]*)?>$"))
    plain = F.regexp_replace(F.array_join(kept, "\n"), r"</?(?:p|div|span)(?: [^>]*)?>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return plain


def cover_row(spine: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """A cover page for books whose cover image no spine page refers to (A04). items: id, href, properties."""
    covers = items.where(F.col("properties").contains("cover-image") | F.lower("id").isin("cover", "cover-image")).groupBy(key).agg(F.min("href").alias("cover"))
    name = F.regexp_extract("cover", r"([^/]+)$", 1)
    used = covers.join(spine, key).where(F.expr("contains(xhtml, regexp_extract(cover, '([^/]+)$', 1))")).select(key).distinct()
    return covers.join(used, key, "left_anti").select(key, F.lit(-1).alias("spine_idx"), "cover", F.concat(F.lit("![cover]("), name, F.lit(")")).alias("markdown"))


def book_relation(spine: DataFrame, key: str) -> DataFrame:
    """Chapters of a spine (A21): empty shells, navigation and page lists go; covers and apparatus are kept as they are; a page
    after an index continues it; the rest is numbered. spine: spine_idx, title, markdown."""
    title, body = F.lower(F.coalesce("title", F.lit(""))), F.trim(F.col("markdown"))
    rows = spine.where((body != "") & ~title.rlike(r"^(?:navigation|page list|table of contents|contents)$"))
    w = Window.partitionBy(key).orderBy("spine_idx")
    index = (title == "index").cast("int")
    letters = body.rlike(r"^#+ [A-Z]\s")
    rows = rows.withColumn("_index", F.max(index).over(w)).withColumn("preserve", (title.rlike(r"^(?:cover|index|bibliography|notes|copyright|glossary)$")) | ((F.col("_index") == 1) & letters))
    return rows.withColumn("chapter_index", F.row_number().over(w)).drop("_index")


def page_images(chapters: DataFrame, folder: str = "pages") -> DataFrame:
    """Preserved back matter as one image link for each of its pages."""
    links = F.transform("source_pages", lambda p: F.format_string(f"![page %d]({folder}/page-%04d.png)", p, p))
    return chapters.withColumn("markdown", F.when(F.col("preserve"), F.array_join(links, "\n\n")).otherwise(F.col("markdown")))


def epub(title: str, chapters: list[tuple[str, str, bool]]) -> bytes:
    """An EPUB of (title, markdown, in navigation) chapters (B02); resources stay in the spine without a navigation entry."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="c.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        for k, (name, text, _) in enumerate(chapters):
            paragraphs = "".join(f"<p>{html.escape(p)}</p>" for p in text.split("\n\n") if p.strip())
            z.writestr(f"c{k}.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{html.escape(name)}</title></head><body><h1>{html.escape(name)}</h1>{paragraphs}</body></html>')
        nav = "".join(f'<li><a href="c{k}.xhtml">{html.escape(n)}</a></li>' for k, (n, _, shown) in enumerate(chapters) if shown)
        z.writestr("nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{nav}</ol></nav></body></html>')
        items = "".join(f'<item id="c{k}" href="c{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(len(chapters)))
        refs = "".join(f'<itemref idref="c{k}"/>' for k in range(len(chapters)))
        z.writestr("c.opf", f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{html.escape(title)}</dc:title></metadata><manifest><item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>{items}</manifest><spine>{refs}</spine></package>')
    return out.getvalue()


def epubs(chapters: DataFrame, book: str) -> DataFrame:
    """book and content (an EPUB's bytes) of every book; a book, which must fit in memory as a file does, is packed in one
    task. chapters: chapter_index, title, markdown, resource_only."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chapter_index")
        name = str(pdf[book].iloc[0])
        return pd.DataFrame({book: [pdf[book].iloc[0]], "content": [epub(name, list(zip(pdf["title"], pdf["markdown"], ~pdf["resource_only"].astype(bool), strict=True)))]})

    return chapters.select(book, "chapter_index", "title", "markdown", "resource_only").groupBy(book).applyInPandas(pack, f"`{book}` {dict(chapters.dtypes)[book]}, content binary")


def lenient_lines(batches: Iterator[str]) -> Iterator[dict]:
    """Objects of JSON lines, malformed ones skipped."""
    for line in batches:
        try:
            value = json.loads(line)
        except ValueError:
            continue
        if isinstance(value, dict):
            yield value
