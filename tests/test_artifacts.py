"""Goldens of artifact readers and writers."""

import json

import pytest
from pyspark.sql import functions as F

from quire.sources import artifacts, tables


def test_two_shapes(spark, tmp_path):
    rows = [{"chapter_id": "a", "title": "A", "markdown": "x"}, {"chapter_id": "b", "title": "B", "markdown": "y", "translate": False}]
    (tmp_path / "1.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "2.json").write_text(json.dumps({"chapters": rows}))
    got = artifacts.chapters(spark, str(tmp_path)).orderBy("file", "pos").collect()
    assert [(r.chapter_id, r.translate) for r in got] == [("a", True), ("b", False)] * 2


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"cases": [{"source_pdf": "a.pdf", "mode": "profile"}]}))
    assert artifacts.manifest(spark, str(tmp_path / "m.json")).first().source_pdf == "a.pdf"
    (tmp_path / "n.json").write_text(json.dumps([{"source_pdf": "a.pdf"}]))
    with pytest.raises(Exception):  # noqa: B017
        artifacts.manifest(spark, str(tmp_path / "n.json")).collect()


def test_tail(spark):
    log = spark.createDataFrame([(0, 5, "a"), (5, 5, "b"), (10, 5, "c")], "offset long, bytes long, line string")
    rows, end = artifacts.tail(log, 5, 1)
    assert [r.line for r in rows.collect()] == ["b"] and end == 10
    rows, end = artifacts.tail(log, 99, 10)
    assert rows.count() == 3 and end == 15
    assert artifacts.tail(log, 15, 10)[1] == 15


def test_spines_and_covers(spark):
    spine = spark.createDataFrame([("b", 0, "Cover", "![c](c.png)", "<img src='x/c.png'>"), ("b", 1, "Navigation", "x", ""), ("b", 2, "One", "text", ""), ("b", 3, "Index", "a, 1", ""), ("b", 4, None, "## B \nb, 2", ""), ("b", 5, "Shell", " ", "")], "book string, spine_idx int, title string, markdown string, xhtml string")
    got = [(r.chapter_index, r.title, r.preserve) for r in artifacts.book_relation(spine, "book").orderBy("chapter_index").collect()]
    assert got == [(1, "Cover", True), (2, "One", False), (3, "Index", True), (4, None, True)]
    items = spark.createDataFrame([("b", "i", "x/c.png", "cover-image"), ("d", "cover", "d.jpg", None)], "book string, id string, href string, properties string")
    assert [(r.book, r.markdown) for r in artifacts.cover_row(spine, items, "book").collect()] == [("d", "![cover](d.jpg)")]
    pages = artifacts.page_images(spark.createDataFrame([([3, 4], True, "x"), ([5], False, "y")], "source_pages array<int>, preserve boolean, markdown string"))
    assert [r.markdown for r in pages.collect()] == ["![page 3](pages/page-0003.png)\n\n![page 4](pages/page-0004.png)", "y"]
    assert spark.range(1).select(artifacts.clean_wrappers(F.lit("<p>\na &amp; <span>b</span>\n</div>")).alias("x")).first().x == "a & b"


def test_epub_round_trip(spark, tmp_path):
    chapters = spark.createDataFrame([("b", 2, "Two & more", "c", True), ("b", 1, "One", "a\n\nb", False)], "book string, chapter_index int, title string, markdown string, resource_only boolean")
    content = bytes(artifacts.epubs(chapters, "book").first().content)
    (tmp_path / "b.epub").write_bytes(content)
    got = tables.read_epubs(spark, str(tmp_path)).orderBy("spine_idx").collect()
    assert len(got) == 2 and "<p>a</p><p>b</p>" in got[0].xhtml and "Two &amp; more" in got[1].xhtml
    assert list(artifacts.lenient_lines(['{"a": 1}', "x", "3"])) == [{"a": 1}]
