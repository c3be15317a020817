"""Goldens of chapter operators and further text functions."""

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import chapters, rewrite


def test_more_text(spark):
    df = spark.createDataFrame([("# A\n\n# a\nx\n---\nOceanofPDF.com\ny oceanofpdf.com z",)], "t string")
    one = lambda c: df.select(c.alias("x")).first().x
    assert one(T.without_repeated_headings(F.col("t"))).startswith("# A\n\nx\n")
    assert one(T.without_watermarks(F.col("t"))) == "# A\n\n# a\nx\ny  z"
    assert one(T.cover_only(F.lit("a ![c](d.png) b"))) == "![c](d.png)"
    assert one(T.exclusion_keys(F.lit("The War: A History"), F.lit(None).cast("string"))) == ["a history", "the war", "the war: a history"]
    assert one(T.for_translation(F.lit("Dawn"), F.lit("![x](/tmp/run/images/a.png)"))) == "# Dawn\n\n![x](images/a.png)"
    assert one(T.for_translation(F.lit("Chapter 3"), F.lit("b"))) == "b"


def test_detected_and_sections(spark):
    docs = spark.createDataFrame([(1, "Chapter 1\n" + "a" * 50 + "\nChapter 2\nb\nChapter 3\n" + "c" * 60), (2, "no chapters")], "doc_id long, text string")
    got = [(r.doc_id, r.chapter, r.title) for r in chapters.detected(docs, 20).orderBy("doc_id", "chapter").collect()]
    assert got == [(1, 1, "Chapter 1"), (1, 2, "Chapter 3"), (2, 1, "no chapters")]
    docs = spark.createDataFrame([(1, "intro\n# A\nx\n# B\ny")], "doc_id long, text string")
    assert [r.markdown for r in chapters.sections(docs).orderBy("section").collect()] == ["intro", "# A\nx", "# B\ny"]
    assert [r.segment_id for r in chapters.review_segments(spark.createDataFrame([(7, "a\n\nb")], "doc_id long, text string")).orderBy("block").collect()] == ["7:s001", "7:s002"]


def test_plan(spark):
    plan = spark.createDataFrame([("b", 1, "One", 3, 4), ("b", 2, "Two", 5, 6)], "book string, index int, title string, first int, last int")
    pages = spark.createDataFrame([("b", i, "" if i == 6 else f"p{i}") for i in range(1, 9)], "book string, page int, text string")
    got = [(r.chapter_index, r.title, r.page_start, r.page_end, r.markdown) for r in chapters.planned(plan, pages, "book").orderBy("chapter_index").collect()]
    assert got == [(1, "Front matter", 1, 2, "p1\n\np2"), (2, "One", 3, 4, "p3\n\np4"), (3, "Two", 5, 5, "p5"), (4, "Supplementary", 7, 8, "p7\n\np8")]


def test_unions(spark):
    reviewed = spark.createDataFrame([("b", 1, [1, 2])], "book string, chapter_index int, source_pages array<int>")
    base = spark.createDataFrame([("b", 1, [1], True), ("b", 5, [9], True), ("b", 6, [3], False)], "book string, chapter_index int, source_pages array<int>, resource_only boolean")
    assert [(r.chapter_index, r.new_index) for r in chapters.with_resources(reviewed, base, "book").orderBy("new_index").collect()] == [(1, 1), (5, 2)]
    a = spark.createDataFrame([(1, "new text"), (2, "kept\n## Notes\nz")], "i int, markdown string")
    b = spark.createDataFrame([(1, "old\n## Notes\nn1"), (2, "old\n## Notes\nn2")], "i int, markdown string")
    assert [r.markdown for r in chapters.with_notes(a, b, ["i"]).orderBy("i").collect()] == ["new text\n## Notes\nn1", "kept\n## Notes\nz"]


def test_profiles_and_polish(spark):
    books = spark.createDataFrame([("h", "an empire and its dynasty in 1911", ["a"]), ("n", "nothing", ["a"])], "book string, text string, titles array<string>")
    got = {r.book: (r.profile, round(r.confidence, 2)) for r in chapters.detect_profile(books, {"humanities": ["empire", "dynasty"], "social": ["market"], "science": ["theorem"]}).collect()}
    assert got == {"h": ("humanities", 0.98), "n": ("social", 0.35)}
    assert books.select(chapters.sensitivity(F.col("text"), {"empire": 3, "dynasty": 2}).alias("x")).collect()[0].x == 5
    rows = spark.createDataFrame([(0, "一二三四"), (1, "other")], "pos int, line string")
    cache = spark.createDataFrame([("一二三四 ", "一二三四五", 1), ("other", "", 1)], "line string, polished string, seq int")
    assert [r.line for r in chapters.polished(rows, cache, rewrite.polish_reject).orderBy("pos").collect()] == ["一二三四五", "other"]
