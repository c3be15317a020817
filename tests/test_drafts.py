"""Goldens of the draft operators."""

from pyspark.sql import functions as F

from quire.operators import drafts as D


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_pages_between(spark):
    chapters = spark.createDataFrame([("b", 1, 4, 2), ("b", 2, 0, 9), ("b", 3, None, 3)], "book string, c int, page_start int, page_end int")
    pages = spark.createDataFrame([("b", p) for p in range(1, 7)], "book string, page int")
    assert rows(D.pages_between(chapters, pages, "book").select("c", "page"), "page") == [(1, 2), (1, 3), (1, 4)]


def test_aligned_parts(spark):
    kind = "id int, source string, translation string, parts array<struct<part_id: string, source: string, translation: string>>"
    seg = spark.createDataFrame([(1, "s", "t", [("x", "a", "b"), ("y", "c", "d")]), (2, "s", "t", []), (3, "s", None, None)], kind)
    assert rows(D.aligned_parts(seg), "id", "part") == [(1, 0, "a", "b"), (1, 1, "c", "d"), (2, 0, "s", "t"), (3, 0, "s", None)]


def test_adopt_pending(spark):
    cand = spark.createDataFrame([("a", "A", 1), ("a", "AA", 2), ("b", "B", 3), ("c", " ", 4), ("d", "D", 5), ("e", "E", 6), (" ", "x", 7), ("f", "F", 8)], "source string, target_suggestion string, pos int")
    active = spark.createDataFrame([("d", "D", "active"), ("e", "", "active"), ("f", "F", "rejected")], "source string, target string, status string")
    decided = spark.createDataFrame([("b", "active", 1), ("b", "rejected", 2), ("a", "rejected", 1), ("a", "active", 2)], "source string, status string, seq int")
    assert rows(D.adopt_pending(cand, active, decided), "source") == [("a", "A", "confirmed"), ("c", None, "skipped"), ("e", "E", "confirmed")]


def test_marks(spark):
    marks = spark.createDataFrame([("s1", " One ", "m1", 1), ("s2", "Two", "m2", 2), ("s1", "Uno", "m3", 3), ("s9", "x", "m4", 4), ("s2", " ", "m5", 5)], "segment_id string, title string, mark_id string, seq int")
    seg = spark.createDataFrame([("s1", 5), ("s2", 2)], "segment_id string, segment_index int")
    assert rows(D.chapter_marks(marks, seg), "segment_index") == [("s2", "m2", "Two", 1, 2), ("s1", "m1", "Uno", 2, 5)]
    places = spark.createDataFrame([("b", 1, 0.10, 1), ("b", 1, 0.14, 2), ("b", 1, 0.18, 3), ("b", 1, 0.18, 4), ("b", 2, 0.14, 5)], "book string, page int, y double, seq int")
    assert rows(D.place_marks(places, "book"), "seq") == [("b", 1, 1, 0.10), ("b", 1, 3, 0.18), ("b", 2, 5, 0.14)]


def test_resets_and_passthrough(spark):
    cand = spark.createDataFrame([("a", "A", 0.5)], "source string, target_suggestion string, suggestion_confidence double")
    assert rows(D.without_suggestions(cand), "source") == [("a", None, None)]
    again, active, decided = D.reset_review(cand, cand, cand, keep_suggestions=True)
    assert again.count() == 1 and active.count() == decided.count() == 0
    chapters = spark.createDataFrame([(1, "T", "# Old\n\nbody ", True), (2, None, "x", None), (3, "R", "raw", False), (4, "E", " ", True)], "chapter_index int, title string, markdown string, toc boolean")
    assert rows(D.passthrough(chapters).select("chapter_index", "title", "markdown", "translator"), "chapter_index") == [
        (1, "T", "# T\n\nbody\n", "skipped"), (2, "Chapter 2", "# Chapter 2\n\nx\n", "skipped"), (3, "R", "raw\n", "skipped"), (4, "E", "", "skipped")]


def test_polish_lines(spark):
    docs = spark.createDataFrame([(1, "# 标题 active\n这是 active 的 (vital) 词\nplain active\n一个 open form（开放形式）在 vital-\n只有 cross-mere) 吗"), (2, None)], "doc_id long, text string")
    got = rows(D.polish_lines(docs, ("active", "vital", "mere")), "line")
    assert got == [(1, 2, "这是 active 的 (vital) 词", ["active"]), (1, 4, "一个 open form（开放形式）在 vital-", ["open form", "vital"])]


def test_fallback_and_salvage(spark):
    def strict(text):
        if len(text) > 10:
            raise ValueError("too long")
        return text.upper()

    def never(text):
        return ""

    chunks = spark.createDataFrame([("b", 0, "short"), ("b", 1, "first one\n\nsecond"), ("b", 2, None), ("b", 3, "later")], "book string, index int, text string")
    got = {r["index"]: (r.translated, r.attempt) for r in D.with_fallback(chunks, (never, strict), sizes=(12, 9)).collect()}
    assert got[0] == ("SHORT", "whole:1") and got[1] == ("FIRST ONE\n\nSECOND", "parts:1")
    assert got[2][1] == "kept" and got[2][0].startswith("<!-- fail-open chunk=2")
    have = spark.createDataFrame([("b", 0)], "book string, index int")
    saved, failed = D.salvage(chunks, have, (strict,), "book", sizes=(12, 9))
    assert [r["index"] for r in saved.collect()] == [1] and rows(failed, "index") == [("b", 2, "empty")]
    saved, failed = D.salvage(chunks, have, (strict,), "book", most=1, sizes=(12, 9))
    assert [r["index"] for r in saved.collect()] == [1] and failed.count() == 0


def test_rewrite_requests(spark):
    asked = spark.createDataFrame([("s1", "model_rewrite", "open", "shorter"), ("s2", "model_rewrite", "open", " "), ("s3", "approve", "open", "x"), ("s4", "model_rewrite", "requested", "y")], "segment_id string, action string, status string, comment string")
    seg = spark.createDataFrame([("s1", "cat", "gato"), ("s2", "a", "b"), ("s3", "a", "b"), ("s4", " ", "b")], "segment_id string, source_text string, translated_text string")
    terms = spark.createDataFrame([("s1", "cat", "felis")], "segment_id string, source string, target string")
    got = rows(D.rewrite_requests(asked, seg, terms, lambda prompt: prompt.splitlines()[-1]), "segment_id")
    assert got == [("s1", "cat => felis", None), ("s4", None, "empty source")]


def test_note_cluster(spark):
    texts = ["a", "b", "c", "d", "e", "1", "note", "2", "note", "3"]
    blocks = spark.createDataFrame([("x", i, t) for i, t in enumerate(texts)] + [("y", i, "1") for i in range(5)], "book string, pos int, text string")
    got = rows(D.note_cluster(blocks, "book", F.col("text").rlike(r"^[0-9]{1,3}$")).where("notes").select("book", "pos"), "book", "pos")
    assert got == [("x", i) for i in range(5, 10)]
