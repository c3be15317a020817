"""Small goldens of operators whose cases the tables don't hold."""

import datetime
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import predicates as P
from quire.functions import text as T
from quire.operators import glossary, html, lines, lookup, ordered, review, translate
from quire.sources import tables
from quire.streaming import events


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'int'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_text(spark):
    c = F.col("t")
    assert one(spark, T.collapse(c), t="a  b ,c\n d .") == "a b,c d."
    assert one(spark, T.pdf_block(c), t="exam- ple co­op word.12") == "example coop word. 12"
    assert one(spark, T.repair(c), t="he went to be in a s ingular place") == "he went to be in a singular place"
    assert one(spark, T.footnote_space(c), t="as shown.12") == "as shown. 12"
    assert one(spark, T.term_key(c), t="“New Deal”  Policy.") == '"new deal" policy'
    assert one(spark, T.slug(c), t="  The Great Leap!") == "the-great-leap"
    assert one(spark, T.one_heading(F.lit("T"), c), t="# a\nx\n# b") == "# T\n\nx"
    assert one(spark, T.nfkc(c), t="ﬁne") == "fine"
    assert one(spark, T.strip_gloss(c, F.lit("")), t="Market（市场）") == "市场"
    assert one(spark, T.cut_appendix(c), t="text\n\nGlossary:\n- a => b") == "text"
    assert one(spark, T.file_stem(c), t="/a/b/My  Book.PDF") == "my book"
    assert one(spark, T.detect_rule(c), t="的" * 50) == "zh-cn"
    assert one(spark, T.operation(F.lit("auto"), F.lit("zh-cn"), F.lit("zh-tw")), t="") == "convert"
    assert one(spark, T.page_ranges(F.array(*[F.lit(i) for i in (3, 1, 2, 7, 7)])), t="") == "1-3, 7"


def test_predicates(spark):
    c = F.col("t")
    for text, kind in (("## a", "heading"), ("![x](y)", "image"), ("| a | b |", "table"), ("- a", "list"), ("12 Cf. this", "footnote"), ("plain words", "plain")):
        assert one(spark, P.block_type(c), t=text) == kind
    for title, kind in (("Preface", "front_matter"), ("Table of Contents", "toc"), ("Index", "index"), ("The War", "narrative")):
        assert one(spark, P.chapter_kind(c, F.lit("body")), t=title) == kind
    assert one(spark, P.ocr_verdict(P.ocr_score(P.ocr_reasons(c))), t="1 2 / 3 4 theMarket") == "suspect_ocr"
    assert one(spark, P.ocr_verdict(P.ocr_score(P.ocr_reasons(c))), t="A plain sentence of prose.") == "reading"
    assert one(spark, P.error_class(c), t="HTTP 429") == "transient"
    assert one(spark, P.untranslated(c, c), t="word " * 100) is True
    assert one(spark, P.mixed_words(c), t="这是 some mixed words 行\nno cjk here") == 3
    assert one(spark, P.page_number_like(c), t=" xiv ") is True
    assert one(spark, P.formula_like(c), t="x=+") is True


def test_blocks_keep_fences(spark):
    docs = spark.createDataFrame([(1, "a\nb\n\n```\nx\n\ny\n```\n\nc")], "doc_id long, text string")
    assert [r.text for r in lines.blocks(docs).orderBy("block").collect()] == ["a\nb", "```\nx\n\ny\n```", "c"]


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "\n".join(["aaaa", "bbbb", "c" * 30, "One two. Three four. Five."])), (2, "")], "doc_id long, text string")
    got = lines.chunks(docs, 14).orderBy("doc_id", "chunk").collect()
    # one block: lines follow each other, only its sentences part it
    assert [r.text for r in got if r.doc_id == 1] == ["\n".join(["aaaa", "bbbb", "c" * 30, "One two."]), "Three four.", "Five."]
    assert [(r.doc_id, r.chunk) for r in got] == [(1, 0), (1, 1), (1, 2)]


def test_notes(spark):
    docs = spark.createDataFrame([(1, "text\n1 First note. See Smith, p. 3\n* starred\n1 again")], "doc_id long, text string")
    got = {r.marker: r.body for r in lines.footnotes(docs).collect()}
    assert got == {"1": "First note. See Smith, p. 3", "*": "starred"}
    spans = one(spark, lines.spans(F.col("t")), t="First note. See Smith, p. 3")
    assert "".join(s.text for s in spans) == "First note. See Smith, p. 3" and [s.kind for s in spans] == ["prose", "citation"]
    assert lines.defect_evidence(spark.createDataFrame([(1, "# H\na bad� char")], "doc_id long, text string"), "replacement_character").first().heading == "# H"


def test_ledger(spark):
    pages = spark.createDataFrame([("b", 1, True, None), ("b", 2, True, None), ("b", 3, False, None), ("b", 4, True, None), ("b", 5, True, "ad")], "book string, page_no int, has_content boolean, skip_reason string")
    chapters = spark.createDataFrame([("b", 0, False, 1), ("b", 1, True, 2), ("b", 2, False, 1)], "book string, chapter_index int, resource_only boolean, page_no int")
    got = {r.page_no: (r.owner, r.missing, r.duplicate, r.disposition) for r in lookup.page_ledger(pages, chapters).collect()}
    assert got == {1: (0, False, True, "content"), 2: (1, False, False, "resource"), 3: (None, False, False, "blank"), 4: (None, True, False, "content"), 5: (None, False, False, "skipped")}
    assert lookup.ledger_summary(lookup.page_ledger(pages, chapters)).first().ready is False


def test_columns_and_order(spark):
    rows = [(1, i, 50.0 + 200 * (i % 2), 500.0 - 30 * i, "text", "x" * 80) for i in range(6)] + [(1, 9, 55.0, 700.0, "section_header", "Title")]
    b = spark.createDataFrame(rows, "page int, pos int, left double, top double, label string, text string")
    placed = ordered.flows(ordered.nearest_column(b, ordered.column_clusters(b, ["page"]), ["page"]), ["page"])
    assert [r.pos for r in ordered.reading_order(placed, ["page"]).orderBy("order").collect()] == [9, 0, 2, 4, 1, 3, 5]


def test_terms(spark):
    assert glossary.select_terms("The New Deal Act and the new deal", ["New Deal", "New Deal Act", "Deal"]) == [(4, "New Deal Act"), (25, "new deal".title())]
    e = spark.createDataFrame([("k", 1, "A", "x", "system", ["p"]), ("k", 2, "a", "y", "user", ["q", "p"])], "key string, seq int, source string, target string, updated_by string, evidence array<string>")
    r = glossary.merge_variants(e, "key").first()
    assert (r.target, r.evidence) == ("y", ["p", "q"])


def test_review(spark):
    rows = spark.createDataFrame([(1, 0, "a" * 100, ""), (1, 1, "b" * 100, "c" * 100), (1, 2, "tiny", "")], "conv_id long, turn long, source_text string, translated_text string")
    assert [(r.turn, r.issue_type, r.item_id) for r in review.items(rows).orderBy("turn").collect()] == [(0, "missing_translation", "review-0001-0001"), (1, "untranslated", "review-0001-0002")]


def test_html(spark):
    c = F.col("t")
    assert one(spark, html.markdown(c), t="<nav><p>x</p></nav><h1>A &amp; B</h1><p>hy-<br>phen <b>b</b></p><li>i</li>") == "## A & B\n\nhyphen **b**\n\n- i"
    assert one(spark, html.tables(c), t="<table><tr><td>a|b</td><td>c</td></tr><tr><td>d</td></tr></table>") == "| a\\|b | c |\n| d |  |"
    for href, want in (("/x", "https://h.org/x"), ("y#f", "https://h.org/a/y#f"), ("javascript:a()", None), ("http://o.net/z", "http://o.net/z"), ("//c.d/e", "https://c.d/e")):
        assert one(spark, html.resolve(F.lit("https://h.org/a/b"), c), t=href) == want
    docs = spark.createDataFrame([("b", 0, '<p>one</p><p id="page_2">two</p>'), ("b", 1, "<p>three</p>")], "k string, o int, h string")
    assert [r.page for r in html.print_pages(docs, "k", "o", "h").orderBy("page").collect()] == [1, 2, 3]


def test_epub(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        z.writestr("OEBPS/c.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="z"/></spine></package>')
        z.writestr("OEBPS/a.xhtml", "<p>a</p>")
        z.writestr("OEBPS/b.xhtml", "<p>b</p>")
    (tmp_path / "x.epub").write_bytes(raw.getvalue())
    got = tables.read_epubs(spark, str(tmp_path)).orderBy("spine_idx").collect()
    assert [(r.href, r.xhtml) for r in got] == [("OEBPS/b.xhtml", "<p>b</p>"), ("OEBPS/a.xhtml", "<p>a</p>")]


def test_event_log(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"seq": 1, "event": "a"}\nbroken\n{"seq": 2, "event": "b"}\n')
    log = tables.event_log(spark, str(tmp_path), "seq long, event string")
    assert sorted(r.seq for r in log.collect()) == [1, 2]
    with pytest.raises(Exception):  # noqa: B017
        tables.event_log(spark, str(tmp_path), "seq long, event string", strict=True).collect()


def test_progress_stream_equals_batch(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(1, 0, "attempt_start", 1), (1, 0, "attempt_success", 2), (1, 1, "cache_hit", 3), (1, 2, "attempt_start", 4), (2, 0, "attempt_failure", 5), (1, 3, "attempt_failure", 6)]
    df = spark.createDataFrame([(*r, t0 + datetime.timedelta(seconds=r[3])) for r in rows], "job long, chunk long, event string, seq long, ts timestamp")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = events.progress_stream(stream).writeStream.outputMode("update").format("memory").queryName("progress").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.job: r for r in spark.sql("select * from progress").collect()}
    batch = {r.job: r for r in events.progress(df, F.lit(5)).collect()}
    for job in (1, 2):
        assert (last[job].completed, last[job].failed, last[job].cache_hits) == (batch[job].completed, batch[job].failed, batch[job].cache_hits)


def test_progress_stream_with_late_and_repeated_events(spark, tmp_path):
    """Each event in a micro-batch of its own, later ones first, cache hits repeated: the same as the batch form."""
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(1, 0, "attempt_failure", 5), (1, 0, "attempt_start", 4), (1, 1, "cache_hit", 8), (1, 1, "cache_hit", 7), (1, 2, "attempt_failure", 9), (1, 2, "attempt_success", 3)]
    schema = "job long, chunk long, event string, seq long, ts timestamp"
    for n, r in enumerate(rows):
        spark.createDataFrame([(*r, t0 + datetime.timedelta(seconds=r[3]))], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={n}"))
        # files are taken in order of their time
        for f in (tmp_path / "in" / f"k={n}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "k=*"))
    q = events.progress_stream(stream).writeStream.outputMode("update").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    updates = spark.sql("select * from late").collect()
    batch = events.progress(spark.read.schema(schema).parquet(str(tmp_path / "in" / "k=*")), F.lit(5)).first()
    last = updates[-1]
    assert len(updates) == len(rows)
    assert (last.completed, last.failed, last.running, last.cache_hits) == (batch.completed, batch.failed, batch.running, batch.cache_hits) == (2, 1, 0, 1)


def test_translate_and_resume(spark):
    chunks = spark.createDataFrame([(0, "a cat"), (1, "a dog")], "chunk int, text string")
    run = translate.dictionary({"cat": "CAT", "a cat": "X"})
    first = translate.translate(chunks.where("chunk = 0"), run)
    assert first.first().translated == "X"
    got = {r.chunk: (r.translated, r.cached) for r in translate.resume(chunks, first, run).collect()}
    assert got == {0: ("X", True), 1: ("a dog", False)}


def test_chunks_keep_fences_and_paragraphs():
    text = "# Title\n\nOne line\nstill one.\n\n```python\nprint(1)\n\nprint(2)\n```\n\nLast paragraph."
    got = list(lines.chunk_texts(text, 40))
    assert got == ["# Title\n\nOne line\nstill one.", "```python\nprint(1)\n\nprint(2)\n```", "Last paragraph."]
    assert list(lines.chunk_texts("\n".join(f"line {i}" for i in range(20)), 30))[0] == "line 0 line 1 line 2 line 3"
    assert all(len(c) <= 30 for c in lines.chunk_texts("\n".join(f"line {i}" for i in range(20)), 30))
    assert list(lines.chunk_texts("First one. Second two! Third three? Fourth.", 24)) == ["First one. Second two!", "Third three? Fourth."]
    table = "| a | b |\n| c | d |\n| e | f |"
    assert list(lines.chunk_texts(table, 10)) == [table]
    long = "A very long block that is too long."
    assert list(lines.chunk_texts(f"open\n\n{long}\n\nend", 20)) == ["open", long, "end"]
    assert list(lines.chunk_texts(None, 10)) == list(lines.chunk_texts(" \n\n", 10)) == []


def test_ocr_rules(spark):
    rows = [("forMen came", None), ("ofAb cd", None), ("Étude à l'œuvre, très « bien »", None), ("", ""), ("Some Words", "some words"), ("Some words", "other text here")]
    df = spark.createDataFrame(rows, "t string, e string").select("t", "e", P.ocr_reasons(F.col("t"), evidence=F.col("e")).alias("r"))
    got = [r.r for r in df.collect()]
    assert got == [["impossible_word_join"], [], ["symbol_density"], [], [], ["evidence_disagreement"]]


def test_contents_page(spark):
    from quire.operators import pages

    def kind(lines_, page=3, total=200):
        return spark.createDataFrame([(lines_,)], "l array<string>").select(pages.page_kind(F.col("l"), F.lit(page), F.lit(total), F.lit(None)).alias("k")).first().k

    assert kind([f"Some title {i}" for i in range(9)]) == "toc"  # eight short lines, or
    assert kind(["A line of prose that is rather longer than eight words for sure", "Notes 201", "Index 230"]) == "toc"  # two references
    assert kind([f"Some title {i}" for i in range(9)], page=100) == "body"
    assert kind([*(f"Some title {i}" for i in range(9)), " ".join(["word"] * 19) + "."]) != "toc"


def test_links_of_any_shape(spark):
    from quire.operators import html

    page = """<h1 class="x">A <em>b</em></h1><a class="k" href="/p">one</a> <a href="/q"><b>two</b></a> <A HREF='r?x=1&amp;y=2'>three</A> <a href=../s/./t>four</a> <a name="n">no</a> <a href="?z">five</a> <area data-href="/no">"""
    df = spark.createDataFrame([(1, "https://h.org/a/b/c.html?old#f", page)], "page_id long, url string, html string")
    assert df.select(html.title(F.col("html"))).first()[0] == "A b"
    got = html.links(df).select("label", html.resolve(F.col("url"), F.col("href")).alias("to")).collect()
    assert [tuple(r) for r in got] == [("one", "https://h.org/p"), ("two", "https://h.org/q"), ("three", "https://h.org/a/b/r?x=1&y=2"), ("four", "https://h.org/a/s/t"), ("five", "https://h.org/a/b/c.html?z")]
