"""Goldens of the page, control and rewrite operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from quire.functions import predicates as P
from quire.functions import text as T
from quire.operators import control, pages, rewrite


def kind(spark, text, page=50, total=100):
    df = spark.createDataFrame([(text,)], "t string")
    lines = F.split("t", "\n")
    return df.select(pages.page_kind(lines, F.lit(page), F.lit(total), pages.chapter_title(lines)).alias("k")).first().k


def test_page_kinds(spark):
    assert kind(spark, "") == "visual_only"
    assert kind(spark, "Table of Contents\nOne .... 3") == "toc"
    assert kind(spark, "\n".join(f"Chapter {i} ..... {i}" for i in range(5))) == "toc"
    assert kind(spark, "References\nSmith") == "references"
    assert kind(spark, "\n".join(f"term {i}, {i}, 4{i}" for i in range(9))) == "index"
    assert kind(spark, "\n".join(["12 345 678 | x"] * 5)) == "table_heavy"
    assert kind(spark, "\n".join(f"{i} See the archive for more." for i in range(7))) == "notes_heavy"
    assert kind(spark, "Written by one\nwritten by two", page=99) == "back_matter"
    assert kind(spark, "Chapter 3\nThe Long March\nIt began.") == "body"
    assert kind(spark, "short page", page=2) == "front_matter"
    assert kind(spark, "short page") == "body"


def test_titles(spark):
    df = spark.createDataFrame([("Chapter IV\nThe Harvest",), ("Preface",), ("12 THE GREAT FAMINE",), ("Plain words of a page that runs on.",)], "t string")
    assert [r.x for r in df.select(pages.chapter_title(F.split("t", "\n")).alias("x")).collect()] == ["Chapter IV: The Harvest", "Preface", "12 THE GREAT FAMINE", None]


def test_flatten_layout(spark):
    doc = ("d", {"children": [{"$ref": "#/texts/1"}, {"$ref": "#/pictures/0"}, {"$ref": "#/texts/0"}, {"$ref": "#/texts/9"}]},
           [{"label": "text", "text": "b", "prov": [{"page_no": 2, "bbox": {"l": 1.0, "t": 2.0, "r": 3.0, "b": 0.0}}]}, {"label": "section_header", "text": "a", "prov": []}])
    got = pages.flatten_layout(spark.createDataFrame([doc], pages.LAYOUT)).orderBy("pos").collect()
    assert [(r.pos, r.label, r.text, r.page_no, r.left) for r in got] == [(0, "section_header", "a", None, None), (2, "text", "b", 2, 1.0)]


def test_backlinks_and_items(spark):
    notes = spark.createDataFrame([("b", 1, 5, "3"), ("b", 2, 5, "9")], "book string, note_id int, page int, marker string")
    blocks = spark.createDataFrame([("b", 3, 0, "a claim[3] here"), ("b", 4, 1, "later claim.3"), ("b", 5, 0, "nothing")], "book string, page int, pos int, text string")
    assert {r.note_id: r.link_page for r in pages.backlinks(notes, blocks, "book").collect()} == {1: 4, 2: None}
    items = spark.createDataFrame([(1, 0, "figure", "f"), (1, 1, "caption", "Fig. 1"), (1, 2, "figure", "g"), (1, 3, "table", "t")], "page int, pos int, kind string, text string")
    assert {r.pos: (r.number, r.caption) for r in pages.numbered_items(items, ["page"]).collect()} == {0: (1, "Fig. 1"), 2: (2, None), 3: (1, None)}


def test_page_geometry(spark):
    pics = spark.createDataFrame([(1, 0.0, 100.0, 50.0, 0.0), (1, 0.0, 100.0, 80.0, 0.0)], "page int, l double, t double, r double, b double")
    sizes = spark.createDataFrame([(1, 100.0, 100.0), (2, 10.0, 10.0)], "page int, width double, height double")
    assert {r.page: r.picture for r in pages.picture_share(pics, sizes, ["page"]).collect()} == {1: 1.0, 2: 0.0}
    blocks = spark.createDataFrame([(1, 700.0, "a"), (1, 100.0, "b"), (2, 700.0, "c"), (2, 50.0, "d")], "page_no int, top double, text string")
    assert sorted(r.text for r in pages.between(blocks, (1, 300.0), (2, 300.0)).collect()) == ["b", "c"]
    note = "1 first note of the page here\n2 second note of the page here"
    marked = pages.trailing_notes(spark.createDataFrame([(1, 0, note), (1, 1, "prose"), (1, 2, note)], "page int, pos int, text string"), ["page"])
    assert {r.pos: r.note for r in marked.collect()} == {0: False, 1: False, 2: True}


def test_noise(spark):
    df = spark.createDataFrame([("page_footer", "12", 0.0), ("text", "P H O T O S", 0.0), ("page_header", "Short", 600.0), ("text", "A sentence.", 600.0)], "l string, t string, y double")
    assert [r.x for r in df.select(pages.magazine_noise(F.col("l"), F.col("t"), F.col("y")).alias("x")).collect()] == [True, True, True, False]


def test_job_rules(spark):
    now = datetime.datetime(2024, 1, 1, 1)
    jobs = spark.createDataFrame([(1, True, False, True, 0, now), (2, False, False, False, 0, now), (3, False, False, True, 3, now), (4, False, False, True, 0, now), (5, False, False, True, 0, now - datetime.timedelta(minutes=9))],
                                 "id int, locked boolean, human_gate boolean, retryable boolean, auto_attempts int, failed_at timestamp")
    got = {r.id: r.decision for r in control.resume_decision(jobs, F.lit(now)).collect()}
    assert got == {1: "locked", 2: "permanent", 3: "exhausted", 4: "cooling_down", 5: "resume"}
    runs = spark.createDataFrame([("x" * 40 + "a", "failed", True, 0, 1), ("x" * 40 + "b", "ok", True, 0, 2), ("y", "failed", True, 2, 1), ("z", "failed", True, 3, 1)], "name string, status string, retryable boolean, resets int, updated int")
    assert sorted(r.action for r in control.repair_action(runs).collect()) == ["leave", "none", "remove", "reset"]
    df = spark.createDataFrame([(1,)], "a int")
    assert df.select(control.merged_progress(F.lit(3), F.lit(7), F.lit(None).cast("int"), F.lit(10)).alias("x")).first().x == 70
    assert df.select(control.pacing(F.lit(500), F.lit(20_000_000), F.lit(1_000_000)).alias("x")).first().x == 3.0


def test_versions(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    control.write_version(df, str(tmp_path / "v"), "v1", None)
    control.write_version(df, str(tmp_path / "v"), "v2", "v1")
    assert {r.version: r.parent_version for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {"v1": None, "v2": "v1"}
    with pytest.raises(ValueError):
        control.write_version(df, str(tmp_path / "v"), "../x", None)
    control.write_report(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().a == 1


def test_drafts_and_quarantine(spark):
    a, b = spark.createDataFrame([("k", 1)], "key string, x int"), spark.createDataFrame([("k", 2), ("m", 3)], "key string, x int")
    assert {(r.key, r.x, r.origin) for r in control.pick_draft((a, "saved"), (b, "toc"), key="key").collect()} == {("k", 1, "saved"), ("m", 3, "toc")}
    noisy = "\x01\x02 1 2 / 3"
    q = control.quarantine(spark.createDataFrame([(noisy,)] * 3 + [("\x01 1 2 3 theMarket",), ("clean prose",)], "text string"))
    assert sorted(r.resolution for r in q.collect()) == ["excluded_from_flow", "noise", "noise", "noise"]


def test_splitting():
    text = "First part. Second one here.\nA line\n\nAnother paragraph that is longer than most."
    for most in (5, 12, 30, 200):
        parts = rewrite.split_down(text, most)
        assert all(len(p) <= most for p in parts) and "".join("".join(parts).split()) == "".join(text.split())
    chunks = rewrite.fixed_chunks("A sentence of some words. " * 2000)
    assert "".join(chunks) == "A sentence of some words. " * 2000 and all(9000 <= len(c) <= 11_000 for c in chunks[:-1])
    assert rewrite.byline(["Title", "by", "Ann Lee", "Bo Chen", "Text starts here now"]) == ["Title", "By Ann Lee Bo Chen", "Text starts here now"]
    assert rewrite.merge_boundaries([(1, 5.0, 0, "A"), (1, 5.2, 2, ""), (1, 9.0, 0, "B"), (2, 5.0, 0, "A")]) == [(1, 5.2, 2, "A"), (1, 9.0, 0, "B"), (2, 5.0, 0, "A")]
    assert rewrite.toc_entries(["One ..... 3", "Two .... 9", "Three 12", "two .... 9"]) == [("One", 3), ("Two", 9), ("Three", 12)]
    assert rewrite.toc_entries(["One", "3", "Two", "9"]) == [("One", 3), ("Two", 9)]
    assert rewrite.lenient_json('Sure:\n```json\n[{"a": 1}]\n```') == [{"a": 1}] and rewrite.lenient_json("none") is None


def test_translation_checks(spark):
    df = spark.createDataFrame([("一二三四五六七八九十[1]", "一二三[1]", "English（英）Other（他）Third（三）")], "a string, b string, g string")
    one = lambda c: df.select(c.alias("x")).first().x
    assert one(rewrite.polish_reject(F.col("a"), F.col("b"))) == "cjk_drop"
    assert one(rewrite.polish_reject(F.col("a"), F.col("a"))) is None
    assert one(rewrite.gloss_pollution(F.lit(""), F.col("g"))) is True
    assert one(rewrite.rewrite_ok(F.lit("word " * 20), F.col("a"))) is False
    assert one(rewrite.non_prose(F.lit("![a](b)"))) is True and one(rewrite.non_prose(F.lit("Plain prose."))) is False
    assert one(rewrite.bad_candidate(F.lit("While Running"))) == "clause_lead" and one(rewrite.bad_candidate(F.lit("New Deal"))) is None
    assert one(rewrite.substituted(F.lit("the Fed and the Fed"), F.array(F.struct(F.lit("Fed").alias("source"), F.lit("美联储").alias("target"))))) == "the 美联储 and the 美联储"
    assert one(rewrite.translated_notes(F.array(F.struct(F.lit("prose").alias("kind"), F.lit("a ").alias("text")), F.struct(F.lit("citation").alias("kind"), F.lit("See b").alias("text"))), F.upper)) == "A See b"
    assert one(rewrite.hard_term(F.lit(None).cast("string"), F.lit("system"))) is True


def test_media_and_inputs(spark):
    blocks = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "b", "![x](y)", "| t | u |", "c"])], "doc int, pos int, text string")
    assert [(r.kind, r.text) for r in rewrite.media_segments(blocks, "doc").orderBy("segment").collect()] == [("text", "a\n\nb"), ("media", "![x](y)"), ("media", "| t | u |"), ("text", "c")]
    ch = spark.createDataFrame([("c1", True, "text\n![x](y)\n![p](fallback-1.png)"), ("c2", False, "x")], "chapter_id string, translate boolean, markdown string")
    assert [r.markdown for r in rewrite.translation_input(ch).collect()] == ["text\n[image]\n[image]"]
    q = spark.createDataFrame([("c1", "bad", None), ("c1", "ok", "noise")], "chapter_id string, text string, resolution string")
    assert sorted(r.violation for r in rewrite.suspicious_pages(q, ch).collect()) == ["fallback_image", "unresolved_ocr"]
    assert P.UNTRANSLATED[0] == "cover" and T.REGNAL.startswith("II|")
