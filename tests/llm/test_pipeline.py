"""The pipeline's stages on the smallest tables and on odd ones."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from quire.llm import common  # noqa: E402
from quire.llm.common import staged  # noqa: E402

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "very long text " * 20_000
ODD = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \t\n ", None, None, 0), (4, "One small text.", "en", "b", 15), (4, "One small text.", "en", "b", 15), (5, "One small text.", None, "b", None),
       (None, "no id here", "en", None, 10), (None, None, None, None, None), (6, LONG, "en", "c", len(LONG)), (7, "日本語 テスト", "ja", "c", 3)]
CLASHES = ("_t", "_text", "_mix_n", "_mix_key", "_p_source", "doc", "shard", "key", "cell", "place", "times", "pass", "first", "part", "fp", "score", "lang_pred", "n", "size", "stays", "ordinal", "sequence_id")


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, DIR), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert before > counts[0] >= counts[1] > counts[2]
    assert docs.select("doc_id").distinct().count() <= counts[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert packed.groupBy("sequence_id").sum("length").toPandas()["sum(length)"].max() <= 4096
    assert packed.where("piece = 0").count() == counts[3]


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "simhash_near_dedup", "mixing", "best_fit_packing"]


def test_exact_copies_leave_one_document(spark):
    text = " ".join(f"word{i}" for i in range(50))
    docs = spark.createDataFrame([(5, text, "en", "a", 1), (3, text, "en", "b", 1), (3, text, "en", "b", 1), (9, "something else entirely", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_filter(spark, docs, DIR).collect()) == [3, 9]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names are used inside."""
    docs = spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit(7) for c in CLASHES})
    out = stage(spark, docs, DIR)
    if name == "best_fit_packing":
        assert {r.length for r in out.where("doc_id < 4").collect()} == {1}
        assert out.where("piece = 0").count() == len(ODD)
        return
    assert out.columns == docs.columns
    got = sorted(r.doc_id or 0 for r in out.collect())
    assert set(got) <= {0, 1, 2, 3, 4, 5, 6, 7}
    if name == "toxicity":
        assert {1, 2, 3} <= set(got)
    elif name == "language_id":
        assert not {1, 2, 3} & set(got)
    elif name == "simhash_near_dedup":
        assert got == [0, 1, 4, 6, 7]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_empty_tables(spark, name, stage):
    docs = spark.createDataFrame([], DOCS)
    out = stage(spark, docs, DIR)
    assert out.count() == 0 and (name == "best_fit_packing" or out.columns == docs.columns)


def test_run_leaves_only_its_result(spark):
    common.clear_staged(spark)
    out = corpus_pipeline.run(spark, DIR)
    assert common._staged == [out._quire_path]
    rows = out.collect()
    bins = {}
    for r in rows:
        bins[r.sequence_id] = bins.get(r.sequence_id, 0) + r.length
    assert rows and max(bins.values()) <= 4096


def test_staged_tables_can_be_cleared(spark):
    a, b = common.staged(spark.range(3), "a"), common.staged(spark.range(4), "b")
    common.drop_staged(a)
    assert b.count() == 4
    common.clear_staged(spark)
    assert not common._staged
