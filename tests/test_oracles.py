"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from quire.plans.backlog import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert rows == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in result.fetchall())


def test_input_gate_on_long_texts(spark, tmp_path):
    """Made-up bytes of texts over 53,687 characters pass the range of an int."""
    path = str(tmp_path / "documents.parquet")
    rows = [(0, "x" * 60_000, "en", "a", 60_000), (1, "y" * 3_000, "en", "a", 3_000), (2, "", "en", None, 0), (3, None, None, None, None), (899, "few", "en", "a", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    got = {tuple(r) for r in QUERIES["input_gate"](spark, str(tmp_path)).select("doc_id", "gate", "gate_ok", "warn").collect()}
    sql = duckdb.connect()
    sql.execute(f"create view documents as select * from '{path}/*.parquet'")
    assert got == set(sql.execute(f"SELECT doc_id, gate, gate_ok, warn FROM ({ORACLES['input_gate']})").fetchall())
    assert {d: g for d, g, *_ in got}[0] == "too_large"
