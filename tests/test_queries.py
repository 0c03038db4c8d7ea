"""Every registered query with an SQL equivalent gives DuckDB's rows."""

import glob
import os

import duckdb
import pytest

from notelake import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(row, names):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in (row[n] for n in names))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in queries.ORACLES:
        assert rows
        return
    cur = duck.execute(queries.ORACLES[name])
    names = sorted(d[0] for d in cur.description)
    want = [dict(zip([d[0] for d in cur.description], r, strict=True)) for r in cur.fetchall()]
    assert sorted(df.columns) == names
    key = lambda t: tuple((v is None, str(v)) for v in t)
    assert sorted((plain(r, names) for r in rows), key=key) == sorted((plain(r, names) for r in want), key=key)


def test_folder_contents_of_odd_texts(spark, tmp_path):
    """Empty and missing texts inside and outside of what is asked for, and every kind of line end."""
    texts = ["", None, "a\r\nb\rc\n\rd", "plain", "\r", " ", "\ufeffx\x00\u2028y\x85z"]
    rows = [(i, texts[i % 7], f"src{i // 7 % 4}") for i in range(84)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["folder_contents"]).fetchall()
    got = [(r.path, r.content) for r in queries.QUERIES["folder_contents"](spark, str(tmp_path)).collect()]
    assert {c for _, c in want} >= {"", None, "a\nb\nc\n\nd", "\n"}
    assert sorted(got, key=str) == sorted(want, key=str)
