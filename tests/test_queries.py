"""Every registered query against its SQL twin on the smallest driver tables."""
import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (str, bool)):
        return v
    return float(v) if isinstance(v, (int, float)) or hasattr(v, "__float__") else str(v)


def canon(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = canon([tuple(r[c] for c in cols) for r in df.collect()])
    if name not in SQL:
        assert got
        return
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    assert got == canon([tuple(r[i] for i in order) for r in rel.fetchall()])


def test_entry_is_the_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["vec_id", "verdict", "m"] and 0 < df.count() <= 20
    assert set(SQL) <= set(QUERIES)
