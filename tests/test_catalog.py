"""Each catalog query against DuckDB on the same tables."""

import datetime
import os

import duckdb
import pytest

from lodestack.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return round(v, 6) if isinstance(v, float) else v


def in_order(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


def test_q10_finds_packs_by_tag(spark, tmp_path):
    spark.createDataFrame([(1, "4-LOW"), (2, "3-MEDIUM")], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 7), (2, 8)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(7, "ring", "Medium#1", "PROMO"), (8, "ring", "Brand#1", "PROMO")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    assert in_order(QUERIES["q10_search_any_field"](spark, str(tmp_path)).collect()) == [(1, "tags"), (2, "category")]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_like_duckdb(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    rows = in_order(got.select(*[f"`{c}`" for c in cols]).collect())
    assert rows == in_order(want)
    assert rows


def test_every_query_is_covered():
    assert set(QUERIES) == set(ORACLE_SQL)
