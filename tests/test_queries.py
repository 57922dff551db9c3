"""Every query with SQL gives what DuckDB gives, on the smallest tables; the others have rows and don't depend on the
number of partitions."""

import glob
import os

import duckdb
import pytest

from orrery.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_reruns_agree(spark, name):
    first = rows(*(lambda d: (d.columns, map(tuple, d.collect())))(QUERIES[name](spark, SF)))
    assert first[1]
    if name != "learned_fusion":
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        try:
            assert rows(*(lambda d: (d.columns, map(tuple, d.collect())))(QUERIES[name](spark, SF))) == first
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
