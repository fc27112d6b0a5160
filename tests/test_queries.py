"""Every registered array query against its SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from gridlake.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shaped(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, str, bool, type(None))) else str(v)
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    expected = con.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert shaped(df.collect(), df.columns) == shaped(expected.fetchall(), expected.columns)


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_queries_open_arrays(spark):
    """Plans read fragments; only inputs of writes are plain tables."""
    for name in ("flagship", "attr_and", "dim_range", "agg_multi", "join_dims", "join_star3", "key_lookup", "top_k", "ts_range", "str_dim_eq", "unit_to_day"):
        files = catalogue.queries()[name](spark, SF).inputFiles()
        assert len({f.split("__frag=")[1].split("/")[0] for f in files}) >= 1 + (name != "dim_range"), name


def test_spatial_boxes_reach_the_scan(spark):
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    for name in ("spatial_intersects", "spatial_overlaps"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(_X,-10.0)" in plan and "LessThanOrEqual(_Y,14.0)" in plan
    spark.conf.set("spark.sql.maxMetadataStringLength", before)


def test_pushdown(spark):
    plan = catalogue.queries()["dim_between"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,10)" in plan and "o_orderpriority" not in plan.split("ReadSchema")[1]
