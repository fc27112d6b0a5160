"""The array engine's registered queries and the SQL that gives the same rows."""

from __future__ import annotations

import datetime
import math
import re
import secrets
import struct
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridlake.functions import geometry, units, values
from gridlake.functions import types as kinds
from gridlake.operators import dense, lookup, merge, ordering, slicing, spatial
from gridlake.plans.arrays import array, catalog_of
from gridlake.session import Options
from gridlake.sources.catalog import ArrayCatalog
from gridlake.sources.schema import ArraySchema, Attribute, Dimension
from gridlake.sources.scratch import new_folder

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A plain table, as input of writes."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """All cells of an array of two fragments."""
    return array(spark, sf_dir, name).df()


def _register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def _simple(name: str, table: str, columns: list[str], where: Callable[[], Column] | dict | None, sql_where: str = "TRUE", on: str | None = None) -> None:
    """A projection and filter of one array (``on``, or the table's own); a dict is a slice by dimension."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if isinstance(where, dict):
            return array(spark, sf_dir, on or table).slice(where, columns)
        df = _cells(spark, sf_dir, on or table)
        return (df if where is None else df.where(where())).select(*columns)

    _QUERIES[name] = run
    _SQL[name] = f"SELECT {', '.join(columns)} FROM {table} WHERE {sql_where}"


ORDERS = ["o_orderkey", "o_custkey", "o_totalprice"]
LINES = ["l_orderkey", "l_linenumber", "l_quantity"]
CUSTOMERS = ["c_custkey", "c_acctbal", "c_mktsegment"]
c = F.col

# -- scans and projections
_simple("scan_full", "region", ["*"], None)
_simple("project_prune", "lineitem", ["l_orderkey", "l_quantity"], None)
_QUERIES["project_expression"] = lambda spark, sf_dir: _cells(spark, sf_dir, "lineitem").select("l_orderkey", (c("l_quantity") + 0).alias("quantity"), (c("l_extendedprice") * (1 - c("l_discount"))).alias("net"))
_SQL["project_expression"] = "SELECT l_orderkey, l_quantity + 0 AS quantity, l_extendedprice * (1 - l_discount) AS net FROM lineitem"

# -- dimension predicates
_simple("dim_eq", "orders", ORDERS, {"o_orderkey": 77}, "o_orderkey = 77")
_simple("dim_range", "orders", ORDERS, {"o_orderkey": (100, 220)}, "o_orderkey >= 100 AND o_orderkey <= 220")
_simple("dim_between", "orders", ORDERS, lambda: c("o_orderkey").between(10, 20), "o_orderkey BETWEEN 10 AND 20")
_simple("dim_not_between", "orders", ORDERS, lambda: ~c("o_orderkey").between(100, 14000), "o_orderkey NOT BETWEEN 100 AND 14000")
_simple("dim_in", "orders", ORDERS, {"o_orderkey": [1, 5, 9, 5]}, "o_orderkey IN (1, 5, 9)")
_simple("dim_strict", "orders", ORDERS, lambda: (c("o_orderkey") > 10) & (c("o_orderkey") < 15), "o_orderkey > 10 AND o_orderkey < 15")
_simple("dim_and_merge", "orders", ORDERS, lambda: (c("o_orderkey") >= 1) & (c("o_orderkey") > 2) & (c("o_orderkey") < 40), "o_orderkey >= 1 AND o_orderkey > 2 AND o_orderkey < 40")
_simple("dim_contradiction", "orders", ORDERS, lambda: (c("o_orderkey") == 1) & (c("o_orderkey") == 3), "o_orderkey = 1 AND o_orderkey = 3")
_simple("dim_range_and_in", "orders", ORDERS, lambda: (c("o_orderkey") >= 2) & c("o_orderkey").isin(1, 3), "o_orderkey >= 2 AND o_orderkey IN (1, 3)")
_simple("subarray_2d", "lineitem", LINES, {"l_orderkey": (10, 500), "l_linenumber": (2, 4)}, "l_orderkey BETWEEN 10 AND 500 AND l_linenumber BETWEEN 2 AND 4")
_simple("multirange_2d", "lineitem", LINES, {"l_orderkey": [(10, 50), (400, 420), 999], "l_linenumber": [1, 3, 7]}, "(l_orderkey BETWEEN 10 AND 50 OR l_orderkey BETWEEN 400 AND 420 OR l_orderkey = 999) AND l_linenumber IN (1, 3, 7)")
_simple("multirange_with_contained_points", "lineitem", LINES, {"l_orderkey": [(10, 50), 20, 30, 60]}, "l_orderkey BETWEEN 10 AND 50 OR l_orderkey = 60")
_simple("tuple_in", "lineitem", LINES, lambda: slicing.any_tuple(["l_orderkey", "l_linenumber"], [(1, 1), (2, 4), (3, 2), (70, 5)]), "(l_orderkey, l_linenumber) IN ((1, 1), (2, 4), (3, 2), (70, 5))")
_simple("str_dim_eq", "customer", CUSTOMERS, {"c_mktsegment": "BUILDING"}, "c_mktsegment = 'BUILDING'", "customer_by_segment")
_simple("str_dim_in", "customer", CUSTOMERS, {"c_mktsegment": ["BUILDING", "MACHINERY"]}, "c_mktsegment IN ('BUILDING', 'MACHINERY')", "customer_by_segment")
_simple("str_dim_range", "customer", CUSTOMERS, {"c_mktsegment": ("F", None)}, "c_mktsegment >= 'F'", "customer_by_segment")
_simple("utf8_attr_contains", "documents", ["doc_id", "lang"], lambda: c("text").contains("é") & (c("lang") == "fr"), "contains(text, 'é') AND lang = 'fr'")

_UTF8 = ("customer", ["c_custkey"], False)


@_register("utf8_attr_eq", "SELECT c_custkey, 'Zürich ' || c_mktsegment AS label FROM customer WHERE c_mktsegment = 'BUILDING'")
def _utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality of a UTF-8 attribute, which the scan's row groups are filtered by."""
    labelled = array(spark, sf_dir, "customer_labels", lambda rows: rows.select("c_custkey", F.concat(F.lit("Zürich "), "c_mktsegment").alias("label")), _UTF8)
    return labelled.df().where(c("label") == "Zürich BUILDING")


# -- attribute predicates
for _name, _op, _sql in (("eq", lambda: c("l_quantity") == 10, "= 10"), ("ne", lambda: c("l_quantity") != 10, "<> 10"), ("lt", lambda: c("l_quantity") < 3, "< 3"), ("le", lambda: c("l_quantity") <= 3, "<= 3"), ("gt", lambda: c("l_quantity") > 48, "> 48"), ("ge", lambda: c("l_quantity") >= 48, ">= 48"), ("between", lambda: c("l_quantity").between(10, 12), "BETWEEN 10 AND 12"), ("in", lambda: c("l_quantity").isin(1, 7, 9), "IN (1, 7, 9)")):
    _simple(f"attr_{_name}", "lineitem", LINES, _op, f"l_quantity {_sql}")
_simple("attr_and", "lineitem", LINES, lambda: (c("l_quantity") > 40) & (c("l_discount") < 0.05), "l_quantity > 40 AND l_discount < 0.05")
_simple("attr_or", "lineitem", LINES, lambda: (c("l_quantity") > 49) | (c("l_discount") < 0.01), "l_quantity > 49 OR l_discount < 0.01")
_simple("dim_or_dim", "lineitem", LINES, lambda: (c("l_orderkey") == 5) | (c("l_linenumber") == 7), "l_orderkey = 5 OR l_linenumber = 7")
_simple("dim_or_attr", "lineitem", LINES, lambda: (c("l_orderkey") < 20) | (c("l_quantity") == 50), "l_orderkey < 20 OR l_quantity = 50")
_simple("nested_bool", "lineitem", LINES, lambda: ((c("l_orderkey") < 300) & ((c("l_quantity") > 45) | (c("l_tax") < 0.01))) | ((c("l_linenumber") == 2) & ~(c("l_quantity") < 49)), "(l_orderkey < 300 AND (l_quantity > 45 OR l_tax < 0.01)) OR (l_linenumber = 2 AND NOT (l_quantity < 49))")
_simple("int_literal_on_float", "customer", CUSTOMERS, lambda: c("c_acctbal") > 3, "c_acctbal > 3")
_simple("decimal_literal_on_int", "part", ["p_partkey", "p_size"], lambda: (c("p_size") < 2.5) & (c("p_size") != 1.5), "p_size < 2.5 AND p_size <> 1.5")
_simple("negative_float_lt", "customer", CUSTOMERS, lambda: c("c_acctbal") < 0, "c_acctbal < 0")
_simple("function_argument", "customer", CUSTOMERS, lambda: F.abs(c("c_acctbal")) < F.lit(10) * 10, "abs(c_acctbal) < 10 * 10")
_simple("is_null", "lineitem", ["l_orderkey", "l_linenumber"], lambda: F.nullif(c("l_linenumber"), F.lit(1)).isNull(), "nullif(l_linenumber, 1) IS NULL")
_simple("is_not_null", "lineitem", ["l_orderkey", "l_linenumber"], lambda: F.nullif(c("l_linenumber"), F.lit(1)).isNotNull(), "nullif(l_linenumber, 1) IS NOT NULL")


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


EVENTS = ["event_id", "user_id", "event_type"]
_simple("ts_range", "events", EVENTS, lambda: (c("ts") >= _ts("2024-01-05 00:00:00")) & (c("ts") < _ts("2024-01-06 12:30:00")), "ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-06 12:30:00'", "events_by_time")
_simple("ts_between", "events", EVENTS, lambda: c("ts").between(_ts("2024-01-10 00:00:00"), _ts("2024-01-10 23:59:59.999999")), "ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-10 23:59:59.999999'", "events_by_time")
_simple("ts_eq", "orders", ORDERS, lambda: c("o_orderdate") == _ts("1995-03-15 00:00:00.000"), "o_orderdate = TIMESTAMP '1995-03-15'", "orders_by_date")
_simple("ts_in", "orders", ORDERS, lambda: c("o_orderdate").isin(_ts("1995-03-15"), _ts("1996-01-01"), _ts("1997-07-04")), "o_orderdate IN (TIMESTAMP '1995-03-15', TIMESTAMP '1996-01-01', TIMESTAMP '1997-07-04')", "orders_by_date")
_simple("ts_year", "orders", ORDERS, lambda: F.year("o_orderdate") == 1996, "year(o_orderdate) = 1996")


# -- aggregates
def _agg(name: str, table: str, aggs: Callable[[], list[Column]], sql: str, where: Callable[[], Column] | None = None, tail: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _cells(spark, sf_dir, table)
        return (df if where is None else df.where(where())).agg(*aggs())

    _QUERIES[name] = run
    _SQL[name] = f"SELECT {sql} FROM {table} {tail}"


def _sum(column: str, name: str) -> Column:
    """A float sum that does not depend on the order of additions within the rounding."""
    return F.round(F.sum(c(column)), 2).alias(name)


_agg("agg_sum", "lineitem", lambda: [_sum("l_quantity", "s"), F.sum("l_linenumber").alias("n")], "round(sum(l_quantity), 2) AS s, CAST(sum(l_linenumber) AS BIGINT) AS n")
_agg("agg_avg", "lineitem", lambda: [F.round(F.avg("l_quantity"), 6).alias("a")], "round(avg(l_quantity), 6) AS a")
_agg("agg_min", "lineitem", lambda: [F.min("l_extendedprice").alias("m")], "min(l_extendedprice) AS m")
_agg("agg_max", "lineitem", lambda: [F.max("l_extendedprice").alias("m")], "max(l_extendedprice) AS m")
_agg("agg_count", "lineitem", lambda: [F.count("l_tax").alias("n"), F.count(F.lit(1)).alias("rows")], "count(l_tax) AS n, count(*) AS rows")
_agg("agg_multi", "orders", lambda: [_sum("o_totalprice", "s"), F.round(F.avg("o_totalprice"), 4).alias("a"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.count("o_totalprice").alias("n")], "round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(o_totalprice) AS n")
_agg("agg_filtered", "lineitem", lambda: [_sum("l_quantity", "s"), F.count(F.lit(1)).alias("n")], "round(sum(l_quantity), 2) AS s, count(*) AS n", lambda: c("l_orderkey").between(100, 900) & (c("l_discount") > 0.02), "WHERE l_orderkey BETWEEN 100 AND 900 AND l_discount > 0.02")
_agg("agg_dim", "orders", lambda: [F.sum("o_orderkey").alias("s"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")], "CAST(sum(o_orderkey) AS BIGINT) AS s, min(o_orderkey) AS lo, max(o_orderkey) AS hi")
_agg("agg_string_minmax", "customer", lambda: [F.min("c_name").alias("lo"), F.max("c_name").alias("hi"), F.max(F.repeat("c_name", 3)).alias("long")], "min(c_name) AS lo, max(c_name) AS hi, max(repeat(c_name, 3)) AS long")
_agg("agg_datetime_minmax", "events", lambda: [F.min("ts").alias("lo"), F.max("ts").alias("hi")], "min(ts) AS lo, max(ts) AS hi")
_agg("null_aggs", "lineitem", lambda: [f(F.nullif(c("l_linenumber"), F.lit(1))).alias(n) for n, f in (("s", F.sum), ("lo", F.min), ("hi", F.max), ("n", F.count))], "CAST(sum(nullif(l_linenumber, 1)) AS BIGINT) AS s, min(nullif(l_linenumber, 1)) AS lo, max(nullif(l_linenumber, 1)) AS hi, count(nullif(l_linenumber, 1)) AS n")
_agg("agg_empty_input", "orders", lambda: [F.sum("o_orderkey").alias("s"), F.coalesce(F.sum("o_orderkey"), F.lit(0)).alias("z"), F.count("o_orderkey").alias("n")], "CAST(sum(o_orderkey) AS BIGINT) AS s, CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS z, count(o_orderkey) AS n", lambda: c("o_orderkey") < -1, "WHERE o_orderkey < -1")


@_register("group_by_host", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY ALL HAVING count(*) > 10")
def _group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), _sum("l_quantity", "s")).where("n > 10")


# -- joins
@_register("join_dims", "SELECT a.conv_id, a.turn, a.role, b.text FROM conversations a JOIN conversations b USING (conv_id, turn)")
def _join_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _cells(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", "role").join(t.select("conv_id", "turn", "text"), ["conv_id", "turn"])


@_register("join_attr", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey > 10")
def _join_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, "supplier").join(_cells(spark, sf_dir, "nation").where("n_nationkey > 10"), c("s_nationkey") == c("n_nationkey")).select("s_suppkey", "n_name")


@_register("join_attr_agg", "SELECT s_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS s FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_acctbal > 0 GROUP BY ALL")
def _join_attr_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays joined on an attribute of both; the customers of a nation are added up before they meet the suppliers."""
    sums = _cells(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy(c("c_nationkey").alias("s_nationkey")).agg(F.count(F.lit(1)).alias("k"), F.sum("c_acctbal").alias("t"))
    own = _cells(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("m"))
    return own.join(sums, "s_nationkey").select("s_nationkey", (c("m") * c("k")).alias("n"), F.round(c("m") * c("t"), 2).alias("s"))


@_register("join_star3", "SELECT count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' AND c_acctbal > 0")
def _star(spark: SparkSession, sf_dir: str) -> DataFrame:
    europe = _cells(spark, sf_dir, "region").where("r_name = 'EUROPE'")
    return _cells(spark, sf_dir, "customer").where("c_acctbal > 0").join(_cells(spark, sf_dir, "nation"), c("c_nationkey") == c("n_nationkey")).join(europe, c("n_regionkey") == c("r_regionkey")).agg(F.count(F.lit(1)).alias("n"))


@_register("join_hetero", "SELECT a.o_orderkey, b.l_linenumber FROM (SELECT CAST(o_orderkey AS DOUBLE) AS k, o_orderkey FROM orders) a JOIN lineitem b ON a.k = b.l_orderkey")
def _hetero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DOUBLE dimension joined with a BIGINT one."""
    orders = array(spark, sf_dir, "orders_by_float", lambda rows: rows.select(c("o_orderkey").cast("double").alias("k"), "o_orderkey"), ("orders", ["k"], False))
    return orders.df().join(_cells(spark, sf_dir, "lineitem"), c("k") == c("l_orderkey")).select("o_orderkey", "l_linenumber")


@_register("join_ts", "SELECT a.o_orderkey, b.l_orderkey, b.l_linenumber FROM orders a JOIN lineitem b ON a.o_orderdate = b.l_shipdate AND a.o_orderkey = b.l_orderkey")
def _join_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, "orders_by_date").join(_cells(spark, sf_dir, "lineitem_by_date"), (c("o_orderdate") == c("l_shipdate")) & (c("o_orderkey") == c("l_orderkey"))).select("o_orderkey", "l_orderkey", "l_linenumber")


@_register("agg_over_join", "SELECT round(sum(l_quantity), 2) AS s, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def _agg_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, "lineitem").join(_cells(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), c("l_orderkey") == c("o_orderkey")).agg(_sum("l_quantity", "s"), F.count(F.lit(1)).alias("n"))


@_register("batched_key_join", "SELECT o.o_orderkey, o.o_totalprice, k.l_linenumber FROM orders o JOIN (SELECT l_orderkey AS o_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 50) k USING (o_orderkey)")
def _batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _cells(spark, sf_dir, "lineitem").where("l_quantity = 50").select(c("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return lookup.batched_key_join(_cells(spark, sf_dir, "orders"), keys, ["o_orderkey"]).select("o_orderkey", "o_totalprice", "l_linenumber")


# -- keys and order
@_register("key_lookup", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 33 AND l_linenumber = 2")
def _key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return array(spark, sf_dir, "lineitem").find((33, 2)).select(*LINES)


@_register("prefix_key", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 33")
def _prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return array(spark, sf_dir, "lineitem").find((33,), "PREFIX").select(*LINES)


@_register("after_key", "SELECT conv_id, turn, role FROM conversations WHERE conv_id > 40 OR (conv_id = 40 AND turn > 1)")
def _after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return array(spark, sf_dir, "conversations").find((40, 1), "AFTER_KEY").select("conv_id", "turn", "role")


@_register("key_or_prev", "SELECT conv_id, turn, role FROM conversations WHERE conv_id < 40 OR (conv_id = 40 AND turn <= 1)")
def _prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return array(spark, sf_dir, "conversations").find((40, 1), "KEY_OR_PREV").select("conv_id", "turn", "role")


for _flag, _sql in {"KEY_OR_NEXT": "conv_id > 40 OR (conv_id = 40 AND turn >= 1)", "BEFORE_KEY": "conv_id < 40 OR (conv_id = 40 AND turn < 1)"}.items():
    _QUERIES[_flag.lower()] = lambda spark, sf_dir, f=_flag: array(spark, sf_dir, "conversations").find((40, 1), f).select("conv_id", "turn", "role")
    _SQL[_flag.lower()] = f"SELECT conv_id, turn, role FROM conversations WHERE {_sql}"
_QUERIES["prefix_last"] = lambda spark, sf_dir: array(spark, sf_dir, "lineitem").find((33,), "PREFIX_LAST").select(*LINES)
_SQL["prefix_last"] = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 33 ORDER BY l_orderkey DESC, l_linenumber DESC"
_QUERIES["permuted_key"] = lambda spark, sf_dir: array(spark, sf_dir, "lineitem").find((2, 33), "EXACT", ["l_linenumber", "l_orderkey"]).select(*LINES)
_SQL["permuted_key"] = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 33 AND l_linenumber = 2"
_QUERIES["second_dim_key"] = lambda spark, sf_dir: array(spark, sf_dir, "lineitem").find((7,), "EXACT", ["l_linenumber"]).select(*LINES)
_SQL["second_dim_key"] = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber = 7"


@_register("join_string_dims", "SELECT c_mktsegment, count(*) AS n, sum(c_custkey) :: BIGINT AS s FROM customer JOIN (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment < 'G') USING (c_mktsegment) GROUP BY ALL")
def _join_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = array(spark, sf_dir, "customer_by_segment")
    few = table.slice({"c_mktsegment": (None, "FZZZ")}, ["c_mktsegment"]).distinct()
    return table.df().join(few, "c_mktsegment").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("s"))


@_register("join_date_string", "SELECT a.o_orderkey, a.o_orderpriority FROM orders a JOIN (SELECT o_orderdate, o_orderpriority, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) b USING (o_orderdate, o_orderpriority, o_orderkey)")
def _join_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on a time, a string and a number dimension at once."""
    mixed = array(spark, sf_dir, "orders_mixed", lambda rows: rows.select("o_orderdate", "o_orderpriority", "o_orderkey", "o_totalprice"), ("orders", ["o_orderdate", "o_orderpriority", "o_orderkey"], False))
    last = _cells(spark, sf_dir, "orders_by_date").groupBy("o_orderdate", "o_orderpriority").agg(F.max("o_orderkey").alias("o_orderkey"))
    return mixed.df().join(last, ["o_orderdate", "o_orderpriority", "o_orderkey"]).select("o_orderkey", "o_orderpriority")


def _numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows per conversation with their place in the order, which must be unique within it."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))


@_register("order_desc", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS place FROM conversations")
def _order_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(_cells(spark, sf_dir, "conversations").select("conv_id", "turn"), [c("turn").desc()])


@_register("layout_row_major", "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn")
def _row_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.row_major(_cells(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])


@_register("layout_col_major", "SELECT conv_id, turn, role FROM conversations ORDER BY turn, conv_id")
def _col_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.col_major(_cells(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])


@_register("order_by_multi", "SELECT o_orderstatus, o_totalprice, o_orderkey FROM orders ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey")
def _order_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice", "o_orderkey").orderBy(c("o_orderstatus").desc(), "o_totalprice", "o_orderkey")


@_register("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(c("o_totalprice").desc(), "o_orderkey").limit(20)


# -- versions of cells, through real arrays
_ORDER_ARRAY = ArraySchema((Dimension("o_orderkey", "BIGINT", 0, 10**15, 10**6),), (Attribute("o_totalprice", "DOUBLE"), Attribute("o_orderstatus", "VARCHAR")))
_V1 = "SELECT o_orderkey, o_totalprice, o_orderstatus, 1 AS ver FROM orders"
_V2 = "SELECT o_orderkey, o_totalprice + 1000 AS o_totalprice, nullif(o_orderstatus, 'F') AS o_orderstatus, 2 AS ver FROM orders WHERE o_orderkey % 3 = 0"
_V3 = "SELECT o_orderkey, -1.0 AS o_totalprice, 'X' AS o_orderstatus, 3 AS ver FROM orders WHERE o_orderkey % 5 = 0"


def _merged(versions: int, where: str = "TRUE", dims: str = "TRUE") -> str:
    union = " UNION ALL ".join([_V1, _V2, _V3][:versions])
    return f"SELECT o_orderkey, o_totalprice, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY ver DESC) AS r FROM ({union}) WHERE {dims}) WHERE r = 1 AND {where}"


def _order_table(spark: SparkSession, sf_dir: str, versions: int = 3, open_at: int | None = None, dups: bool = False):
    from dataclasses import replace

    catalog = ArrayCatalog(spark, new_folder(spark, "arrays"))
    table = catalog.create("orders", replace(_ORDER_ARRAY, allows_dups=dups))
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    later = [orders, orders.where("o_orderkey % 3 = 0").select("o_orderkey", (c("o_totalprice") + 1000).alias("o_totalprice"), F.nullif(c("o_orderstatus"), F.lit("F")).alias("o_orderstatus")), orders.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit(-1.0).alias("o_totalprice"), F.lit("X").alias("o_orderstatus"))]
    for stamp, rows in enumerate(later[:versions], 1):
        table.insert(rows, timestamp=stamp)
    return catalog.open("orders", open_at=open_at)


_QUERIES["merge_last_write"] = lambda spark, sf_dir: _order_table(spark, sf_dir).df()
_SQL["merge_last_write"] = _merged(3)
_QUERIES["filter_after_merge"] = lambda spark, sf_dir: _order_table(spark, sf_dir).df().where((c("o_totalprice") > 100_000) & c("o_orderstatus").isNotNull())
_SQL["filter_after_merge"] = _merged(3, "o_totalprice > 100000 AND o_orderstatus IS NOT NULL")
_QUERIES["slice_before_merge"] = lambda spark, sf_dir: _order_table(spark, sf_dir).slice({"o_orderkey": [(30, 90), 1000]})
_SQL["slice_before_merge"] = _merged(3, dims="(o_orderkey BETWEEN 30 AND 90 OR o_orderkey = 1000)")
_QUERIES["time_travel"] = lambda spark, sf_dir: _order_table(spark, sf_dir, open_at=2).df()
_SQL["time_travel"] = _merged(2)
_QUERIES["dups_kept"] = lambda spark, sf_dir: _order_table(spark, sf_dir, dups=True).df().groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))
_SQL["dups_kept"] = f"SELECT o_orderkey, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM ({_V1} UNION ALL {_V2} UNION ALL {_V3}) GROUP BY o_orderkey"
_QUERIES["merge_operator"] = lambda spark, sf_dir: merge.last_write_wins(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_extendedprice"])
_SQL["merge_operator"] = "SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC) AS r FROM lineitem) WHERE r = 1"


@_register("non_empty_domain", "SELECT min(l_orderkey) AS l_orderkey_min, max(l_orderkey) AS l_orderkey_max, min(l_linenumber) AS l_linenumber_min, max(l_linenumber) AS l_linenumber_max FROM lineitem")
def _domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the manifests, without reading data."""
    return array(spark, sf_dir, "lineitem").aggregates().drop("cells")


@_register("dense_fill", """WITH cells AS (SELECT l_linenumber, l_suppkey, CAST(count(*) AS INTEGER) AS n, max(nullif(l_returnflag, 'A')) AS flag FROM lineitem GROUP BY ALL),
e AS (SELECT min(l_linenumber) AS a, max(l_linenumber) AS b, min(l_suppkey) AS c, max(l_suppkey) AS d FROM lineitem),
g AS (SELECT CAST(unnest(generate_series(a, b)) AS BIGINT) AS l_linenumber, c, d FROM e),
h AS (SELECT l_linenumber, CAST(unnest(generate_series(c, d)) AS BIGINT) AS l_suppkey FROM g)
SELECT h.l_linenumber, h.l_suppkey, CASE WHEN c.n IS NULL THEN -2147483648 ELSE c.n END AS n, CASE WHEN c.n IS NULL THEN 'none' ELSE c.flag END AS flag FROM h LEFT JOIN cells c USING (l_linenumber, l_suppkey)""")
def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all line items on the grid of their non-empty domain, written to a dense array and read back."""
    cells = _cells(spark, sf_dir, "lineitem").groupBy(c("l_linenumber").cast("bigint").alias("l_linenumber"), "l_suppkey").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max(F.nullif(c("l_returnflag"), F.lit("A"))).alias("flag"))
    schema = ArraySchema((Dimension("l_linenumber", "BIGINT", 0, 10**6, 10), Dimension("l_suppkey", "BIGINT", 0, 10**9, 10**4)), (Attribute("n", "INT", nullable=False), Attribute("flag", "VARCHAR", default="none", has_default=True)), "DENSE")
    table = ArrayCatalog(spark, new_folder(spark, "arrays")).create("counts", schema)
    table.insert(cells, timestamp=1)
    return table.df()


# -- schema work
def _evolving(spark: SparkSession, sf_dir: str):
    catalog = ArrayCatalog(spark, new_folder(spark, "arrays"))
    table = catalog.create("orders", _ORDER_ARRAY)
    orders = _read(spark, sf_dir, "orders")
    table.insert(orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), timestamp=1)
    return table, orders


@_register("alter_add_col", "SELECT o_orderkey, o_totalprice, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority END AS note, CASE WHEN o_orderkey % 7 = 0 THEN 9 ELSE 5 END AS level FROM orders")
def _add(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, orders = _evolving(spark, sf_dir)
    table.alter(add=[Attribute("note", "VARCHAR"), Attribute("level", "INT", nullable=False, default=5, has_default=True)])
    table.insert(orders.where("o_orderkey % 7 = 0").select("o_orderkey", "o_totalprice", "o_orderstatus", c("o_orderpriority").alias("note"), F.lit(9).alias("level")), timestamp=2)
    return table.df()


@_register("alter_drop_col", "SELECT o_orderkey, o_totalprice, CAST(NULL AS VARCHAR) AS o_orderstatus FROM orders")
def _drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, _ = _evolving(spark, sf_dir)
    table.alter(drop=["o_orderstatus"])
    table.alter(add=[Attribute("o_orderstatus", "VARCHAR")])  # a new column: what was dropped does not come back
    return table.df()


@_register("subset_recast", "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS o_totalprice FROM orders")
def _subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subset of the columns, re-typed on opening."""
    cells = catalog_of(spark, sf_dir, "orders").open("orders", columns={"o_orderkey": "double", "o_totalprice": "double"}).df()
    return cells.select("o_orderkey", F.round("o_totalprice").cast("bigint").alias("o_totalprice"))


@_register("fill_default", "SELECT o_orderkey, 12345 AS attr0, 'abc' AS attr1, 12.345 :: DOUBLE AS attr2 FROM orders")
def _fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = ArrayCatalog(spark, new_folder(spark, "arrays"))
    table = catalog.create_sql("CREATE TABLE fills (o_orderkey bigint dimension=1 lower_bound='0' upper_bound='1000000000' tile_extent='1000', attr0 int NOT NULL DEFAULT 12345, attr1 varchar(255) DEFAULT 'abc', attr2 double NOT NULL DEFAULT 12.345, PRIMARY KEY(o_orderkey))")
    table.insert(_read(spark, sf_dir, "orders").select("o_orderkey"))
    return table.df()


@_register("metadata_kv", "SELECT * FROM (VALUES ('key1', '25'), ('key2', '25,26,27,28'), ('key3', '25.1'), ('key4', '25.1,26.2,27.3'), ('key5', 'some text')) t(key, value)")
def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = ArrayCatalog(spark, new_folder(spark, "arrays"))
    catalog.create("m", _ORDER_ARRAY).put_metadata({"key1": 25, "key2": [25, 26, 27, 28], "key3": 25.1, "key4": [25.1, 26.2, 27.3], "key5": "some text"})
    return catalog.read("m@metadata")


@_register("insert_select", "SELECT n_nationkey, n_name FROM nation")
def _insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = ArrayCatalog(spark, new_folder(spark, "arrays"))
    schema = ArraySchema((Dimension("n_nationkey", "BIGINT", 0, 1000, 10),), (Attribute("n_name", "VARCHAR", filters="ZSTD=7"),))
    first, second = catalog.create("a", schema), catalog.create("b", schema)
    first.insert(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    second.insert(first.df())
    second.insert(first.df())
    return second.df()


@_register("csv_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "arrays")
    _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).option("sep", ";").csv(f"{folder}/csv")
    schema = ArraySchema((Dimension("n_nationkey", "BIGINT", 0, 1000, 10),), (Attribute("n_name", "VARCHAR"), Attribute("n_regionkey", "BIGINT")), allows_dups=True)
    table = ArrayCatalog(spark, folder).create("loaded", schema)
    table.load_csv(f"{folder}/csv", delimiter=";")
    return table.df()


@_register("encrypted_array", "SELECT n_nationkey, n_name FROM nation")
def _encrypted(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = ArraySchema((Dimension("n_nationkey", "BIGINT", 0, 1000, 10),), (Attribute("n_name", "VARCHAR"),), encrypted=True)
    table = ArrayCatalog(spark, new_folder(spark, "arrays")).create("secret", schema, encryption_key=secrets.token_hex(16))
    table.insert(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return table.df()


# -- values
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_LABELS = ", ".join(f"'{p}'" for p in _PRIORITIES)


@_register("enum_decode", f"SELECT o_orderkey, CAST(list_position([{_LABELS}], o_orderpriority) - 1 AS BIGINT) AS code, CASE WHEN list_contains([{_LABELS}], o_orderpriority) THEN o_orderpriority END AS label FROM orders")
def _enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = _cells(spark, sf_dir, "orders").select("o_orderkey", values.enum_code(c("o_orderpriority"), _PRIORITIES).alias("code"))
    return coded.withColumn("label", values.enum_label(c("code"), _PRIORITIES))


@_register("enum_filter", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH'")
def _enum_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = _cells(spark, sf_dir, "orders").select("o_orderkey", values.enum_code(c("o_orderpriority"), _PRIORITIES).alias("code"))
    return coded.where(values.enum_equals(c("code"), "2-HIGH", _PRIORITIES)).select("o_orderkey")


@_register("multi_value_elem", "SELECT vec_id, embedding[1] AS e0, embedding[64] AS e63, CAST(len(embedding) AS INTEGER) AS n FROM embeddings")
def _elem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, "embeddings").select("vec_id", c("embedding")[0].alias("e0"), c("embedding")[63].alias("e63"), F.size("embedding").alias("n"))


@_register("multi_value_bytes", "SELECT l_orderkey, l_linenumber, CAST(l_suppkey & 255 AS INTEGER) AS b1, CAST((l_suppkey >> 8) & 255 AS INTEGER) AS b2 FROM lineitem")
def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = values.int_bytes(F.array(c("l_suppkey").cast("int"), c("l_linenumber").cast("int")))
    return _cells(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", values.byte_at(raw, 1).alias("b1"), values.byte_at(raw, 2).alias("b2"))


_EPOCH = "TIMESTAMP '1970-01-01'"
for _unit, _sql in {
    "YEAR": "CAST(year(ts) - 1970 AS BIGINT)",
    "MONTH": "CAST((year(ts) - 1970) * 12 + month(ts) - 1 AS BIGINT)",
    "WEEK": "epoch_us(ts) // 604800000000",
    "DAY": "epoch_us(ts) // 86400000000",
    "HR": "epoch_us(ts) // 3600000000",
    "MIN": "epoch_us(ts) // 60000000",
    "SEC": "epoch_us(ts) // 1000000",
    "MS": "epoch_us(ts) // 1000",
    "US": "epoch_us(ts)",
    "NS": "epoch_us(ts) * 1000",
}.items():
    _QUERIES[f"unit_to_{_unit.lower()}"] = lambda spark, sf_dir, u=_unit: _cells(spark, sf_dir, "events").select("event_id", units.to_unit(c("ts"), u).alias("v"))
    _SQL[f"unit_to_{_unit.lower()}"] = f"SELECT event_id, {_sql} AS v FROM events"
for _unit, _sql in {
    "YEAR": "CAST(event_id % 200 + 1870 AS INTEGER)",
    "MONTH": "CAST(DATE '1970-01-01' + to_months(CAST(event_id % 200 - 100 AS INTEGER)) AS DATE)",
    "WEEK": "DATE '1970-01-01' + CAST((event_id % 200 - 100) * 7 AS INTEGER)",
    "DAY": "DATE '1970-01-01' + CAST(event_id % 200 - 100 AS INTEGER)",
    "HR": f"{_EPOCH} + to_hours(CAST(event_id % 200 - 100 AS INTEGER))",
    "MIN": f"{_EPOCH} + to_minutes(CAST(event_id % 200 - 100 AS INTEGER))",
    "SEC": f"{_EPOCH} + to_seconds(event_id % 200 - 100)",
    "MS": f"{_EPOCH} + to_milliseconds(event_id % 200 - 100)",
    "NS": f"{_EPOCH} + to_microseconds(CAST(trunc((event_id % 200 - 100) / 1000) AS BIGINT))",
}.items():
    _QUERIES[f"unit_from_{_unit.lower()}"] = lambda spark, sf_dir, u=_unit: _cells(spark, sf_dir, "events").select("event_id", units.from_unit(c("event_id") % 200 - 100, u).alias("v"))
    _SQL[f"unit_from_{_unit.lower()}"] = f"SELECT event_id, {_sql} AS v FROM events"
_QUERIES["unit_month_compatible"] = lambda spark, sf_dir: _cells(spark, sf_dir, "events").select("event_id", units.from_unit(c("event_id") % 200, "MONTH", True).alias("v"))
_SQL["unit_month_compatible"] = f"SELECT event_id, {_EPOCH} + to_seconds((event_id % 200) * 2628000) AS v FROM events"


@_register("time_parts", "SELECT event_id, CASE WHEN m < 0 THEN -1 ELSE 1 END AS sign, abs(m) // 3600000000 AS hour, abs(m) // 60000000 % 60 AS minute, abs(m) // 1000000 % 60 AS second, abs(m) % 1000000 AS micro FROM (SELECT event_id, (event_id - 5000) * 7654321 AS m FROM events)")
def _time(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = units.time_parts((c("event_id") - 5000) * 7654321)
    return _cells(spark, sf_dir, "events").select("event_id", *[v.alias(k) for k, v in parts.items()])


# -- spatial
def _polygon(*points: tuple[float, float]) -> bytes:
    return geometry.to_wkb([(2, [geometry.np.array([*points, points[0]])])])


_AREA = _polygon((0.0, 5.0), (2000.0, 5.0), (2000.0, 12.0), (0.0, 12.0))


def _with_boxes(rows: DataFrame) -> DataFrame:
    """Customers as 10 x 2 boxes around (account balance, nation), in WKB made by an Arrow-batched function."""
    rows = rows.select(c("c_acctbal").alias("_X"), c("c_nationkey").cast("double").alias("_Y"), "c_custkey")
    return rows.mapInPandas(_box_wkb, T.StructType([*rows.schema.fields, T.StructField("wkb_geometry", T.BinaryType())]))


def _box_wkb(frames):
    head = struct.pack("<BIII", 1, 3, 1, 5)
    for pdf in frames:
        boxes = [head + struct.pack("<10d", x - 5, y - 1, x + 5, y - 1, x + 5, y + 1, x - 5, y + 1, x - 5, y - 1) for x, y in zip(pdf["_X"], pdf["_Y"], strict=True)]
        yield pdf.assign(wkb_geometry=boxes)


def _buildings(spark: SparkSession, sf_dir: str):
    """A spatial array: centroids are dimensions; the metadata names the geometry and the greatest extents."""
    return array(spark, sf_dir, "buildings", _with_boxes, ("customer", ["_X", "_Y"], True), {"GEOMETRY_ATTRIBUTE_NAME": "wkb_geometry", "PAD_X": 10.0, "PAD_Y": 2.0})


@_register("mbr_filter", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 - 2.5 AND 2000 + 2.5 AND c_nationkey BETWEEN 5 - 0.5 AND 12 + 0.5")
def _mbr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.mbr_filter(_buildings(spark, sf_dir).df(), spatial.mbr(_AREA), 5.0, 1.0).select("c_custkey")


@_register("spatial_intersects", "SELECT c_custkey FROM customer WHERE c_acctbal + 5 >= 0 AND c_acctbal - 5 <= 2000 AND c_nationkey + 1 >= 5 AND c_nationkey - 1 <= 12")
def _intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.find_geometries(_buildings(spark, sf_dir), _AREA, "intersects").select("c_custkey")


@_register("spatial_overlaps", "SELECT c_custkey FROM customer WHERE c_acctbal + 5 > 0 AND c_acctbal - 5 < 2000 AND c_nationkey + 1 > 5 AND c_nationkey - 1 < 12 AND NOT (c_acctbal - 5 >= 0 AND c_acctbal + 5 <= 2000 AND c_nationkey - 1 >= 5 AND c_nationkey + 1 <= 12)")
def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.find_geometries(_buildings(spark, sf_dir), _AREA, "overlaps").select("c_custkey")


@_register("spatial_equals", "SELECT c_custkey FROM customer WHERE c_acctbal = (SELECT c_acctbal FROM customer WHERE c_custkey = 7) AND c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 7)")
def _equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geometries that equal customer 7's; its coordinates are one row of the table."""
    x, y = _read(spark, sf_dir, "customer").where("c_custkey = 7").select("c_acctbal", c("c_nationkey").cast("double")).collect()[0]
    return spatial.find_geometries(_buildings(spark, sf_dir), _polygon((x - 5, y - 1), (x + 5, y - 1), (x + 5, y + 1), (x - 5, y + 1)), "equals").select("c_custkey")


@_register("spatial_measures", "SELECT c_custkey, 20.0 :: DOUBLE AS area, round(c_acctbal, 3) AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer")
def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _buildings(spark, sf_dir).df().withColumn("m", geometry.st_centroid(c("wkb_geometry")))
    return rows.select("c_custkey", F.round(geometry.st_area(c("wkb_geometry")), 6).alias("area"), F.round("m.x", 3).alias("x"), F.round("m.y", 6).alias("y"))


@_register("spatial_texts", "SELECT c_custkey, c_acctbal AS x, CAST(c_nationkey + 0.5 AS DOUBLE) AS y, 8.0 :: DOUBLE AS envelope_area, round(8 * 0.5 * 4 * sin(2 * pi() / 8), 6) AS buffer_area FROM customer")
def _geometry_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and lines from text: coordinates, the envelope of a line, a buffer of eight sides and radius 2."""
    x, y = c("c_acctbal").cast("string"), F.concat(c("c_nationkey").cast("string"), F.lit(".5"))
    point = geometry.st_geom_from_text(F.concat(F.lit("POINT("), x, F.lit(" "), y, F.lit(")")))
    line = geometry.st_geom_from_text(F.concat(F.lit("LINESTRING(0 "), c("c_nationkey").cast("string"), F.lit(", 4 "), (c("c_nationkey") + 2).cast("string"), F.lit(")")))
    rows = _cells(spark, sf_dir, "customer").select("c_custkey", point.alias("p"), line.alias("l"))
    return rows.select("c_custkey", geometry.st_x(c("p")).alias("x"), geometry.st_y(c("p")).alias("y"), F.round(geometry.st_area(geometry.st_envelope(c("l"))), 6).alias("envelope_area"), F.round(geometry.st_area(geometry.st_buffer(c("p"), 2.0, 8)), 6).alias("buffer_area"))


# -- arrays as objects: dense writes, discovery, description, snapshots, filters, types
@_register("dense_write", "SELECT k, CASE WHEN k BETWEEN 10 AND 12 THEN 'again' WHEN k % 3 = 0 THEN '' ELSE n_name END AS label FROM (SELECT CAST(unnest(generate_series(0, 24)) AS INTEGER) AS k) LEFT JOIN nation ON n_nationkey = k")
def _dense_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense array written, partly overwritten and filled where nothing was written."""
    return _labels(spark, sf_dir).df()


def _labels(spark: SparkSession, sf_dir: str):
    table = ArrayCatalog(spark, new_folder(spark, "arrays")).create("labels", ArraySchema((Dimension("k", "INT", 0, 100, 10),), (Attribute("label", "VARCHAR", nullable=False, default="", has_default=True),), "DENSE"))
    names = _read(spark, sf_dir, "nation").select(c("n_nationkey").alias("k"), c("n_name").alias("label"))
    table.insert(names.where("k % 3 <> 0 OR k IN (0, 24)").select("k", F.when(c("k") % 3 == 0, "").otherwise(c("label")).alias("label")), timestamp=1)
    table.insert(names.where("k BETWEEN 10 AND 12").select("k", F.lit("again").alias("label")), timestamp=2)
    return table


@_register("dense_attr_filter", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey NOT BETWEEN 10 AND 12 AND n_nationkey % 3 = 0")
def _dense_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition on an attribute of a dense array sees overwritten and fill values alike."""
    return _labels(spark, sf_dir).df().where("label = ''").select("k")


@_register("dense_dates", "SELECT day, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(range(lo, hi + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events)) LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) USING (day)")
def _dense_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense array over dates: events a day, days without any from the fill."""
    table = ArrayCatalog(spark, new_folder(spark, "arrays")).create("days", ArraySchema((Dimension("day", "DATE", None, None, 1),), (Attribute("n", "BIGINT", nullable=False, default=0, has_default=True),), "DENSE"))
    table.insert(_cells(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")))
    return table.df()


@_register("discover_attach", "SELECT o_orderkey, o_totalprice FROM orders")
def _attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array opened by its address in another catalogue, its columns discovered from what is stored."""
    return ArrayCatalog(spark, new_folder(spark, "arrays")).attach("found", array(spark, sf_dir, "orders").path).df().select("o_orderkey", "o_totalprice")


@_register("exists_and_drop", "SELECT * FROM (VALUES (1, 'array', true), (2, 'other', false), (3, 'kept when dropped', true), (4, 'purged', false)) t(k, what, there)")
def _exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = ArrayCatalog(spark, new_folder(spark, "arrays"))
    catalog.create("a", _ORDER_ARRAY)
    seen = [("array", catalog.exists("a")), ("other", catalog.exists("b"))]
    catalog.drop("a")
    seen.append(("kept when dropped", catalog.exists("a")))
    catalog.drop("a", purge=True)
    seen.append(("purged", catalog.exists("a")))
    return spark.createDataFrame([(k, *x) for k, x in enumerate(seen, 1)], "k int, what string, there boolean")


@_register("describe_array", "SELECT * FROM (VALUES ('o_orderkey', 'bigint', false, 'dimension'), ('o_totalprice', 'double', true, 'attribute'), ('o_orderstatus', 'string', true, 'attribute')) t(\"column\", type, nullable, role)")
def _describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The description of an array made from the CREATE TABLE text that another array gives."""
    catalog = ArrayCatalog(spark, new_folder(spark, "arrays"))
    text = catalog.create("a", _ORDER_ARRAY).ddl("b")
    text = re.sub(r" uri='[^']*'", "", text)  # the copy has a place of its own
    catalog.create_sql(text)
    return catalog.describe("b")


@_register("pinned_and_reopened", "SELECT * FROM (SELECT 'pinned' AS reader, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'reopened', count(*) FROM orders)")
def _pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader that keeps the fragments seen at opening, and one that looks again after a write."""
    catalog = ArrayCatalog(spark, new_folder(spark, "arrays"))
    table, orders = catalog.create("orders", _ORDER_ARRAY), _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    table.insert(orders.where("o_orderkey % 2 = 0"))
    pinned = type(table)(spark, table.path, options=Options(reopen_for_every_query=False))
    table.insert(orders.where("o_orderkey % 2 = 1"))
    counted = [(name, t.df().agg(F.count(F.lit(1)).alias("n"))) for name, t in (("pinned", pinned), ("reopened", table))]
    return counted[0][1].select(F.lit("pinned").alias("reader"), "n").unionByName(counted[1][1].select(F.lit("reopened").alias("reader"), "n"))


@_register("compacted", _merged(3))
def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _order_table(spark, sf_dir)
    table.compact()
    return table.df()


@_register("time_travel_compacted", _merged(2))
def _travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As of a time before the newest fragment, after all were compacted."""
    table = _order_table(spark, sf_dir)
    table.compact()
    return type(table)(spark, table.path, open_at=2).df()


_QUERIES["agg_from_manifests"] = lambda spark, sf_dir: array(spark, sf_dir, "lineitem").aggregates()
_SQL["agg_from_manifests"] = "SELECT count(*) AS cells, min(l_orderkey) AS l_orderkey_min, max(l_orderkey) AS l_orderkey_max, min(l_linenumber) AS l_linenumber_min, max(l_linenumber) AS l_linenumber_max FROM lineitem"


_QUERIES["agg_attrs_from_manifests"] = lambda spark, sf_dir: array(spark, sf_dir, "lineitem").aggregates(["l_quantity", "l_shipdate"]).select("cells", *[f"{a}_{n}" for a in ("l_quantity", "l_shipdate") for n in ("count", "min", "max")])
_SQL["agg_attrs_from_manifests"] = "SELECT count(*) AS cells, count(l_quantity) AS l_quantity_count, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, count(l_shipdate) AS l_shipdate_count, min(l_shipdate) AS l_shipdate_min, max(l_shipdate) AS l_shipdate_max FROM lineitem"


@_register("agg_merged", "SELECT count(*) AS cells, count(o_totalprice) AS o_totalprice_count, min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max FROM orders")
def _agg_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where cells have several versions, the manifests do not do: the merged cells are scanned."""
    return array(spark, sf_dir, "orders").aggregates(["o_totalprice"]).drop("o_orderkey_min", "o_orderkey_max")


@_register("record_count", "SELECT * FROM (SELECT 'counted' AS how, count(*) AS n FROM lineitem UNION ALL SELECT 'guess', 100000)")
def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by the manifests, and the guess that stands in where counting is off."""
    n = [(how, array(spark, sf_dir, "lineitem", options=Options(compute_table_records=on)).records()) for how, on in (("counted", True), ("guess", False))]
    return spark.createDataFrame(n, "how string, n long")


@_register("derived_table", "SELECT status, max(total) AS top FROM (SELECT o_custkey, o_orderstatus AS status, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL) GROUP BY status")
def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over an array's view with a derived table."""
    array(spark, sf_dir, "orders").view("gl_orders")
    return spark.sql("SELECT status, max(total) AS top FROM (SELECT o_custkey, o_orderstatus AS status, round(sum(o_totalprice), 2) AS total FROM gl_orders GROUP BY o_custkey, o_orderstatus) GROUP BY status")


@_register("hilbert_array", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey BETWEEN 100 AND 700")
def _hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = ArraySchema((Dimension("c_custkey", "BIGINT", 0, 10**6, 10**4), Dimension("c_nationkey", "INT", 0, 100, 10)), (Attribute("c_acctbal", "DOUBLE"),), cell_order="HILBERT")
    table = ArrayCatalog(spark, new_folder(spark, "arrays")).create("h", schema)
    table.insert(_read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"))
    return table.slice({"c_custkey": (100, 700)}, ["c_custkey", "c_acctbal"])


@_register("hilbert_neighbours", "SELECT 255 :: BIGINT AS cells, 0 :: BIGINT AS jumps, 256 :: BIGINT AS places")
def _hilbert_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the whole 16 x 16 grid each place is taken once, and following ones are neighbours."""
    grid = dense.grid(spark, {"x": (0, 15), "y": (0, 15)}).withColumn("d", ordering.hilbert(c("x"), c("y"), 4))
    after = grid.select((c("d") - 1).alias("d"), c("x").alias("nx"), c("y").alias("ny"))
    far = F.sum(((F.abs(c("x") - c("nx")) + F.abs(c("y") - c("ny"))) != 1).cast("bigint")).alias("jumps")
    return grid.join(after, "d").agg(F.count(F.lit(1)).alias("cells"), far).crossJoin(grid.agg(F.count_distinct("d").alias("places")))


@_register("global_order", "SELECT CAST(conv_id AS BIGINT) AS conv_id, turn FROM conversations")
def _global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return array(spark, sf_dir, "conversations", options=Options(read_layout="global-order")).slice(columns=["conv_id", "turn"])


@_register("filters_per_column", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = ArraySchema((Dimension("o_orderkey", "BIGINT", 0, 10**12, 10**6, "DOUBLE_DELTA"),), (Attribute("o_custkey", "BIGINT", filters="BIT_WIDTH_REDUCTION,ZSTD=7"), Attribute("o_orderstatus", "VARCHAR", filters="DICTIONARY"), Attribute("o_totalprice", "DOUBLE", filters="NONE")), coordinate_filters="GZIP=5")
    table = ArrayCatalog(spark, new_folder(spark, "arrays")).create("filtered", schema)
    table.insert(_read(spark, sf_dir, "orders").select(*schema.columns))
    return table.df()


@_register("domain_check", "SELECT * FROM (VALUES ('above', true), ('below', true), ('inside', false), ('null', true), ('unsigned', true)) t(what, refused)")
def _domain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates outside the domain are refused, and nothing of their write is read."""
    catalog, seen = ArrayCatalog(spark, new_folder(spark, "arrays")), []
    for what, kind, value in (("inside", "INT", 5), ("above", "INT", 11), ("below", "INT", -1), ("null", "INT", None), ("unsigned", "BIGINT UNSIGNED", -1)):
        table = catalog.create(f"a_{what}", ArraySchema((Dimension("d", kind, None if "UNS" in kind else 0, None if "UNS" in kind else 10, 1),), (Attribute("v", "INT"),)))
        try:
            table.insert(spark.createDataFrame([(value, 1)], "d int, v int"))
        except Exception as e:  # noqa: BLE001  whatever Spark wraps the refusal in
            if "dimension d" not in str(e):
                raise
        seen.append((what, table.df().isEmpty()))
    return spark.createDataFrame(seen, "what string, refused boolean")


#: SQL type -> (value by a Spark expression, the same in SQL; both as they are shown).
_KINDS: dict[str, tuple[str, str]] = {
    "TINYINT": ("cast(k % 200 - 100 as tinyint)", "CAST(k % 200 - 100 AS TINYINT)"),
    "TINYINT UNSIGNED": ("cast(k % 256 as smallint)", "CAST(k % 256 AS SMALLINT)"),
    "SMALLINT": ("cast(k % 60000 - 30000 as smallint)", "CAST(k % 60000 - 30000 AS SMALLINT)"),
    "SMALLINT UNSIGNED": ("cast(65535 - k % 65536 as int)", "CAST(65535 - k % 65536 AS INTEGER)"),
    "MEDIUMINT": ("cast(k - 5000 as int)", "CAST(k - 5000 AS INTEGER)"),
    "MEDIUMINT UNSIGNED": ("16777215 - k", "16777215 - k"),
    "INT": ("cast(k - 2147483648 as int)", "CAST(k - 2147483648 AS INTEGER)"),
    "INT UNSIGNED": ("4294967294 - k", "4294967294 - k"),
    "BIGINT": ("k - 9000000000000000000", "k - 9000000000000000000"),
    "BIGINT UNSIGNED": ("cast(18446744073709551614 - k as decimal(20,0))", "CAST(18446744073709551614 - k AS VARCHAR)"),
    "FLOAT": ("cast(k / 4 as float)", "CAST(k / 4 AS FLOAT)"),
    "DOUBLE": ("cast(k as double) / 8", "CAST(k AS DOUBLE) / 8"),
    "DECIMAL(12,2)": ("cast(k as decimal(10,0)) - cast(0.25 as decimal(3,2))", "CAST(CAST(k AS DECIMAL(10,0)) - 0.25 AS VARCHAR)"),
    "BOOL": ("k % 3 = 0", "k % 3 = 0"),
    "BIT": ("cast(k % 2 as smallint)", "CAST(k % 2 AS SMALLINT)"),
    "CHAR(10)": ("concat('c', k)", "'c' || k"),
    "VARCHAR(255)": ("concat('é', k)", "'é' || k"),
    "TEXT": ("repeat('ü', cast(k % 5 as int))", "repeat('ü', CAST(k % 5 AS INTEGER))"),
    "BLOB": ("unhex(lpad(hex(k), 8, '0'))", "lpad(printf('%X', k), 8, '0')"),
    "DATE": ("date_add(date'1970-01-01', cast(k as int))", "DATE '1970-01-01' + CAST(k AS INTEGER)"),
    "DATETIME(6)": ("timestamp_ntz'2000-01-01 00:00:00.000001' + make_dt_interval(0, k)", "TIMESTAMP '2000-01-01 00:00:00.000001' + to_hours(CAST(k AS INTEGER))"),
    "TIME": ("k * 1000001", "k * 1000001"),
    "YEAR": ("cast(1901 + k % 250 as int)", "CAST(1901 + k % 250 AS INTEGER)"),
}


def _typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(c("o_orderkey").alias("k"), *[F.expr(_by_key(x)).alias(f"v{i}") for i, (x, _) in enumerate(_KINDS.values())])


def _by_key(expression: str) -> str:
    """The expression over the key column ``k``."""
    return re.sub(r"\bk\b", "o_orderkey", expression)


def _shown(df: DataFrame) -> DataFrame:
    """Decimals as text and binaries as hexadecimal digits, which every engine shows alike."""
    def show(name: str) -> Column:
        kind = df.schema[name].dataType
        return F.hex(name) if isinstance(kind, T.BinaryType) else c(name).cast("string") if isinstance(kind, T.DecimalType) else c(name)

    return df.select(*[show(x).alias(x) for x in df.columns])


def _typed_sql(where: str = "TRUE") -> str:
    return f"SELECT k, {', '.join(f'{x} AS v{i}' for i, (_, x) in enumerate(_KINDS.values()))} FROM (SELECT o_orderkey AS k FROM orders) WHERE {where}"


@_register("type_matrix", _typed_sql())
def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every SQL type as a NOT NULL attribute: written in two fragments and read back merged."""
    return _shown(_typed(spark, sf_dir).df())


@_register("type_matrix_encrypted", _typed_sql())
def _matrix_encrypted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_typed(spark, sf_dir, True).df())


def _typed(spark: SparkSession, sf_dir: str, encrypted: bool = False):
    schema = ArraySchema((Dimension("k", "BIGINT", 0, 10**12, 10**6),), tuple(Attribute(f"v{i}", kind, nullable=False) for i, kind in enumerate(_KINDS)), encrypted=encrypted)
    table = ArrayCatalog(spark, new_folder(spark, "arrays")).create("typed", schema, encryption_key=secrets.token_hex(16) if encrypted else None)
    rows = _typed_rows(spark, sf_dir)
    table.insert(rows.where("k % 2 = 0"), timestamp=1)
    table.insert(rows.where("k % 2 = 1 OR k % 10 = 0"), timestamp=2)
    return table


#: Types that can be dimensions, with a condition on the coordinate that both engines read alike.
_DIMENSIONS = {"SMALLINT": "k % 60000 - 30000 < -29000", "INT UNSIGNED": "4294967294 - k > 4294966294", "BIGINT UNSIGNED": "k < 1000", "FLOAT": "k / 4 < 250", "DOUBLE": "k / 8 < 125", "VARCHAR(255)": "k < 1000", "DATE": "k < 1000", "DATETIME(6)": "k < 1000", "TIME": "k < 1000"}


@_register("type_dimensions", " UNION ALL ".join(f"SELECT '{kind}' AS kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS s FROM (SELECT o_orderkey AS k FROM orders) WHERE k < 30000 AND {where}" for kind, where in _DIMENSIONS.items()))
def _type_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types as dimensions: arrays sliced by a range of coordinates."""
    spans = {"SMALLINT": (None, -29001), "INT UNSIGNED": (4294966295, None), "BIGINT UNSIGNED": (Decimal(18446744073709551614 - 999), None), "FLOAT": (None, 249.75), "DOUBLE": (None, 124.875), "DATE": (None, "1972-09-26"), "TIME": (None, 999 * 1000001)}
    out = None
    for kind in _DIMENSIONS:
        place = list(_KINDS).index(kind)
        rows = _typed_rows(spark, sf_dir).where("k < 30000").select(c(f"v{place}").alias("d"), "k")
        bounds = (None, None, 1) if kind not in ("FLOAT", "DOUBLE") else (0.0, 1e6, 1e3)
        schema = ArraySchema((Dimension("d", kind, *((None,) * 3 if "CHAR" in kind else bounds)),), (Attribute("k", "BIGINT"),))
        table = ArrayCatalog(spark, new_folder(spark, "arrays")).create("typed", schema)
        table.insert(rows)
        cells = table.slice({"d": spans[kind]}) if kind in spans else table.df().where("k < 1000")
        one = cells.agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("s")).select(F.lit(kind).alias("kind"), "n", "s")
        out = one if out is None else out.unionByName(one)
    return out


@_register("type_fills", "SELECT * FROM (VALUES ('BIGINT', '-9223372036854775808'), ('BIGINT UNSIGNED', '18446744073709551615'), ('BOOL', 'false'), ('INT UNSIGNED', '4294967295'), ('MEDIUMINT', '-2147483648'), ('SMALLINT', '-32768'), ('TINYINT', '-128'), ('TINYINT UNSIGNED', '255')) t(kind, fill)")
def _fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an unwritten cell of a dense array shows for each type."""
    whole = ["BIGINT", "BIGINT UNSIGNED", "BOOL", "INT UNSIGNED", "MEDIUMINT", "SMALLINT", "TINYINT", "TINYINT UNSIGNED"]
    schema = ArraySchema((Dimension("k", "INT", 0, 9, 1),), (Attribute("x", "INT"), *(Attribute(f"v{i}", kind, nullable=False) for i, kind in enumerate(whole))), "DENSE")
    table = ArrayCatalog(spark, new_folder(spark, "arrays")).create("fills", schema)
    ends = _read(spark, sf_dir, "nation").where("n_nationkey IN (0, 2)").select(c("n_nationkey").alias("k"), F.lit(1).alias("x"), *[F.lit(1).cast(kinds.parse_sql_type(kind)[1]).alias(f"v{i}") for i, kind in enumerate(whole)])
    table.insert(ends)
    hole = table.slice({"k": 1})
    pairs = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), c(f"v{i}").cast("string").alias("fill")) for i, kind in enumerate(whole)])).alias("p")
    return hole.select(pairs).select("p.kind", "p.fill")


@_register("unsigned_clamp", "SELECT event_id, CASE WHEN event_id % 600 - 100 < 0 THEN 0 WHEN event_id % 600 - 100 > 255 THEN 255 ELSE event_id % 600 - 100 END :: BIGINT AS v FROM events")
def _clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, "events").select("event_id", kinds.clamp_unsigned(c("event_id") % 600 - 100, "TINYINT", strict=False).cast("bigint").alias("v"))


@_register("fill_literals", "SELECT * FROM (VALUES (1, 'NULL'), (2, '0.0'), (3, '-128'), (4, chr(39) || 'it' || chr(39) || chr(39) || 's' || chr(39)), (5, '1'), (6, '2.5')) t(k, literal)")
def _literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = [kinds.fill_literal(v, k) for v, k in ((None, "int"), (math.nan, "double"), (-128, "tinyint"), ("it's", "string"), (True, "boolean"), (2.5, "double"))]
    return spark.createDataFrame(list(enumerate(texts, 1)), "k int, literal string")


@_register("charsets", "SELECT c_custkey, 'Zürich ' || c_mktsegment AS utf8, 'Zürich ' || c_mktsegment AS latin1, 'Zürich ' || c_mktsegment AS utf16, 'Zürich ' || c_mktsegment AS ucs2, 'Zürich ' || c_mktsegment AS utf32 FROM customer")
def _charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text stored in several character sets, as binary attributes, read back as strings."""
    stored = {"utf8": "UTF-8", "latin1": "ISO-8859-1", "utf16": "UTF-16", "ucs2": "UTF-16BE", "utf32": "UTF-32"}

    def encoded(rows: DataFrame) -> DataFrame:
        text = F.concat(F.lit("Zürich "), "c_mktsegment")
        return rows.select("c_custkey", *[(F.encode(text, s) if n != "utf32" else _utf32(text)).alias(n) for n, s in stored.items()])

    cells = array(spark, sf_dir, "customer_charsets", encoded, _UTF8).df()
    return cells.select("c_custkey", *[values.decode_text(c(n), n).alias(n) for n in stored])


def _utf32(text: Column) -> Column:
    """Big-endian UTF-32, of one number for each character."""
    return F.unhex(F.array_join(F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: F.lpad(F.hex(F.ascii(x)), 8, "0")), ""))


for _unit, _sql in {"US": f"{_EPOCH} + to_microseconds(event_id % 200 - 100)", "PS": f"{_EPOCH} + to_microseconds(CAST(trunc((event_id % 200 - 100) / 1000000) AS BIGINT))", "FS": _EPOCH, "AS": _EPOCH}.items():
    _QUERIES[f"unit_from_{_unit.lower()}"] = lambda spark, sf_dir, u=_unit: _cells(spark, sf_dir, "events").select("event_id", units.from_unit(c("event_id") % 200 - 100, u).alias("v"))
    _SQL[f"unit_from_{_unit.lower()}"] = f"SELECT event_id, {_sql} AS v FROM events"


@_register("time_intervals", "SELECT event_id, (event_id - 5000) * 1000 AS micros FROM events")
def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of day in milliseconds as intervals, and back to whole parts."""
    span = units.time_from_unit(c("event_id") - 5000, "MS")
    rows = _cells(spark, sf_dir, "events").select("event_id", units.time_parts(units.micros_of(F.lit("1970-01-01").cast("date").cast("timestamp_ntz") + span))["sign"].alias("s"), span.alias("span"))
    parts = units.time_parts((c("event_id") - 5000) * 1000)
    return rows.select("event_id", units.time_to_micros(c("s"), parts["hour"], parts["minute"], parts["second"], parts["micro"]).alias("micros"))


@_register("metadata_times", "SELECT * FROM (VALUES ('at', '2024-01-05 10:11:12.000013'), ('day', '2024-01-05'), ('flag', '1')) t(key, value)")
def _metadata_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = ArrayCatalog(spark, new_folder(spark, "arrays")).create("m", _ORDER_ARRAY)
    table.put_metadata({"day": datetime.date(2024, 1, 5), "at": datetime.datetime(2024, 1, 5, 10, 11, 12, 13), "flag": True})
    return table.metadata()


# -- the flagship
_FLAG = "round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(o_totalprice) AS n"


@_register("flagship", f"SELECT o_orderstatus, {_FLAG} FROM orders WHERE o_orderkey BETWEEN 100 AND 900 AND o_totalprice > 1000 GROUP BY o_orderstatus")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an array of two fragments keyed on ``o_orderkey``: slice a range, filter an attribute, aggregate."""
    cells = array(spark, sf_dir, "orders").slice({"o_orderkey": (100, 900)}).where(c("o_totalprice") > 1000)
    return cells.groupBy("o_orderstatus").agg(_sum("o_totalprice", "s"), F.round(F.avg("o_totalprice"), 4).alias("a"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.count("o_totalprice").alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
