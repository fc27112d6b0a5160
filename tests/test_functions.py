"""Units, values, geometry, slices, orders and lookups."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.functions import geometry as G
from gridlake.functions import types, units, values
from gridlake.operators import dense, lookup, ordering, slicing, spatial
from gridlake.session import parse_config


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_types():
    assert types.parse_sql_type("int unsigned") == ("INT", "bigint", True)
    assert types.parse_sql_type("DECIMAL(10, 2)")[1] == "decimal(10,2)"
    with pytest.raises(ValueError):
        types.parse_sql_type("jsonb")
    assert types.fill_literal(float("nan"), "double") == "0.0" and types.fill_literal("\0", "string") == "'\\0'"


@pytest.mark.parametrize(
    ("value", "unit", "expected"),
    [
        (50, "YEAR", 2020),
        (606, "MONTH", dt.date(2020, 7, 1)),
        (2638, "WEEK", dt.date(2020, 7, 23)),
        (-1, "DAY", dt.date(1969, 12, 31)),
        (443317, "HR", dt.datetime(2020, 7, 28, 13)),
        (1595771155123, "MS", dt.datetime(2020, 7, 26, 13, 45, 55, 123000)),
        (1595771155123456789, "NS", dt.datetime(2020, 7, 26, 13, 45, 55, 123456)),
        (-1500, "NS", dt.datetime(1969, 12, 31, 23, 59, 59, 999999)),
        (2_000_000_000_000, "AS", dt.datetime(1970, 1, 1, 0, 0, 0, 2)),
    ],
)
def test_units(spark, value, unit, expected):
    assert one(spark, units.from_unit(F.lit(value), unit)) == expected


def test_month_compatible(spark):
    assert one(spark, units.from_unit(F.lit(606), "MONTH", compat_month=True)) == dt.datetime(2020, 6, 19, 12)


@pytest.mark.parametrize("unit", ["HR", "MIN", "SEC", "MS", "US"])
def test_unit_round_trip(spark, unit):
    for v in (-77, 0, 12345):
        assert one(spark, units.to_unit(units.from_unit(F.lit(v), unit), unit)) == v


def test_time(spark):
    assert one(spark, units.time_from_unit(F.lit(-90), "MIN")) == dt.timedelta(minutes=-90)
    parts = units.time_parts(F.lit(-3_723_000_004))
    assert [one(spark, parts[k]) for k in ("sign", "hour", "minute", "second", "micro")] == [-1, 1, 2, 3, 4]
    assert one(spark, units.time_to_micros(F.lit(-1), F.lit(1), F.lit(2), F.lit(3), F.lit(4))) == -3_723_000_004


def test_values(spark):
    assert one(spark, values.enum_label(F.lit(1), ["a", "b"])) == "b" and one(spark, values.enum_label(F.lit(5), ["a"])) is None
    assert one(spark, values.enum_code(F.lit("z"), ["a"])) is None
    raw = values.int_bytes(F.array(F.lit(258), F.lit(-1)))
    assert bytes(one(spark, raw)) == values.value_bytes([258, -1], "int") and one(spark, values.byte_at(raw, 2)) == 1
    assert one(spark, values.decode_text(F.lit("é".encode("utf-16-be")), "ucs2")) == "é"
    assert one(spark, types.clamp_unsigned(F.lit(-1), "SMALLINT", strict=False)) == 0
    assert parse_config("a=1, b=x=y") == {"a": "1", "b": "x=y"}


SQUARE = G.from_wkt("POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))")
HOLED = G.from_wkt("POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))")


def test_geometry_measures():
    assert G.area(SQUARE) == 100 and G.area(HOLED) == 96
    assert G.centroid(SQUARE) == (5, 5) and G.envelope(HOLED) == (0, 0, 10, 10)
    assert G.area(G.from_wkb(G.to_wkb(HOLED))) == 96
    assert abs(G.area(G.buffer_point(0, 0, 1, 256)) - np.pi) < 1e-3
    assert G.centroid(G.from_wkt("MULTIPOLYGON(((0 0,2 0,2 2,0 2,0 0)),((10 0,12 0,12 2,10 2,10 0)))")) == (6, 1)
    assert G.centroid(G.from_wkt("LINESTRING(0 0, 4 0)")) == (2, 0) and G.from_wkt("POINT EMPTY") == []


@pytest.mark.parametrize(
    ("other", "expected"),
    [
        ("POLYGON((5 5, 15 5, 15 15, 5 15, 5 5))", (True, False, True)),
        ("POLYGON((2 2, 3 2, 3 3, 2 3, 2 2))", (True, False, False)),
        ("POLYGON((10 0, 20 0, 20 10, 10 10, 10 0))", (True, False, False)),
        ("POLYGON((5 0, 15 0, 15 10, 5 10, 5 0))", (True, False, True)),
        ("POLYGON((10 10, 10 0, 0 0, 0 10, 10 10))", (True, True, False)),
        ("POLYGON((20 20, 30 20, 30 30, 20 20))", (False, False, False)),
        ("POINT(5 5)", (True, False, False)),
        ("LINESTRING(-5 5, 15 5)", (True, False, False)),
    ],
)
def test_geometry_predicates(other, expected):
    b = G.from_wkt(other)
    assert (G.intersects(SQUARE, b), G.equals(SQUARE, b), G.overlaps(SQUARE, b)) == expected
    assert (G.intersects(b, SQUARE), G.equals(b, SQUARE), G.overlaps(b, SQUARE)) == expected


def test_point_in_hole():
    assert not G.intersects(HOLED, G.from_wkt("POINT(3 3)")) and G.intersects(HOLED, G.from_wkt("POINT(2 3)"))


def buildings(spark):
    made = [("b1", 15.0, 15.0), ("b2", 89.0, 89.0)]
    return spark.createDataFrame([(x, y, n, bytearray(G.to_wkb(G.from_wkt(f"POLYGON(({x - 5} {y - 5},{x + 5} {y - 5},{x + 5} {y + 5},{x - 5} {y + 5},{x - 5} {y - 5}))")))) for n, x, y in made], "_X double, _Y double, name string, wkb_geometry binary")


@pytest.mark.parametrize("pads", [(None, None), (10.0, 10.0)])
def test_spatial_filter(spark, pads):
    area = G.to_wkb(G.from_wkt("POLYGON((93 93, 110 93, 110 110, 93 110, 93 93))"))
    for name, found in (("intersects", ["b2"]), ("overlaps", ["b2"]), ("equals", [])):
        assert [r.name for r in spatial.spatial_filter(buildings(spark), area, name, *pads).collect()] == found
    with pytest.raises(ValueError):
        spatial.spatial_filter(buildings(spark), area, "touches")
    assert buildings(spark).select(G.st_area(F.col("wkb_geometry")).alias("a")).first()["a"] == 100
    assert spark.createDataFrame([("POINT(1 2)",), (None,)], "t string").select(G.st_x(G.st_geom_from_text(F.col("t"))).alias("x")).collect()[0]["x"] == 1


def test_slices():
    assert slicing.overlaps([(1, 3), 9], 4, 9) and not slicing.overlaps([(1, 3), 9], 4, 8)
    assert slicing.overlaps((None, 3), 3, 5) and slicing.overlaps("a", None, None)
    with pytest.raises(ValueError):
        slicing.predicate(F.lit(1), (1, 2, 3))


def test_grid_guard(spark):
    assert dense.grid(spark, {"a": (1, 3), "b": (0, 1)}).count() == 6
    assert dense.grid(spark, {"a": (1, 0)}).count() == 0
    with pytest.raises(ValueError):
        dense.grid(spark, {"a": (0, 10**6), "b": (0, 10**6)})


def test_hilbert_visits_neighbours(spark):
    cells = spark.range(64).selectExpr("id div 8 as x", "id % 8 as y")
    got = sorted((r.h, r.x, r.y) for r in cells.select("x", "y", ordering.hilbert(F.col("x"), F.col("y"), 3).alias("h")).collect())
    assert [h for h, _, _ in got] == list(range(64))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(got, got[1:], strict=False))


def test_find_flags(spark):
    cells = spark.range(16).selectExpr("id div 4 as c0", "id % 4 as c1")
    get = lambda key, flag: [tuple(r) for r in lookup.find(cells, ["c0", "c1"], key, flag).collect()]
    assert get((1, 2), "EXACT") == [(1, 2)] and get((9, 9), "EXACT") == []
    assert get((1,), "PREFIX") == [(1, i) for i in range(4)] and get((1,), "PREFIX_LAST") == [(1, i) for i in (3, 2, 1, 0)]
    assert get((3, 2), "KEY_OR_NEXT") == [(3, 2), (3, 3)] and get((3, 2), "AFTER_KEY") == [(3, 3)]
    assert get((0, 1), "KEY_OR_PREV") == [(0, 1), (0, 0)] and get((0, 1), "BEFORE_KEY") == [(0, 0)]


def test_batched_key_join(spark):
    cells = spark.range(100).selectExpr("id as k", "id * 2 as v")
    keys = spark.createDataFrame([(5, "a"), (7, "b"), (500, "c")], "k long, n string")
    assert sorted(tuple(r) for r in lookup.batched_key_join(cells, keys, ["k"]).collect()) == [(5, 10, "a"), (7, 14, "b")]
    assert lookup.batched_key_join(cells, keys.limit(0), ["k"]).count() == 0


def test_key_filter_drops_cells_and_loses_none(spark):
    cells = spark.range(100_000).selectExpr("id as k", "id % 7 as v")
    keys = spark.range(300).selectExpr("id * 331 as k", "id as n")
    kept = {r.k for r in lookup.among_hashes(cells, keys, ["k"], 300).collect()}
    assert {i * 331 for i in range(300)} <= kept and len(kept) < 15_000
    few = lookup.among_hashes(cells, keys, ["k"], 1)  # a count that is far too small makes the filter dense, not wrong
    assert {i * 331 for i in range(300)} <= {r.k for r in few.collect()}
    plan = lookup.batched_key_join(cells, keys, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_batched_key_join_on_odd_keys(spark):
    def joined(cells, keys, dims):
        got, plain = lookup.batched_key_join(cells, keys, dims), cells.join(keys, dims)
        assert got.columns == plain.columns
        same = lambda df: sorted(repr(tuple(r)) for r in df.collect())
        assert same(got) == same(plain)
        return got.count()

    nan = float("nan")
    reals = spark.createDataFrame([(0.0, 1), (-0.0, 2), (nan, 3), (1.5, 4), (None, 5)], "k double, v int")
    assert joined(reals, spark.createDataFrame([(-0.0, 1), (nan, 2), (None, 3), (7.0, 4)], "k double, n int"), ["k"]) == 3
    whole = spark.range(50).selectExpr("id as k", "id as v")
    assert joined(whole, spark.createDataFrame([(3, 1), (3, 2), (None, 3), (49, 4), (-1, 5)], "k int, n int"), ["k"]) == 3  # of another type
    assert joined(whole, spark.createDataFrame([(None, 1)], "k long, n int"), ["k"]) == 0
    pairs = spark.range(60).selectExpr("cast(id div 6 as string) as a", "id % 6 as b", "id as v")
    assert joined(pairs, spark.createDataFrame([("1", 2), ("1", None), ("9", 5), ("x", 0)], "a string, b long"), ["a", "b"]) == 2


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from gridlake.sources.scratch import shared_dir

    unset = SimpleNamespace(get=lambda _: None)
    spark = SimpleNamespace(sparkContext=SimpleNamespace(master="yarn", getConf=lambda: unset, getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        shared_dir(spark)
