"""Arrays on disk: the golden cases of the test inputs, restated."""

import math
from dataclasses import replace
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlake.operators import lookup
from gridlake.session import Options
from gridlake.sources.catalog import ArrayCatalog
from gridlake.sources.schema import ArraySchema, Attribute, Dimension, SchemaError, parse_ddl
from gridlake.sources.table import ArrayTable


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def quickstart(catalog, spark):
    table = catalog.create_sql("CREATE TABLE q (`rows` int dimension=1 lower_bound='1' upper_bound='4' tile_extent='4', cols int dimension=1 lower_bound='1' upper_bound='4' tile_extent='4', a int NOT NULL, PRIMARY KEY(`rows`, cols)) array_type='DENSE'")
    table.insert(spark.createDataFrame([(r, c, (r - 1) * 4 + c) for r in range(1, 5) for c in range(1, 5)], "rows int, cols int, a int"), timestamp=1000)
    return table


def test_quickstart_dense(catalog, spark):
    table = quickstart(catalog, spark)
    df = table.df()
    assert tuple(df.agg(F.sum("a"), F.avg("a"), F.min("a"), F.max("a"), F.count("a")).first()) == (136, 8.5, 1, 16, 16)
    assert df.where("a > 3").count() == 13
    assert table.slice({"rows": [1, 2, 3], "cols": (1, 3)}).count() == 9
    assert rows(table.slice({"rows": 3, "cols": [1, 2]})) == [(3, 1, 9), (3, 2, 10)]
    assert table.non_empty_domain() == {"rows": (1, 4), "cols": (1, 4)}


def test_open_at(catalog, spark):
    quickstart(catalog, spark)
    for name, at in (("q", 0), ("q@0", None), ("q@1", None)):
        assert catalog.open(name, open_at=at).df().count() == 0
    assert catalog.open("q@1", open_at=5000).df().count() == 16


def test_subset_and_recast(catalog, spark):
    quickstart(catalog, spark)
    assert catalog.open("q", columns=["a"]).df().columns == ["a"]
    assert catalog.open("q", columns={"rows": "float", "a": "int"}).df().dtypes == [("rows", "float"), ("a", "int")]
    assert catalog.open("q", columns=["a"]).df().count() == 16


def dup_schema(**how):
    return ArraySchema((Dimension("dim1", "INT", 0, 100, 10),), (Attribute("attr1", "INT"),), **how)


def test_duplicates_are_a_schema_property(catalog, spark):
    for dups in (True, False):
        table = catalog.create(f"d{dups}", dup_schema(allows_dups=dups))
        table.insert(spark.createDataFrame([(1, 1)], "dim1 int, attr1 int"))
        table.insert(spark.createDataFrame([(1, 20)], "dim1 int, attr1 int"))
        assert rows(table.df()) == ([(1, 1), (1, 20)] if dups else [(1, 20)])


def test_attribute_filters_see_only_the_last_version(catalog, spark):
    schema = ArraySchema((Dimension("id", "INT", 0, 100, 10),), (Attribute("a1", "INT", nullable=False), Attribute("a2", "INT"), Attribute("a3", "VARCHAR"), Attribute("a4", "VARCHAR", nullable=False)))
    table = catalog.create("t", schema)
    kind = "id int, a1 int, a2 int, a3 string, a4 string"
    table.insert(spark.createDataFrame([(1, 1, 1, "a", "b"), (2, 2, 2, "c", "d"), (3, 3, 3, "e", "f")], kind))
    table.insert(spark.createDataFrame([(1, 1, 10, "beef", "stew"), (2, 100, None, "test", "orange"), (3, 300, 400, "def", "beef")], kind))
    df = table.df()
    assert df.where("a2 = 1").count() == 0
    assert rows(df.where("a2 is null")) == [(2, 100, None, "test", "orange")]
    assert rows(df.where("a2 > 5 or a3 = 'test'").select("id")) == [(1,), (2,), (3,)]


def test_repeats_within_one_write_the_later_row_wins(catalog, spark):
    table = catalog.create("t", dup_schema())
    table.insert(spark.createDataFrame([(5, 1), (5, 2), (5, 3)], "dim1 int, attr1 int").coalesce(1))
    assert rows(table.df()) == [(5, 3)]


def test_dense_fill_and_written_nulls(catalog, spark):
    schema = ArraySchema((Dimension("dim0", "BIGINT", 0, 100, 10),), (Attribute("attr1", "VARCHAR"), Attribute("attr2", "INT", nullable=False)), "DENSE")
    table = catalog.create("d", schema)
    table.insert(spark.createDataFrame([(1, "a", 1), (2, None, 2), (5, "c", 3)], "dim0 long, attr1 string, attr2 int"))
    table.insert(spark.createDataFrame([(1, "x", 9)], "dim0 long, attr1 string, attr2 int"))
    assert rows(table.df()) == [(1, "x", 9), (2, None, 2), (3, None, -(2**31)), (4, None, -(2**31)), (5, "c", 3)]
    assert rows(table.slice({"dim0": (3, 50)}, ["dim0", "attr2"])) == [(3, -(2**31)), (4, -(2**31)), (5, 3)]
    assert table.slice({"dim0": 77}).count() == 0


def test_defaults_for_omitted_columns(catalog, spark):
    table = catalog.create_sql("CREATE TABLE f (dim0 int dimension=1 lower_bound='0' upper_bound='100' tile_extent='10', attr0 int NOT NULL DEFAULT 12345, attr1 varchar(9) DEFAULT 'abc', attr2 double NOT NULL DEFAULT 12.345, attr3 int, PRIMARY KEY(dim0))")
    table.insert(spark.createDataFrame([(1,)], "dim0 int"))
    assert rows(table.df()) == [(1, 12345, "abc", 12.345, None)]


def test_schema_evolution(catalog, spark):
    table = catalog.create("e", ArraySchema((Dimension("id", "INT", 0, 9, 1),), (Attribute("a1", "INT", filters="GZIP=5"), Attribute("a3", "VARCHAR"))))
    table.insert(spark.createDataFrame([(1, 10, "old"), (2, 20, "old")], "id int, a1 int, a3 string"))
    table.alter(drop=["a3"], add=[Attribute("a10", "INT"), Attribute("a30", "VARCHAR")])
    assert rows(table.df()) == [(1, 10, None, None), (2, 20, None, None)]
    table.alter(add=[Attribute("a3", "VARCHAR")])
    table.insert(spark.createDataFrame([(2, 21, 5, "x", "new")], "id int, a1 int, a10 int, a30 string, a3 string"))
    assert rows(table.df()) == [(1, 10, None, None, None), (2, 21, 5, "x", "new")]
    with pytest.raises(SchemaError):
        table.alter(drop=["id"])
    with pytest.raises(SchemaError):
        table.alter(drop=["none"])


def test_enumerations(catalog, spark):
    table = catalog.create_sql("CREATE TABLE fruit (dim1 int dimension=1 lower_bound='0' upper_bound='9' tile_extent='1', attr1 int, fruit ENUM('apple','orange','pear') NULL, PRIMARY KEY(dim1))")
    table.insert(spark.createDataFrame([(1, 2, "pear"), (2, 1, "orange"), (3, 0, None)], "dim1 int, attr1 int, fruit string"))
    assert rows(table.df()) == [(1, 2, "pear"), (2, 1, "orange"), (3, 0, None)]
    assert rows(table.df().where("fruit = 'pear'").select("dim1")) == [(1,)]
    with pytest.raises(Exception, match="no label"):
        table.insert(spark.createDataFrame([(4, 1, "plum")], "dim1 int, attr1 int, fruit string"))
    assert table.df().count() == 3


def test_multi_value_cells(catalog, spark):
    schema = ArraySchema((Dimension("d", "INT", 0, 9, 1),), (Attribute("a3", "INT", size=2), Attribute("a4", "DOUBLE", size=2)))
    table = catalog.create("m", schema)
    table.insert(spark.createDataFrame([(1, [31, 0], [0.1, 0.2])], "d int, a3 array<int>, a4 array<double>"))
    assert table.df().first()["a3"] == [31, 0]
    with pytest.raises(Exception, match="needs 2 values"):
        table.insert(spark.createDataFrame([(1, [1], [0.1, 0.2])], "d int, a3 array<int>, a4 array<double>"))


@pytest.mark.parametrize("bad", [None, -1, 101])
def test_coordinates_are_checked(catalog, spark, bad):
    table = catalog.create("t", dup_schema())
    with pytest.raises(Exception, match="dimension dim1"):
        table.insert(spark.createDataFrame([(bad, 1)], "dim1 int, attr1 int"))
    assert table.df().count() == 0 and table.fragments() == []


def test_unsigned_and_not_null(catalog, spark):
    table = catalog.create("u", ArraySchema((Dimension("d", "INT", 0, 9, 1),), (Attribute("v", "BIGINT UNSIGNED", nullable=False),)))
    table.insert(spark.createDataFrame([(1, Decimal(2**64 - 1))], "d int, v decimal(20,0)"))
    assert int(table.df().first()["v"]) == 2**64 - 1
    with pytest.raises(Exception, match="out of range"):
        table.insert(spark.createDataFrame([(1, -1)], "d int, v int"))
    with pytest.raises(Exception, match="v is null"):
        table.insert(spark.createDataFrame([(1, None)], "d int, v int"))


def test_heterogeneous_and_string_dimensions(catalog, spark):
    schema = ArraySchema((Dimension("d1", "FLOAT", 1.0, 20.0, 1.0), Dimension("d2", "BIGINT", 1, 30, 1)), (Attribute("a", "INT"),))
    table = catalog.create("h", schema)
    table.insert(spark.createDataFrame([(1 + i / 10, i, i) for i in range(1, 7)], "d1 float, d2 long, a int"))
    assert table.df().where("d1 > 1.35").count() == 3 and table.slice({"d2": (2, 4)}).count() == 3
    strings = catalog.create("s", ArraySchema((Dimension("dim1", "VARCHAR"), Dimension("dim2", "VARCHAR")), (Attribute("attr1", "INT"),)))
    strings.insert(spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("aa", "b", 4)], "dim1 string, dim2 string, attr1 int"))
    assert rows(strings.slice({"dim1": "aa"})) == [("aa", "b", 4)]
    assert strings.df().where("dim1 < 'aa'").count() == 3


def test_metadata(catalog, spark):
    table = catalog.create("m", dup_schema())
    assert catalog.read("m@metadata").count() == 0
    table.put_metadata({"key1": 25, "key2": [25, 26, 27, 28], "key3": 25.1, "key4": [25.1, 26.2], "key5": "text"})
    table.put_metadata({"key1": 26})
    assert rows(catalog.read("m@metadata")) == [("key1", "26"), ("key2", "25,26,27,28"), ("key3", "25.1"), ("key4", "25.1,26.2"), ("key5", "text")]


def test_csv(catalog, spark, tmp_path):
    schema = ArraySchema((Dimension("day", "INT", 0, 99, 1),), (Attribute("mode", "VARCHAR"), Attribute("riders", "DOUBLE")), allows_dups=True)
    table = catalog.create("c", schema)
    (tmp_path / "a.csv").write_text('day|mode|riders\n1|"Light | Rail"|2.5\n2|Bus|\n')
    (tmp_path / "none.csv").write_text("day|mode|riders\n")
    table.load_csv(f"file://{tmp_path}/a.csv", delimiter="|")
    assert table.load_csv(f"file://{tmp_path}/none.csv", delimiter="|") is None
    assert rows(table.df()) == [(1, "Light | Rail", 2.5), (2, "Bus", None)]


def test_encryption_needs_the_key(catalog, spark):
    key = "0123456789abcdeF0123456789abcdeF"
    table = catalog.create("s", dup_schema(encrypted=True), encryption_key=key)
    table.insert(spark.createDataFrame([(1, 5), (2, None)], "dim1 int, attr1 int"))
    table.insert(spark.createDataFrame([(1, 6)], "dim1 int, attr1 int"))
    assert rows(catalog.open("s", encryption_key=key).df()) == [(1, 6), (2, None)]
    with pytest.raises(PermissionError):
        catalog.open("s")
    with pytest.raises(Exception):
        catalog.open("s", encryption_key="x" * 32).df().collect()


def test_ddl_round_trip():
    schema = ArraySchema(
        (Dimension("d0", "BIGINT", 0, 100, 10, "ZSTD=2"), Dimension("d1", "INT", -5, 5, 1)),
        (Attribute("a", "INT", False, 7, True, "GZIP=5"), Attribute("b", "VARCHAR(20)", True, "it's", True), Attribute("e", "ENUM", labels=("x", "y, z")), Attribute("f", "DOUBLE", size=2)),
        cell_order="COLUMN_MAJOR",
        coordinate_filters="ZSTD=1",
    )
    name, parsed, options = parse_ddl(schema.ddl("t", "file:///x", 5))
    assert name == "t" and options == {"uri": "file:///x", "open_at": "5"}
    assert parsed == replace(schema)
    assert ArraySchema.from_json(schema.to_json()) == schema


def test_schema_rules():
    with pytest.raises(SchemaError):
        ArraySchema((Dimension("d", "INT", 0, 9),), ())
    with pytest.raises(SchemaError):
        ArraySchema((Dimension("d", "DOUBLE", 0.0, 9.0, 1.0),), (), "DENSE")
    with pytest.raises(SchemaError):
        ArraySchema((Dimension("d", "VARCHAR", 0, 9, 1),), ())
    with pytest.raises(SchemaError):
        ArraySchema((Dimension("d", "BLOB"),), ())
    with pytest.raises(SchemaError):
        dup_schema(coordinate_filters="NOPE=1")
    assert math.isnan(Attribute("x", "DOUBLE", nullable=False).fill) and Attribute("x", "SMALLINT UNSIGNED", nullable=False).fill == 65535
    assert Dimension("d", "INT", extent=100).bounds() == (-(2**31), 2**31 - 101)


def test_discovery_and_drop(catalog, spark):
    table = quickstart(catalog, spark)
    other = ArrayCatalog(spark, catalog.root + "/other")
    assert other.attach("found", table.path).df().count() == 16
    assert catalog.exists("q") and not catalog.exists("nope") and catalog.names() == ["q"]
    assert catalog.describe("q").where("role = 'dimension'").count() == 2
    other.drop("found")
    assert catalog.exists("q")
    catalog.drop("q", purge=True)
    assert not catalog.exists("q")
    with pytest.raises(FileNotFoundError):
        catalog.open("q")


def test_tiles_and_fragments_are_pruned(catalog, spark):
    table = catalog.create("t", ArraySchema((Dimension("d", "INT", 0, 999, 100),), (Attribute("v", "INT"),)))
    table.insert(spark.range(1000).selectExpr("cast(id as int) d", "cast(id as int) v"))
    plan = table.slice({"d": (150, 160)})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "__t_d" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "GreaterThanOrEqual(d,150)" in plan
    table.insert(spark.createDataFrame([(5, 0)], "d int, v int"))
    assert len(table.slice({"d": (500, 510)}).inputFiles()) < len(table.df().inputFiles())


def test_attribute_filters_stay_above_the_merge(catalog, spark):
    table = catalog.create("t", dup_schema())
    table.insert(spark.createDataFrame([(1, 1)], "dim1 int, attr1 int"))
    table.insert(spark.createDataFrame([(1, 2)], "dim1 int, attr1 int"))
    plan = table.df().where("attr1 = 1")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Aggregate")
    plan = table.df().where("dim1 = 1")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Filter")


def test_compaction_keeps_what_is_read(catalog, spark):
    table = catalog.create("t", dup_schema())
    for k in range(3):
        table.insert(spark.createDataFrame([(d, d * 10 + k) for d in range(k, 6)], "dim1 int, attr1 int"))
    before = rows(table.df())
    table.compact()
    assert rows(table.df()) == before and len(table.fragments()) == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_fragment_and_disjoint_ones_are_read_without_exchange(catalog, spark):
    table = catalog.create("t", dup_schema())
    table.insert(spark.createDataFrame([(d, d) for d in [*range(50), *range(50)]], "dim1 int, attr1 int"))
    assert table.fragments()[0]["rows"] == 50 and "Exchange" not in plan_of(table.df()) and "Sort" not in plan_of(table.df())
    assert "GreaterThan(attr1__v0,40)" in plan_of(table.df().where("attr1 > 40"))  # nothing is merged, so it may go down
    table.insert(spark.createDataFrame([(d, -d) for d in range(50, 60)], "dim1 int, attr1 int"))
    assert "Exchange" not in plan_of(table.df()) and table.df().count() == 60
    table.insert(spark.createDataFrame([(55, 0)], "dim1 int, attr1 int"))
    assert "Exchange" in plan_of(table.df()) and rows(table.df().where("dim1 >= 55"))[0] == (55, 0)
    assert plan_of(table.df()).count("Exchange") == 1


def test_small_deltas_are_broadcast_over_large_fragments(catalog, spark):
    table = catalog.create("t", dup_schema())
    table.insert(spark.createDataFrame([(d, d) for d in range(90)], "dim1 int, attr1 int"))
    table.insert(spark.createDataFrame([(7, -7), (95, 5)], "dim1 int, attr1 int"))
    table.insert(spark.createDataFrame([(7, None), (8, -8)], "dim1 int, attr1 int"))
    merged = rows(table.df())
    over = ArrayTable(spark, table.path, options=Options(delta_rows=10))
    assert rows(over.df()) == merged and len(merged) == 91 and (7, None) in merged
    assert "BroadcastHashJoin" in plan_of(over.df()) and "LeftAnti" in plan_of(over.df())
    assert rows(over.slice({"dim1": (6, 9)})) == [r for r in merged if 6 <= r[0] <= 9]


def test_key_joins_filter_cells_before_versions_meet(catalog, spark):
    table = catalog.create("t", dup_schema())
    table.insert(spark.createDataFrame([(d, d) for d in range(90)], "dim1 int, attr1 int"))
    table.insert(spark.createDataFrame([(d, None if d % 2 else -d) for d in range(0, 90, 3)], "dim1 int, attr1 int"))
    keys = spark.createDataFrame([(3, "a"), (3, "b"), (6, "c"), (7, "d"), (200, "e")], "dim1 int, n string")
    for delta in (0, 1000):  # met in the aggregate, and by broadcast
        cells = ArrayTable(spark, table.path, options=Options(delta_rows=delta)).df()
        got = lookup.batched_key_join(cells, keys, ["dim1"])
        assert rows(got) == rows(cells.join(keys, "dim1")) and (3, None, "a") in rows(got) and len(rows(got)) == 4
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        if not delta:
            assert plan.index("Aggregate") < plan.index("LeftSemi")


def test_versions_are_ordered_by_what_decides(catalog, spark):
    from gridlake.plans.arrays import fill

    for dups in (False, True):
        table = catalog.create(f"t{dups}", replace(dup_schema(), allows_dups=dups))
        fill(table, spark.createDataFrame([(d % 40, d) for d in range(50)], "dim1 int, attr1 int"))
        stored = spark.read.option("mergeSchema", True).parquet(table.store.at("__fragments"))
        assert "__seq" not in stored.columns  # repeats are settled before it would be stored
        assert table.df().count() == (50 if dups else 40)
        assert dups or rows(table.df()) == [tuple(r) for r in sorted([(d, d + 40 if d < 10 else d) for d in range(40)], key=repr)]
    table = catalog.create("same_time", dup_schema())
    for k in range(3):
        table.insert(spark.createDataFrame([(1, k), (k + 2, k)], "dim1 int, attr1 int"), timestamp=7)
    assert rows(table.df()) == [(1, 2), (2, 0), (3, 1), (4, 2)]  # of one time, by the commits' order
    table.insert(spark.createDataFrame([(1, 9)], "dim1 int, attr1 int"), timestamp=6)
    assert (1, 2) in rows(table.df())
    table.compact()
    table.insert(spark.createDataFrame([(1, 10)], "dim1 int, attr1 int"), timestamp=8)
    assert (1, 10) in rows(table.df()) and len(table.fragments()) == 2
    old = {"timestamp": 1, "unique": False}  # may hold repeats, which the place in the fragment settles
    assert [len(ArrayTable._versions(x)) for x in ([old], [old | {"unique": True}])] == [2, 1]


def test_writes_during_a_compaction_are_kept(catalog, spark, monkeypatch):
    table = catalog.create("t", dup_schema())
    frame = lambda *cells: spark.createDataFrame(list(cells), "dim1 int, attr1 int")
    table.insert(frame((1, 1), (2, 1)), timestamp=10)
    table.insert(frame((1, 2)), timestamp=30)
    write = ArrayTable._write

    def meanwhile(self, schema, cells, stamp, replaces=None):
        if replaces:
            monkeypatch.setattr(ArrayTable, "_write", write)
            table.insert(frame((1, 99)), timestamp=40)
            table.insert(frame((2, 98), (1, 97)), timestamp=20)  # dated between the compacted ones
        return write(self, schema, cells, stamp, replaces)

    monkeypatch.setattr(ArrayTable, "_write", meanwhile)
    table.compact()
    assert rows(table.df()) == [(1, 99), (2, 98)]
    assert rows(ArrayTable(spark, table.path, open_at=30).df()) == [(1, 2), (2, 98)]


def test_history_survives_compaction_until_vacuum(catalog, spark):
    table = catalog.create("t", dup_schema())
    for k in (10, 20, 30):
        table.insert(spark.createDataFrame([(1, k), (k, k)], "dim1 int, attr1 int"), timestamp=k)
    at = lambda t: rows(ArrayTable(spark, table.path, open_at=t).df())
    before = [at(t) for t in (5, 15, 25, 30)]
    table.compact()
    assert [at(t) for t in (5, 15, 25, 30)] == before and rows(table.df()) == before[-1]
    table.vacuum()
    assert rows(table.df()) == before[-1] == at(30) and at(5) == [] and len(table.store.names("__commits")) == 1
    with pytest.raises(ValueError, match="vacuum"):
        at(15)
    table.insert(spark.createDataFrame([(1, 40)], "dim1 int, attr1 int"), timestamp=40)
    assert (1, 40) in rows(table.df())


def test_manifests_are_rolled_up(catalog, spark, monkeypatch):
    from gridlake.sources import table as module
    from gridlake.sources.store import Store

    monkeypatch.setattr(module, "ROLL_UP", 3)
    table = catalog.create("t", dup_schema())
    for k in range(7):
        table.insert(spark.createDataFrame([(k, k)], "dim1 int, attr1 int").coalesce(1), timestamp=k + 1)
    assert len(table.store.names("__rollup")) == 2
    monkeypatch.setattr(Store, "_fixed", {})
    read = []
    monkeypatch.setattr(Store, "read", lambda self, *parts, f=Store.read: read.append(parts) or f(self, *parts))
    assert len(table.fragments()) == 7 and len([p for p in read if p[0] == "__commits"]) == 1
    assert len(ArrayTable(spark, table.path, open_at=4).fragments()) == 4


def test_aggregates_from_manifests_equal_a_scan(catalog, spark):
    import datetime

    schema = ArraySchema((Dimension("k", "INT", 0, 999, 10),), (Attribute("x", "DOUBLE"), Attribute("u", "BIGINT UNSIGNED"), Attribute("t", "DATETIME(6)"), Attribute("s", "VARCHAR")))
    table = catalog.create("t", schema)
    assert tuple(table.aggregates(["x"]).first()) == (0, None, None, 0, None, None)
    at = datetime.datetime(2020, 1, 1, 0, 0, 0, 5)
    kind = "k int, x double, u decimal(20,0), t timestamp_ntz, s string"
    table.insert(spark.createDataFrame([(1, 0.1, Decimal(2**64 - 1), at, "a"), (2, None, None, None, None), (3, -1e-300, Decimal(0), at, "b")], kind))
    table.insert(spark.createDataFrame([(10, math.inf, Decimal(5), at.replace(year=1900), "c")], kind))
    own = ["x", "u", "t"]
    by_scan = ArrayTable(spark, table.path, options=Options(enable_aggregate_pushdown=False)).aggregates(own).first()
    assert table.aggregates(own).first() == by_scan and table.aggregates(own).inputFiles() == []
    assert table.aggregates(["s"]).first()["s_max"] == "c"  # strings are not measured, so this one scans
    table.alter(add=[Attribute("later", "INT", nullable=False, default=7, has_default=True)])
    assert table.aggregates(["later"]).first()["later_min"] == 7
    table.insert(spark.createDataFrame([(2, 9.0, None, None, None, 1)], kind + ", later int"))
    got = table.aggregates(["x"]).first()
    assert (got["cells"], got["x_count"], got["x_max"]) == (4, 4, math.inf)


def test_odd_coordinates_are_merged_and_found(catalog, spark):
    table = catalog.create("f", ArraySchema((Dimension("x", "DOUBLE", extent=1.0),), (Attribute("v", "INT"),)))
    table.insert(spark.createDataFrame([(1.0, 1), (math.nan, 1)], "x double, v int"))
    table.insert(spark.createDataFrame([(math.nan, 2), (5.0, 2)], "x double, v int"))
    assert sorted((str(x), v) for x, v in rows(table.df())) == [("1.0", 1), ("5.0", 2), ("nan", 2)]
    assert rows(table.slice({"x": (0.5, 7.0)})) == [(1.0, 1), (5.0, 2)]
    days = catalog.create("d", ArraySchema((Dimension("d", "DATE", extent=1),), (Attribute("v", "INT"),)))
    for v, text in ((1, ["9999-01-01", "+12000-01-01"]), (2, ["+10000-01-01", "+12000-01-01"])):
        days.insert(spark.createDataFrame([(x, v) for x in text], "d string, v int").selectExpr("cast(d as date) d", "v"))
    assert sorted(tuple(r) for r in days.df().selectExpr("cast(d as string)", "v").collect()) == [("+10000-01-01", 2), ("+12000-01-01", 2), ("9999-01-01", 1)]


def test_an_array_made_anew_elsewhere_is_seen(catalog, spark, tmp_path):
    import shutil
    import time

    catalog.create("t", dup_schema())
    assert catalog.open("t").schema.attrs == ["attr1"]
    shutil.rmtree(tmp_path / "t")  # as another process would
    time.sleep(1.1)  # file systems may keep whole seconds
    ArrayTable.create(spark, catalog.path("t"), ArraySchema((Dimension("dim1", "INT", 0, 100, 10),), (Attribute("other", "INT"),)))
    assert catalog.open("t").schema.attrs == ["other"]


def test_encrypted_cells_keep_every_type(catalog, spark):
    import datetime

    at = datetime.datetime(2020, 1, 2, 3, 4, 5, 123456)
    schema = ArraySchema((Dimension("d", "DATETIME(6)", extent=1),), (Attribute("t", "DATETIME(6)"), Attribute("b", "BLOB"), Attribute("x", "DOUBLE"), Attribute("u", "BIGINT UNSIGNED")), encrypted=True)
    table = catalog.create("e", schema, encryption_key="k" * 32)
    cells = [(at, at, b"\x00\xff", float("inf"), Decimal(2**64 - 1)), (at.replace(microsecond=1), None, None, None, None)]
    table.insert(spark.createDataFrame(cells, "d timestamp_ntz, t timestamp_ntz, b binary, x double, u decimal(20,0)"))
    assert sorted((tuple(r) for r in table.df().collect()), key=repr) == sorted(((d, t, None if b is None else bytearray(b), x, u) for d, t, b, x, u in cells), key=repr)


def test_dense_dates_and_refused_dense_times(catalog, spark):
    table = catalog.create("d", ArraySchema((Dimension("day", "DATE", extent=1),), (Attribute("v", "INT"),), "DENSE"))
    table.insert(spark.createDataFrame([("2024-02-28", 1), ("2024-03-01", 2)], "day string, v int").selectExpr("cast(day as date) day", "v"))
    assert [(str(d), v) for d, v in rows(table.df())] == [("2024-02-28", 1), ("2024-02-29", None), ("2024-03-01", 2)]
    assert table.slice({"day": ("2024-02-29", None)}).count() == 2
    with pytest.raises(SchemaError):
        ArraySchema((Dimension("t", "DATETIME", extent=1),), (), "DENSE")
    with pytest.raises(ValueError, match="limit"):
        table.slice(max_cells=2)


def test_unsigned_dimensions(catalog, spark):
    table = catalog.create("u", ArraySchema((Dimension("d", "BIGINT UNSIGNED", extent=1),), (Attribute("v", "INT"),)))
    table.insert(spark.createDataFrame([(Decimal(2**64 - 2), 1), (Decimal(0), 2)], "d decimal(20,0), v int"))
    assert rows(table.slice({"d": (Decimal(2**63), None)})) == [(Decimal(2**64 - 2), 1)]
    with pytest.raises(Exception, match="out of its domain"):
        table.insert(spark.createDataFrame([(-1, 1)], "d int, v int"))


def test_many_tiles_share_folders(catalog, spark):
    table = catalog.create("t", ArraySchema((Dimension("d", "BIGINT", 0, 10**6, 10),), (Attribute("v", "INT"),)))
    table.insert(spark.range(0, 10**6, 500).selectExpr("id d", "cast(id as int) v"))
    assert rows(table.slice({"d": (3500, 4499)})) == [(3500, 3500), (4000, 4000)]
    assert len({f.split("__t_d=")[1].split("/")[0] for f in table.df().inputFiles()}) <= 256
    assert "__t_d" in plan_of(table.slice({"d": (3500, 4499)})).split("PartitionFilters")[1].split("]")[0]


def test_filters_reach_the_files(catalog, spark):
    schema = ArraySchema((Dimension("d", "INT", 0, 9, 10),), (Attribute("a", "VARCHAR", filters="NONE"), Attribute("b", "VARCHAR", filters="DICTIONARY")), coordinate_filters="GZIP=9")
    assert schema.write_options() == {"compression": "gzip", "zlib.compress.level": "BEST_COMPRESSION", "parquet.enable.dictionary#a__v0": "false", "parquet.enable.dictionary#b__v0": "true"}
    table = catalog.create("t", schema)
    table.insert(spark.createDataFrame([(i, "x" * 9, "y" * 9) for i in range(9)], "d int, a string, b string").coalesce(1))
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(table.df().inputFiles()[0].removeprefix("file://")).metadata.row_group(0)
    columns = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert columns["a__v0"].compression == "GZIP" and not columns["a__v0"].has_dictionary_page and columns["b__v0"].has_dictionary_page


def test_options_take_effect(catalog, spark):
    table = catalog.create("t", dup_schema())
    with pytest.raises(SchemaError):
        ArrayTable(spark, table.path, options=Options(dimensions_are_keys=False)).find((1,))
    try:
        ArrayCatalog(spark, catalog.root, Options(enable_pushdown=False, read_batch_rows=128, config="gridlake.test=7"))
        assert spark.conf.get("gridlake.test") == "7"
        assert spark.conf.get("spark.sql.parquet.filterPushdown") == "false" and spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "128"
    finally:
        Options().apply(spark)


def test_layouts_and_pinned_snapshots(catalog, spark):
    quickstart(catalog, spark)
    col = ArrayTable(spark, catalog.path("q"), options=Options(read_layout="col-major"))
    assert [tuple(r)[:2] for r in col.df().limit(3).collect()] == [(1, 1), (2, 1), (3, 1)]
    tiled = catalog.create("g", ArraySchema((Dimension("x", "INT", 0, 3, 2), Dimension("y", "INT", 0, 3, 2)), (Attribute("v", "INT"),)))
    tiled.insert(spark.createDataFrame([(x, y, 0) for x in range(4) for y in range(4)], "x int, y int, v int"))
    read = ArrayTable(spark, tiled.path, options=Options(read_layout="global-order")).df().collect()
    assert [tuple(r)[:2] for r in read] == sorted(((x, y) for x in range(4) for y in range(4)), key=lambda p: (p[0] // 2, p[1] // 2, p))
    with pytest.raises(ValueError):
        ArrayTable(spark, tiled.path, options=Options(read_layout="zigzag")).df()
    assert [tuple(ArrayTable(spark, tiled.path, options=Options(enable_aggregate_pushdown=on)).aggregates().first()) for on in (True, False)] == [(16, 0, 3, 0, 3)] * 2
    pinned = ArrayTable(spark, catalog.path("q"), options=Options(reopen_for_every_query=False, compute_table_records=True))
    catalog.open("q").insert(spark.createDataFrame([(1, 1, 99)], "rows int, cols int, a int"))
    assert pinned.df().where("a = 99").count() == 0 and pinned.records() == 16
    assert catalog.open("q").df().where("a = 99").count() == 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.integers(0, 12), st.one_of(st.none(), st.integers(-3, 3))), min_size=1, max_size=8), min_size=1, max_size=4), st.integers(0, 4), st.tuples(st.integers(0, 12), st.integers(0, 12)))
def test_replay_against_a_dict(spark, tmp_path_factory, writes, at, span):
    catalog = ArrayCatalog(spark, f"file://{tmp_path_factory.mktemp('replay')}")
    table = catalog.create("t", dup_schema())
    expected = {}
    for k, cells in enumerate(writes, 1):
        table.insert(spark.createDataFrame(cells, "dim1 int, attr1 int").coalesce(1), timestamp=k)
        if k <= at:
            expected |= dict(cells)
    low, high = min(span), max(span)
    assert rows(catalog.open("t", open_at=at).df()) == sorted(expected.items(), key=repr)
    assert rows(catalog.open("t", open_at=at).slice({"dim1": (low, high)})) == sorted(((k, v) for k, v in expected.items() if low <= k <= high), key=repr)


def test_stream_appends_fragments(catalog, spark, tmp_path):
    from gridlake.streaming.fragments import append_stream

    table = catalog.create("t", dup_schema())
    for k in range(2):
        spark.createDataFrame([(k, k), (7, k)], "dim1 int, attr1 int").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema("dim1 int, attr1 int").parquet(f"file://{tmp_path}/in")
        append_stream(stream, table, f"file://{tmp_path}/checkpoint", base=100).awaitTermination()
    assert [f["timestamp"] for f in table.fragments()] == [100, 101]
    assert rows(table.df()) == [(0, 0), (1, 1), (7, 1)]
