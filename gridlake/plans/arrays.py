"""The test tables as arrays on disk, which the registered queries open.

Each has two fragments.  In arrays without duplicates the first holds every cell, a quarter of them without values,
and the second these again with their values, so that a read which does not merge is wrong; in arrays with duplicates
the cells are dealt to both.  An array is written once a session and input folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.session import Options
from gridlake.sources.catalog import ArrayCatalog
from gridlake.sources.schema import ArraySchema, Attribute, Dimension
from gridlake.sources.scratch import new_folder
from gridlake.sources.table import ArrayTable

_SQL_TYPES = {"int": "INT", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "timestamp_ntz": "DATETIME(6)", "timestamp": "DATETIME(6)", "binary": "BLOB", "date": "DATE", "boolean": "BOOL"}
_DOMAINS = {"INT": (0, 10**9, 10**3), "BIGINT": (0, 10**12, 10**6), "DOUBLE": (-1e12, 1e12, 1e6)}
#: Array -> (table, dimensions, duplicates allowed).
_KEYS: dict[str, tuple[str, list[str], bool]] = {
    "region": ("region", ["r_regionkey"], False),
    "nation": ("nation", ["n_nationkey"], False),
    "customer": ("customer", ["c_custkey"], False),
    "customer_by_segment": ("customer", ["c_mktsegment", "c_custkey"], False),
    "supplier": ("supplier", ["s_suppkey"], False),
    "part": ("part", ["p_partkey"], False),
    "orders": ("orders", ["o_orderkey"], False),
    "orders_by_date": ("orders", ["o_orderdate", "o_orderkey"], False),
    "lineitem": ("lineitem", ["l_orderkey", "l_linenumber"], True),
    "lineitem_by_date": ("lineitem", ["l_shipdate", "l_orderkey"], True),
    "events": ("events", ["event_id"], False),
    "events_by_time": ("events", ["ts", "event_id"], False),
    "documents": ("documents", ["doc_id"], False),
    "embeddings": ("embeddings", ["vec_id"], False),
    "conversations": ("conversations", ["conv_id", "turn"], False),
}
_BUILT: dict[tuple[str, str, str], ArrayCatalog] = {}


def schema_of(rows: DataFrame, dims: list[str], **how) -> ArraySchema:
    """An array's schema from a DataFrame: its columns' types, and domains wide enough for any key."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def dimension(name: str) -> Dimension:
        kind = _SQL_TYPES[kinds[name]]
        return Dimension(name, kind) if kind == "VARCHAR" else Dimension(name, kind, *_DOMAINS.get(kind, (None, None, 1)))

    def attribute(name: str) -> Attribute:
        kind = kinds[name]
        return Attribute(name, _SQL_TYPES[kind[6:-1]], size=64) if kind.startswith("array<") else Attribute(name, _SQL_TYPES[kind])

    return ArraySchema(tuple(map(dimension, dims)), tuple(attribute(c) for c in rows.columns if c not in dims), **how)


def fill(table: ArrayTable, rows: DataFrame) -> None:
    """Two fragments with the rows' cells; see above."""
    schema = table.schema
    again = F.pmod(F.xxhash64(*schema.dims), F.lit(4)) == 0
    if schema.allows_dups:
        table.insert(rows.where(~again), timestamp=1)
    else:
        table.insert(rows.select(*[F.col(c) if c in schema.dims else F.when(~again, F.col(c)).alias(c) for c in rows.columns]), timestamp=1)
    table.insert(rows.where(again), timestamp=2)


def array(spark: SparkSession, sf_dir: str, name: str, make: Callable[[DataFrame], DataFrame] | None = None, key: tuple[str, list[str], bool] | None = None, metadata: dict | None = None, options: Options | None = None) -> ArrayTable:
    """An array by name; ``make`` and ``key`` define one that is not in the list."""
    source, dims, dups = key or _KEYS[name]
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _BUILT:
        rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
        rows = make(rows) if make else rows
        catalog = ArrayCatalog(spark, new_folder(spark, "arrays"))
        table = catalog.create(name, schema_of(rows, dims, allows_dups=dups))
        fill(table, rows)
        if metadata:
            table.put_metadata(metadata)
        _BUILT[at] = catalog
    return ArrayTable(spark, _BUILT[at].path(name), options=options)


def catalog_of(spark: SparkSession, sf_dir: str, name: str) -> ArrayCatalog:
    """The catalogue that a listed array is in."""
    array(spark, sf_dir, name)
    return _BUILT[spark.sparkContext.applicationId, sf_dir, name]
