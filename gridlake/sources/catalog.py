"""Array catalogue: names and URIs to tables; creation, discovery, dropping."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from gridlake.session import Options
from gridlake.sources.schema import ArraySchema, parse_ddl
from gridlake.sources.store import Store
from gridlake.sources.table import ArrayTable

_AT = re.compile(r"@(\d+)$")
METADATA = "@metadata"


class ArrayCatalog:
    """Arrays below a root folder by name, and anywhere by URI.

    A URI may end in ``@<ms>`` (as of that time) or ``@metadata`` (the key/value table); an explicit ``open_at`` wins.
    """

    def __init__(self, spark: SparkSession, root: str, options: Options | None = None):
        self.spark, self.root, self.options = spark, root.rstrip("/"), options or Options()
        self.registered: dict[str, str] = {}
        if options is not None:
            options.apply(spark)

    def path(self, name: str) -> str:
        return self.registered.get(name) or (name if "/" in name else f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return bool(Store(self.spark, self.path(_AT.sub("", name.removesuffix(METADATA)))).names("__schema"))

    def names(self) -> list[str]:
        return sorted({*self.registered, *(n for n in Store(self.spark, self.root).names() if self.exists(n))})

    def create(self, name: str, schema: ArraySchema, path: str | None = None, encryption_key: str | None = None) -> ArrayTable:
        where = path or self.path(name)
        if not (self.options.create_allow_subset_existing_array and Store(self.spark, where).names("__schema")):
            ArrayTable.create(self.spark, where, schema)
        self.registered[name] = where
        return self.open(name, columns=schema.columns if self.options.create_allow_subset_existing_array else None, encryption_key=encryption_key)

    def create_sql(self, ddl: str) -> ArrayTable:
        """Create from a CREATE TABLE statement with the engine's table and column options."""
        name, schema, options = parse_ddl(ddl)
        return self.create(name, schema, options.get("uri"), options.get("encryption_key"))

    def attach(self, name: str, uri: str) -> ArrayTable:
        """Register an existing array: its columns are discovered from what is stored."""
        if not self.exists(uri):
            raise FileNotFoundError(uri)
        self.registered[name] = self.path(uri)
        return self.open(name)

    def open(self, name: str, open_at: int | None = None, columns: list[str] | dict[str, str] | None = None, encryption_key: str | None = None) -> ArrayTable:
        m = _AT.search(name)
        if m:
            name = name[: m.start()]
            open_at = int(m[1]) if open_at is None else open_at
        return ArrayTable(self.spark, self.path(name), open_at, columns, encryption_key, self.options)

    def read(self, name: str, **how) -> DataFrame:
        """The array (or its metadata) as a DataFrame, also registered as a temp view."""
        if name.endswith(METADATA):
            return self.open(name.removesuffix(METADATA), **how).metadata()
        df = self.open(name, **how).df()
        if re.fullmatch(r"\w+", name):
            df.createOrReplaceTempView(name)
        return df

    def describe(self, name: str) -> DataFrame:
        """``column, type, nullable, role`` as an information schema gives them."""
        fields = self.open(name).schema.struct()
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable, f.metadata["role"]) for f in fields], "column string, type string, nullable boolean, role string")

    def drop(self, name: str, purge: bool | None = None) -> None:
        """Unregister; delete the data only with ``purge`` (default: the session's ``delete_arrays``)."""
        where = self.path(name)
        self.registered.pop(name, None)
        self.spark.catalog.dropTempView(name) if re.fullmatch(r"\w+", name) else None
        if self.options.delete_arrays if purge is None else purge:
            Store(self.spark, where).delete()
