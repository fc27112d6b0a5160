"""Helpers that the operators share: Arrow batch mapping, scratch tables, and rows' addresses.

A stage that keeps, drops or changes rows decides on small rows first, each of which names its document by address: the
Parquet file and the place in it.  Decisions are then written as side files, and the one pass over the texts reads the
side file of the rows that it is at.  So no text is shuffled to be kept, dropped or changed, whatever the size, and
repeated ids need no care.
"""

from __future__ import annotations

import ctypes
import gc
import posixpath
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridlake.sources.scratch import new_folder, shared_dir  # noqa: F401  the operators take them from here

#: Rows, and bytes but for a longer row, that a Python worker takes of an Arrow batch at once.
SLICE_ROWS, SLICE_BYTES = 1_000, 4 << 20
#: A row's address: a hash of its Parquet file's path, and its place in the file.
FILE, ROW, PART = "__gl_file", "__gl_row", "__gl_part"
#: Rows of a file whose decisions share a side file, as a power of two.
BLOCK_BITS = 18
#: Rows of documents for which a table of a few numbers a row gets another file, as a power of two.
FILE_BITS = 16
#: A key with more than this share of the rows is hot (so fewer than so many are), and dealt to so many tasks.
HOT_SHARE, SALTS = 256, 32


def in_few_files(df: DataFrame, rows: int) -> DataFrame:
    """Small rows made by many tasks, gathered in a number of partitions that follows that of the documents' ``rows``."""
    return df.repartition(max(1, -(-rows >> FILE_BITS)))


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a URI; Hadoop's names for S3 are those of Arrow's S3 too."""
    for old in ("s3a://", "s3n://"):
        path = path.replace(old, "s3://", 1) if path.startswith(old) else path
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def is_plain_read(df: DataFrame) -> bool:
    """Whether ``df`` is one Parquet table, at most projected and filtered: its rows' addresses are then fixed."""
    nodes = [line.lstrip(" +-:") for line in df._jdf.queryExecution().analyzed().toString().splitlines() if line.strip()]
    return nodes[-1].startswith("Relation") and nodes[-1].rstrip().endswith("parquet") and all(n.startswith(("Project", "Filter", "SubqueryAlias")) for n in nodes[:-1])


def addressed(df: DataFrame) -> DataFrame:
    """``df`` with the columns FILE and ROW.  What is not a plain read of Parquet is written to the shared folder first."""
    if FILE in df.columns:
        return df
    if not is_plain_read(df):
        df = cut(df, "rows")
    place = df.metadataColumn("_metadata")
    return df.select("*", F.xxhash64(place["file_path"]).alias(FILE), place["row_index"].alias(ROW))


@dataclass(frozen=True)
class Side:
    """Values of some rows of an addressed table, in side files of about a quarter million rows at most."""

    path: str
    parts: int

    def part(self) -> Column:
        """The side file that a row's values are in, if it has any."""
        return F.pmod(F.xxhash64(FILE, F.shiftright(F.col(ROW), BLOCK_BITS)), F.lit(self.parts)).cast("int").alias(PART)


def put_side(found: DataFrame, rows: int, name: str) -> Side:
    """Write ``found`` (FILE, ROW, which are unique, and perhaps ``value``) for a table of so many rows."""
    side = Side(new_folder(found.sparkSession, name), max(1, -(-rows >> BLOCK_BITS)))
    dealt = found.withColumn(PART, side.part()).repartition(side.parts, PART).sortWithinPartitions(PART, FILE, ROW)
    dealt.write.partitionBy(PART).option("compression", "zstd").parquet(side.path)
    return side


class SideReader:
    """Looks rows up in a ``Side`` on an executor; holds the values of one file's rows in one side file at a time."""

    def __init__(self, side: Side, values: bool = False):
        self.store, self.inner = open_store(side.path)
        self.columns, self.at = [ROW, *(["value"] if values else [])], None
        self.rows, self.values = np.empty(0, np.int64), None

    def load(self, part: int, file: int) -> None:
        folder = posixpath.join(self.inner, f"{PART}={part}")
        self.at, self.rows, self.values = (part, file), np.empty(0, np.int64), None
        if self.store.get_file_info(folder).type == pafs.FileType.Directory:
            own = ds.dataset(folder, filesystem=self.store, format="parquet").to_table(self.columns, filter=ds.field(FILE) == file).sort_by(ROW)
            self.rows, self.values = own.column(ROW).to_numpy(), own.column("value") if "value" in self.columns else None

    def find(self, parts: np.ndarray, files: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list | None]:
        """Whether each row has an entry; and the entries' values (None where there is none) if they are read."""
        there, values = np.zeros(len(rows), bool), [None] * len(rows) if "value" in self.columns else None
        edges = [0, *(np.flatnonzero((np.diff(parts) != 0) | (np.diff(files) != 0)) + 1).tolist(), len(rows)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if (key := (int(parts[a]), int(files[a]))) != self.at:
                self.load(*key)
            if len(self.rows):
                place = np.minimum(np.searchsorted(self.rows, rows[a:b]), len(self.rows) - 1)
                there[a:b] = self.rows[place] == rows[a:b]
                if values is not None:
                    for k in np.flatnonzero(there[a:b]).tolist():
                        values[a + k] = self.values[int(place[k])].as_py()
        return there, values


def without(rows: DataFrame, gone: DataFrame, total: int, name: str) -> DataFrame:
    """The rows of an addressed table but for those in ``gone (FILE, ROW)``, without the addresses.

    Only three numbers a row go through Python; the texts stay where they are read.
    """
    side = put_side(gone.select(FILE, ROW), total, name)

    @F.pandas_udf("boolean")
    def stays(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        reader = SideReader(side)
        for part, file, row in batches:
            yield pd.Series(~reader.find(part.to_numpy(), file.to_numpy(), row.to_numpy())[0])

    return rows.where(stays(side.part(), F.col(FILE), F.col(ROW))).select(*[plain(c) for c in rows.columns if c not in (FILE, ROW)])


def hot_keys(counted: DataFrame, key: str, n: str, total: int) -> list:
    """The keys with more than a ``HOT_SHARE``th of ``total`` rows, by their numbers of rows: fewer than that many."""
    return [r[0] for r in counted.where(F.col(n) > max(1, total // HOT_SHARE)).select(key).collect()]


def left_join(rows: DataFrame, facts: DataFrame, key: str, hot: list, spread: Column) -> DataFrame:
    """``rows`` with the facts of their key, of which there is one row a key at most.  Rows of hot keys go to several
    tasks by ``spread``.  Always merged: whether a side happens to fit a broadcast must not change what is shuffled."""
    if not hot:
        return rows.join(facts.hint("merge"), key, "left")
    is_hot = F.col(key).isin(hot)
    dealt = rows.withColumn("__gl_salt", F.when(is_hot, F.pmod(spread, F.lit(SALTS)).cast("int")).otherwise(0))
    each = facts.withColumn("__gl_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(each.hint("merge"), [key, "__gl_salt"], "left").drop("__gl_salt")


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts, so that what a step makes of it stays small."""
    if batch.num_rows:
        rows = max(1, min(SLICE_ROWS, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task and serves other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, columns: Iterable[str | Column], schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict | None]]) -> DataFrame:
    """``mapInArrow`` over the given columns only.

    ``make`` runs once for each partition and returns a function from an Arrow batch to a dict of
    column values (lists or arrays, in any order); None or empty columns give no rows.
    """
    kind = StructType.fromDDL(schema)
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch):
                if (got := step(part)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in target], schema=target)
        give_back()

    return df.select(*columns).mapInArrow(run, kind)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as strings, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def plain(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")
