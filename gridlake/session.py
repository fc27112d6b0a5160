"""Session options of the array engine."""

from __future__ import annotations

import logging
import tempfile
import zipfile
from dataclasses import dataclass, field

from pathlib import Path

from pyspark.sql import SparkSession


@dataclass
class Options:
    """``delete_arrays``: dropping a table removes its data; ``reopen_for_every_query``: False pins the fragments
    seen at open; ``read_layout``: row-major, col-major, unordered or global-order; ``compute_table_records``: count
    from manifests instead of a guess; ``create_allow_subset_existing_array``: creation over an existing array opens
    it; ``config``: more settings of Spark, also as ``key=value,key=value``; ``dimensions_are_keys``: cells can be looked up by key; ``delta_rows``: newer cells over larger fragments up to
    which a read broadcasts their coordinates instead of merging.  Buffer sizes map to Spark's batch and file sizes.

    A catalogue applies the options that it is given to its session."""

    delete_arrays: bool = False
    reopen_for_every_query: bool = True
    read_layout: str = "unordered"
    dimensions_are_keys: bool = True
    enable_pushdown: bool = True
    enable_aggregate_pushdown: bool = True
    compute_table_records: bool = False
    create_allow_subset_existing_array: bool = False
    read_batch_rows: int = 4096
    max_records_per_file: int = 0
    delta_rows: int = 500_000
    log_level: str = "warning"
    config: dict[str, str] | str = field(default_factory=dict)

    def __post_init__(self) -> None:
        if isinstance(self.config, str):
            self.config = parse_config(self.config)

    def apply(self, spark: SparkSession) -> None:
        """Set what Spark itself decides on."""
        spark.conf.set("spark.sql.parquet.filterPushdown", str(self.enable_pushdown).lower())
        spark.conf.set("spark.sql.parquet.aggregatePushdown", str(self.enable_aggregate_pushdown).lower())
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(self.read_batch_rows))
        for key, value in self.config.items():
            spark.conf.set(key, value)
        logging.getLogger("gridlake").setLevel(self.log_level.upper())


def parse_config(text: str) -> dict[str, str]:
    """``key=value,key=value``."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        key, eq, value = part.partition("=")
        if not eq:
            raise ValueError(f"not key=value: {part}")
        out[key.strip()] = value.strip()
    return out


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that their Python can import it wherever it runs."""
    context = spark.sparkContext
    if getattr(context, "_gridlake_shipped", False):
        return
    package = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="gridlake-")) / "gridlake.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    context._gridlake_shipped = True
