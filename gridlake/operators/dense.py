"""Dense arrays: every cell of the domain exists, unwritten ones hold fill values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells of a grid above which building it is refused unless the caller allows more.
MAX_CELLS = 2_000_000_000


def grid(spark: SparkSession, domain: dict[str, tuple[int, int]], max_cells: int = MAX_CELLS, kinds: dict[str, str] | None = None) -> DataFrame:
    """All coordinates of a hyper-rectangle of whole numbers, or dates as days since 1970, from one range split over the
    cluster."""
    total = 1
    for low, high in domain.values():
        total *= max(0, high - low + 1)
    if total > max_cells:
        raise ValueError(f"{total} cells exceed the limit of {max_cells}; slice the array or raise the limit")
    rest: Column = F.col("id")
    columns = []
    for name, (low, high) in reversed(domain.items()):
        width = max(1, high - low + 1)
        kind, place = (kinds or {}).get(name, "bigint"), F.pmod(rest, F.lit(width)) + F.lit(str(low)).cast("bigint" if abs(low) < 2**62 else "decimal(20,0)")
        columns.append((F.date_add(F.lit("1970-01-01").cast("date"), place.cast("int")) if kind == "date" else place.cast(kind)).alias(name))
        rest = F.call_function("div", rest, F.lit(width).cast("bigint"))
    return spark.range(total).select(*reversed(columns))


def dense_fill(cells: DataFrame, domain: dict[str, tuple[int, int]], fills: dict[str, Column], max_cells: int = MAX_CELLS) -> DataFrame:
    """Cells of the domain, unwritten ones with their fill; a written null stays null."""
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    whole = grid(cells.sparkSession, domain, max_cells, kinds)
    there = whole.join(cells.withColumn("__there", F.lit(True)), list(domain), "left")
    return there.select(*domain, *[F.when(F.col("__there").isNull(), fills[c]).otherwise(F.col(c)).alias(c) for c in cells.columns if c not in domain])

