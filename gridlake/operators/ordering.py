"""Cell orders: row-major, column-major and Hilbert, as sort keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_major(cells: DataFrame, dims: list[str]) -> DataFrame:
    return cells.orderBy(*dims)


def col_major(cells: DataFrame, dims: list[str]) -> DataFrame:
    return cells.orderBy(*reversed(dims))


def global_order(cells: DataFrame, dims: list[str], tiles: list[Column], column_major_tiles: bool = False, column_major_cells: bool = False) -> DataFrame:
    """Tiles first, then cells within each."""
    return cells.orderBy(*(reversed(tiles) if column_major_tiles else tiles), *(reversed(dims) if column_major_cells else dims))


def laid_out(cells: DataFrame, dims: list[str], layout: str, tiles: list[Column], column_major_tiles: bool, column_major_cells: bool) -> DataFrame:
    """The cells in a read layout; ``unordered`` leaves them as they are read."""
    if layout == "unordered":
        return cells
    if layout == "global-order":
        return global_order(cells, dims, tiles, column_major_tiles, column_major_cells)
    if layout not in ("row-major", "col-major"):
        raise ValueError(f"unknown layout: {layout}")
    return (row_major if layout == "row-major" else col_major)(cells, dims)


def hilbert(x: Column, y: Column, bits: int = 16) -> Column:
    """Distance along the Hilbert curve of a 2^bits x 2^bits grid; JVM-side."""
    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("d"))

    def step(a: Column, k: Column) -> Column:
        s = F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
        rx = (a["x"].bitwiseAND(s) > 0).cast("bigint")
        ry = (a["y"].bitwiseAND(s) > 0).cast("bigint")
        d = a["d"] + s * s * (F.lit(3) * rx).bitwiseXOR(ry)
        fx = F.when((ry == 0) & (rx == 1), F.lit((1 << bits) - 1) - a["x"]).otherwise(a["x"])
        fy = F.when((ry == 0) & (rx == 1), F.lit((1 << bits) - 1) - a["y"]).otherwise(a["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda a: a["d"])


def scaled(value: Column, low: float, high: float, bits: int = 16) -> Column:
    """A coordinate as a grid number of so many bits."""
    top = (1 << bits) - 1
    return F.least(F.greatest(F.floor((value.cast("double") - low) / max(high - low, 1e-300) * top), F.lit(0)), F.lit(top)).cast("bigint")
