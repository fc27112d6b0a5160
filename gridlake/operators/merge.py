"""Fragment merge: which version of a cell is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_write_wins(cells: DataFrame, dims: list[str], order: list[str | Column], keep: list[str] | None = None) -> DataFrame:
    """The latest cell of each coordinate by ``order`` (ascending; ties are settled by the later columns).

    Values travel in one struct, so a null that was written last stays null.  A struct buffer cannot be hashed, so the
    aggregate sorts, on both sides of the one exchange, and combines before it; filters on dimensions pass below it and
    filters on attributes do not.
    """
    columns = keep if keep is not None else [c for c in cells.columns if c not in dims]
    if not columns:
        return cells.select(*dims).distinct()
    own = [F.col(x) if isinstance(x, str) else x for x in order]
    latest = F.max_by(F.struct(*columns), F.struct(*[x.alias(f"o{i}") for i, x in enumerate(own)])).alias("__cell")
    return cells.groupBy(*dims).agg(latest).select(*dims, *[F.col("__cell")[c].alias(c) for c in columns])
