"""Subarrays: ranges per dimension as Catalyst predicates, and the tile predicates that follow from them."""

from __future__ import annotations

import math
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A slice of a dimension: a value, (low, high) with None for open ends, or a list of values and ranges.
Slice = Any


def _ranges(given: Slice) -> list[tuple[Any, Any]]:
    if isinstance(given, tuple):
        if len(given) != 2:
            raise ValueError("a range is (low, high)")
        return [given]
    if isinstance(given, (list, set, frozenset)):
        return [r for x in given for r in (_ranges(x) if isinstance(x, tuple) else [(x, x)])]
    return [(given, given)]


def predicate(column: Column, given: Slice) -> Column:
    """True where the coordinate lies in the slice.  Points become one IN list; contradictions are simply empty."""
    ranges = _ranges(given)
    points = [a for a, b in ranges if a is not None and a == b]
    parts: list[Column] = []
    if points:
        parts.append(column == points[0] if len(points) == 1 else column.isin(points))
    for low, high in ranges:
        if low is not None and low == high:
            continue
        ends = ([column >= low] if low is not None else []) + ([column <= high] if high is not None else [])
        parts.append(reduce(lambda a, b: a & b, ends) if ends else column.isNotNull())
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def tile_of(value: float, lower: float, extent: float) -> int:
    return math.floor((value - lower) / extent)


def tile_predicate(tile: Column, given: Slice, lower: float, extent: float) -> Column | None:
    """The slice in terms of tile numbers; None if it says nothing about them."""
    moved = []
    for low, high in _ranges(given):
        if low is None and high is None:
            return None
        a = None if low is None or low == -math.inf else tile_of(low, lower, extent)
        b = None if high is None or high == math.inf else tile_of(high, lower, extent)
        if a is None and b is None:
            return None
        moved.append((a, b))
    return predicate(tile, moved)


def overlaps(given: Slice, low: Any, high: Any) -> bool:
    """Whether a fragment whose coordinates span [low, high] can hold cells of the slice."""
    if low is None or high is None:
        return True
    try:
        return any((a is None or a <= high) and (b is None or b >= low) for a, b in _ranges(given))
    except TypeError:
        return True


def subarray(dims: dict[str, Slice]) -> Column:
    """The hyper-rectangle (or product of range lists) of all given slices."""
    return reduce(lambda a, b: a & b, [predicate(F.col(d), s) for d, s in dims.items()], F.lit(True))


def any_tuple(columns: list[str], tuples: list[tuple]) -> Column:
    """``(a, b) IN ((...), ...)``."""
    if not tuples:
        return F.lit(False)
    first = F.col(columns[0]).isin(sorted({t[0] for t in tuples}))  # what a scan can use
    each = [reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(columns, t, strict=True)]) for t in tuples]
    return first & reduce(lambda a, b: a | b, each)
