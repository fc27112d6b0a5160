"""Key access: point, prefix and neighbour lookups on dimensions, and joins by key."""

from __future__ import annotations

import math
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(dims: list[str], key: tuple) -> Column:
    return reduce(lambda a, b: a & b, [F.col(d) == v for d, v in zip(dims, key, strict=False)], F.lit(True))


def _before(dims: list[str], key: tuple, strict: bool, after: bool) -> Column:
    """Lexicographic comparison of the leading dimensions with a key."""
    out = F.lit(not strict)
    for d, v in reversed(list(zip(dims, key, strict=False))):
        c = F.col(d)
        out = ((c > v) if after else (c < v)) | ((c == v) & out)
    return out


def find(cells: DataFrame, dims: list[str], key: tuple, flag: str = "EXACT") -> DataFrame:
    """Cells by key, as an index would give them.

    EXACT and PREFIX: all that match the key's parts; KEY_OR_NEXT, AFTER_KEY: all from (behind) it in key order;
    KEY_OR_PREV, BEFORE_KEY: all up to (before) it; PREFIX_LAST: matches in falling order.
    """
    if flag in ("EXACT", "PREFIX"):
        return cells.where(_same(dims, key)).orderBy(*dims)
    if flag == "PREFIX_LAST":
        return cells.where(_same(dims, key)).orderBy(*[F.col(d).desc() for d in dims])
    if flag in ("KEY_OR_NEXT", "AFTER_KEY"):
        return cells.where(_before(dims, key, flag == "AFTER_KEY", True)).orderBy(*dims)
    if flag in ("KEY_OR_PREV", "BEFORE_KEY"):
        return cells.where(_before(dims, key, flag == "BEFORE_KEY", False)).orderBy(*[F.col(d).desc() for d in dims])
    raise ValueError(f"unknown flag: {flag}")


#: Bits of a key filter: so many a key, and at most so many in all (2^19 words, which are broadcast with their numbers).
KEY_BITS, MOST_BITS = 16, 2**25


def bounding_ranges(keys: DataFrame, dims: list[str]) -> dict[str, tuple[Any, Any]]:
    """Least and greatest of each key column: two numbers a dimension, whatever the number of keys."""
    return _bounds(keys, dims)[0]


def _bounds(keys: DataFrame, dims: list[str]) -> tuple[dict[str, tuple[Any, Any]], int]:
    """The bounding ranges and the number of keys, in one pass."""
    row = keys.agg(*[f(d) for d in dims for f in (F.min, F.max)], F.count(F.lit(1))).collect()[0]
    return {d: (row[2 * i], row[2 * i + 1]) for i, d in enumerate(dims)}, row[2 * len(dims)]


def among_hashes(cells: DataFrame, keys: DataFrame, dims: list[str], count: int) -> DataFrame:
    """The cells but for most that no key meets: those whose hash is none of the keys' hashes.

    The hashes are bits of a bounded number of words, so that the broadcast is bounded; a cell that is kept by chance
    is left to the join.  The semi-join only asks for dimensions, so that Catalyst moves it below the merge of versions.
    """
    size = 64 * 2 ** max(0, math.ceil(math.log2(min(KEY_BITS * count, MOST_BITS) / 64)))
    place = F.pmod(F.xxhash64(*dims), F.lit(size).cast("bigint"))
    word, bit = F.call_function("div", place, F.lit(64).cast("bigint")), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int"))
    words = keys.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    return cells.join(F.broadcast(words), (word == F.col("__word")) & (bit.bitwiseAND(F.col("__bits")) != 0), "left_semi")


def batched_key_join(cells: DataFrame, keys: DataFrame, dims: list[str], ranges: bool = True) -> DataFrame:
    """Join by all key columns.  With ``ranges``, the keys' bounds and a filter of their hashes go to the scan of the
    cells first, so that most cells without a key are neither merged nor shuffled; the join strategy stays Catalyst's.
    The keys are read for the bounds, for the filter and for the join: they must be the same each time."""
    if ranges:
        bounds, count = _bounds(keys, dims)
        cells = cells.where(reduce(lambda a, b: a & b, [F.col(d).between(*bounds[d]) if bounds[d][0] is not None else F.lit(False) for d in dims]))
        same = all(cells.schema[d].dataType == keys.schema[d].dataType for d in dims)  # else equal values may differ in hash
        if same and 0 < count <= MOST_BITS // 2:
            cells = among_hashes(cells, keys, dims, count)
    return cells.join(keys, dims)
