"""Type table: SQL names to Spark types, built-in fill values, domain limits, fill literals."""

from __future__ import annotations

import math
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: SQL type name -> (signed Spark type, unsigned Spark type or None).
SQL_TYPES: dict[str, tuple[str, str | None]] = {
    "TINYINT": ("tinyint", "smallint"),
    "BOOL": ("boolean", None),
    "BOOLEAN": ("boolean", None),
    "SMALLINT": ("smallint", "int"),
    "MEDIUMINT": ("int", "bigint"),
    "INT": ("int", "bigint"),
    "INTEGER": ("int", "bigint"),
    "BIGINT": ("bigint", "decimal(20,0)"),
    "FLOAT": ("float", None),
    "DOUBLE": ("double", None),
    "BIT": ("smallint", None),
    "CHAR": ("string", None),
    "VARCHAR": ("string", None),
    "SET": ("string", None),
    "TEXT": ("string", None),
    "TINYTEXT": ("string", None),
    "MEDIUMTEXT": ("string", None),
    "LONGTEXT": ("string", None),
    "BLOB": ("binary", None),
    "TINYBLOB": ("binary", None),
    "MEDIUMBLOB": ("binary", None),
    "LONGBLOB": ("binary", None),
    "GEOMETRY": ("binary", None),
    "ENUM": ("string", None),
    "DATE": ("date", None),
    "DATETIME": ("timestamp_ntz", None),
    "TIMESTAMP": ("timestamp_ntz", None),
    "TIME": ("bigint", None),
    "YEAR": ("int", None),
}
#: Highest values of the unsigned types, by the SQL name.
UNSIGNED_TOP = {"TINYINT": 2**8 - 1, "SMALLINT": 2**16 - 1, "MEDIUMINT": 2**24 - 1, "INT": 2**32 - 1, "INTEGER": 2**32 - 1, "BIGINT": 2**64 - 1}
_LIMITS = {"tinyint": 2**7, "smallint": 2**15, "int": 2**31, "bigint": 2**63}
_SQL = re.compile(r"\s*([A-Za-z]+)\s*(\(\s*\d+\s*(?:,\s*\d+\s*)?\))?\s*(UNSIGNED)?\s*", re.I)


def parse_sql_type(text: str) -> tuple[str, str, bool]:
    """(base name, Spark type, unsigned) of a SQL type such as ``INT UNSIGNED`` or ``DECIMAL(10,2)``."""
    m = _SQL.fullmatch(text)
    base = m[1].upper() if m else ""
    if m and base in ("DECIMAL", "NUMERIC"):
        return base, f"decimal{(m[2] or '(10,0)').replace(' ', '')}", False
    if not m or base not in SQL_TYPES:
        raise ValueError(f"unknown SQL type: {text}")
    signed, unsigned = SQL_TYPES[base]
    if m[3]:
        if unsigned is None:
            raise ValueError(f"{base} has no unsigned form")
        return base, unsigned, True
    return base, signed, False


def spark_type(text: str) -> T.DataType:
    """The Spark type of a DDL string; ``array<...>`` holds multi-value attributes."""
    return T.StructType.fromDDL(f"c {text}")[0].dataType


def limits(kind: str, unsigned_base: str | None = None) -> tuple[Any, Any]:
    """Least and greatest value that a dimension of this type may have; None where there is no limit."""
    if unsigned_base:
        return 0, UNSIGNED_TOP[unsigned_base]
    if kind in _LIMITS:
        return -_LIMITS[kind], _LIMITS[kind] - 1
    if kind in ("float", "double"):
        return -math.inf, math.inf
    return None, None


def builtin_fill(kind: str, unsigned_base: str | None = None) -> Any:
    """The value that an unwritten cell shows where none was declared: integers their least value (unsigned their
    greatest), floats NaN, booleans false, strings and binaries a zero byte; dates and times have none (null)."""
    if unsigned_base:
        return UNSIGNED_TOP[unsigned_base]
    if kind in _LIMITS:
        return -_LIMITS[kind]
    if kind in ("float", "double"):
        return math.nan
    return {"boolean": False, "string": "\0", "binary": b"\0"}.get(kind)


def fill_column(value: Any, kind: str) -> Column:
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(value, float) and math.isnan(value):
        return F.lit("NaN").cast(kind)
    if kind == "binary":
        return F.unhex(F.lit((value.encode() if isinstance(value, str) else value).hex()))
    if isinstance(value, int) and not isinstance(value, bool):
        return F.lit(str(value)).cast(kind)  # by text: a literal holds no more than a signed 64-bit number
    return F.lit(value).cast(kind)


def fill_literal(value: Any, kind: str) -> str:
    """How a fill value reads in DDL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        return "0.0" if math.isnan(value) else repr(value)
    if isinstance(value, bytes):
        value = value.decode("latin-1")
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "''").replace("\0", "\\0") + "'"
    return str(value)


def clamp_unsigned(value: Column, base: str, strict: bool = True) -> Column:
    """Out-of-range values raise, or (not strict) go to the nearest limit."""
    top = UNSIGNED_TOP[base]
    wide = value.cast("decimal(38,0)")
    if strict:
        message = F.concat(F.lit(f"out of range for {base} UNSIGNED: "), value.cast("string"))
        return F.when((wide < 0) | (wide > F.lit(str(top)).cast("decimal(38,0)")), F.raise_error(message)).otherwise(value)
    return F.greatest(F.least(wide, F.lit(str(top)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
