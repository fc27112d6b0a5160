"""Conversions of single values: enumerations, multi-value cells, metadata text, strings in other character sets."""

from __future__ import annotations

import struct
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def enum_label(code: Column, labels: list[str]) -> Column:
    """The label of a zero-based code; null for null or a code without label."""
    return F.when((code >= 0) & (code < len(labels)), F.element_at(F.array(*[F.lit(x) for x in labels]), (code + 1).cast("int")))


def enum_code(label: Column, labels: list[str]) -> Column:
    """The zero-based code of a label; null if it has none."""
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), label)
    return F.when(place > 0, place - 1)


def enum_equals(code: Column, label: str, labels: list[str]) -> Column:
    """``column = 'label'`` as a comparison of codes, which reaches the scan."""
    return code == labels.index(label) if label in labels else F.lit(False)


_PACK = {"tinyint": "b", "smallint": "h", "int": "i", "bigint": "q", "float": "f", "double": "d"}


def value_bytes(values: list[Any], kind: str) -> bytes:
    """Little-endian bytes of a fixed-length multi-value cell."""
    return struct.pack(f"<{len(values)}{_PACK[kind]}", *values)


def int_bytes(values: Column, kind: str = "int") -> Column:
    """Little-endian bytes of an array of integers, as a column expression."""
    width = {"tinyint": 2, "smallint": 4, "int": 8, "bigint": 16}[kind]

    def one(x: Column) -> Column:
        digits = F.substring(F.lpad(F.hex(x.cast("bigint")), 16, "0"), 17 - width, width)
        return F.concat(*[F.substring(digits, i, 2) for i in range(width - 1, 0, -2)])

    return F.unhex(F.array_join(F.transform(values, one), ""))


def byte_at(data: Column, position: int) -> Column:
    """The unsigned byte at a one-based position of a binary."""
    return F.conv(F.hex(F.substring(data, position, 1)), 16, 10).cast("int")


def metadata_text(value: Any) -> str:
    """How a metadata value reads: numbers joined by commas, text as it is."""
    if isinstance(value, bytes):
        return value.decode("latin-1")
    if isinstance(value, (list, tuple)):
        return ",".join(metadata_text(v) for v in value)
    if isinstance(value, bool):
        return str(int(value))
    return value if isinstance(value, str) else str(value)


def decode_text(data: Column, charset: str) -> Column:
    """A binary in ``utf8``, ``latin1``, ``utf16``, ``utf32`` or ``ucs2`` as a string."""
    names = {"utf8": "UTF-8", "latin1": "ISO-8859-1", "utf16": "UTF-16", "ucs2": "UTF-16BE", "utf32": "UTF-32"}
    return F.decode(data, names[charset.lower()])
