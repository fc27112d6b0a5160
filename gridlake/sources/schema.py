"""Array schemas: dimensions, attributes, enumerations; JSON and DDL forms."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from gridlake.functions import types as K

ARRAY_TYPES, CELL_ORDERS, TILE_ORDERS = ("SPARSE", "DENSE"), ("ROW_MAJOR", "COLUMN_MAJOR", "HILBERT"), ("ROW_MAJOR", "COLUMN_MAJOR")
CODECS = {"GZIP": "gzip", "ZSTD": "zstd", "LZ4": "lz4", "BZIP2": "gzip"}
#: Hadoop's names of the zlib levels 0 to 9.
ZLIB_LEVELS = ("NO_COMPRESSION", "BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION")
FILTERS = {*CODECS, "NONE", "RLE", "BIT_WIDTH_REDUCTION", "POSITIVE_DELTA", "DOUBLE_DELTA", "BITSHUFFLE", "BYTESHUFFLE", "CHECKSUM_MD5", "CHECKSUM_SHA256", "DICTIONARY", "SCALE_FLOAT", "WEBP", "XOR", "DELTA"}


class SchemaError(ValueError):
    """The schema or a change of it is not allowed."""


def parse_filters(text: str | None) -> list[tuple[str, str | None]]:
    """``NAME=argument,NAME`` as pairs."""
    out = []
    for part in filter(None, (p.strip() for p in (text or "").split(","))):
        name, _, value = part.partition("=")
        if name.strip().upper() not in FILTERS:
            raise SchemaError(f"unknown filter: {name}")
        out.append((name.strip().upper(), value.strip() or None))
    return out


@dataclass(frozen=True)
class Dimension:
    """A coordinate column, never null.  Strings have no domain; other types need an extent."""

    name: str
    type: str
    lower: Any = None
    upper: Any = None
    extent: Any = None
    filters: str | None = None

    @property
    def parsed(self) -> tuple[str, str, bool]:
        return K.parse_sql_type(self.type)

    @property
    def kind(self) -> str:
        return self.parsed[1]

    def bounds(self) -> tuple[Any, Any]:
        """The domain: the type's least value and its greatest less one extent where none is given."""
        base, kind, unsigned = self.parsed
        low, high = K.limits(kind, base if unsigned else None)
        if high is not None and self.extent is not None and kind not in ("float", "double"):
            high -= self.extent
        return (low if self.lower is None else self.lower), (high if self.upper is None else self.upper)

    def check(self, dense: bool) -> None:
        if self.kind in ("binary", "boolean") or self.parsed[0] == "ENUM":
            raise SchemaError(f"{self.name}: {self.type} cannot be a dimension")
        if dense and self.kind not in ("tinyint", "smallint", "int", "bigint", "decimal(20,0)", "date"):
            raise SchemaError(f"{self.name}: dense arrays need whole-number, date or time-of-day dimensions")
        if self.kind == "string":
            if self.lower is not None or self.upper is not None or self.extent is not None:
                raise SchemaError(f"{self.name}: string dimensions have no domain")
        elif self.extent is None:
            raise SchemaError(f"{self.name}: the tile extent is missing")


@dataclass(frozen=True)
class Attribute:
    """A value column.  ``labels``: an enumeration; ``size`` over 1: a fixed-length multi-value cell."""

    name: str
    type: str
    nullable: bool = True
    default: Any = None
    has_default: bool = False
    filters: str | None = None
    labels: tuple[str, ...] | None = None
    size: int = 1
    since: int = 0  # schema version that added it; part of the stored column's name

    @property
    def kind(self) -> str:
        if self.labels is not None:
            return "bigint"
        kind = K.parse_sql_type(self.type)[1]
        return f"array<{kind}>" if self.size > 1 else kind

    @property
    def stored(self) -> str:
        return f"{self.name}__v{self.since}"

    @property
    def fill(self) -> Any:
        if self.has_default:
            return self.default
        if self.nullable:
            return None
        base, kind, unsigned = ("ENUM", "bigint", False) if self.labels is not None else K.parse_sql_type(self.type)
        return K.builtin_fill(kind, base if unsigned else None)


@dataclass(frozen=True)
class ArraySchema:
    dimensions: tuple[Dimension, ...]
    attributes: tuple[Attribute, ...]
    array_type: str = "SPARSE"
    allows_dups: bool = False
    cell_order: str = "ROW_MAJOR"
    tile_order: str = "ROW_MAJOR"
    capacity: int = 10_000
    coordinate_filters: str | None = None
    offset_filters: str | None = None
    validity_filters: str | None = None
    encrypted: bool = False
    version: int = 0

    def __post_init__(self) -> None:
        names = [c.name.lower() for c in (*self.dimensions, *self.attributes)]
        if not self.dimensions:
            raise SchemaError("an array needs a dimension")
        if len(set(names)) != len(names):
            raise SchemaError("column names must differ")
        if any(n.startswith("__") for n in names):
            raise SchemaError("names that begin with __ are reserved")
        for value, known in ((self.array_type, ARRAY_TYPES), (self.cell_order, CELL_ORDERS), (self.tile_order, TILE_ORDERS)):
            if value not in known:
                raise SchemaError(f"{value} is none of {known}")
        if self.dense and self.allows_dups:
            raise SchemaError("dense arrays hold one value a cell")
        if self.dense and self.cell_order == "HILBERT":
            raise SchemaError("dense arrays have no Hilbert order")
        for d in self.dimensions:
            d.check(self.dense)
        for text in (self.coordinate_filters, self.offset_filters, self.validity_filters, *(c.filters for c in (*self.dimensions, *self.attributes))):
            parse_filters(text)

    @property
    def dense(self) -> bool:
        return self.array_type == "DENSE"

    @property
    def dims(self) -> list[str]:
        return [d.name for d in self.dimensions]

    @property
    def attrs(self) -> list[str]:
        return [a.name for a in self.attributes]

    @property
    def columns(self) -> list[str]:
        return [*self.dims, *self.attrs]

    def dimension(self, name: str) -> Dimension:
        return next(d for d in self.dimensions if d.name == name)

    def attribute(self, name: str) -> Attribute:
        return next(a for a in self.attributes if a.name == name)

    def struct(self) -> T.StructType:
        """The schema that readers see, with roles and domains as field metadata."""
        out = T.StructType()
        for d in self.dimensions:
            low, high = d.bounds()
            out.add(T.StructField(d.name, K.spark_type(d.kind), False, {"role": "dimension", "lower": str(low), "upper": str(high), "extent": str(d.extent)}))
        for a in self.attributes:
            kind = T.StringType() if a.labels is not None else K.spark_type(a.kind)
            out.add(T.StructField(a.name, kind, a.nullable, {"role": "attribute", "fill": repr(a.fill), "filters": a.filters or "", "labels": list(a.labels or ())}))
        return out

    def codec(self) -> tuple[str, str | None]:
        """The Parquet codec of the array and its level: the first compressing filter that is named, as a Parquet
        writer has one codec for all columns."""
        for text in (self.coordinate_filters, *(c.filters for c in (*self.attributes, *self.dimensions)), self.offset_filters):
            for name, level in parse_filters(text):
                if name in CODECS:
                    return CODECS[name], level
        return "zstd", None

    def write_options(self) -> dict[str, str]:
        """Parquet options from the filters: codec and level for the array, encodings for each column.

        DICTIONARY and RLE keep a column's dictionary (runs of its numbers are run-length coded), NONE and the delta,
        bit and byte filters leave it out, as what follows them is plain or packed values.  Columns without filters
        have Parquet's own choice.
        """
        name, level = self.codec()
        out = {"compression": name}
        if level is not None and name == "zstd" and 1 <= int(level) <= 22:
            out["parquet.compression.codec.zstd.level"] = level
        elif level is not None and name == "gzip" and 0 <= int(level) <= 9:
            out["zlib.compress.level"] = ZLIB_LEVELS[int(level)]
        for column, text in [*((d.name, d.filters) for d in self.dimensions), *((a.stored, a.filters) for a in self.attributes)]:
            kinds = {k for k, _ in parse_filters(text)} - set(CODECS)
            if kinds:
                out[f"parquet.enable.dictionary#{column}"] = str(bool(kinds & {"DICTIONARY", "RLE"})).lower()
        return out

    def evolve(self, add: list[Attribute] = [], drop: list[str] = []) -> ArraySchema:  # noqa: B006
        """Drop, then add attributes; both may come in one change."""
        for name in drop:
            if name in self.dims:
                raise SchemaError(f"{name} is a dimension and cannot be dropped")
            if name not in self.attrs:
                raise SchemaError(f"no attribute {name}")
        version = self.version + 1
        kept = [a for a in self.attributes if a.name not in drop]
        return replace(self, attributes=(*kept, *(replace(a, since=version) for a in add)), version=version)

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=str)

    @staticmethod
    def from_json(text: str) -> ArraySchema:
        raw = json.loads(text)
        dims = tuple(Dimension(**d) for d in raw.pop("dimensions"))
        attrs = tuple(Attribute(**(a | {"labels": None if a["labels"] is None else tuple(a["labels"])})) for a in raw.pop("attributes"))
        return ArraySchema(dims, attrs, **raw)

    def ddl(self, name: str, uri: str | None = None, open_at: int | None = None) -> str:
        """CREATE TABLE text from which ``parse_ddl`` makes an equal schema."""
        lines = []
        for d in self.dimensions:
            options = "".join(f" {k}='{v}'" for k, v in (("lower_bound", d.lower), ("upper_bound", d.upper), ("tile_extent", d.extent), ("filters", d.filters)) if v is not None)
            lines.append(f"`{d.name}` {d.type} NOT NULL dimension=1{options}")
        for a in self.attributes:
            kind = f"ENUM({','.join(K.fill_literal(x, 'string') for x in a.labels)})" if a.labels is not None else a.type
            lines.append(f"`{a.name}` {kind}" + (f" cell_val_num={a.size}" if a.size > 1 else "") + (" NULL" if a.nullable else " NOT NULL") + (f" DEFAULT {K.fill_literal(a.default, a.kind)}" if a.has_default else "") + (f" filters='{a.filters}'" if a.filters else ""))
        keys = ",".join(f"`{d}`" for d in self.dims)
        lines.append(f"INDEX ({keys})" if self.allows_dups else f"PRIMARY KEY ({keys})")
        options = {"array_type": self.array_type, "cell_order": self.cell_order, "tile_order": self.tile_order, "capacity": self.capacity, "coordinate_filters": self.coordinate_filters, "offset_filters": self.offset_filters, "validity_filters": self.validity_filters, "uri": uri, "open_at": open_at}
        return f"CREATE TABLE `{name}` (\n  " + ",\n  ".join(lines) + "\n)" + "".join(f" {k}='{v}'" for k, v in options.items() if v is not None)


def _split(text: str) -> list[str]:
    """Parts between commas outside brackets and quotes."""
    out, depth, quoted, at = [], 0, False, 0
    for i, c in enumerate(text):
        if c == "'" and text[i - 1] != "\\":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 0:
                out.append(text[at:i].strip())
                at = i + 1
    return [*out, text[at:].strip()]


def _value(text: str, kind: str) -> Any:
    if text.upper() == "NULL":
        return None
    if text.startswith("'"):
        text = text[1:-1].replace("\\0", "\0").replace("''", "'").replace("\\\\", "\\")
    if kind in ("float", "double"):
        return float(text)
    if kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        return int(float(text)) if "." in text else int(text)
    return text


_OPTION = re.compile(r"\b(dimension|lower_bound|upper_bound|tile_extent|filters|cell_val_num)\s*=\s*('(?:[^']*)'|[^\s,]+)", re.I)


def parse_ddl(text: str) -> tuple[str, ArraySchema, dict[str, str]]:
    """Table name, schema and remaining options of a CREATE TABLE statement."""
    m = re.match(r"\s*CREATE\s+TABLE\s+`?([^`\s(]+)`?\s*\((.*)\)([^)]*)$", text, re.I | re.S)
    if not m:
        raise SchemaError("not a CREATE TABLE statement")
    options = {k.lower(): v.strip("'\"") for k, v in re.findall(r"(\w+)\s*=\s*('[^']*'|\"[^\"]*\"|\S+)", m[3])}
    raw, keys, unique = [], [], None
    for part in _split(m[2]):
        if k := re.match(r"(PRIMARY\s+KEY|INDEX|KEY)\s*\w*\s*\(([^)]*)\)", part, re.I):
            keys, unique = [x.strip(" `") for x in k[2].split(",")], k[1].upper().startswith("PRIMARY")
            continue
        own = {k.lower(): v.strip("'") for k, v in _OPTION.findall(part)}
        part = _OPTION.sub(" ", part).strip()
        n = re.match(r"`?(\w+)`?\s+(ENUM\s*\((.*?)\)|\w+\s*(?:\([^)]*\))?(?:\s+UNSIGNED)?)(.*)$", part, re.I | re.S)
        if not n:
            raise SchemaError(f"cannot read column: {part}")
        raw.append((n[1], n[2].strip(), n[3], n[4], own))
    if re.search(r"PRIMARY\s+KEY", " ".join(r[3] for r in raw), re.I):
        unique, keys = True, [r[0] for r in raw if re.search(r"PRIMARY\s+KEY", r[3], re.I)]
    dims, attrs = [], []
    for name, kind, labels, rest, own in raw:
        if own.get("dimension") in ("1", "true") or name in keys:
            spark = K.parse_sql_type(kind)[1]
            number = lambda k, spark=spark, own=own: _value(own[k], spark) if k in own else None
            dims.append(Dimension(name, kind, number("lower_bound"), number("upper_bound"), number("tile_extent"), own.get("filters")))
        else:
            default = re.search(r"DEFAULT\s+('(?:[^']|'')*'|\S+)", rest, re.I)
            enum = tuple(_value(x, "string") for x in _split(labels)) if labels is not None else None
            spark = "string" if enum else K.parse_sql_type(kind)[1]
            attrs.append(Attribute(name, "ENUM" if enum else kind, not re.search(r"NOT\s+NULL", rest, re.I), _value(default[1], spark) if default else None, bool(default), own.get("filters"), enum, int(own.get("cell_val_num", 1))))
    if keys:
        order = {k: i for i, k in enumerate(keys)}
        dims.sort(key=lambda d: order.get(d.name, len(order)))
    dense = options.pop("array_type", "SPARSE").upper()
    known = {k: options.pop(k) for k in ("cell_order", "tile_order", "coordinate_filters", "offset_filters", "validity_filters") if k in options}
    known |= {k: known[k].upper() for k in ("cell_order", "tile_order") if k in known}
    if "capacity" in options:
        known["capacity"] = int(options.pop("capacity"))
    dups = dense != "DENSE" and unique is not True
    return m[1], ArraySchema(tuple(dims), tuple(attrs), dense, dups, encrypted="encryption_key" in options, **known), options
