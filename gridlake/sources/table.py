"""Array tables: timestamped Parquet fragments read with merge, fill, time-travel and slicing semantics.

Layout of an array's folder:

* ``__schema/<version>.json``            schema versions
* ``__fragments/__frag=<ts>_<id>/...``   Parquet files of one write, with tile folders where they are few
* ``__commits/<ts>_<id>.json``           manifest of a fragment; a fragment without it is not read, nor one that a
  manifest names in ``replaces``
* ``__rollup/<n>.json``                  the first n manifests in one file, so that opening reads few
* ``__vacuum/<from>_<to>.json``          times between which vacuuming removed history
* ``__meta/<ts>_<id>.json``              key/value metadata
"""

from __future__ import annotations

import datetime
import json
import math
import time
import uuid
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.functions import types as K
from gridlake.functions import values
from gridlake.operators import dense as D
from gridlake.operators import lookup, merge, ordering, slicing
from gridlake.session import Options
from gridlake.sources.schema import ArraySchema, Attribute, SchemaError
from gridlake.sources.store import Store

#: Folders that a write makes at most for the tiles of the first dimension; neighbouring tiles share one beyond that.
MAX_TILE_FOLDERS = 256
#: The fragment that a cell was first written in (of compacted ones: null elsewhere), and its place there, which settles
#: repeats within a write and is stored in fragments only that may hold some (none that are written now).
FRAGMENT, SEQUENCE, ORIGIN = "__frag", "__seq", "__origin"
#: Manifests after which another roll-up is written.
ROLL_UP = 16
_WHOLE = ("tinyint", "smallint", "int", "bigint")
_JSON = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
DEFAULT_RECORDS = 100_000


class ArrayTable:
    """One array.  ``open_at``: milliseconds as of which it is read; ``columns``: a subset, or {name: type} re-typed."""

    def __init__(self, spark: SparkSession, path: str, open_at: int | None = None, columns: list[str] | dict[str, str] | None = None, key: str | None = None, options: Options | None = None):
        self.spark, self.path, self.open_at, self.options = spark, path.rstrip("/"), open_at, options or Options()
        self.store, self.key, self.subset = Store(spark, self.path), key, columns
        if not self.store.names("__schema"):
            raise FileNotFoundError(f"no array at {path}")
        if self.schema.encrypted and not (key and len(key.encode()) == 32):
            raise PermissionError("the array is encrypted: a key of 32 bytes is needed")
        self._pinned = None if self.options.reopen_for_every_query else self._commits()

    # -- creation, schema -----------------------------------------------------------------------------------------

    @staticmethod
    def create(spark: SparkSession, path: str, schema: ArraySchema) -> None:
        store = Store(spark, path)
        if store.names("__schema"):
            raise FileExistsError(path)
        store.write(schema.to_json(), "__schema", f"{schema.version:08d}.json")

    @property
    def schema(self) -> ArraySchema:
        return ArraySchema.from_json(self.store.read_fixed("__schema", self.store.names("__schema")[-1]))

    def alter(self, add: list[Attribute] = [], drop: list[str] = []) -> None:  # noqa: B006
        """Add and drop attributes; old fragments show null (or the fill, if not nullable) in new ones."""
        schema = self.schema.evolve(add, drop)
        self.store.write(schema.to_json(), "__schema", f"{schema.version:08d}.json")

    def ddl(self, name: str) -> str:
        return self.schema.ddl(name, self.path, self.open_at)

    # -- fragments -------------------------------------------------------------------------------------------------

    def _commits(self) -> list[dict]:
        """The visible manifests.  They never change, so roll-ups and this process keep what was read once."""
        names = self.store.names("__commits")
        rolled = self.store.names("__rollup")
        known = json.loads(self.store.read_fixed("__rollup", rolled[-1])) if rolled else {}
        if self.open_at is not None:
            for low, high in (map(int, n.removesuffix(".json").split("_")) for n in self.store.names("__vacuum")):
                if low <= self.open_at < high:
                    raise ValueError(f"vacuuming removed the history from {low} to {high}")
            names = [n for n in names if int(n.partition("_")[0]) <= self.open_at]
        out = [known.get(n) or json.loads(self.store.read_fixed("__commits", n)) for n in names]
        replaced = {x for m in out for x in m.get("replaces", ())}
        return [m for m in out if m["id"] not in replaced]

    def _roll_up(self) -> None:
        """Put all manifests in one file when many are not in one yet.  It only saves reading: losing it is harmless."""
        names, rolled = self.store.names("__commits"), self.store.names("__rollup")
        known = json.loads(self.store.read_fixed("__rollup", rolled[-1])) if rolled else {}
        if sum(n not in known for n in names) >= ROLL_UP:
            every = {n: known.get(n) or json.loads(self.store.read_fixed("__commits", n)) for n in names}
            self.store.write(json.dumps(every), "__rollup", f"{len(names):012d}_{uuid.uuid4().hex[:8]}.json")

    def fragments(self) -> list[dict]:
        """Manifests of the fragments that a read sees, oldest first."""
        return self._commits() if self._pinned is None else self._pinned

    def records(self) -> int:
        """Cells by the manifests, or the default guess if counting is off."""
        return sum(f["rows"] for f in self.fragments()) if self.options.compute_table_records else DEFAULT_RECORDS

    def non_empty_domain(self) -> dict[str, tuple[Any, Any]] | None:
        """Per dimension the least and greatest written coordinate, from the manifests; None for no cells."""
        found = [f for f in self.fragments() if f["rows"]]
        if not found:
            return None
        return {d.name: (min(self._coordinate(f["domain"][d.name][0], d.kind) for f in found), max(self._coordinate(f["domain"][d.name][1], d.kind) for f in found)) for d in self.schema.dimensions}

    @staticmethod
    def _coordinate(value: Any, kind: str) -> Any:
        """A coordinate as a manifest has it (text) in a form that compares as the dimension does."""
        if kind in _WHOLE:
            return int(value)
        if kind.startswith("decimal"):
            return Decimal(value) if "," in kind and not kind.endswith(",0)") else int(value)
        if kind in ("float", "double"):
            return math.inf if math.isnan(float(value)) else float(value)  # NaN is the greatest of Spark's order
        return value

    def aggregates(self, attrs: list[str] | tuple[str, ...] = ()) -> DataFrame:
        """One row: ``cells``, each dimension's ``<dim>_min`` and ``<dim>_max``, and ``<attr>_count``, ``_min`` and ``_max``
        of the attributes asked for.

        From the manifests, without reading data, where no cell can have two versions and every fragment has measured
        the attributes; else by a scan of these columns, as for encrypted and dense arrays and where
        ``enable_aggregate_pushdown`` is off.
        """
        schema, found = self.schema, [f for f in self.fragments() if f["rows"]]
        asked = [schema.attribute(a) for a in attrs]
        single = schema.allows_dups or not (schema.dense or self._overlapping(schema, found))
        known = all(a.stored in f.get("stats", {}) for f in found for a in asked)
        measured = self.options.enable_aggregate_pushdown and not schema.encrypted and single and known
        if not measured:
            cells = self.slice(columns=[*schema.dims, *attrs]).withColumn("__n", F.lit(1).cast("bigint"))
            sizes = {a: F.count(a) for a in attrs}
        else:
            texts = [[str(f["rows"]), *(x for d in schema.dims for x in f["domain"][d]), *(x for a in asked for x in f["stats"][a.stored])] for f in found]
            names = ["__n", *(f"{d}_{n}" for d in schema.dims for n in ("min", "max")), *(f"{a.name}_{n}" for a in asked for n in ("count", "min", "max"))]
            kinds = {"__n": "bigint"} | {f"{c.name}_{n}": "bigint" if n == "count" else c.kind for c in (*schema.dimensions, *asked) for n in ("count", "min", "max")}
            cells = self.spark.createDataFrame(texts, ", ".join(f"`{n}` string" for n in names)).select(*[F.col(n).cast(kinds[n]).alias(n) for n in names])
            sizes = {a: F.coalesce(F.sum(f"{a}_count"), F.lit(0).cast("bigint")) for a in attrs}
        ends = lambda c: [f(F.col(f"{c}_{n}" if measured else c)).alias(f"{c}_{n}") for n, f in (("min", F.min), ("max", F.max))]
        return cells.agg(F.coalesce(F.sum("__n"), F.lit(0).cast("bigint")).alias("cells"), *[e for d in schema.dims for e in ends(d)], *[e for a in attrs for e in (sizes[a].alias(f"{a}_count"), *ends(a))])

    def find(self, key: tuple, flag: str = "EXACT", dims: list[str] | None = None) -> DataFrame:
        """Cells by key; ``dims``: the key's parts, by default the leading dimensions.  See ``lookup.find``."""
        if not self.options.dimensions_are_keys:
            raise SchemaError("dimensions are not keys in this session")
        names = dims or self.schema.dims
        exact = dict(zip(names, key, strict=False)) if flag in ("EXACT", "PREFIX", "PREFIX_LAST") else {}
        return lookup.find(self.slice(exact), names, key, flag)

    # -- reading ---------------------------------------------------------------------------------------------------

    def _tiled(self, schema: ArraySchema) -> tuple[str, float, float] | None:
        """Name, lower bound and width of the dimension whose tiles (or groups of them) are folders."""
        for d in schema.dimensions:
            low, high = d.bounds()
            if schema.encrypted or not d.extent or d.kind not in (*_WHOLE, "float", "double"):
                continue
            if all(isinstance(x, (int, float)) and abs(x) < 2**62 for x in (low, high)) and (high - low) / d.extent > 1:
                tiles = int((high - low) / d.extent) + 1
                return d.name, low, d.extent * -(-tiles // MAX_TILE_FOLDERS)
        return None

    def _stored(self, schema: ArraySchema) -> T.StructType:
        out = [("__cipher", "binary")] if schema.encrypted else [(d.name, d.kind) for d in schema.dimensions] + [(a.stored, a.kind) for a in schema.attributes]
        out += [(SEQUENCE, "bigint"), (ORIGIN, "string")]
        if (tiled := self._tiled(schema)) is not None:
            out.append((f"__t_{tiled[0]}", "bigint"))
        return T.StructType([T.StructField(n, K.spark_type(k)) for n, k in [*out, (FRAGMENT, "string")]])

    def _empty(self, schema: ArraySchema) -> DataFrame:
        return self.spark.createDataFrame([], self._stored(schema))

    def _overlapping(self, schema: ArraySchema, found: list[dict]) -> list[dict]:
        """The fragments whose domain meets another's: only these can hold two versions of a cell."""
        if any(not f.get("unique") or not f.get("domain") for f in found):
            return found if len(found) > 1 or not all(f.get("unique") for f in found) else []
        boxes = [[tuple(self._coordinate(x, d.kind) for x in f["domain"][d.name]) for d in schema.dimensions] for f in found]
        order = sorted(range(len(found)), key=lambda i: boxes[i][0][0])
        if any(d.kind != "string" and isinstance(x, str) and x[0] in "+-" for b in boxes for d, ends in zip(schema.dimensions, b, strict=True) for x in ends):
            return found  # years outside 0 to 9999, whose text does not sort as they do
        met, active = set(), []
        for i in order:
            active = [j for j in active if boxes[j][0][1] >= boxes[i][0][0]]
            for j in active:
                if all(a[0] <= b[1] and b[0] <= a[1] for a, b in zip(boxes[i], boxes[j], strict=True)):
                    met |= {i, j}
            active.append(i)
        return [found[i] for i in sorted(met)]

    def _selected(self, schema: ArraySchema, dims: dict[str, slicing.Slice]) -> list[dict]:
        """The fragments that can hold some of the slice."""
        known = (*_WHOLE, "float", "double", "string")
        out = []
        for f in self.fragments():
            spans = f.get("domain") or {}
            if f["rows"] and all(slicing.overlaps(s, *(self._coordinate(v, schema.dimension(d).kind) for v in spans[d])) for d, s in dims.items() if spans.get(d) and schema.dimension(d).kind in known):
                out.append(f)
        return out

    def _cells(self, schema: ArraySchema, dims: dict[str, slicing.Slice], found: list[dict]) -> DataFrame:
        """Stored cells of the fragments, within the slice."""
        if not found:
            return self._empty(schema)
        paths = [self.store.at("__fragments", f"{FRAGMENT}={f['id']}") for f in found]
        cells = self.spark.read.option("basePath", self.store.at("__fragments")).schema(self._stored(schema)).parquet(*paths)
        if schema.encrypted:
            inner = T.StructType([T.StructField(d.name, K.spark_type(d.kind)) for d in schema.dimensions] + [T.StructField(a.stored, K.spark_type(a.kind)) for a in schema.attributes])
            plain = F.from_json(F.aes_decrypt(F.col("__cipher"), F.lit(self.key.encode()), F.lit("GCM")).cast("string"), inner, _JSON)
            cells = cells.withColumn("__plain", plain).select("__plain.*", SEQUENCE, ORIGIN, FRAGMENT)
        if dims:
            cells = cells.where(slicing.subarray(dims))
        tiled = self._tiled(schema)
        if tiled is not None and tiled[0] in dims:
            condition = slicing.tile_predicate(F.col(f"__t_{tiled[0]}"), dims[tiled[0]], tiled[1], tiled[2])
            cells = cells if condition is None else cells.where(condition)
        return cells

    def _merged(self, schema: ArraySchema, dims: dict[str, slicing.Slice], found: list[dict], names: list[str]) -> DataFrame:
        """The last version of each cell: what no other fragment meets is read as it is, without exchange or sort.

        Where a few newer cells (``Options.delta_rows`` at most, by the manifests) lie over large fragments that do not
        meet one another, the large ones are read but for the newer coordinates, which are broadcast: fixed-width rows
        of a bounded number.  All others meet in one sort-based aggregate.
        """

        def last(own: list[dict]) -> DataFrame:
            return merge.last_write_wins(self._cells(schema, dims, own).select(*schema.dims, *names, FRAGMENT, SEQUENCE, ORIGIN), schema.dims, self._versions(own), names)

        met = self._overlapping(schema, found)
        alone = [f for f in found if f not in met]
        parts = [self._cells(schema, dims, alone).select(*schema.dims, *names)] if alone or not met else []
        if met:
            newer, held = [], 0
            for f in sorted(met, key=lambda f: f["id"], reverse=True):
                if f.get("replaces") or held + f["rows"] > self.options.delta_rows:
                    break
                newer.append(f)
                held += f["rows"]
            base = [f for f in met if f not in newer]
            fixed = all(d.kind not in ("string", "binary") for d in schema.dimensions)
            if base and newer and fixed and not schema.encrypted and not self._overlapping(schema, base) and all(b["timestamp"] < f["timestamp"] for b in base for f in newer):
                fresh = last(newer) if len(newer) > 1 else self._cells(schema, dims, newer).select(*schema.dims, *names)
                over = self._cells(schema, dims, newer).select(*schema.dims).distinct()
                parts += [self._cells(schema, dims, base).select(*schema.dims, *names).join(F.broadcast(over), schema.dims, "left_anti"), fresh]
            else:
                parts.append(last(met))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @staticmethod
    def _versions(own: list[dict]) -> list[Column]:
        """What the versions of a cell in these fragments are ordered by, as little of it as decides, as it is shuffled
        with every cell: the fragments' times where these differ, else their ids, and the place in a fragment only
        where one may hold repeats."""
        stamps = {f["timestamp"] for f in own}
        if not all(f.get("unique") for f in own):
            return [F.coalesce(ORIGIN, FRAGMENT), F.col(SEQUENCE)]
        if any(f.get("replaces") for f in own) or len(stamps) < len(own) or min(stamps, default=0) < 0:
            return [F.coalesce(ORIGIN, FRAGMENT)]
        return [F.substring(FRAGMENT, 1, 20).cast("bigint")]

    def slice(self, dims: dict[str, slicing.Slice] | None = None, columns: list[str] | None = None, max_cells: int = D.MAX_CELLS) -> DataFrame:
        """Cells of a subarray.  Coordinates are filtered before versions are merged, attributes never are.

        The merge is left out where it cannot matter: duplicates allowed, or fragments that do not meet.  ``max_cells``:
        the size up to which a dense array's grid is built.
        """
        schema, dims = self.schema, dict(dims or {})
        for d in dims:
            if d not in schema.dims:
                raise SchemaError(f"{d} is no dimension")
        wanted = columns if columns is not None else schema.columns
        attrs = [a for a in schema.attributes if a.name in wanted]
        names = [a.stored for a in attrs]
        found = self._selected(schema, dims)
        cells = self._cells(schema, dims, found) if schema.allows_dups else self._merged(schema, dims, found, names)
        cells = cells.select(*schema.dims, *[self._value(a) for a in attrs])
        if schema.dense and (box := self._box(schema, dims)) is not None:
            fills = {a.name: self._fill(a) for a in attrs}
            cells = D.dense_fill(cells, box, fills, max_cells)
            for d, s in dims.items():
                cells = cells.where(slicing.predicate(F.col(d), s))
        cells = cells.select(*wanted)
        if not set(schema.dims) <= set(wanted):
            return cells
        numeric = [d for d in schema.dimensions if d.extent and d.kind in (*_WHOLE, "float", "double") and abs(d.bounds()[0]) < 2**62]
        tiles = [F.floor((F.col(d.name) - F.lit(d.bounds()[0])) / F.lit(d.extent)) for d in numeric]
        return ordering.laid_out(cells, schema.dims, self.options.read_layout, tiles, schema.tile_order == "COLUMN_MAJOR", schema.cell_order == "COLUMN_MAJOR")

    def _value(self, a: Attribute) -> Column:
        stored = F.col(a.stored)
        if a.labels is not None:
            stored = values.enum_label(stored, list(a.labels))
        elif not a.nullable and a.fill is not None and a.size == 1:
            stored = F.coalesce(stored, K.fill_column(a.fill, a.kind))  # a fragment older than the attribute
        return stored.alias(a.name)

    def _fill(self, a: Attribute) -> Column:
        if a.labels is not None or a.size > 1:
            return F.lit(a.default).cast("string") if a.labels is not None else F.lit(None).cast(a.kind)
        return K.fill_column(a.fill, a.kind)

    def _box(self, schema: ArraySchema, dims: dict[str, slicing.Slice]) -> dict[str, tuple[int, int]] | None:
        """The non-empty domain, cut to the slice's outer bounds; dates as days since 1970."""
        domain = self.non_empty_domain()
        if domain is None:
            return None

        def number(value: Any) -> Any:
            if isinstance(value, str):
                value = datetime.date.fromisoformat(value)
            return (value - datetime.date(1970, 1, 1)).days if isinstance(value, datetime.date) else value

        out = {}
        for d, ends in domain.items():
            low, high = map(number, ends)
            if d in dims:
                spans = [tuple(number(x) for x in r) for r in slicing._ranges(dims[d])]
                low = max(low, min((a for a, _ in spans), default=low) if all(a is not None for a, _ in spans) else low)
                high = min(high, max((b for _, b in spans), default=high) if all(b is not None for _, b in spans) else high)
            out[d] = (low, high)
        return out if all(a <= b for a, b in out.values()) else {d: (0, -1) for d in out}

    def df(self) -> DataFrame:
        """All cells, in the subset of columns and types asked for at opening."""
        if self.subset is None:
            return self.slice()
        names = list(self.subset)
        whole = self.slice(columns=names)
        return whole.select(*[F.col(c).cast(self.subset[c]).alias(c) if isinstance(self.subset, dict) else F.col(c) for c in names])

    def view(self, name: str) -> DataFrame:
        df = self.df()
        df.createOrReplaceTempView(name)
        return df

    # -- writing ---------------------------------------------------------------------------------------------------

    def insert(self, rows: DataFrame, timestamp: int | None = None) -> str:
        """Append the rows as one fragment; returns its id.  Missing attributes take their default.

        A null or out-of-domain coordinate, a null in a NOT NULL attribute or an unknown enumeration label fails the
        write, which then leaves nothing that is read.
        """
        schema = self.schema
        unknown = [c for c in rows.columns if c not in schema.columns]
        if unknown or any(d not in rows.columns for d in schema.dims):
            raise SchemaError(f"the rows need {schema.dims} and no other columns than the array's (got {rows.columns})")
        place = [] if schema.allows_dups else [F.monotonically_increasing_id().alias(SEQUENCE)]  # where repeats stay, nothing asks for it
        rows = rows.select(*[self._checked(schema, c, c in rows.columns) for c in schema.columns], *place)
        known = self.store.names("__commits")
        last = int(known[-1].partition("_")[0]) if known else 0
        stamp = timestamp if timestamp is not None else max(int(time.time() * 1000), last + 1)
        return self._write(schema, rows, stamp)

    def _write(self, schema: ArraySchema, rows: DataFrame, stamp: int, replaces: list[str] | None = None) -> str:
        """Write stored cells as one fragment and commit it.  Of several cells of a coordinate the last one stays (if
        duplicates are not allowed), so that every fragment is free of them: equal coordinates lie in one range
        partition side by side, which takes no further exchange."""
        own = f"{stamp:020d}_{len(self.store.names('__commits')):08d}{uuid.uuid4().hex[:12]}"
        watch = Observation(own)
        measured = [F.count(F.lit(1)).alias("rows"), *[f(F.col(d)).cast("string").alias(f"{n}{i}") for i, d in enumerate(schema.dims) for n, f in (("lo", F.min), ("hi", F.max))]]
        plain = [] if schema.encrypted else [a for a in schema.attributes if a.labels is None and a.size == 1 and a.stored in rows.columns and (a.kind in (*_WHOLE, "float", "double", "date", "timestamp_ntz") or a.kind.startswith("decimal"))]
        measured += [f(F.col(a.stored)).cast("string").alias(f"{n}{i}") for i, a in enumerate(plain) for n, f in (("count", F.count), ("least", F.min), ("most", F.max))]
        tiled = self._tiled(schema)
        if tiled is not None:
            name, low, width = tiled
            whole = F.call_function("div", F.col(name).cast("bigint") - F.lit(low), F.lit(width).cast("bigint")) if isinstance(low, int) and isinstance(width, int) else F.floor((F.col(name) - F.lit(low)) / F.lit(width))
            rows = rows.withColumn(f"__t_{name}", whole.cast("bigint"))
        if (curve := self._curve(schema)) is not None and not schema.encrypted:
            rows = rows.withColumn("__h", curve)
        keys = [] if schema.encrypted else [c for c in (f"__t_{tiled[0]}" if tiled else "", "__h") if c in rows.columns]
        keys += schema.dims[::-1] if schema.cell_order == "COLUMN_MAJOR" else schema.dims
        if not schema.encrypted:
            rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, *([] if schema.allows_dups else [F.col(SEQUENCE).desc()]))
        if not schema.allows_dups:
            place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(SEQUENCE).desc()))
            rows = rows.withColumn("__place", place).where("__place = 1").drop("__place", SEQUENCE)
        rows = rows.drop("__h").observe(watch, *measured)  # above the range partitioning, whose sampling reads the rows once more
        if schema.encrypted:
            inner = F.to_json(F.struct(*schema.dims, *[a.stored for a in schema.attributes]), _JSON)
            more = [c for c in (ORIGIN,) if c in rows.columns]
            rows = rows.select(F.aes_encrypt(inner.cast("binary"), F.lit(self.key.encode()), F.lit("GCM")).alias("__cipher"), *more)
        writer = rows.write.options(**schema.write_options())
        if self.options.max_records_per_file:
            writer = writer.option("maxRecordsPerFile", self.options.max_records_per_file)
        if tiled is not None:
            writer = writer.partitionBy(f"__t_{tiled[0]}")
        writer.parquet(self.store.at("__fragments", f"{FRAGMENT}={own}"))
        got = watch.get
        domain = {} if schema.encrypted else {d: [got[f"lo{i}"], got[f"hi{i}"]] for i, d in enumerate(schema.dims)}
        manifest = {"id": own, "timestamp": stamp, "rows": got["rows"], "domain": domain, "schema": schema.version, "unique": not schema.allows_dups}
        manifest["stats"] = {a.stored: [got[f"{n}{i}"] for n in ("count", "least", "most")] for i, a in enumerate(plain)}
        self.store.write(json.dumps(manifest | ({"replaces": replaces} if replaces else {})), "__commits", f"{own}.json")
        self._roll_up()
        return own

    def _curve(self, schema: ArraySchema) -> Column | None:
        """The place of a cell on the Hilbert curve, for two numeric dimensions."""
        if schema.cell_order != "HILBERT" or len(schema.dims) != 2 or not all(d.kind in (*_WHOLE, "float", "double") for d in schema.dimensions):
            return None
        return ordering.hilbert(*[ordering.scaled(F.col(d.name), float(max(d.bounds()[0], -1e300)), float(min(d.bounds()[1], 1e300))) for d in schema.dimensions])

    def _checked(self, schema: ArraySchema, name: str, there: bool) -> Column:
        if name in schema.dims:
            d = schema.dimension(name)
            base, kind, unsigned = d.parsed
            value = F.col(name)
            checked = F.when(value.isNull(), F.raise_error(f"dimension {name} is null").cast(kind))
            if d.kind != "string":
                low, high = d.bounds()
                if low is not None and high is not None:
                    inside = (value >= F.lit(str(low)).cast(kind)) & (value <= F.lit(str(high)).cast(kind)) if low != float("-inf") else value.isNotNull()
                    checked = checked.when(~inside, F.raise_error(F.concat(F.lit(f"dimension {name} is out of its domain: "), value.cast("string"))).cast(kind))
            return checked.otherwise(value.cast(kind)).alias(name)
        a = schema.attribute(name)
        if not there:
            return (values.enum_code(F.lit(a.default), list(a.labels)) if a.labels is not None else self._fill(a)).cast(a.kind).alias(a.stored)
        value = F.col(name)
        if a.labels is not None:
            code = values.enum_code(value, list(a.labels))
            value = F.when(value.isNotNull() & code.isNull(), F.raise_error(F.concat(F.lit(f"{name} has no label "), value)).cast("bigint")).otherwise(code)
        elif a.size > 1:
            value = F.when(F.size(value) != a.size, F.raise_error(f"{name} needs {a.size} values").cast(a.kind)).otherwise(value.cast(a.kind))
        elif K.parse_sql_type(a.type)[2]:
            value = K.clamp_unsigned(value, K.parse_sql_type(a.type)[0]).cast(a.kind)
        else:
            value = value.cast(a.kind)
        if not a.nullable:
            value = F.when(value.isNull(), F.raise_error(f"{name} is null").cast(a.kind)).otherwise(value)
        return value.alias(a.stored)

    def load_csv(self, path: str, delimiter: str = ",", quote: str = '"', header: bool = True, timestamp: int | None = None) -> str | None:
        """Append a CSV file whose columns are the array's, in order; a file without rows adds no fragment."""
        kinds = ", ".join(f"`{c}` {'string' if c in self.schema.attrs and self.schema.attribute(c).labels is not None else (self.schema.dimension(c).kind if c in self.schema.dims else self.schema.attribute(c).kind)}" for c in self.schema.columns)
        rows = self.spark.read.schema(kinds).option("sep", delimiter).option("quote", quote).option("header", header).option("mode", "FAILFAST").csv(path)
        return None if rows.isEmpty() else self.insert(rows, timestamp)

    def compact(self) -> None:
        """Rewrite what is read now as one fragment, whose manifest names those that it replaces: one commit does both.

        It is dated as the newest of these, and each cell keeps the fragment that it was written in, so that writes
        that come in meanwhile win or lose against it as they would have.  The replaced fragments stay for reads as of
        earlier times, until ``vacuum``.
        """
        schema, old = self.schema, self._commits()
        if len(old) < 2 or schema.allows_dups:
            return
        names = [a.stored for a in schema.attributes]
        cells = self._cells(schema, {}, old).withColumn(ORIGIN, F.coalesce(ORIGIN, FRAGMENT))
        merged = merge.last_write_wins(cells.select(*schema.dims, *names, ORIGIN, SEQUENCE), schema.dims, [ORIGIN, SEQUENCE], [*names, ORIGIN, SEQUENCE])
        self._write(schema, merged, max(f["timestamp"] for f in old), [f["id"] for f in old])

    def vacuum(self) -> None:
        """Delete replaced fragments.  Reads as of times before the fragment that replaced them are refused from then
        on; readers that were opened before must have ended."""
        every = [json.loads(self.store.read_fixed("__commits", n)) for n in self.store.names("__commits")]
        for m in every:
            gone = [f for f in every if f["id"] in m.get("replaces", ())]
            if not gone:
                continue
            first = min(f["timestamp"] for f in gone)
            if first < m["timestamp"]:
                self.store.write("{}", "__vacuum", f"{first:020d}_{m['timestamp']:020d}.json")
            for f in gone:
                self.store.delete("__commits", f"{f['id']}.json")
                self.store.delete("__fragments", f"{FRAGMENT}={f['id']}")

    # -- metadata --------------------------------------------------------------------------------------------------

    def put_metadata(self, items: dict[str, Any], timestamp: int | None = None) -> None:
        stamp = int(time.time() * 1000) if timestamp is None else timestamp
        self.store.write(json.dumps(items, default=str), "__meta", f"{stamp:020d}_{len(self.store.names('__meta')):08d}.json")

    def metadata_values(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for name in self.store.names("__meta"):
            if self.open_at is None or int(name.partition("_")[0]) <= self.open_at:
                out |= json.loads(self.store.read_fixed("__meta", name))
        return out

    def metadata(self) -> DataFrame:
        """``key, value`` text of each metadata item."""
        return self.spark.createDataFrame([(k, values.metadata_text(v)) for k, v in sorted(self.metadata_values().items())], "key string, value string")

