"""Best-fit packing by the sum-of-squares rule.

Documents are tokenised and cut where they are read; only small rows (no text) are shuffled.  Pieces are
dealt by a hash of document and piece to groups of about ``GROUP`` documents, so that no source or id can
fill a group; each group is packed by itself, largest pieces first.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridlake.llm.shared import map_batches, texts_of

CAPACITY = 2048
_PLACE = ("sequence_id", "offset")
#: Documents for each independently packed group: bounds a task's memory; a group wastes a few bins at most.
GROUP = 40_000


class SumOfSquares:
    """Online bin packing: each item goes where the squared counts of open bins per residual gap become smallest."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by residual gap
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.fill: list[int] = []

    def place(self, size: int) -> tuple[int, int]:
        """Bin number and offset for an item of this size (0 < size <= capacity)."""
        cap, count = self.capacity, self.count
        gap = cap
        if size < cap:
            # change of the sum when a bin of gap h takes the item: (N[h-size]+1)^2 - N[h-size]^2 + (N[h]-1)^2 - N[h]^2
            old, new = count[size:cap], count[: cap - size]
            change = 2 * (new - old) + 2
            change[0] = 1 - 2 * old[0]  # an exact fit closes the bin: nothing is added
            fresh = 2 * count[cap - size] + 1
            k = int(np.argmin(np.where(old > 0, change, np.iinfo(np.int64).max)))
            if old[k] > 0 and change[k] <= fresh:
                gap = k + size
        if gap == cap:
            number = len(self.fill)
            self.fill.append(0)
        else:
            number = self.bins[gap].pop()
            self.count[gap] -= 1
        offset = self.fill[number]
        self.fill[number] += size
        if gap > size:
            self.bins[gap - size].append(number)
            self.count[gap - size] += 1
        return number, offset


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin numbers and offsets of the items, which are placed in falling order of size."""
    packer, bins, offsets = SumOfSquares(capacity), np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        bins[i], offsets[i] = packer.place(int(sizes[i]))
    return bins, offsets


class Ids:
    """Token ids of a ``tokenizers`` byte-level file, from the same vocabulary in ``tiktoken``'s faster matcher."""

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        from gridlake.llm.bpe import BytePairCodec, byte_alphabet

        of = {c: b for b, c in enumerate(byte_alphabet())}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(of[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in added}
        self.fast = tiktoken.Encoding(base64.b32encode(path.encode()).decode(), pat_str=BytePairCodec.BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=added)
        self.added, self.path = frozenset(added), path

    @cached_property
    def slow(self):
        """The library's own tokenizer, loaded only for a text that needs it."""
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self.path)
        own.no_padding()
        own.no_truncation()
        return own

    def __call__(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special=self.added), dtype="<u4")
        except Exception:  # noqa: BLE001  the matcher's backtracking limit on a freak text
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: the first takes what full pieces leave."""
    if total <= capacity:
        return [total]
    first = total % capacity
    return ([first] if first else []) + [capacity] * (total // capacity)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` for each piece; every document ends with id 0, so none is empty."""

    def make():
        own = ids_of(path)

        def step(batch):
            out, rows = {k: [] for k in ("piece", "start", "length", "ids_crc32")}, []
            for row, text in enumerate(texts_of(batch)):
                ids, start = np.append(own(text), np.uint32(0)).astype("<u4"), 0
                for k, n in enumerate(cut_lengths(len(ids), capacity)):
                    rows.append(row)
                    for name, value in (("piece", k), ("start", start), ("length", n), ("ids_crc32", zlib.crc32(ids[start : start + n].tobytes()))):
                        out[name].append(value)
                    start += n
            return {"doc_id": batch.column(0).take(pa.array(rows, pa.int64()))} | out

        return step

    return map_batches(docs, ["doc_id", "text"], "doc_id long, piece int, start long, length long, ids_crc32 long", make)


def pack(items: DataFrame, groups: int, capacity: int = CAPACITY, size_col: str = "length", key_cols: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the items (in place of columns of these names), which need ``size_col``
    between 1 and ``capacity``.

    Ties and repeated rows are separate items; null keys come last among items of a size, and all columns keep their
    values exactly.  Items of one group meet in one task as small rows; ``groups`` bounds them.  No items: no rows.
    """
    schema = StructType([f for f in items.schema.fields if f.name not in _PLACE]).add("sequence_id", "long").add("offset", "long")
    names, target = [f.name for f in schema.fields[:-2]], to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        order = [("__group", "ascending"), (size_col, "descending"), *((k, "ascending") for k in key_cols)]
        rows = rows.take(pc.sort_indices(rows, sort_keys=order))
        groups, sizes = rows.column("__group").to_numpy(), rows.column(size_col).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a < b:
                bins, offsets = pack_sizes(sizes[a:b].astype(np.int64), capacity)
                own = [rows.column(n).slice(a, b - a).combine_chunks() for n in names]
                place = [pa.array(bins + (int(groups[a]) << 36)), pa.array(offsets)]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([*own, *place], target, strict=True)], schema=target)

    group = F.pmod(F.xxhash64(*key_cols), F.lit(groups)).cast("int")
    return items.withColumn("__group", group).repartition(groups, "__group").mapInArrow(run, schema)


def best_fit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Cut and pack all rows of ``docs``; ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece.

    Null and empty texts are one piece holding id 0.  Repeated rows are packed once each, null ids stay null, other
    columns are not read, an empty table gives no rows.  Only documents of over ``capacity`` ids are cut; a text is
    encoded whole, in memory that follows its length.
    """
    groups = max(1, -(-docs.count() // group))
    return pack(pieces(docs, path, capacity), groups, capacity)
