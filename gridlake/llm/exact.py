"""Exact dedup: owners of equal texts from compressed radix (Patricia) tries.

Texts are first inserted into a trie where they are read, so that a text repeated a million times leaves each
task as one row; distinct texts are then dealt by length and content hash, and tries over the full byte strings
settle who owns each.  A trie over its budget gives its largest subtree downstream, where equal texts meet again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridlake.llm.shared import FILE, ROW, addressed, cut, give_back, hot_keys, in_few_files, left_join, plain, without

#: Bytes that one trie holds, and what a node takes besides its edge (measured: lists, dictionary, owner).
BUDGET, NODE = 64 << 20, 250
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = bytes.maketrans(_UPPER.encode(), _LOWER.encode())
Owner = tuple  # largest id, rows, rows with that id; and perhaps the address of the first of these


def merge_owners(a: Owner, b: Owner) -> Owner:
    """Nulls rank below every id."""
    if a[0] == b[0]:
        return a[0], a[1] + b[1], a[2] + b[2], *min(a[3:], b[3:])
    top = b if a[0] is None or (b[0] is not None and b[0] > a[0]) else a
    return top[0], a[1] + b[1], *top[2:]


class RadixTrie:
    """Byte strings as compressed edges; a terminal node holds its text's owner.  Node: [edge, children, owner]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.bytes = 0

    def insert(self, key: bytes, owner: Owner) -> None:
        node, at, n = self.root, 0, len(key)
        while at < n:
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, owner]
                self.bytes += n - at + NODE
                return
            edge = child[0]
            if key.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            low, high = 1, min(len(edge), n - at)  # the edge splits where the strings part
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if key.startswith(edge[:mid], at) else (low, mid - 1)
            lower = [edge[low:], child[1], child[2]]
            child[0], child[1], child[2] = edge[:low], {edge[low]: lower}, None
            self.bytes += NODE
            node, at = child, at + low
        node[2] = owner if node[2] is None else merge_owners(node[2], owner)

    @staticmethod
    def terminals(node: list, before: bytes = b"") -> Iterator[tuple[bytes, Owner]]:
        stack = [(node, before)]
        while stack:
            (edge, children, owner), path = stack.pop()
            path = path + edge if edge else path
            if owner is not None:
                yield path, owner
            stack.extend((c, path) for c in children.values())

    def drain(self) -> Iterator[tuple[bytes, Owner]]:
        root, self.root, self.bytes = self.root, [b"", {}, None], 0
        yield from self.terminals(root)

    def spill(self) -> Iterator[tuple[bytes, Owner]]:
        """Take out the largest subtree below the root and give its owners."""

        def weight(node: list) -> int:
            total, stack = 0, [node]
            while stack:
                x = stack.pop()
                total += len(x[0]) + NODE
                stack.extend(x[1].values())
            return total

        if not self.root[1]:
            return
        key, size = max(((k, weight(c)) for k, c in self.root[1].items()), key=lambda p: p[1])
        node = self.root[1].pop(key)
        self.bytes -= size
        yield from self.terminals(node)


_PARTIAL = f"n_bytes long, h long, body binary, keep_id long, n long, ties long, {FILE} long, {ROW} long"
_OWNERS = f"text_sha256 string, keep_id long, group_size long, ties long, {FILE} long, {ROW} long"


def _batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + (row[0] if isinstance(row[0], int) else 0)
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: bool = True, budget: int = BUDGET) -> DataFrame:
    """``text_sha256, keep_id, group_size, ties`` for each distinct text, and the address of the row that stays; ties
    counts the rows that carry keep_id, of which the one with the least address stays."""
    docs = addressed(docs)
    partial, final = StructType.fromDDL(_PARTIAL), StructType.fromDDL(_OWNERS)
    partial_arrow, final_arrow = to_arrow_schema(partial), to_arrow_schema(final)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie()

        def shaped(found: Iterator[tuple[bytes, Owner]]) -> Iterator[tuple]:
            for body, owner in found:
                yield len(body), xxhash.xxh3_64_intdigest(body) - (1 << 63), body, *owner

        for batch in batches:
            for doc_id, body, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = body or b""
                trie.insert(body.translate(FOLD) if fold else body, (doc_id, 1, 1, *place))
                while trie.bytes > budget:
                    yield from _batches(shaped(trie.spill()), partial_arrow)
        yield from _batches(shaped(trie.drain()), partial_arrow)
        give_back()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, at = RadixTrie(), (None, None)

        def shaped(found: Iterator[tuple[bytes, Owner]]) -> Iterator[tuple]:
            for body, owner in found:
                yield hashlib.sha256(body).hexdigest(), *owner

        for batch in batches:
            for n, h, body, *owner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (n, h) != at and (n != at[0] or trie.bytes > budget):  # in this order no earlier text comes again
                    yield from _batches(shaped(trie.drain()), final_arrow)
                at = (n, h)
                trie.insert(body, tuple(owner))
        yield from _batches(shaped(trie.drain()), final_arrow)
        give_back()

    first = docs.select(plain(id_col).cast("long"), plain(text_col).cast("binary"), FILE, ROW).mapInArrow(read, partial)
    return first.repartition("n_bytes", "h").sortWithinPartitions("n_bytes", "h").mapInArrow(settle, final)


def digest(text_col: str = "text", fold: bool = True):
    """SHA-256 of the normalised text: A-Z lower-cased, null as empty."""
    text = F.coalesce(plain(text_col), F.lit(""))
    return F.sha2((F.translate(text, _UPPER, _LOWER) if fold else text).cast("binary"), 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: bool = True) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    The largest id of equal texts is kept; rows that repeat this id are all marked kept (``drop_copies`` leaves one).
    Null ids rank lowest; null text equals empty text; an empty table gives no rows; other columns are not read.  Only
    digests are joined, those of hot texts in several tasks.  Texts pass whole through tries, one of which may exceed
    its budget by one text.
    """
    docs = addressed(docs)
    total = docs.count()
    found = cut(in_few_files(owners(docs, id_col, text_col, fold).where("group_size > 1").drop(FILE, ROW), total), "owners")
    rows = docs.select(plain(id_col).alias("doc_id"), digest(text_col, fold).alias("text_sha256"), ROW)
    joined = left_join(rows, found, "text_sha256", hot_keys(found, "text_sha256", "group_size", total), F.col(ROW))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: bool = True) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: one for each distinct text.

    That is the row with the largest id, nulls lowest, and of rows that repeat it one.  Null text equals empty text;
    an empty table gives no rows.  The texts go through tries once, and are not moved again: see ``shared``.
    """
    docs = addressed(docs)
    total = docs.count()
    found = owners(docs, id_col, text_col, fold).where("group_size > 1")
    found = cut(in_few_files(found.select("text_sha256", "group_size", F.struct(FILE, ROW).alias("keeper")), total), "owners")
    rows = docs.select(digest(text_col, fold).alias("text_sha256"), FILE, ROW)
    joined = left_join(rows, found, "text_sha256", hot_keys(found, "text_sha256", "group_size", total), F.col(ROW))
    return without(docs, joined.where(F.col("keeper") != F.struct(FILE, ROW)), total, "copies")
