"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked symbol list.

The vocabulary file is a parameter (the public ``tokenizers`` JSON layout); nothing is trained or copied here.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
import sys
from collections.abc import Callable
from functools import cached_property, lru_cache

import regex
from pyspark.sql import DataFrame

from gridlake.llm.shared import map_batches, texts_of

#: Words kept per Python worker with their ids, in each of two generations.  Bounds memory, never results.
CACHED_WORDS = 200_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in kept:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def spans_of(numbers: list[int]) -> str:
    """Code points as the inside of a character class."""
    spans: list[list[int]] = []
    for n in numbers:
        if spans and spans[-1][1] == n - 1:
            spans[-1][1] = n
        else:
            spans.append([n, n])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


def every_character() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))


@lru_cache(maxsize=8)
def library_class(name: str) -> frozenset[str]:
    """The characters that the ``tokenizers`` library's patterns count as ``\\p{name}``: its Unicode version decides
    on ids, and neither ``regex`` nor Python need have the same."""
    from tokenizers import Regex, pre_tokenizers

    every, found, at = every_character(), [], 0
    rest = pre_tokenizers.Split(Regex(f"\\p{{{name}}}"), "removed").pre_tokenize_str(every)
    for _, (start, end) in [*rest, ("", (len(every), 0))]:
        found += every[at:start]
        at = end
    return frozenset(found)


@lru_cache(maxsize=1)
def odd_characters() -> frozenset[str]:
    """Characters whose properties the library, ``regex`` and this Python need not agree on."""
    every = every_character()
    odd = {c for c in every if unicodedata.category(c) == "Cn"}
    for name in "LN":
        odd |= library_class(name) ^ set(regex.findall(f"\\p{{{name}}}", every))
    return frozenset(odd)


#: Only characters from here on can be odd ones: all that are older than any of the libraries lie below it.
_LATE = re.compile("[\u0378-\U0010ffff]")


def has_odd(text: str) -> bool:
    return not text.isascii() and _LATE.search(text) is not None and not odd_characters().isdisjoint(text)


def compiled(pattern: str) -> regex.Pattern:
    """White space as Unicode has it, which is what the library's ``\\s`` means."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def spelt(part: str, inside: dict[str, str]) -> str:
    """A class or property of a pattern with letters and numbers spelt out."""
    if not part.startswith("["):
        return f"[{inside[part[3]]}]"
    for name, points in inside.items():
        part = part.replace(f"\\p{{{name}}}", points)
    return part


class Words(dict):
    """What ``make`` gives for a word, kept for short words.  A full generation becomes the old one, from which words
    that are met again come back, so that frequent words are never made anew."""

    def __init__(self, make: Callable, size: int = CACHED_WORDS):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, word: str | int):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if isinstance(word, int) or len(word) <= 64:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value


class BytePairCodec:
    """Encodes as the ``tokenizers`` library does for byte-level BPE files, without its encoder.

    Supported: NFC, whitespace replacement and lower-casing as normalisers; a Split pattern or the
    byte-level pattern as pre-tokeniser; end-of-word suffix; added tokens found in the raw text.
    The library says which characters are letters and numbers, and normalises texts with characters that are newer
    than this Python.
    """

    BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.strings = {i: s for s, i in vocab.items()}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        alphabet = byte_alphabet()
        self.inner = [vocab.get(c) for c in alphabet]
        self.final = [vocab.get(c + self.suffix) for c in alphabet]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self.strings |= {i: s for s, i in self.added.items()}
        self.find_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        steps = spec.get("normalizer") or {"normalizers": []}
        kinds = [n["type"] for n in steps.get("normalizers", [steps])]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        pre = spec["pre_tokenizer"]
        split = next((p for p in pre.get("pretokenizers", [pre]) if p["type"] == "Split"), None)
        pattern = split["pattern"]["Regex"] if split else self.BYTE_LEVEL
        self.raw_pattern, self.pattern = pattern, compiled(pattern)
        self.path = path
        self.byte_decoder = {c: b for b, c in enumerate(alphabet)} if (spec.get("decoder") or {}).get("type") == "ByteLevel" else None
        self.gapless = None not in self.inner and None not in self.final
        self.words = Words(self.word)

    @cached_property
    def exact_pattern(self) -> regex.Pattern:
        """The pattern with the library's own letters and numbers spelt out: slow, for texts with odd characters."""
        inside = {name: spans_of(sorted(map(ord, library_class(name)))) for name in "LN"}
        return compiled(re.sub(r"\[\^?[^\]]*\]|\\p\{[LN]\}", lambda m: spelt(m[0], inside), self.raw_pattern))

    def split(self, text: str) -> list[str]:
        return (self.exact_pattern if has_odd(text) else self.pattern).findall(text)

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the symbols of one word: lowest rank first, leftmost on ties, stale queue entries skipped."""
        n = len(ids)
        if n < 2:
            return ids
        merges, before, after = self.merges, list(range(-1, n - 1)), list(range(1, n + 1))
        alive, queue = [True] * n, []
        for i in range(n - 1):
            if (found := merges.get((ids[i], ids[i + 1]))) is not None:
                queue.append((found[0], i, found[1]))
        heapq.heapify(queue)
        while queue:
            rank, i, whole = heapq.heappop(queue)
            if not alive[i] or (j := after[i]) >= n:
                continue
            found = merges.get((ids[i], ids[j]))
            if found is None or found[0] != rank:
                continue  # the entry is stale: one of its symbols has changed
            ids[i], alive[j] = whole, False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := merges.get((whole, ids[k]))) is not None:
                    heapq.heappush(queue, (found[0], i, found[1]))
            if (h := before[i]) >= 0 and (found := merges.get((ids[h], whole))) is not None:
                heapq.heappush(queue, (found[0], h, found[1]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def word(self, word: str | int) -> tuple[bytes, bytes]:
        """Of a pre-token, or an added token's id: the ids as little-endian 32-bit integers, and what they decode to
        (bytes, or the vocabulary strings joined)."""
        if isinstance(word, int):
            return struct.pack("<I", word), self.joined([word])
        raw = word.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        ids = self.merge(symbols if self.gapless else [i for i in symbols if i is not None])
        return struct.pack(f"<{len(ids)}I", *ids), self.joined(ids)

    def joined(self, ids: list[int]) -> bytes:
        """Vocabulary strings concatenated: through the byte alphabet if the file has that decoder, else with spaces."""
        strings = [self.strings[i] for i in ids if i in self.strings]
        if self.byte_decoder is None:
            return " ".join(strings).encode()
        return b"".join(bytes(self.byte_decoder[c] for c in s) if all(c in self.byte_decoder for c in s) else s.encode() for s in strings)

    def parts(self, text: str) -> list[str | int]:
        """Pre-tokens (strings) and added tokens (ids) of a text, in order."""
        if self.find_added is None or not (("<|" in text) if self.bars else self.find_added.search(text)):
            return self.plain(text)
        out: list[str | int] = []
        at = 0
        for m in self.find_added.finditer(text):
            out += self.plain(text[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return out + self.plain(text[at:])

    @cached_property
    def bars(self) -> bool:
        return all(t.startswith("<|") for t in self.added)

    def plain(self, text: str) -> list[str]:
        """Pre-tokens of text without added tokens, normalised."""
        if not text.isascii() and (self.nfc or self.lower):
            if has_odd(text):
                return self.split(self.library.normalizer.normalize_str(text))
            if self.nfc:
                text = unicodedata.normalize("NFC", text)
            if self.lower:
                text = text.replace("Σ", "σ")
        return self.split(text.lower() if self.lower else text)

    def digests(self, text: str) -> tuple[bytes, bytes]:
        """The text's ids as bytes and its decoded text in UTF-8, from each distinct word's cached bytes."""
        parts = list(map(self.words.__getitem__, self.parts(text)))
        if not self.gapless:
            parts = [p for p in parts if p[0]]
        ids = b"".join([p[0] for p in parts])
        if self.byte_decoder is None:
            return ids, b" ".join([p[1] for p in parts])
        return ids, b"".join([p[1] for p in parts]).decode("utf-8", "replace").encode()

    def encode(self, text: str) -> list[int]:
        raw = b"".join([self.words[p][0] for p in self.parts(text)])
        return list(struct.unpack(f"<{len(raw) // 4}I", raw))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; ids that the file does not have are skipped, bytes that are no UTF-8 replaced."""
        return self.joined(ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> BytePairCodec:
    return BytePairCodec(path)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>, decoded string`` for each row; null text counts as empty, which gives no ids."""

    def make():
        own = codec(path)

        def step(batch):
            ids = [own.encode(t) for t in texts_of(batch, text_col)]
            return {id_col: batch.column(0), "ids": ids, "decoded": [own.decode(x) for x in ids]}

        return step

    return map_batches(docs, [id_col, text_col], f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string", make)


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row, from per-word byte strings.

    Null text counts as empty, which has no ids and decodes to nothing; repeated rows are encoded once each; an empty
    table gives no rows; columns other than ``doc_id`` and ``text`` are not read.  Row-local, so nothing is shuffled; a
    text is worked on whole, in memory that follows its length.
    """

    def make():
        own = codec(path)

        def step(batch):
            n, ids, back = [], [], []
            for text in texts_of(batch):
                raw, decoded = own.digests(text)
                n.append(len(raw) // 4)
                ids.append(hashlib.sha256(raw).hexdigest())
                back.append(hashlib.sha256(decoded).hexdigest())
            return {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": back}

        return step

    return map_batches(docs, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
