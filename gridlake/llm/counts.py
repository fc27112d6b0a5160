"""Edit-aware token counts: a segment tree of pre-tokens per document.

An edit re-encodes only the pre-tokens that it touches and the boundary context that can change with it;
the sums of the subtrees above are updated, the rest is kept.
"""

from __future__ import annotations

import re
from functools import cached_property, lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from gridlake.llm.bpe import Words, codec, has_odd
from gridlake.llm.packing import ids_of
from gridlake.llm.shared import map_batches, texts_of

#: Characters after a pre-token that the pattern may look at before it ends there (a contraction's two, and one);
#: where added tokens count as one, also their length.
LOOKAHEAD = 3
BLOCK = 32
#: Characters of a pre-token up to which the matcher's own merge is used; longer ones go to the heap of ``bpe``.
SHORT = 256
Tokens = list[tuple[int, int]]  # characters and ids of each pre-token


class PreTokens:
    """Pre-tokens of a byte-level file's pattern, and each one's number of ids.

    ``added``: the file's added tokens count as one id wherever they stand in a text, as the library has it by
    default; else they are ordinary text.  Files with a normaliser have no fixed offsets and are refused.
    """

    def __init__(self, path: str, added: bool = True):
        self.codec = codec(path)
        if self.codec.nfc or self.codec.lower or self.codec.suffix:
            raise ValueError(f"{path} normalises texts: edits need a byte-level file without that")
        self.core = ids_of(path).fast._core_bpe
        self.known = Words(self.count)
        self.added = sorted(self.codec.added, key=len, reverse=True) if added else []
        self.look = max([LOOKAHEAD, *map(len, self.added)])
        self.pattern = self.with_added(self.codec.pattern)

    @cached_property
    def exact_pattern(self) -> regex.Pattern:
        return self.with_added(self.codec.exact_pattern)

    def pattern_of(self, text: str) -> regex.Pattern:
        return self.exact_pattern if has_odd(text) else self.pattern

    def with_added(self, plain: regex.Pattern) -> regex.Pattern:
        """The pattern with added tokens as pre-tokens, before which all others end as they do at a text's end."""
        if not self.added:
            return plain
        if any(regex.match(r"[\p{L}\p{N}\p{White_Space}']", t) for t in self.added):
            raise ValueError("added tokens that begin like a word are not supported")
        any_of = "|".join(map(regex.escape, self.added))
        text = re.sub(r"(\[\^\\p\{White_Space\}[^\]]*\])\+", lambda m: f"(?:(?!{any_of}){m[1]})+", plain.pattern)
        return regex.compile(f"{any_of}|" + text.replace(r"\p{White_Space}+(?!", rf"\p{{White_Space}}+(?={any_of})|\p{{White_Space}}+(?!"))

    def count(self, word: str) -> int:
        if word in self.added:
            return 1
        if len(word) > SHORT:
            return len(self.codec.word(word)[0]) // 4
        return len(self.core.encode_single_piece(word.encode("utf-8", "surrogatepass")))

    def full(self, text: str) -> int:
        return sum(map(self.known.__getitem__, self.pattern_of(text).findall(text)))


class CountTree:
    """A text as blocks of pre-tokens under a binary tree of (characters, tokens) sums.

    Blocks that no edit touched are ranges of the first text; a touched block has its own text and pre-tokens, so that
    an edit costs what it touches and not the length of the text.
    """

    def __init__(self, text: str, words: PreTokens):
        self.words, self.encoded = words, 0  # characters that edits re-encode
        self.pattern = words.pattern_of(text)
        found = self.pattern.findall(text)
        n = len(found)
        self._load(text, np.fromiter(map(len, found), np.int64, n), np.fromiter(map(words.known.__getitem__, found), np.int64, n))

    def _load(self, text: str, lengths: np.ndarray, counts: np.ndarray) -> None:
        self.first, self.lengths, self.counts = text, lengths, counts
        starts = np.arange(0, len(lengths), BLOCK)
        blocks = max(1, len(starts))
        size = 1 << (blocks - 1).bit_length()
        self.size, self.blocks = size, [None] * blocks
        sums = np.zeros((2, 2 * size), np.int64)
        if len(starts):
            sums[0, size : size + blocks] = np.add.reduceat(lengths, starts)
            sums[1, size : size + blocks] = np.add.reduceat(counts, starts)
        self.offsets = np.concatenate([[0], np.cumsum(sums[0, size : size + blocks])])
        at = size
        while at > 1:
            sums[:, at // 2 : at] = sums[:, at : 2 * at].reshape(2, -1, 2).sum(axis=2)
            at //= 2
        self.chars, self.tokens = sums.tolist()

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self._block(k)[0] for k in range(len(self.blocks)))

    def _block(self, k: int) -> tuple[str, Tokens]:
        if (own := self.blocks[k]) is not None:
            return own
        part = slice(k * BLOCK, (k + 1) * BLOCK)
        return self.first[self.offsets[k] : self.offsets[k + 1]], list(zip(self.lengths[part].tolist(), self.counts[part].tolist(), strict=True))

    def _block_at(self, char: int) -> tuple[int, int]:
        """The block that holds a character (the last that has any, behind the end), and where it begins."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if char >= start + self.chars[i] and start + self.chars[i] < self.chars[1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def _head(self, k: int, at: int, start: int) -> Tokens:
        """Pre-tokens of a block whose match cannot have looked at ``start``."""
        out = []
        for token in self._block(k)[1]:
            if (at := at + token[0]) + self.words.look > start:
                break
            out.append(token)
        return out

    def replace(self, start: int, end: int, new: str) -> int:
        """Replace the characters from ``start`` to ``end`` (clamped to the text); returns the new number of tokens."""
        length, look = self.chars[1], self.words.look
        start, end = max(0, min(start, length)), max(0, min(end, length))
        end = max(start, end)
        if has_odd(new):
            self.pattern = self.words.exact_pattern
        shift = len(new) - (end - start)
        # first block: the last one that has a boundary which cannot depend on the edit
        first, base = self._block_at(max(0, start - look - 1))
        head = self._head(first, base, start)
        while not head and first > 0 and base + look > start:
            first -= 1
            base -= self.chars[self.size + first]
            head = self._head(first, base, start)
        place = sum(n for n, _ in head)  # from here on all is relative to base
        high = self._block_at(end)[0]
        old = [self._block(k) for k in range(first, high + 1)]
        cut = self._joined(old, start - base, end - base, new)
        fresh: Tokens = []
        k, index, pos = 0, 0, 0  # the old boundary that is compared: block (from first), pre-token in it, character
        while True:
            if place >= end - base + shift:
                while k < len(old) and pos + shift < place or pos < end - base:
                    if index == len(old[k][1]):
                        if k + 1 == len(old):
                            break
                        k, index = k + 1, 0
                        continue
                    pos += old[k][1][index][0]
                    index += 1
                if pos >= end - base and pos + shift == place:
                    break
            m = self.pattern.match(cut, place)
            if (m is None or m.end() + look > len(cut)) and high + 1 < len(self.blocks):
                more = min(len(self.blocks) - 1, high + 1 + (high - first))  # as many blocks again
                old += [self._block(j) for j in range(high + 1, more + 1)]
                cut += "".join(t for t, _ in old[high + 1 - first :])
                high = more
                continue
            if m is None:
                k, index, pos = len(old) - 1, len(old[-1][1]), sum(len(t) for t, _ in old)
                break
            fresh.append((m.end() - place, self.words.known[m[0]]))
            self.encoded += m.end() - place
            place = m.end()
        tail = old[k][1][index:]
        merged, last = head + fresh + tail, first + k
        stop = sum(len(t) for t, _ in old[: k + 1]) + shift
        self._store(first, last, cut[:stop], merged)
        return self.total

    @staticmethod
    def _joined(old: list[tuple[str, Tokens]], start: int, end: int, new: str) -> str:
        text = "".join(t for t, _ in old)
        return text[:start] + new + text[end:]

    def _store(self, first: int, last: int, text: str, merged: Tokens) -> None:
        """Put pre-tokens in the place of some blocks; too many for these leaves rebuild the tree from known counts."""
        leaves = last - first + 1
        if len(merged) > leaves * 4 * BLOCK:
            around = [self._block(j) for j in range(first)], [self._block(j) for j in range(last + 1, len(self.blocks))]
            tokens = [t for b in around[0] for t in b[1]] + merged + [t for b in around[1] for t in b[1]]
            whole = "".join([*(b[0] for b in around[0]), text, *(b[0] for b in around[1])])
            pairs = np.array(tokens, np.int64).reshape(-1, 2)
            self._load(whole, pairs[:, 0], pairs[:, 1])
            return
        share, at, touched = max(1, -(-len(merged) // leaves)), 0, set()
        for j in range(first, last + 1):
            own = merged[(j - first) * share : (j - first + 1) * share]
            size = sum(n for n, _ in own)
            self.blocks[j] = text[at : at + size], own
            at += size
            self.chars[self.size + j], self.tokens[self.size + j] = size, sum(n for _, n in own)
            touched.add((self.size + j) // 2)
        while touched and touched != {0}:
            for i in touched:
                self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
                self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            touched = {i // 2 for i in touched if i > 1}


@lru_cache(maxsize=2)
def pre_tokens(path: str, added: bool = True) -> PreTokens:
    return PreTokens(path, added)


#: Edits that the registered query applies to every document, in this order: a front-matter line comes in,
#: addresses and long digit runs are masked, and the closing line goes.
MASKS = re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]+|[0-9]{4,}")
LONG_NUMBER = re.compile(r"[0-9]{4,}")


def standard_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits (start, end, replacement) from the last to the first place, so that earlier offsets stay valid."""
    edits = [(m.start(), m.end(), "<masked>") for m in (MASKS if "@" in text else LONG_NUMBER).finditer(text)]
    cut = text.rstrip("\n").rfind("\n")
    if cut > 0:
        edits = [e for e in edits if e[1] <= cut] + [(cut, len(text), "")]
    return edits[::-1] + [(0, 0, "---\nsource: corpus\n---\n")]


def apply_edits(text: str, edits: list[tuple[int, int, str]]) -> str:
    for start, end, new in edits:
        text = text[:start] + new + text[end:]
    return text


def edit_counts(docs: DataFrame, path: str, edits_col: str | None = None, added: bool = True) -> DataFrame:
    """``doc_id, n_tokens, n_edits, n_tokens_edited, n_chars_edited, reencoded_chars`` for each row: token counts before
    and after edits.

    ``edits_col``: a column of ``array<struct<start:int,end:int,text:string>>``, applied in order to offsets of the
    text as it then is (out of range: clamped); None: ``standard_edits``.  ``added``: see ``PreTokens``.  Null texts
    count as empty, null edits as none; an empty table gives no rows; other columns are not read.  Row-local, so
    copies, ties and hot sources cost nothing extra; a text is worked on whole, in memory that follows its length.
    """

    def make():
        words = pre_tokens(path, added)

        def step(batch):
            out = {k: [] for k in ("n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "reencoded_chars")}
            given = batch.column(2).to_pylist() if edits_col else [None] * batch.num_rows
            for text, own in zip(texts_of(batch), given, strict=True):
                edits = [(e["start"] or 0, e["end"] or 0, e["text"] or "") for e in own or ()] if edits_col else standard_edits(text)
                tree = CountTree(text, words)
                before = tree.total
                for e in edits:
                    tree.replace(*e)
                for name, value in zip(out, (before, len(edits), tree.total, tree.chars[1], tree.encoded), strict=True):
                    out[name].append(value)
            return {"doc_id": batch.column(0)} | out

        return step

    columns = ["doc_id", "text", *([edits_col] if edits_col else [])]
    return map_batches(docs, columns, "doc_id long, n_tokens long, n_edits int, n_tokens_edited long, n_chars_edited long, reencoded_chars long", make)
