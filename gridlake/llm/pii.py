"""PII: base patterns, and information-theoretic sanitisation of terms that reveal protected entities.

A term t near an entity e discloses it by the share of e's information that t gives:

    disclosure(e; t) = PMI(e; t) / IC(e) = log(p(e|t) N / n(e)) / log(N / n(e))
    p(e|t) = (n(e,t) + a n(e) / N) / (n(t) + a)

with counts of distinct contexts (n(e,t), n(e)) and of documents that hold the term (n(t)) over the whole corpus.
Every pair is estimated: the ``SMOOTH`` (a) draws the few sightings of a rare term to the entity's base rate.
Terms at or above ``FULL`` are removed, those at or above ``PARTIAL`` are generalised.  Contexts are counted
once however often a passage is copied.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.shared import FILE, ROW, SideReader, addressed, cut, map_batches, plain, put_side, texts_of

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W\d_]{2,}")
#: Words on each side of an entity that count as its context; what is found there holds for the whole document.
WINDOW = 6
#: The disclosure from which a term is generalised or removed, and the sightings that the base rate counts for.
PARTIAL, FULL, SMOOTH = 0.6, 0.9, 1.0


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, in linear time: each ``@`` is tried once, with the longest local part before it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1  # nothing before this @ can begin a match any more
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind and then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() <= 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def gaps(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The parts of the text that no span covers."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda x: x[1]):
        if a > at:
            out.append((at, a))
        at = max(at, b)
    return [*out, (at, len(text))]


def contexts(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[tuple[str, str, int]], dict[str, tuple[list[int], list[int]]]]:
    """(entity, term, context hash) of each word within ``WINDOW`` words of an entity; and of every word of the text its
    starts and stops.  Words stand outside all spans and are whole, however long.
    """
    words = [(m[0].lower(), *m.span()) for a, b in gaps(text, spans) for m in _WORD.finditer(text, a, b)]
    starts = [a for _, a, _ in words]
    near = []
    for kind, a, b in spans:
        entity = f"{kind}:{text[a:b].lower() if kind == 'email' else _NOT_DIGIT.sub('.' if kind == 'ip' else '', text[a:b])}"
        left, right = bisect_left(starts, a), bisect_left(starts, b)
        window = [w for w, _, _ in words[max(0, left - WINDOW) : left] + words[right : right + WINDOW]]
        mark = xxhash.xxh3_64_intdigest(" ".join(window)) - (1 << 63)
        near += [(entity, w, mark) for w in dict.fromkeys(window)]
    places: dict[str, tuple[list[int], list[int]]] = {}
    for w, a, b in words:
        at = places.setdefault(w, ([], []))
        at[0].append(a)
        at[1].append(b)
    return near, places


_SCAN = (
    f"doc_id long, {FILE} long, {ROW} long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
    "near array<struct<entity:string,term:string,mark:long>>, words array<struct<term:string,starts:array<int>,stops:array<int>>>"
)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document of an addressed table: counts and spans of the base kinds, the terms around them, and the
    places of all words if there are spans."""

    def make():
        def step(batch):
            out = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "near", "words")}
            for text in texts_of(batch):
                spans = base_spans(text)
                kinds, base = [k for k, _, _ in spans], joined(spans)
                near, places = contexts(text, spans) if spans else ([], {})
                near = [{"entity": e, "term": t, "mark": m} for e, t, m in near]
                words = [{"term": t, "starts": a, "stops": b} for t, (a, b) in places.items()]
                row = (*(kinds.count(k) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), base, near, words)
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            return {"doc_id": batch.column(0), FILE: batch.column(2), ROW: batch.column(3)} | out

        return step

    return map_batches(docs, [plain("doc_id").cast("long").alias("doc_id"), plain("text").alias("text"), FILE, ROW], _SCAN, make)


def words_of(text: Column) -> Column:
    """Distinct lower-case words of two letters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) > 1))


def disclosures(docs: DataFrame, scanned: DataFrame, partial: float = PARTIAL) -> DataFrame:
    """``entity, term, disclosure`` of the pairs at or above ``partial``.

    Pairs and entities are counted over distinct contexts; terms over all documents, summed before the shuffle and
    before they meet the pairs, so the join's rows are bounded by the pairs.
    """
    near = scanned.where(F.size("near") > 0).select(F.explode("near").alias("x")).select("x.entity", "x.term", "x.mark").distinct()
    near = cut(near, "near")
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("n_et"))
    pairs = cut(pairs, "pairs")
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(0.0).alias("disclosure"))
    entities = near.select("entity", "mark").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    terms = docs.select(F.explode(words_of(plain("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    total = docs.count()
    both = pairs.join(entities, "entity").join(terms, "term", "left")
    all_contexts = F.lit(float(max(total, 2)))
    n_t = F.greatest(F.coalesce("n_t", F.lit(0)), F.col("n_et"))
    n = F.greatest(all_contexts, n_t, F.col("n_e")) + 1.0
    given = (F.col("n_et") + F.lit(SMOOTH) * F.col("n_e") / n) / (n_t + F.lit(SMOOTH))
    share = F.log(given * n / F.col("n_e")) / F.log(n / F.col("n_e"))
    return both.select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= partial)


def term_spans(docs: DataFrame, scanned: DataFrame, partial: float = PARTIAL, full: float = FULL) -> DataFrame:
    """``FILE, ROW, added array<struct<kind,start,stop>>`` for the documents that hold an entity and a term that
    discloses it: every place of the term, near the entity or not.

    A document's words meet the terms found, then its entities; no row holds both lists.
    """
    found = cut(disclosures(docs, scanned, partial), "disclosures")
    rows = scanned.where(F.size("near") > 0)
    words = rows.select(FILE, ROW, F.explode("words").alias("x")).select(FILE, ROW, "x.term", "x.starts", "x.stops")
    held = rows.select(FILE, ROW, F.explode(F.array_distinct(F.col("near.entity"))).alias("entity"))
    # merged at every size: whether a side happens to fit a broadcast must not change what is shuffled
    hit = words.join(found.hint("merge"), "term").join(held.hint("merge"), [FILE, ROW, "entity"], "left_semi")
    top = hit.groupBy(FILE, ROW, "term").agg(F.max("disclosure").alias("d"), F.first("starts").alias("starts"), F.first("stops").alias("stops"))
    kind = F.when(F.col("d") >= full, F.lit("term_removed")).otherwise(F.lit("term_generalised"))
    places = top.select(FILE, ROW, kind.alias("kind"), F.explode(F.arrays_zip("starts", "stops")).alias("x"))
    return places.groupBy(FILE, ROW).agg(F.array_sort(F.collect_list(F.struct("kind", F.col("x.starts").alias("start"), F.col("x.stops").alias("stop")))).alias("added"))


def find_pii(docs: DataFrame, partial: float = PARTIAL, full: float = FULL) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Null and empty texts have no spans.  Repeated rows get the same spans; other columns are not read; an empty table
    gives no rows.  No text is shuffled: each is read once for its spans, whole, and once for the corpus counts of terms.
    """
    docs = addressed(docs)
    scanned = cut(scan(docs), "scan")
    both = scanned.join(term_spans(docs, scanned, partial, full).hint("merge"), [FILE, ROW], "left")
    more = F.transform("added", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string")))
    spans = F.concat_ws(",", F.array_compact(F.concat(F.array(F.when(F.col("base") != "", F.col("base"))), F.coalesce(more, F.array().cast("array<string>")))))
    return both.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"))


def rewrite(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Mask base spans by their kind, generalise terms, take out removed ones.

    Spans that overlap are one span, up to the end of their union: a base kind's (the first's) if there is one in it.
    """
    unions: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if unions and a < unions[-1][2]:
            last = unions[-1]
            last[2] = max(last[2], b)
            if last[0] not in KINDS and kind in KINDS:
                last[0] = kind
        else:
            unions.append([kind, a, b])
    out, at = [], 0
    for kind, a, b in unions:
        out.append(text[at:a])
        out.append("" if kind == "term_removed" else "[TERM]" if kind == "term_generalised" else f"[{kind.upper()}]")
        at = b
    return "".join(out) + text[at:]


def cleaned(text: str, added: list[tuple[str, int, int]]) -> str:
    """The text with base spans and ``added`` rewritten, and what only then reads as a base span."""
    spans = base_spans(text) + added
    while spans:
        text = rewrite(text, spans)
        spans = base_spans(text)
    return text


def sanitise(docs: DataFrame, partial: float = PARTIAL, full: float = FULL) -> DataFrame:
    """The rows of documents with all spans rewritten; ``n_chars`` follows the text, other columns are unchanged.

    Null text stays null, empty text empty; repeated rows are rewritten alike; an empty table gives no rows.  Texts are
    not shuffled: the one pass that rewrites them reads the added spans of the rows that it is at; see ``shared``.
    """
    docs = addressed(docs)
    scanned = cut(scan(docs), "scan")
    side = put_side(term_spans(docs, scanned, partial, full).withColumnRenamed("added", "value"), docs.count(), "added")
    names = [c for c in docs.columns if c not in (FILE, ROW)]
    fields = [docs.schema[c] for c in names]
    at, chars, last = names.index("text"), names.index("n_chars") if "n_chars" in names else None, len(names)

    def make():
        reader = SideReader(side, values=True)

        def step(batch):
            columns = [batch.column(i) for i in range(last)]
            place = [batch.column(last + i).to_numpy() for i in range(3)]
            out = []
            for text, extra in zip(columns[at].to_pylist(), reader.find(*place)[1], strict=True):
                if text is not None:
                    text = cleaned(text, [(x["kind"], x["start"], x["stop"]) for x in extra or ()])
                out.append(text)
            result = {f"c{i}": c for i, c in enumerate(columns)}
            result[f"c{at}"] = out
            if chars is not None:
                result[f"c{chars}"] = [None if t is None else len(t) for t in out]
            return result

        return step

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))
    done = map_batches(docs, [*[plain(c).alias(f"c{i}") for i, c in enumerate(names)], side.part(), FILE, ROW], schema, make)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
