"""Language identification by Bayesian evidence fusion.

log P(l | all) = temper * log P(text | l) + log P(declared | l) + log P(suffix | l) + log P(l | host) + const

The languages are all that any row declares, by a grouped count of the whole table.

* text: multinomial over hashed byte trigrams of letters, learned from a bounded sample of each language's rows;
* declared: the language that the markup (``<html lang>``) or the table states, right with probability ``TRUST``;
* suffix: the address's last label, from smoothed grouped counts;
* host: grouped counts of declared languages, smoothed hierarchically (host -> registered domain -> all), the
  document's own declaration left out so that it does not count twice.

Text without letters, and longer text that no learned language explains better than uniform trigrams do, is ``und``.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridlake.llm.shared import FILE, HOT_SHARE, ROW, addressed, cut, left_join, map_batches, plain, texts_of, without

BUCKETS = 1 << 15
#: Rows of each language that the text model is fitted on: all up to this number, else about so many, by hash.
SAMPLE = 6_000
TEMPER, TRUST, HOST_WEIGHT, DOMAIN_WEIGHT = 0.25, 0.9, 20.0, 50.0
#: Posterior below which a document is rejected, and the trigrams from which a text can be told to be no language.
ACCEPT, ENOUGH = 0.5, 20
_TAGS = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the lower-cased text's UTF-8 bytes, other than letters taken as one blank."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    folded = np.where(letter, raw, 32).astype(np.uint32)
    keep = np.ones(len(folded), bool)
    keep[1:] = letter[1:] | letter[:-1]
    f = folded[keep]
    if len(f) < 3 or not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = (f[:-2] * np.uint32(0x9E3779B1)) ^ (f[1:-1] * np.uint32(0x85EBCA77)) ^ (f[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
    count = np.bincount(h, minlength=BUCKETS)
    index = np.flatnonzero(count)
    return index, count[index]


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    logp: np.ndarray  # BUCKETS x languages, float32
    read: np.ndarray  # of each language, whether the sample has any letters of it

    def log_likelihoods(self, text: str) -> tuple[np.ndarray, int, float]:
        """Per language; the number of trigrams; the best language's gain a trigram over uniform ones."""
        index, count = trigram_counts(text)
        n = int(count.sum())
        if not n or not self.read.any():
            return np.zeros(len(self.languages)), n, 0.0
        ll = count @ self.logp[index]
        return ll, n, float(ll[self.read].max() / n + np.log(BUCKETS))


def fit_text(rows: DataFrame, declared: dict[str, int], sample: int = SAMPLE) -> TextModel:
    """Fit on about ``sample`` rows at most of each language in ``declared``, which has the languages' numbers of rows
    in ``rows (key, text, declared)``.  The trigrams that occur leave each task; they are added up per language."""
    languages = tuple(sorted(declared))
    if not languages:
        return TextModel((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, bool))
    shares = [(x, min(1.0, sample / declared[x])) for x in languages]
    share = F.element_at(F.map_from_arrays(F.array(*[F.lit(x) for x, _ in shares]), F.array(*[F.lit(p) for _, p in shares])), F.col("declared"))
    chance = F.shiftrightunsigned(F.xxhash64("key", "text"), 11) / F.lit(float(1 << 53))
    own = rows.where(F.col("declared").isNotNull()).where(chance < share).select("text", "declared")
    kind = StructType.fromDDL("declared string, buckets binary, counts binary")
    target = to_arrow_schema(kind)

    def packed(name: str, total: np.ndarray) -> list[pa.Array]:
        index = np.flatnonzero(total)
        return [pa.array([name], pa.string()), pa.array([index.astype("<i4").tobytes()], pa.binary()), pa.array([total[index].astype("<i8").tobytes()], pa.binary())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, name in zip(texts_of(batch), batch.column(1).to_pylist(), strict=True):
                index, n = trigram_counts(text)
                total.setdefault(name, np.zeros(BUCKETS, np.int64))[index] += n
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays(packed(k, v), schema=target)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS, np.int64)
        for b, n in zip(table.column("buckets").to_pylist(), table.column("counts").to_pylist(), strict=True):
            total[np.frombuffer(b, "<i4")] += np.frombuffer(n, "<i8")
        return pa.Table.from_arrays(packed(table.column("declared")[0].as_py(), total), schema=target)

    counts = np.zeros((BUCKETS, len(languages)))
    for r in own.mapInArrow(count, kind).groupBy("declared").applyInArrow(add, kind).collect():
        counts[np.frombuffer(r["buckets"], "<i4"), languages.index(r["declared"])] = np.frombuffer(r["counts"], "<i8")
    smooth = 0.01
    return TextModel(languages, np.log((counts + smooth) / (counts.sum(axis=0) + smooth * BUCKETS)).astype(np.float32), counts.any(axis=0))


def host_of(url: Column) -> Column:
    """The host of an address (or the value itself if it has no scheme), lower-case, ``www.`` removed."""
    host = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[/?#:].*$", ""))
    return F.regexp_replace(host, r"^www\.", "")


def domain_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]+\.[^.]+)$|^([^.]*)$", 0)


def suffix_of(host: Column) -> Column:
    """The last label, empty for a host without dots."""
    return F.regexp_extract(host, r"\.([^.]+)$", 1)


def html_declared(html: Column) -> Column:
    """Primary subtag of ``<html lang>``; null if the markup states none."""
    found = F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return F.when(found != "", found)


def html_text(html: Column) -> Column:
    """Markup, scripts, styles and comments removed."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), _TAGS.pattern, " ")


def host_counts(rows: DataFrame) -> DataFrame:
    """``host, declared, n`` over all rows; those without a declaration count for none, but their hosts are there."""
    return rows.groupBy("host", "declared").agg(F.count("*").alias("n"))


def host_priors(hosts: DataFrame, declared: dict[str, int]) -> DataFrame:
    """``host, counts, domain_p, suffix_logp``: the host's counts and the smoothed levels above, by grouped aggregation
    of ``host_counts``; arrays in the order of the sorted languages.
    """
    languages = sorted(declared)
    names = F.array(*[F.lit(x) for x in languages])
    base = np.array([declared[x] + 1.0 for x in languages])
    p = base / base.sum()
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))

    def counted(level: str, *more: str) -> DataFrame:
        each = hosts.groupBy(level, *more, "declared").agg(F.sum("n").alias("n"))
        found = F.map_from_entries(F.collect_list(F.when(F.col("declared").isNotNull(), F.struct("declared", "n"))))
        return each.groupBy(level, *more).agg(found.alias("found")).select(level, *more, F.transform(names, lambda x: F.coalesce(F.try_element_at("found", x), F.lit(0))).alias("counts"))

    def numbers(values: np.ndarray) -> Column:
        return F.array(*[F.lit(float(x)) for x in values])

    mass = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x) + F.lit(DOMAIN_WEIGHT)
    domains = counted("domain").select("domain", F.zip_with("counts", numbers(DOMAIN_WEIGHT * p), lambda x, q: x + q).alias("d"), mass.alias("mass"))
    domains = domains.select("domain", F.transform("d", lambda x: x / F.col("mass")).alias("domain_p"))
    suffixes = counted("suffix")
    width = suffixes.count()
    silent = F.transform(names, lambda x: F.lit(0.0))
    shares = F.zip_with("counts", numbers(base + width), lambda x, b: F.log((x + 1.0) / b))
    suffixes = suffixes.select("suffix", F.when(F.col("suffix") == "", silent).otherwise(shares).alias("suffix_logp"))
    return counted("host", "domain", "suffix").join(domains, "domain").join(suffixes, "suffix").select("host", "counts", "domain_p", "suffix_logp")


def language_id(docs: DataFrame, key: Column, text: Column, declared: Column, host: Column, sample: int = SAMPLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key, *carry, lang, posterior, declared, text_gain, accepted`` for every row of ``docs``.

    Texts pass through Python once, whole; only one small row of log-likelihoods per document meets the host priors,
    rows of hot hosts in several tasks.  Null text is empty: no letters, ``und``, rejected.  Null declaration or host:
    that evidence says nothing.  Repeated rows are judged alike and count once each in the priors.  Other columns are
    not read; an empty table gives no rows.
    """
    rows = docs.select(key.alias("key"), F.coalesce(text, F.lit("")).alias("text"), declared.alias("declared"), host_of(host).alias("host"), *carry)
    hosts = cut(host_counts(rows), "hosts")
    stated = {r["declared"]: r["n"] for r in hosts.where(F.col("declared").isNotNull()).groupBy("declared").agg(F.sum("n").alias("n")).collect()}
    model = fit_text(rows, stated, sample)
    languages = model.languages
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def make():
        own = pickle.loads(shared.value)

        def step(batch):
            got = [own.log_likelihoods(t) for t in texts_of(batch)]
            return {
                "key": batch.column(0), "declared": batch.column(2), "host": batch.column(3), "spread": batch.column(4),
                **{c: batch.column(5 + i) for i, c in enumerate(carry)},
                "ll": [g[0].tolist() for g in got], "trigrams": [g[1] for g in got], "text_gain": [g[2] for g in got],
            }

        return step

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    more = "".join(f"{c} {kinds[c]}, " for c in carry)
    scored = map_batches(rows, ["key", "text", "declared", "host", F.xxhash64("key", "text"), *carry], f"key {kinds['key']}, declared string, host string, spread long, {more}ll array<double>, trigrams long, text_gain double", make)
    if not languages:
        return scored.select("key", *carry, F.lit("und").alias("lang"), F.lit(0.0).alias("posterior"), "declared", "text_gain", F.lit(False).alias("accepted"))
    total = hosts.agg(F.sum("n")).first()[0]
    sizes = hosts.groupBy("host").agg(F.sum("n").alias("n"))
    hot = [r["host"] for r in sizes.where(F.col("n") > max(1, total // HOT_SHARE)).collect()]
    joined = left_join(scored, cut(host_priors(hosts, stated), "priors"), "host", hot, F.col("spread"))
    size = len(languages)
    names = F.array(*[F.lit(x) for x in languages])
    right, wrong = float(np.log(TRUST)), float(np.log((1 - TRUST) / max(1, size - 1)))

    def fused(name: Column, i: Column) -> Column:
        same = F.col("declared") == name
        own = F.coalesce(same.cast("int"), F.lit(0))
        alone = F.greatest(F.get("counts", i) - own, F.lit(0)) + F.lit(HOST_WEIGHT) * F.get("domain_p", i)
        prior = F.coalesce(F.log(alone), F.lit(0.0))  # up to a constant of the host
        says = F.coalesce(F.when(same, F.lit(right)).otherwise(F.when(F.col("declared").isNotNull(), F.lit(wrong))), F.lit(0.0))
        return F.lit(TEMPER) * F.get("ll", i) + says + F.coalesce(F.get("suffix_logp", i), F.lit(0.0)) + prior

    logs = joined.select("key", *carry, "declared", "trigrams", "text_gain", F.transform(names, fused).alias("logs"))
    logs = logs.withColumn("top", F.array_max("logs"))
    best = F.element_at(names, F.array_position("logs", F.col("top")).cast("int"))
    posterior = 1 / F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    read = (F.col("trigrams") > 0) & ((F.col("text_gain") > 0) | (F.col("trigrams") < ENOUGH))
    return logs.select("key", *carry, F.when(read, best).otherwise("und").alias("lang"), posterior.alias("posterior"), "declared", "text_gain", (read & (posterior >= ACCEPT)).alias("accepted"))


def identify_documents(docs: DataFrame, sample: int = SAMPLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """The documents table: ``lang`` is what the source declares, ``source`` the host."""
    return language_id(docs, plain("doc_id"), plain("text"), F.lower(plain("lang")), plain("source"), sample, carry)


def identify_pages(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The pages table: declared by the markup, host and suffix from the address, text without markup."""
    return language_id(pages, plain("page_id"), html_text(plain("html")), html_declared(plain("html")), plain("url"), sample)


def keep_accepted(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of documents whose language is accepted, all columns unchanged; texts are not shuffled: see ``shared``."""
    docs = addressed(docs)
    rejected = identify_documents(docs, sample, (FILE, ROW)).where(~F.col("accepted"))
    return without(docs, rejected, docs.count(), "rejected")
