"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader (FTRL-Proximal)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridlake.llm.shared import map_batches, texts_of

BITS = 18
#: Labelled rows that training reads at most: those with the smallest hashes of their ids.  A documented bound;
#: scoring reads every row.
SAMPLE = 12_000
#: Features (words and pairs, each text's distinct ones) that training holds at most: of the sample, the documents in
#: the order of their hashes that fit.  Bounds the memory of the one task that trains.
FEATURES = 30_000_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Ftrl:
    """Parameters of FTRL-Proximal, and when to stop: once an epoch lowers the mean loss of the epoch before by less than
    ``settled`` of it, or after the epoch that reaches ``updates``."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01
    settled: float = 0.02
    updates: int = 100_000


class Hasher:
    """Texts to sparse vectors of hashed word uni- and bigrams.

    Words keep their case, runs of punctuation are words, and a word that equals the one before counts as
    "again", so that repetition of any word is one feature.  Counts go in as 1 + log, scaled to length 1.
    """

    def __init__(self, bits: int = BITS):
        self.shift, self.words = np.uint64(64 - bits), {}
        self.again = np.uint64(xxhash.xxh3_64_intdigest("\0again"))

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        known, tokens = self.words, _TOKEN.findall(text)
        if not tokens:
            return np.empty(0, np.int64), np.empty(0)
        if len(known) > 200_000:
            known.clear()
        ids = []
        for t in tokens:
            h = known.get(t)
            if h is None:
                h = known[t] = xxhash.xxh3_64_intdigest(t)
            ids.append(h)
        h = np.array(ids, dtype=np.uint64)
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        h = np.where(same, self.again, h)
        pairs = (h[:-1] * _MIX) ^ ((h[1:] * _MIX2) >> np.uint64(7))
        index, count = np.unique(np.concatenate([h * _MIX2, pairs * _MIX]) >> self.shift, return_counts=True)
        value = 1 + np.log(count)
        return index.astype(np.int64), value / np.sqrt((value * value).sum())


def train(vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], bits: int = BITS, how: Ftrl = Ftrl()) -> np.ndarray:  # noqa: B008
    """Weights (the last is the bias) after per-coordinate FTRL-Proximal updates in the given order, epoch by epoch.

    Both labels weigh alike, however many rows have them, so that 0.5 is the score where neither is likelier.
    """
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = (np.sign(zi) * how.l1 - zi) / ((how.beta + np.sqrt(n[i])) / how.alpha + how.l2)
        return np.where(np.abs(zi) <= how.l1, 0.0, w)

    bias = np.array([size - 1])
    rows = [(np.append(index, bias), np.append(value, 1.0), y) for (index, value), y in zip(vectors, labels, strict=True)]
    ones = sum(labels)
    weight = [len(labels) / (2 * max(1, len(labels) - ones)), len(labels) / (2 * max(1, ones))]
    done, before = 0, np.inf
    while rows:
        loss = 0.0
        for i, x, y in rows:
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            loss -= weight[y] * np.log(p if y else 1 - p)
            g = weight[y] * (p - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / how.alpha
            z[i] += g - sigma * w
            n[i] += g * g
        done += len(rows)
        if done >= how.updates or loss > (1 - how.settled) * before:
            break
        before = loss
    return weights(np.arange(size)).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 3) == 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS, features: int = FEATURES) -> np.ndarray | None:
    """Train on at most ``sample`` labelled documents outside the held-out third; None if no row has a label.

    The sampled ids (bounded) are broadcast to the scan of the documents, which are hashed where they are read, whole;
    one task then runs the sequential updates and sends 2^bits weights to the driver.  Of conflicting labels of an id
    the largest counts; of several documents with an id one (the least by its features) is learned from, so the rows of
    that task are bounded by ``sample`` and their size by ``features``.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def make():
        hasher = Hasher(bits)

        def step(batch):
            vectors = [hasher(t) for t in texts_of(batch)]
            return {"doc_id": batch.column(0), "label": batch.column(2), "i": [v[0].astype("<i4").tobytes() for v in vectors], "x": [v[1].astype("<f4").tobytes() for v in vectors]}

        return step

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    hashed = map_batches(joined, ["doc_id", "text", "label"], "doc_id long, label int, i binary, x binary", make)
    single = hashed.groupBy("doc_id").agg(F.min(F.struct("i", "x", "label")).alias("v")).select("doc_id", "v.label", "v.i", "v.x")
    kind = StructType.fromDDL("weights binary")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, given, held = [], [], 0
        for batch in batches:
            for label, i, x in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                held += len(i) // 4
                if held <= features:
                    vectors.append((np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(np.float64)))
                    given.append(label)
        if vectors:
            yield pa.RecordBatch.from_arrays([pa.array([train(vectors, given, bits).tobytes()], pa.binary())], schema=to_arrow_schema(kind))

    got = single.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(learn, kind).collect()
    return np.frombuffer(got[0]["weights"], np.float32) if got else None


def score(docs: DataFrame, weights: np.ndarray | None, bits: int = BITS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row: sparse dot products with the broadcast weights.

    Null and empty texts get the bias alone; without a model every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        hasher, own = Hasher(bits), shared.value

        def step(batch):
            dots = []
            for t in texts_of(batch):
                i, x = hasher(t)
                dots.append(0.0 if own is None else float(own[i] @ x) + float(own[-1]))
            return {"doc_id": batch.column(0), "score": 1 / (1 + np.exp(-np.clip(np.array(dots), -35, 35)))}

        return step

    rows = map_batches(docs, ["doc_id", "text"], "doc_id long, score double", make)
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, by a model of the labels; see ``fit``, ``score``.

    Null text counts as empty, a null id is never held out; repeated rows are scored alike; other columns are not read;
    an empty table gives no rows.  A text is hashed whole, in memory that follows its length.
    """
    return score(docs, fit(docs, labels))
