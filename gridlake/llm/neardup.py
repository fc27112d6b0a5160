"""MinHash near-dedup by DartMinHash signatures, banded candidates, exact verification and connected components.

A document is the multiset of its five-word shingles; similarity is weighted Jaccard (sum of minima over sum of
maxima).  Every occurrence of a shingle is a region of unit weight into which darts are thrown: a Poisson process
over (weight, rank) that depends on the shingle alone, so equal regions of two documents hold equal darts.  Each
dart belongs to one coordinate; a coordinate keeps its earliest dart, and two documents agree in a coordinate with
probability equal to their similarity.

No pairs are emitted within a bucket but (member, representative), the representative being the member with most
bucket mates over all bands.  Only where the verified links leave a bucket in several components are the members
outside its largest component compared with the rest, inside the join and behind two filters: differing bits of the
signatures (passes true pairs with probability above 1 - 1e-6) and odd sketches, whose differing bits never exceed the
symmetric difference (passes every true pair).
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.shared import FILE, ROW, addressed, cut, drop_folder, hot_keys, in_few_files, left_join, map_batches, plain, texts_of, without

SHINGLE, THRESHOLD = 5, 0.8
#: Bands x rows coordinates: a pair at 0.8 shares no band with probability 3e-6.
BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
#: Most differing bits of the two 160-bit sketches: at 0.8, 16 are expected with deviation 3.8.
HAMMING = 38
#: Members of a band beside its main component that one task compares with the rest of the band.
SPLIT = 512
_WORD = re.compile(r"\w+")
_U = np.uint64
_C1, _C2, _C3 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _C1
    x = (x ^ (x >> _U(27))) * _C2
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """64-bit hashes of words, kept as they are met."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


class Shingler:
    """Texts to word hashes, and those to the hashed units (shingle, occurrence) of the shingle multiset."""

    def __init__(self) -> None:
        self.words = WordHashes()

    def hashes(self, text: str) -> np.ndarray:
        if len(self.words) > 200_000:
            self.words.clear()
        found = _WORD.findall(text.lower())
        return np.fromiter(map(self.words.__getitem__, found), np.uint64, len(found))

    @staticmethod
    def units(h: np.ndarray) -> np.ndarray:
        """Fewer words than a shingle has are one shingle; no words have no units."""
        n = len(h)
        if not n:
            return h
        m = max(1, n - SHINGLE + 1)
        s = np.zeros(m, np.uint64)
        for j in range(min(SHINGLE, n)):
            s += mix(h[j : j + m] + _PLACE[j]) * _PLACE[j]
        s = mix(s)
        s.sort()
        fresh = np.ones(m, bool)
        fresh[1:] = s[1:] != s[:-1]
        first = np.flatnonzero(fresh)
        occurrence = np.arange(m) - np.repeat(first, np.diff(np.append(first, m)))
        return mix(s + occurrence.astype(np.uint64) * _C3)


class DartMinHash:
    """Signatures of ``k`` coordinates from darts in (weight, rank) cells; rank cells double from level to level.

    The number of darts in a cell is Poisson.  All levels that a weight is expected to need are thrown in one pass:
    the levels' distribution functions stand one behind the other, level ``i`` between ``i`` and ``i + 1``.
    """

    FIRST, LEVELS = 2.0**-6, 26

    def __init__(self, k: int = COORDINATES):
        self.k = k
        self.aim = k * (np.log(k) + 2)
        self.high = self.FIRST * 2.0 ** np.arange(self.LEVELS)
        self.low = np.concatenate([[0.0], self.high[:-1]])
        self.seeds = mix(np.arange(1, self.LEVELS + 1, dtype=np.uint64) * _C3)
        self.cdf, self.first = np.empty(0), np.empty(0, np.int64)

    def tables(self, levels: int) -> None:
        """Distribution functions up to so many levels."""
        while len(self.first) < levels:
            at = len(self.first)
            mean = float(self.high[at] - self.low[at])
            log_terms = np.arange(1, int(mean + 12 * np.sqrt(mean) + 40))
            log_terms = np.concatenate([[0.0], np.cumsum(np.log(mean / log_terms))]) - mean
            cdf = np.minimum(np.cumsum(np.exp(log_terms)), 1.0)
            self.first = np.append(self.first, len(self.cdf))
            self.cdf = np.concatenate([self.cdf, at + cdf[cdf < 1 - 1e-13], [at + 1.0]])

    def throw(self, units: np.ndarray, weights: np.ndarray | None, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranks, hashes and coordinates of the darts of levels ``start`` to ``stop``."""
        self.tables(stop)
        h = mix(units[None, :] ^ self.seeds[start:stop, None])
        place = (h >> _U(11)) * 2.0**-53 + np.arange(start, stop)[:, None]
        count = np.searchsorted(self.cdf, place, side="right") - self.first[start:stop, None]
        level, unit = np.nonzero(count)
        c = count[level, unit]
        number = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        dart = mix(np.repeat(h[level, unit], c) + (number.astype(np.uint64) + _U(1)) * _C3)
        level, unit = np.repeat(level + start, c), np.repeat(unit, c)
        if weights is not None:
            inside = (mix(dart ^ _C2) >> _U(11)) * 2.0**-53 < weights[unit]
            dart, level = dart[inside], level[inside]
        rank = self.low[level] + (self.high[level] - self.low[level]) * ((mix(dart ^ _C1) >> _U(11)) * 2.0**-53)
        return rank, dart, ((dart >> _U(33)) % _U(self.k)).astype(np.int64)

    def __call__(self, units: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Earliest dart's hash for each coordinate.  ``weights`` (at most 1 each; None: 1) cut a unit's region."""
        mass = float(len(units) if weights is None else weights.sum())
        best_rank, best = np.full(self.k, np.inf), np.zeros(self.k, np.uint64)
        start, stop = 0, min(self.LEVELS - 1, int(np.searchsorted(self.high, self.aim / mass))) + 1
        while True:
            rank, dart, where = self.throw(units, weights, start, stop)
            np.minimum.at(best_rank, where, rank)
            won = rank == best_rank[where]
            best[where[won]] = dart[won]
            if np.isfinite(best_rank).all():
                return best
            if stop == self.LEVELS:  # weights too small for the levels there are
                raise ValueError("the weights are too small")
            start, stop = stop, stop + 1


@lru_cache(maxsize=1)
def darts() -> DartMinHash:
    return DartMinHash()


def bands_of(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, the band's number mixed in."""
    rows = signature.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _C3
    for j in range(ROWS):
        key = mix(key ^ rows[:, j])
    return key.view(np.int64)


def sketch_bits(signature: np.ndarray) -> np.ndarray:
    """A bit of each coordinate, in three 64-bit numbers."""
    bits = np.zeros(192, np.uint8)
    bits[:COORDINATES] = (signature & _U(1)).astype(np.uint8)
    return np.packbits(bits).view(">i8").astype(np.int64)


def odd_sketch(units: np.ndarray) -> np.ndarray:
    """Bits that an odd number of units falls on, at least 1024 and about as many as units; as 64-bit numbers."""
    size = 1024
    while size < len(units):
        size *= 2
    odd = np.bincount(units & np.uint32(size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_SKETCH = f"doc_id long, {FILE} long, {ROW} long, node long, first boolean, n int, s0 long, s1 long, s2 long, odd array<long>, bands array<long>, units array<int>"


def sketches(docs: DataFrame) -> DataFrame:
    """One row per document; ``node`` stands for its sequence of words, null if it has none.  Bands and units come
    with the first row of a node in each task only, so copies cost a few numbers each."""

    def make():
        shingler, dart, seen = Shingler(), darts(), set()

        def step(batch):
            out = {k: [] for k in ("node", "first", "n", "s0", "s1", "s2", "odd", "bands", "units")}
            for text in texts_of(batch):
                h = shingler.hashes(text)
                node = xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63) if len(h) else None
                row = (node, False, None, None, None, None, None, None, None)
                if node is not None and node not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(node)
                    u = shingler.units(h)
                    signature = dart(u)
                    small = np.unique((u >> _U(32)).astype(np.uint32))
                    row = (node, True, len(small), *sketch_bits(signature).tolist(), odd_sketch(small), bands_of(signature), small.view(np.int32))
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            return {"doc_id": batch.column(0), FILE: batch.column(2), ROW: batch.column(3)} | out

        return step

    return map_batches(docs, [plain("doc_id").cast("long").alias("doc_id"), plain("text").alias("text"), FILE, ROW], _SKETCH, make)


def _near(a: str, b: str):
    """The cheap conditions that every pair at the threshold meets: sizes, and the differing bits of both sketches.

    At similarity t or more the symmetric difference is at most (1 - t) / (1 + t) of the sizes' sum; odd sketches of
    different lengths (sizes on two sides of a power of two) are not compared."""
    sizes = F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) >= THRESHOLD * F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n")) - 2
    bits = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(3)), F.lit(0))
    odd = F.aggregate(F.zip_with(f"{a}.odd", f"{b}.odd", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, x: t + x)
    most = (1 - THRESHOLD) / (1 + THRESHOLD) * (F.col(f"{a}.n") + F.col(f"{b}.n")) + 1e-6
    return sizes & (bits <= HAMMING) & ((F.size(f"{a}.odd") != F.size(f"{b}.odd")) | (odd <= most))


def verify(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""
    left = pairs.join(units.select(F.col("node").alias("a"), F.col("units").alias("ua")), "a")
    both = left.join(units.select(F.col("node").alias("b"), F.col("units").alias("ub")), "b")
    shared = F.size(F.array_intersect("ua", "ub"))
    return both.where(shared >= THRESHOLD * (F.size("ua") + F.size("ub") - shared) - 1e-9).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` (the component's least node) by alternating large and small stars; lineage is cut each round."""
    spark = edges.sparkSession
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(edges, "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        old, edges = edges, cut(in_few_files(small, state[0]) if state else small, "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).collect()[0]
        for path in {p.rpartition("/")[0] for p in old.inputFiles()}:
            drop_folder(spark, path)
        if (now["n"], now["h"]) == state:
            break
        state = now["n"], now["h"]
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def groups_of(sketched: DataFrame) -> DataFrame:
    """``node, label`` of the nodes that have verified links: the components of all candidate pairs at the threshold.

    The links to representatives give components first; links that cross these are then between labels, a graph of the
    few components that they join.  Units are shuffled once, to keep those of documents that share a band; what follows reads only these.
    """
    firsts = sketched.where("first")
    placed = firsts.select("node", F.explode("bands").alias("band"))
    shared = placed.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("top"), F.count("*").alias("mates")).where("least <> top").select("band", "mates")
    members = cut(placed.join(shared, "band").distinct(), "members")
    central = members.groupBy("node").agg(F.sum("mates").alias("centre"))
    reps = members.join(central, "node").groupBy("band").agg(F.max_by("node", F.struct("centre", "node")).alias("rep"))
    members = cut(members.select("band", "node").join(reps, "band"), "members")
    tried = members.where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b")).distinct()
    tried = cut(tried, "tried")
    involved = members.select("node").distinct()
    # merged at every size: whether a side happens to fit a broadcast must not change what is shuffled
    kept = firsts.select("node", "n", "s0", "s1", "s2", "odd", "units").join(involved.hint("merge"), "node", "left_semi")
    kept = cut(kept.dropDuplicates(["node"]), "facts")
    facts, units = kept.drop("units"), kept.select("node", "units")
    fa, fb = facts.alias("x"), facts.alias("y")
    likely = tried.join(fa, tried["a"] == F.col("x.node")).join(fb, tried["b"] == F.col("y.node")).where(_near("x", "y")).select("a", "b")
    found = cut(verify(likely, units), "links")
    labels = cut(components(found), "components")
    if tried.isEmpty():
        return labels
    labelled = members.select("band", "node").join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    labelled = cut(labelled, "labelled")
    spread = labelled.groupBy("band", "label").agg(F.count("*").alias("n_label"))
    mixed = spread.groupBy("band").agg(F.count("*").alias("labels"), F.sum("n_label").alias("n"), F.max("n_label").alias("most"), F.max_by("label", F.struct("n_label", "label")).alias("main")).where("labels > 1")
    # a band's members outside its main component are split, so that no task compares more than so many with the band
    mixed = cut(mixed.select("band", "main", "n", F.ceil((F.col("n") - F.col("most")) / F.lit(SPLIT)).cast("int").alias("parts")), "bands")
    hot = hot_keys(mixed, "band", "n", labelled.count())
    rest = left_join(labelled, mixed.drop("n"), "band", hot, F.col("node")).where(F.col("main").isNotNull())
    rest = cut(rest.join(facts, "node"), "mixed")
    x = rest.where("label <> main").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).alias("x")
    y = rest.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    crossing = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.label") != F.col("y.label")) & _near("x", "y"))
    crossing = crossing.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
    crossing = cut(crossing.join(tried, ["a", "b"], "left_anti"), "crossing")
    if crossing.isEmpty():
        return labels
    more = cut(verify(crossing, units), "more")
    ends = more.select(F.col("a").alias("node")).unionByName(more.select(F.col("b").alias("node"))).distinct()
    labels = cut(labels.unionByName(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))), "components")
    of = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    between = more.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(of, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    joined = components(between).select(F.col("node").alias("label"), F.col("label").alias("whole"))
    return labels.join(joined, "label", "left").select("node", F.coalesce("whole", "label").alias("label"))


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, FILE, ROW, node, class_id, class_size, kept`` for every row.

    ``class_id`` is the least doc_id of the class, nulls last; the row that has it is kept, of several the one with the
    least address.  Documents with the same words are one class; those without words are a class each.  Null text is
    empty; an empty table gives no rows.
    """
    docs = addressed(docs)
    sketched = cut(sketches(docs), "sketches")
    labels = groups_of(sketched)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", FILE, ROW)).alias("first")
    nodes = sketched.where("node is not null").groupBy("node").agg(first, F.count("*").alias("rows"))
    nodes = cut(nodes.join(labels, "node", "left").select("node", "first", "rows", F.coalesce("label", "node").alias("label")), "nodes")
    groups = nodes.groupBy("label").agg(F.min("first").alias("keeper"), F.sum("rows").alias("class_size")).where("class_size > 1")
    known = nodes.join(groups, "label").select("node", "keeper", "class_size")
    rows = sketched.select("doc_id", FILE, ROW, "node")
    rows = left_join(rows, known, "node", hot_keys(nodes, "node", "rows", docs.count()), F.col(ROW))
    alone = F.col("class_size").isNull()
    kept = alone | ((F.col(FILE) == F.col("keeper")[FILE]) & (F.col(ROW) == F.col("keeper")[ROW]))
    return rows.select("doc_id", FILE, ROW, "node", F.when(alone, F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), kept.alias("kept"))


def near_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, class_size, kept`` for every row; see ``classes``.

    Repeated rows are members like others; other columns are not read.  A text is shingled whole, in memory that
    follows its length.
    """
    return classes(docs).select("doc_id", "class_id", "class_size", "kept")


def drop_near(docs: DataFrame) -> DataFrame:
    """The rows that stay: one of each class, all columns unchanged.  Texts are not shuffled: see ``shared``."""
    docs = addressed(docs)
    return without(docs, classes(docs).where(~F.col("kept")), docs.count(), "near")
