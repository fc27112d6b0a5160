"""Language id, WARC, quality, dedup, PII and the pipeline against brute force."""

import base64
import hashlib
import io
import random
import re
import zipfile
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlake.llm import exact, langid, neardup, pii, quality, warc

WORDS = {"en": "the of and to in is that was with for on as by".split(), "fr": "le la les des une dans que pour avec est sur".split(), "de": "der die das und nicht mit für auf ist ein".split()}


def prose(rng, lang="en", n=60):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "x", "ab", "zu"]) for _ in range(n))


# -- language id


def test_language_evidence(spark, make_docs):
    rng = random.Random(0)
    langs = [rng.choice(list(WORDS)) for _ in range(150)]
    texts = [prose(rng, x) for x in langs]
    docs = make_docs([*texts, None, "", "1234 %% 99", texts[0], "ab"], ids=[*range(150), None, 151, 152, 0, 154], langs=[*langs, None, "en", "en", langs[0], "fr"], sources=[*(f"www.{x}.example.{x}" for x in langs), None, "", "x", "y", "fr.example.fr"])
    rows = langid.identify_documents(docs).collect()
    by = {r.key: r for r in rows}
    assert len(rows) == 155
    assert np.mean([by[i].lang == x for i, x in enumerate(langs)]) > 0.97
    for k in (None, 151, 152):
        assert by[k].lang == "und" and not by[k].accepted
    assert by[154].lang == "fr" and by[154].accepted  # too short to tell: the other evidence decides
    kept = langid.keep_accepted(docs.withColumn("host", F.lit(1)).withColumn("ll", F.lit("x")))
    assert kept.columns == [*docs.columns, "host", "ll"] and kept.count() == sum(r.accepted for r in rows)
    assert langid.identify_documents(docs.limit(0)).count() == 0


def test_wrong_declaration_is_overruled(make_docs):
    rng = random.Random(1)
    langs = ["en", "fr"] * 40
    texts = [prose(rng, x, 80) for x in langs]
    declared = [*langs[:-1], "en"]  # the last one is French
    rows = {r.key: r for r in langid.identify_documents(make_docs(texts, langs=declared)).collect()}
    assert rows[79].lang == "fr"


def test_host_prior_decides_where_text_is_silent(make_docs):
    rng = random.Random(2)
    langs = ["en"] * 30 + ["fr"] * 30
    docs = make_docs([*(prose(rng, x) for x in langs), "qx", "qx"], langs=[*langs, None, None], sources=[*("a.example.com" if x == "en" else "b.example.org" for x in langs), "a.example.com", "b.example.org"])
    rows = {r.key: r for r in langid.identify_documents(docs).collect()}
    assert (rows[60].lang, rows[61].lang) == ("en", "fr")


def test_rare_languages_count_whatever_the_sample(make_docs):
    rng = random.Random(3)
    greek = "και το να της την είναι για με που στην"
    words = lambda: " ".join(rng.choice(greek.split()) for _ in range(60))
    texts = [*(prose(rng, "en", 30) for _ in range(600)), words(), words(), "qx"]
    docs = make_docs(texts, langs=["en"] * 600 + ["el", None, None], sources=["a.example.com"] * 600 + ["b.example.gr"] * 3)
    for sample in (20, langid.SAMPLE):
        rows = {r.key: r for r in langid.identify_documents(docs, sample).collect()}
        assert [(rows[i].lang, rows[i].accepted) for i in (600, 601)] == [("el", True)] * 2
        assert sum(rows[i].lang == "en" for i in range(600)) > 590
    assert langid.keep_accepted(docs, 20).where("doc_id in (600, 601)").count() == 2


def brute_languages(rows):
    """(key, text, declared, host) to {key: (lang, posterior)}, by plain loops over all rows."""
    import math

    def trigrams(text):
        raw = f" {text.lower()} ".encode()
        is_letter = [97 <= b <= 122 or b >= 128 for b in raw]
        folded = [b if ok else 32 for k, (b, ok) in enumerate(zip(raw, is_letter, strict=True)) if k == 0 or ok or is_letter[k - 1]]
        out = Counter()
        for a, b, c in zip(folded, folded[1:], folded[2:], strict=False):
            h = (a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA77 & 0xFFFFFFFF) ^ (c * 0xC2B2AE3D & 0xFFFFFFFF)
            h ^= h >> 15
            out[(h * 0x2C1B3C6D & 0xFFFFFFFF) >> 17] += 1
        return out if any(is_letter) else Counter()

    languages = sorted({d for _, _, d, _ in rows if d})
    stated = Counter(d for _, _, d, _ in rows if d)
    base = {x: stated[x] + 1.0 for x in languages}
    domain = lambda h: ".".join(h.split(".")[-2:])
    suffix = lambda h: h.rpartition(".")[2] if "." in h else ""
    counts = {x: Counter() for x in languages}
    level = {f: defaultdict(Counter) for f in ("host", "domain", "suffix")}
    for _, text, d, host in rows:
        if d:
            counts[d].update(trigrams(text))
        for f, name in (("host", host), ("domain", domain(host)), ("suffix", suffix(host))):
            level[f][name][d] += 1
    out = {}
    for key, text, d, host in rows:
        grams, logs, likely = trigrams(text), {}, {}
        for x in languages:
            ll = sum(n * float(np.float32(math.log((counts[x][g] + 0.01) / (sum(counts[x].values()) + 0.01 * 32768)))) for g, n in grams.items())
            own = level["domain"][domain(host)]
            p = (own[x] + 50 * base[x] / sum(base.values())) / (sum(own[y] for y in languages) + 50)
            says = 0 if not d else math.log(0.9) if d == x else math.log(0.1 / (len(languages) - 1))
            ending = level["suffix"][suffix(host)]
            share = math.log((ending[x] + 1) / (base[x] + len(level["suffix"]))) if suffix(host) else 0.0
            logs[x] = 0.25 * ll + says + share + math.log(max(0, level["host"][host][x] - (d == x)) + 20 * p)
            likely[x] = ll
        best = max(languages, key=lambda x: logs[x])
        n = sum(grams.values())
        read = n and (max(likely.values()) / n + math.log(32768) > 0 or n < 20)
        out[key] = (best if read else "und", 1 / sum(math.exp(v - logs[best]) for v in logs.values()))
    return out


def test_language_id_equals_brute_force(spark):
    rng = random.Random(4)
    langs = [rng.choice(list(WORDS)) for _ in range(60)]
    rows = [(i, prose(rng, x, rng.choice([1, 5, 60])), rng.choice([x, x, "en", None]), rng.choice([f"h{i % 4}.site.{x}", f"www{i % 3}.net", "plain", ""])) for i, x in enumerate(langs)]
    rows += [(60, "", "en", "plain"), (61, "999 --", None, ""), (62, "zq", None, "h1.site.fr"), (63, "qxqxqxqx " * 20, "de", "h2.site.de")]
    pages = spark.createDataFrame([(i, f"https://{h}/x?y", f"<html{f' lang={d}' if d else ''}><p>{t}</p></html>", 1.0) for i, t, d, h in rows], "page_id long, url string, html string, posterior double")
    got = {r.key: r for r in langid.identify_pages(pages).collect()}
    # markup leaves blanks, which fold into one; so the texts' trigrams are those of the text alone
    expected = brute_languages([(i, f"  {t}  ", d, h.removeprefix("www.")) for i, t, d, h in rows])
    assert {i: r.lang for i, r in got.items()} == {i: x for i, (x, _) in expected.items()}
    assert all(abs(got[i].posterior - p) < 1e-6 for i, (_, p) in expected.items())
    assert len({r.lang for r in got.values()}) == 4 and not got[60].accepted


def test_language_id_on_odd_rows(spark, make_docs):
    rng = random.Random(9)
    long = prose(rng, "fr", 200_000)
    docs = make_docs([long, prose(rng, "en"), prose(rng, "en"), None, None], ids=[1, 2, 2, 3, 3], langs=["fr", "en", "en", None, "en"]).withColumn("host", F.lit(1)).withColumn("declared", F.lit("x"))
    rows = langid.identify_documents(docs.unionByName(docs)).collect()
    assert len(rows) == 10 and Counter(r.lang for r in rows) == {"fr": 2, "en": 4, "und": 4}
    assert langid.keep_accepted(docs.unionByName(docs)).count() == 6
    assert langid.identify_documents(docs.where("lang is null")).collect()[0].lang == "und"


def test_markup_parts(spark):
    row = spark.createDataFrame([('<!DOCTYPE html><HTML class=a LANG="De-AT"><style>p{}</style><p>Wort<!-- x --></p>', "https://www.Sub.Example.co:8080/p?q#f")], "h string, u string")
    got = row.select(langid.html_declared(F.col("h")).alias("d"), F.trim(langid.html_text(F.col("h"))).alias("t"), langid.host_of(F.col("u")).alias("o")).withColumn("s", langid.suffix_of(F.col("o"))).withColumn("m", langid.domain_of(F.col("o"))).first()
    assert (got.d, got.t, got.o, got.s, got.m) == ("de", "Wort", "sub.example.co", "co", "example.co")


# -- WARC


@pytest.mark.parametrize("big", [False, True])
def test_zip_reader(big):
    members = [("a.txt", b"alpha"), ("é/b.bin", bytes(range(256)) * 9), ("empty", b"")]
    out = io.BytesIO()
    assert warc.write_zip(out, members, zip64=big) == len(out.getvalue())
    raw = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and [(i.filename, z.read(i)) for i in z.infolist()] == members
    reads = []
    reader = warc.ZipReader(lambda o, n: reads.append(n) or raw[o : o + n], len(raw))
    assert [(n, reader.read(n)) for n in reader.members] == members
    assert reader.read("é/b.bin", 10, 5) == members[1][1][10:15]


def test_zip_reader_on_foreign_archives():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("stored", b"x" * 50)
        z.writestr("packed", b"y" * 500, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"
    raw = out.getvalue()
    reader = warc.ZipReader(lambda o, n: raw[o : o + n], len(raw))
    assert reader.read("stored", 48) == b"xx"
    with pytest.raises(ValueError):
        reader.read("packed")
    with pytest.raises(ValueError):
        warc.ZipReader(lambda o, n: b"nothing"[o : o + n], 7)


def test_record_round_trip():
    raw = warc.record(7, "http://x/\r\n", b"a\r\n\r\nb", None)
    fields, body, http = warc.parse_record(raw)
    assert body == b"a\r\n\r\nb" and fields["warc-type"] == "response" and http["content-length"] == "6"
    fields, body, http = warc.parse_record(warc.record(8, None, b"xyz", 7))
    assert body == b"" and fields["warc-refers-to"] == "<urn:page:7>" and http["content-length"] == "3"


def test_warc_query(spark):
    htmls = ["<p>é</p>", None, "", "same", "same", "other", "same", "x" * 100_000]
    pages = spark.createDataFrame([(i, f"http://h/{i}" if i != 2 else None, h, 1) for i, h in enumerate(htmls)] + [(None, "u", "same", 1), (6, "again", "same", 1)], "page_id long, url string, html string, sha int")
    rows = warc.warc_round_trip(pages).collect()
    assert len(rows) == 10
    top = {}
    for i, h in enumerate(htmls):
        top[h or ""] = i
    for r in rows:
        text = "same" if r.page_id is None else htmls[r.page_id] or ""
        assert r.payload_bytes == len(text.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        holds = r.page_id == top[text]
        assert (r.record_type, r.refers_to) == (("response", None) if holds else ("revisit", top[text]))
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


# -- quality


def test_quality(spark, make_docs):
    rng = random.Random(5)
    good = [prose(rng) + "." for _ in range(150)]
    bad = [" | ".join(prose(rng, n=20).split()) if i % 2 else "buy " * 30 for i in range(80)]
    docs = make_docs([*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, 1 if i < 150 else 0, 0) for i in range(230)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(docs.withColumn("label", F.lit(3)), labels).collect()
    import zlib

    assert len(rows) == 232 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 230]
    assert np.mean([r.predicted == (r.doc_id < 150) for r in held]) > 0.95
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.quality_scores(docs, flipped).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)  # held-out labels have no influence
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_ftrl_equals_a_plain_loop():
    import math

    rng = np.random.default_rng(4)
    how = quality.Ftrl(settled=-1e9, updates=300)
    vectors = [(i, rng.random(len(i))) for i in (np.unique(rng.integers(0, 64, 8)) for _ in range(50))]
    labels = [int(rng.random() < 0.8) for _ in vectors]
    z, n, each = [0.0] * 65, [0.0] * 65, {y: 50 / (2 * labels.count(y)) for y in (0, 1)}

    def weight(k):
        if abs(z[k]) <= how.l1:
            return 0.0
        return (math.copysign(how.l1, z[k]) - z[k]) / ((how.beta + math.sqrt(n[k])) / how.alpha + how.l2)

    for _ in range(6):
        for (index, value), y in zip(vectors, labels, strict=True):
            x = dict(zip(index.tolist(), value.tolist(), strict=True)) | {64: 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = each[y] * (p - y) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / how.alpha * w[k]
                n[k] += g * g
    assert np.allclose(quality.train(vectors, labels, 6, how), [weight(k) for k in range(65)], atol=1e-6)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_held_out_quality_of_the_test_tables(spark, sf):
    import os

    if not os.path.isdir(f"/root/testdata/{sf}"):
        pytest.skip("needs the test tables")
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.98
    assert np.mean([r.predicted == 0 for r in held if r.quality == 0]) > 0.9


def test_quality_on_repeated_and_long_rows(spark, make_docs):
    rng = random.Random(6)
    texts = [*(prose(rng) + "." for _ in range(40)), *("buy " * 30 for _ in range(40)), prose(rng, n=100_000)]
    docs = make_docs(texts, ids=[*range(80), 0]).withColumn("score", F.lit("x")).withColumn("i", F.lit(0))
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)] + [(1, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    copies = docs.unionByName(docs.where("doc_id = 2")).unionByName(docs.where("doc_id = 2"))
    once, again = (quality.quality_scores(d, labels).collect() for d in (docs, copies))
    assert len(again) == len(once) + 2 and {(r.doc_id, r.score) for r in once} == {(r.doc_id, r.score) for r in again}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert quality.fit(docs, labels, features=1) is None  # a bound below every document leaves no sample


def test_ftrl_is_sparse_and_repeats():
    rng = np.random.default_rng(0)
    vectors = [(np.unique(rng.integers(0, 1 << 10, 20)), None) for _ in range(200)]
    vectors = [(i, np.full(len(i), len(i) ** -0.5)) for i, _ in vectors]
    y = [int(3 in i or i[0] % 2) for i, _ in vectors]
    a, b = quality.train(vectors, y, 10), quality.train(vectors, y, 10)
    assert (a == b).all() and (a == 0).any()
    assert (quality.train(vectors, y, 10, quality.Ftrl(l1=1e9)) == 0).all()


# -- exact dedup


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), st.integers(0, 9)), max_size=40))
def test_radix_trie(items):
    trie, expected = exact.RadixTrie(), {}
    for key, i in items:
        trie.insert(key, (i, 1, 1))
        expected.setdefault(key, []).append(i)
    got = dict(trie.terminals(trie.root))
    assert got == {k: (max(v), len(v), v.count(max(v))) for k, v in expected.items()}
    parts = defaultdict(list)
    while trie.root[1]:
        for key, owner in trie.spill():
            parts[key].append(owner)
    for key, owner in trie.drain():
        parts[key].append(owner)
    assert {k: v[0] for k, v in parts.items()} == got and trie.bytes == 0


@pytest.mark.parametrize("budget", [exact.BUDGET, 600])
def test_exact_groups(spark, make_docs, budget):
    texts = ["Abc", "aBC", "abc ", None, "", "É", "é", "x" * 3000, "X" * 3000, "abc", "abc"] + ["hot"] * 50
    ids = [*range(9), 9, 9, *range(100, 150)]
    docs = make_docs(texts, ids).withColumn("keep_id", F.lit(-1)).repartition(5)
    fold = lambda t: (t or "").encode().translate(exact.FOLD)
    groups = defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        groups[fold(t)].append(i)
    found = {r.text_sha256: r for r in exact.owners(docs, budget=budget).groupBy("text_sha256").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("n")).collect()}
    assert {k: (r.keep_id, r.n) for k, r in found.items()} == {hashlib.sha256(k).hexdigest(): (max(v), len(v)) for k, v in groups.items()}
    rows = exact.exact_groups(docs).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows) == sorted((i, max(groups[fold(t)]), len(groups[fold(t)]), i == max(groups[fold(t)]), hashlib.sha256(fold(t)).hexdigest()) for i, t in zip(ids, texts, strict=True))
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(v) for v in groups.values())
    assert exact.exact_groups(docs.limit(0)).count() == 0 and exact.drop_copies(docs.limit(0)).count() == 0


def test_decisions_reach_their_rows(spark, make_docs, tmp_path, monkeypatch):
    from gridlake.llm import shared

    monkeypatch.setattr(shared, "BLOCK_BITS", 3)  # many side files
    texts = [f"text {i % 37}" for i in range(400)]
    make_docs(texts).repartition(5).write.parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    assert shared.is_plain_read(docs) and not shared.is_plain_read(docs.repartition(2)) and not shared.is_plain_read(make_docs(["x"]))
    rows = shared.addressed(docs)
    gone = rows.where("doc_id % 3 = 0").select(shared.FILE, shared.ROW)
    assert sorted(r.doc_id for r in shared.without(rows, gone, 400, "gone").collect()) == [i for i in range(400) if i % 3]
    kept = exact.drop_copies(docs)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(363, 400))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan  # the pass over the texts moves nothing
    for stage in (neardup.drop_near, pii.sanitise, langid.keep_accepted):
        assert "Exchange" not in stage(docs)._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_are_dealt_out(spark):
    from gridlake.llm import shared

    rows = spark.range(3000).withColumn("k", F.when(F.col("id") < 1000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 700)))
    facts = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 'k5'")
    hot = shared.hot_keys(facts, "k", "n", 3000)
    joined = shared.left_join(rows, facts, "k", hot, F.col("id"))
    assert hot == ["hot"] and joined.count() == 3000
    assert joined.where("k = 'hot' and n = 1000").count() == 1000 and joined.where("n is null").count() == rows.where("k = 'k5'").count()


def test_exact_null_ids(make_docs):
    docs = make_docs(["a", "a", "b", "b"], ids=[None, 3, None, None])
    assert sorted(map(repr, ((r.doc_id, r.keep_id, r.kept) for r in exact.exact_groups(docs).collect()))) == sorted(map(repr, [(None, 3, False), (3, 3, True), (None, None, True), (None, None, True)]))
    assert exact.drop_copies(docs).count() == 2


# -- near dedup


def test_dart_signatures_estimate_weighted_jaccard():
    dart, rng = neardup.DartMinHash(2000), np.random.default_rng(3)
    units = rng.integers(0, 2**63, 300).astype(np.uint64)
    for lo in (0, 60, 150):
        a, b = units[:200], units[lo:250]
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((dart(a) == dart(b)).mean() - j) < 0.05
    w = rng.random(200) * 0.9 + 0.05
    v = np.clip(w * rng.uniform(0.5, 1.5, 200), 0.01, 1)
    j = np.minimum(w, v).sum() / np.maximum(w, v).sum()
    assert abs((dart(units[:200], w) == dart(units[:200], v)).mean() - j) < 0.05
    assert len(dart(units[:1])) == 2000 and (dart(units[:1]) == dart(units[:1])).all()


def brute_classes(texts):
    s = neardup.Shingler()
    sets = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        grams = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
        sets.append(grams)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for k in range(i):
            low, high = sum((sets[i] & sets[k]).values()), sum((sets[i] | sets[k]).values())
            if high and low >= 0.8 * high - 1e-9:
                a, b = find(i), find(k)
                parent[max(a, b)] = min(a, b)
    assert len(s.units(s.hashes("a b c d e f a b c d e"))) == 7
    return [find(i) for i in range(len(texts))]


def near_corpus(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for n in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 40, 150, 400]))]
        for _ in range(rng.choice([1, 1, 2, 6, 25 if n % 8 == 0 else 3])):
            own = list(base)
            for _ in range(rng.choice([0, 1, len(base) // 60, len(base) // 25])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    return [*texts, None, "", " . ", "one", "one", "two words"]


def test_near_classes_equal_brute_force(make_docs):
    texts = near_corpus()
    docs = make_docs(texts).withColumn("node", F.lit(0)).repartition(4)
    rows = {r.doc_id: r for r in neardup.classes(docs).collect()}
    expected = brute_classes(texts)
    assert [rows[i].class_id for i in range(len(texts))] == expected
    sizes = Counter(expected)
    assert all(rows[i].class_size == sizes[expected[i]] and rows[i].kept == (expected[i] == i) for i in range(len(texts)))
    kept = neardup.drop_near(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(expected))


def recall_of_queries(spark, sf):
    """Of the links at 0.8 or more between documents whose id is divisible by 50 and all others, by exact comparison of
    all their shingles: how many there are, and how many join documents of one class."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    grams, holds = {}, defaultdict(list)
    for r in rows:
        w = re.findall(r"\w+", (r.text or "").lower())
        grams[r.doc_id] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
        for g in grams[r.doc_id]:
            holds[g].append(r.doc_id)
    of = {r.doc_id: r.class_id for r in neardup.near_groups(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    links = found = 0
    for q in (i for i in grams if i % 50 == 0):
        shared = Counter()
        for g, n in grams[q].items():
            for i in holds[g]:
                shared[i] += min(n, grams[i][g])
        mine = grams[q].total()
        for i, both in shared.items():
            if i != q and both >= 0.8 * (mine + grams[i].total() - both) - 1e-9:
                links, found = links + 1, found + (of[i] == of[q])
    return links, found


def test_recall_on_the_test_tables(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("needs the test tables")
    links, found = recall_of_queries(spark, "/root/testdata/sf0.01")
    assert links > 0 and found == links


def test_large_bands_are_split(make_docs, monkeypatch):
    monkeypatch.setattr(neardup, "SPLIT", 2)
    texts = near_corpus(5)
    rows = {r.doc_id: r for r in neardup.classes(make_docs(texts).repartition(4)).collect()}
    assert [rows[i].class_id for i in range(len(texts))] == brute_classes(texts)


def test_near_dedup_on_long_and_repeated_rows(make_docs):
    rng = random.Random(8)
    long = prose(rng, n=120_000)
    docs = make_docs([long, long + " more", "x y z a b c", None], ids=[5, 6, 7, 8]).withColumn("class_id", F.lit("clash"))
    twice = docs.unionByName(docs)
    rows = neardup.near_groups(twice).collect()
    assert len(rows) == 8 and {r.doc_id: (r.class_id, r.class_size) for r in rows} == {5: (5, 4), 6: (5, 4), 7: (7, 2), 8: (8, 1)}
    kept = neardup.drop_near(twice)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [5, 7, 8, 8]


def test_near_edge_cases(make_docs):
    docs = make_docs(["a b c d e f g"] * 3 + ["A b c d e f g!"], ids=[4, 4, None, 9])
    rows = neardup.classes(docs).collect()
    assert {r.class_id for r in rows} == {4} and {r.class_size for r in rows} == {4}
    assert neardup.drop_near(docs).count() == 1
    assert neardup.near_groups(docs.limit(0)).count() == 0
    assert neardup.near_groups(make_docs(["only one document"])).count() == 1


def test_odd_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for n in (10, 500, 3000):
        a = np.unique(rng.integers(0, 2**32, n).astype(np.uint32))
        b = np.unique(np.concatenate([a[n // 5 :], rng.integers(0, 2**32, n // 6).astype(np.uint32)]))
        x, y = neardup.odd_sketch(a), neardup.odd_sketch(b)
        if len(x) == len(y):
            assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(np.setxor1d(a, b))


# -- PII

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a.b@-9 1+()2.%é\n", max_size=40))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_base_spans_on_documents(sample_texts):
    cards = "4111 1111 1111 1111 and 4111-1111-1111-1112, +1 (437) 555-0689 x a@b.c@d.e 1.2.3.4.5.6.7.8 256.1.1.1 00001.2.3.255"
    for t in [cards, *sample_texts]:
        assert pii.base_spans(t) == brute_spans(t)
    assert len(pii.base_spans("a" * 300_000 + " " + "1" * 300_000 + "@" * 1000)) == 0  # linear on freak texts


def pii_corpus():
    rng = random.Random(7)
    secret = [f"{prose(rng, n=4)} zephyrine handles mail for ann@corp{'x'}.example.com {prose(rng, n=4)} zephyrine" for _ in range(8)]
    return [*secret, *(prose(rng, n=40) for _ in range(200)), f"call +1 (437) 555-0689 now {prose(rng)}", None, "", secret[0]]


def test_disclosing_terms(make_docs):
    texts = pii_corpus()
    docs = make_docs(texts).withColumn("spans", F.lit("x")).repartition(3)
    rows = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        base = brute_spans(t or "")
        r = rows[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert r.spans.startswith(pii.joined(base))
        added = {(t or "")[int(s.split(":")[1]) : int(s.split(":")[2])] for s in r.spans.split(",") if s.startswith("term")}
        assert ("zephyrine" in added) == ("zephyrine" in (t or "")) and not added & set(WORDS["en"])
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    got = {r.doc_id: r for r in clean.collect()}
    assert "[EMAIL]" in got[0].text and "zephyrine" not in got[0].text and "ann@" not in got[0].text
    assert got[50].text == texts[50] and got[209].text is None and got[210].text == ""
    assert all(r.text is None or r.n_chars == len(r.text) for r in got.values())
    assert pii.find_pii(docs.limit(0)).count() == 0 and pii.sanitise(docs.limit(0)).count() == 0


def brute_added(texts):
    """Spans of disclosing terms per text, by plain loops."""
    import math

    found = []  # of each text: entities with their windows, and the words' places
    for t in texts:
        spans = pii.base_spans(t or "")
        free = "".join(" " if any(a <= k < b for _, a, b in spans) else c for k, c in enumerate(t or ""))
        words = [(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W\d_]{2,}", free)]
        near = []
        for kind, a, b in spans:
            raw = t[a:b]
            entity = kind + ":" + (raw.lower() if kind == "email" else re.sub(r"[^0-9]+", "." if kind == "ip" else "", raw))
            near.append((entity, [w for w, s, _ in words if s < a][-6:] + [w for w, s, _ in words if s >= b][:6]))
        found.append((near, words))
    contexts, holds = defaultdict(set), Counter()
    for t, (near, _) in zip(texts, found, strict=True):
        for entity, window in near:
            for w in window:
                contexts[entity, w].add(tuple(window))
        holds.update({w for w in re.split(r"[^\w]+|[\d_]+", (t or "").lower()) if len(w) > 1})
    of = defaultdict(set)
    for (entity, _), marks in contexts.items():
        of[entity] |= marks
    share = {}
    for (entity, w), marks in contexts.items():
        n_et, n_e, n_t = len(marks), len(of[entity]), max(holds[w], len(marks))
        n = max(len(texts), 2, n_t, n_e) + 1.0
        share[entity, w] = math.log((n_et + n_e / n) / (n_t + 1) * n / n_e) / math.log(n / n_e)
    out = []
    for near, words in found:
        top = {w: max((share.get((e, w), -1) for e, _ in near), default=-1) for w, _, _ in words}
        out.append(sorted((("term_removed" if top[w] >= pii.FULL else "term_generalised"), a, b) for w, a, b in words if top[w] >= pii.PARTIAL))
    return out


def test_added_spans_equal_brute_force(make_docs):
    rng = random.Random(21)
    rare = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{x}" for x in ("zent", "quillo", "vexor", "marnd", "plisk")]
    people = ["ann@corp.example.com", "Bob@corp.example.com", "10.1.2.3", "+1 (437) 555-0689", "4111 1111 1111 1111"]
    texts = [None, ""]
    for k in range(160):
        words = prose(rng, n=rng.choice([3, 12, 40])).split()
        if k % 8 == 0:  # each person has a word, which seldom stands elsewhere
            own = rng.randrange(5)
            words[1:1] = [people[own], rare[own], *(rare[rng.randrange(5)] for _ in range(k % 16 // 8))]
        if k % 16 == 1:
            words.append(rng.choice(rare))
        texts.append(" ".join(words))
    texts += texts[5:9]
    expected = brute_added(texts)
    rows = {r.doc_id: r for r in pii.find_pii(make_docs(texts).repartition(3)).collect()}
    for i, more in enumerate(expected):
        assert rows[i].spans == ",".join(filter(None, [pii.joined(brute_spans(texts[i] or "")), pii.joined(more)]))
    assert sum(map(len, expected)) > 20 and {k for x in expected for k, _, _ in x} == {"term_removed", "term_generalised"}


def test_copies_show_nothing(make_docs):
    text = "the rare quixotry belongs to joe@corp.example.com of the town"
    rows = pii.find_pii(make_docs([text] * 40 + ["the town of the belongs to"] * 20)).collect()
    assert not any("term" in r.spans for r in rows)


def test_rare_terms_disclose_at_first_sight(make_docs):
    rng = random.Random(11)
    once, twice = "the vexillary writes to solo@corp.example.com and is by", "quillon answers for +1 (437) 555-0689"
    texts = [once, f"{prose(rng, n=4)} {twice} {prose(rng, n=4)}", f"{prose(rng, n=4)} {twice} {prose(rng, n=4)}", *(prose(rng, n=40) for _ in range(200))]
    docs = make_docs(texts)
    spans = {r.doc_id: r.spans for r in pii.find_pii(docs).collect()}
    for i, term in ((0, "vexillary"), (1, "quillon"), (2, "quillon")):
        added = {texts[i][int(s.split(":")[1]) : int(s.split(":")[2])] for s in spans[i].split(",") if s.startswith("term")}
        assert term in added and not added & set(WORDS["en"])
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "vexillary" not in clean[0] and not any("quillon" in clean[i] for i in (1, 2))
    assert all(clean[i] == texts[i] for i in range(3, len(texts)))


def test_terms_are_taken_out_wherever_they_stand(make_docs):
    rng = random.Random(12)
    long = "q" * 300  # a word longer than any window of characters
    texts = [f"vexillary {prose(rng, n=60)} vexillary sees solo@corp.example.com is {long} {prose(rng, n=60)} Vexillary.", *(prose(rng, n=40) for _ in range(200))]
    texts.append(f"{prose(rng, n=40)} vexillary {prose(rng, n=40)} solo@corp.example.com")  # far from the entity here
    texts.append(f"{prose(rng, n=40)} vexillary")  # without the entity
    docs = make_docs(texts)
    clean = {r.doc_id: r.text.lower() for r in pii.sanitise(docs).collect()}
    assert not any("vexillary" in clean[i] or "corp" in clean[i] for i in (0, 201)) and "qq" not in clean[0]
    assert clean[202] == texts[202]
    spans = {r.doc_id: r.spans for r in pii.find_pii(docs).collect()}
    added = [texts[0][int(s.split(":")[1]) : int(s.split(":")[2])] for s in spans[0].split(",") if s.startswith("term")]
    assert sum(w.lower() == "vexillary" for w in added) == 3 and long in added and not set(added) & set(WORDS["en"])
    again = {r.doc_id: r.spans for r in pii.find_pii(make_docs([*texts, texts[0]], ids=[None, *range(1, 203), None])).collect()}
    assert again[None] == spans[0]


def test_rewrite_keeps_the_rest():
    text = "x a@b.cc y 1.2.3.4 z"
    assert pii.rewrite(text, pii.base_spans(text)) == "x [EMAIL] y [IP] z"
    assert pii.rewrite("abcdef", [("term_removed", 1, 3), ("email", 2, 4)]) == "a[EMAIL]ef"  # no part of the email stays
    assert pii.rewrite("abcdef", [("email", 1, 3), ("term_removed", 2, 5)]) == "a[EMAIL]f"
    host = "host 10.0.0.4 0003 2222 3333 444 end"
    assert pii.rewrite(host, [("ip", 5, 13), ("card", 12, 32)]) == "host [IP] end"


def test_overlapping_spans_are_masked_whole(make_docs):
    texts = ["Tel +1 555 123 4567 88bob@mail.com now", "card 4111 1111 1111 1111.ann@x.com"]
    assert [pii.rewrite(t, pii.base_spans(t)) for t in texts] == ["Tel [PHONE] now", "card [CARD]"]
    assert pii.cleaned("host 10.0.0.4 0003 2222 3333 444 end", []) == "host [IP] end"
    got = {r.doc_id: r.text for r in pii.sanitise(make_docs(texts)).collect()}
    assert all("@" not in t and "mail" not in t and "ann" not in t and not brute_spans(t) for t in got.values())


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a.b@-9 1+()2.%é\n", max_size=40))
def test_cleaned_texts_hold_no_base_span(text):
    assert not brute_spans(pii.cleaned(text, []))
    hidden = {i for _, a, b in pii.base_spans(text) for i in range(a, b)}
    kept = re.sub(r"\[[A-Z]+\]", "", pii.rewrite(text, pii.base_spans(text)))
    assert kept == "".join(c for i, c in enumerate(text) if i not in hidden)


def test_every_text_of_the_test_tables_is_clean(spark, sample_texts, make_docs):
    got = [r.text for r in pii.sanitise(make_docs(sample_texts)).collect()]
    assert len(got) == len(sample_texts) and any("[TERM]" in t for t in got) and not any(brute_spans(t) for t in got)


# -- pipeline


def test_stages_on_empty_and_odd_rows(spark, make_docs, tmp_path):
    import corpus_pipeline as P

    odd = make_docs([None, "", "   ", "the of and to in is that was with for on", "z" * 300_000], ids=[1, None, 3, 4, 4])
    for k, docs in enumerate((odd.limit(0), odd.unionByName(odd).withColumn("node", F.lit(1)))):
        for _, stage in P.STAGES[:-1]:
            assert stage(spark, docs, "").columns == docs.columns
            assert stage(spark, docs, "").count() <= docs.count()
        docs.write.parquet(f"file://{tmp_path}/{k}/documents.parquet")
        assert (P.run(spark, f"file://{tmp_path}/{k}").count() > 0) == bool(k)
    packed = P.STAGES[-1][1](spark, odd, "").collect()
    assert {r.doc_id for r in packed} == {None, 1, 3, 4}


def test_pipeline(spark, tmp_path):
    import os

    import corpus_pipeline as P

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the test tables")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in P.STAGES] == ["language ID", "exact dedup", "MinHash near-dedup", "PII", "best-fit packing"]
    states = []
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        stage(spark, docs, sf).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        states.append({r.doc_id: r.text for r in docs.collect()})
    language, single, near, clean = states
    assert len(language) >= 0.99 * len(before)
    fold = lambda t: t.encode().translate(exact.FOLD)
    top = {}
    for i in sorted(language):
        top[fold(language[i])] = i
    assert sorted(single) == sorted(top.values())
    ids = sorted(single)
    assert sorted(near) == sorted({ids[c] for c in brute_classes([single[i] for i in ids])})
    assert sorted(clean) == sorted(near) and not any(brute_spans(t) for t in clean.values())
    packed = P.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == set(clean)
