"""BPE, packing, edit-aware counts and media columns against brute force."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridlake.llm import bpe, counts, media, packing

ODD = [None, "", "  \n", "a<|endoftext|>b <|startoftext|>", "ΑΣ ΣΑΣ", "don't I'LL 's", "é é ﬀ İ", "x" * 5000, "日本語 😀 ok", "a b"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_codec_equals_library(tokenizers_path, sample_texts, name):
    path = tokenizers_path(name)
    library, own = Tokenizer.from_file(path), bpe.BytePairCodec(path)
    for text in [t or "" for t in ODD] + sample_texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x24F), max_size=40))
def test_codec_on_any_text(text):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert bpe.codec(path).encode(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_codec_on_every_character(tokenizers_path, name):
    path = tokenizers_path(name)
    library, own = Tokenizer.from_file(path), bpe.codec(path)
    texts = [f"a{c}b" for c in bpe.every_character()]
    for text, expected in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(text) == expected.ids


def test_digests_follow_the_decoder(tokenizers_path, sample_texts):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = tokenizers_path(name)
        library, own = Tokenizer.from_file(path), bpe.codec(path)
        for text in [t or "" for t in ODD] + sample_texts:
            ids = library.encode(text, add_special_tokens=False).ids
            assert own.digests(text) == (struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False).encode())


def test_words_come_back_from_the_old_generation():
    made = []
    words = bpe.Words(lambda w: made.append(w) or w.upper(), 2)
    assert [words[w] for w in "abcab"] == list("ABCAB") and made == list("abc")


def test_stale_entries_and_ties(tokenizers_path):
    own = bpe.codec(tokenizers_path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(tokenizers_path("byte_bpe_50k.json"))
    for word in ("aaaaaaaaa", "abababab", "thethethethe", "mississippi" * 20):
        assert own.encode(word) == library.encode(word).ids


def test_bpe_query(spark, make_docs, tokenizers_path):
    path = tokenizers_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = make_docs([*ODD, *ODD], ids=[None, *range(1, 20)]).withColumn("ids", F.lit(1))
    got = defaultdict(list)
    for r in bpe.bpe_digest(docs, path).collect():
        got[r.doc_id].append(r)
    for i, text in enumerate([*ODD, *ODD]):
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = got[i or None].pop()
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.bpe_digest(docs.limit(0), path).count() == 0
    assert bpe.bpe_encode(docs, path).where("doc_id = 3").first()["ids"] == library.encode(ODD[3], add_special_tokens=False).ids


def test_packing(spark, make_docs, tokenizers_path, sample_texts):
    path = tokenizers_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*ODD, *sample_texts, "word " * 9000, "again", "again"]
    ids = [None, *range(1, len(texts) - 1), len(texts) - 2]  # the last two rows are equal
    rows = packing.best_fit_packing(make_docs(texts, ids).withColumn("sequence_id", F.lit("clash")), path).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in zip(ids[:-2], texts[:-2], strict=True):
        own = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        found = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in found] == list(range(len(found))) and sum(r.length for r in found) == len(own)
        assert all(r.length == 2048 for r in found[1:])
        for r in found:
            assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
    assert len(by_doc[len(texts) - 2]) == 2
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // 2048) * 1.03 + 1
    assert packing.best_fit_packing(make_docs(["x"]).limit(0), path).count() == 0


def test_packing_keeps_ids_beside_null_ones(make_docs, tokenizers_path):
    ids = [2**53 + 1, None, 2**60 + 7, -(2**53) - 1]
    rows = packing.best_fit_packing(make_docs(["a", "b", "c", "a"], ids), tokenizers_path("byte_bpe_50k.json")).collect()
    assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_sum_of_squares_rule(sizes):
    """Each choice equals the least sum of squares over all possible ones."""
    packer, gaps = packing.SumOfSquares(20), {}
    for size in sizes:
        def cost(now):
            seen = defaultdict(int)
            for g in now.values():
                seen[g] += g > 0
            return sum(v * v for v in seen.values())

        choices = [cost({**gaps, k: g - size}) for k, g in gaps.items() if g >= size and (g < 20)] + [cost({**gaps, len(gaps): 20 - size})]
        number, _ = packer.place(size)
        gaps[number] = gaps.get(number, 20) - size
        assert gaps[number] >= 0 and cost(gaps) == min(choices)


@pytest.mark.parametrize("added", [True, False])
def test_count_tree_equals_full_count(tokenizers_path, added):
    path, r = tokenizers_path("byte_bpe_50k.json"), random.Random(3)
    words, library = counts.PreTokens(path, added), Tokenizer.from_file(path)
    library.encode_special_tokens = not added
    alphabet = [*"ab c'sred l  \n\n12.|é@ ve'll<|\u0c5c", *["<|endoftext|>"] * 2]
    for n in range(400):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(0, 900 if n % 20 == 0 else 30)))
        tree = counts.CountTree(text, words)
        for _ in range(8):
            assert tree.total == len(library.encode(text, add_special_tokens=False).ids) == words.full(text)
            a = r.randrange(0, len(text) + 1)
            b, new = min(len(text), a + r.randrange(0, r.choice([6, 6, 200]))), "".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 3, 60, 400])))
            text = text[:a] + new + text[b:]
            assert tree.replace(a, b, new) == words.full(text) and tree.text == text


def test_small_edits_encode_little(tokenizers_path):
    words = counts.PreTokens(tokenizers_path("byte_bpe_50k.json"))
    tree = counts.CountTree("some words of a text " * 5000, words)
    tree.replace(50_000, 50_003, "xyz")
    assert tree.encoded < 60


@pytest.mark.parametrize("added", [True, False])
def test_counts_query(spark, make_docs, tokenizers_path, sample_texts, added):
    path = tokenizers_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = not added
    texts = [*ODD, "  <|endoftext|>!!<|endoftext|>x", "w" * 300_000, "many words " * 30_000, *sample_texts]
    docs = make_docs(texts).withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r for r in counts.edit_counts(docs.unionByName(docs.where("doc_id < 12")), path, added=added).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        edited = counts.apply_edits(t, counts.standard_edits(t))
        assert got[i].n_tokens == len(library.encode(t, add_special_tokens=False).ids)
        assert got[i].n_tokens_edited == len(library.encode(edited, add_special_tokens=False).ids)
    docs = make_docs(["hello world", None]).withColumn("edits", F.expr("if(doc_id = 0, array(named_struct('start', 0, 'end', 5, 'text', 'bye'), named_struct('start', 90, 'end', 99, 'text', '!')), null)"))
    rows = {r.doc_id: r for r in counts.edit_counts(docs, path, "edits").collect()}
    assert rows[0].n_tokens_edited == len(library.encode("bye world!").ids) and rows[1].n_edits == 0
    assert counts.edit_counts(docs.limit(0), path).count() == 0


def test_media_formats():
    rng = np.random.default_rng(0)
    for shape in ((5, 7), (3, 4, 3), (1, 1), (64, 64)):
        image = rng.integers(0, 256, shape, np.uint8)
        assert (media.decode(media.encode_pgm(image)) == image).all()
        back = media.decode(media.encode_bmp(image))
        assert (back == image).all()
    assert (media.decode(b"P2\n# c\n2 2\n255\n0 1\n2 255\n") == [[0, 1], [2, 255]]).all()
    assert (media.decode(b"P1\n3 1\n1 0 1\n") == [[0, 255, 0]]).all()
    assert (media.decode(b"P4\n9 1\n" + bytes([0b10000000, 0b10000000])) == [[0, 255, 255, 255, 255, 255, 255, 255, 0]]).all()
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02")[0, 0] == 258
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_area_resize_is_the_exact_mean():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (10, 6)).astype(np.uint8)
    fine = np.kron(image.astype(float), np.ones((8, 9)))  # 80 x 54 splits evenly into 8 x 9
    expected = fine.reshape(8, 10, 9, 6).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, 8, 9), expected)
    assert np.load(__import__("io").BytesIO(media.npy_tile(image))).shape == (16, 16)
    ramp = np.tile(np.arange(90, dtype=np.uint8), (16, 1))
    assert media.difference_hash(ramp) == "f" * 16 and media.difference_hash(ramp[:, ::-1]) == "0" * 16


def plain_resize(image, height, width):
    """Each target cell's mean by loops over the pixels that it touches."""
    h, w = image.shape
    out = np.zeros((height, width))
    part = lambda k, n, parts, i: max(0.0, min(k + 1, (i + 1) * n / parts) - max(k, i * n / parts))
    for i in range(height):
        for j in range(width):
            ys = [(y, part(y, h, height, i)) for y in range(h)]
            xs = [(x, part(x, w, width, j)) for x in range(w)]
            out[i, j] = sum(a * b * float(image[y, x]) for y, a in ys if a for x, b in xs if b) / (h * w / height / width)
    return out


def test_features_equal_a_plain_version(spark, make_docs, monkeypatch):
    import io

    texts = ["", None, "some words " * 9, "é" * 500, "".join(chr(33 + k * 7 % 90) for k in range(1500))]
    for r in media.media_columns(make_docs(texts)).collect():
        image = np.frombuffer(media.payload_of(texts[r.doc_id])[1], np.uint8).reshape(-1, 64)
        small = np.round(plain_resize(image, 8, 9), 6)
        bits = "".join("01"[int(a < b)] for row in small for a, b in zip(row, row[1:]))  # noqa: B905
        tile = np.clip(np.round(plain_resize(image, 16, 16)), 0, 255).astype(np.uint8)
        out = io.BytesIO()
        np.save(out, tile)
        assert r.tile == out.getvalue()
        assert r.feature == f"dhash:{int(bits, 2):016x};tile:{hashlib.sha256(out.getvalue()).hexdigest()[:16]}"


def test_resizing_by_strips_changes_nothing(monkeypatch):
    image = np.random.default_rng(5).integers(0, 256, (1000, 64), np.uint8)
    whole = media.area_resize(image, 16, 16)
    for strip in (1, 7, 999, 1000):
        monkeypatch.setattr(media, "STRIP", strip)
        assert (media.area_resize(image, 16, 16) == whole).all()


def test_large_images_need_little_memory():
    import tracemalloc

    image = np.zeros((400_000, 64), np.uint8)
    tracemalloc.start()
    media.difference_hash(image)
    assert tracemalloc.get_traced_memory()[1] < image.size / 2
    tracemalloc.stop()


def test_bmp_masks():
    head = lambda bits, packing, more: b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + len(more)) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, bits, packing, 0, 0, 0, 0, 0) + more
    pixels = struct.pack("<II", 0x11223344, 0xFFEEDDCC)
    assert media.decode(head(32, 3, struct.pack("<III", 0xFF, 0xFF00, 0xFF0000)) + pixels).tolist() == [[[0x44, 0x33, 0x22], [0xCC, 0xDD, 0xEE]]]
    assert media.decode(head(32, 3, struct.pack("<III", 0xFF000000, 0xFF0000, 0xFF00)) + pixels).tolist() == [[[0x11, 0x22, 0x33], [0xFF, 0xEE, 0xDD]]]
    assert media.decode(head(16, 0, b"") + struct.pack("<HH", 0x7C00, 0x001F)).tolist() == [[[255, 0, 0], [0, 0, 255]]]
    assert media.decode(head(16, 3, struct.pack("<III", 0xF800, 0x07E0, 0x001F)) + struct.pack("<HH", 0x07E0, 0xF800)).tolist() == [[[0, 255, 0], [255, 0, 0]]]
    with pytest.raises(ValueError):
        media.decode(head(32, 3, struct.pack("<III", 0, 1, 2)) + pixels)


def test_media_query(spark, make_docs):
    texts = [*ODD, "y" * 64, "z" * 65, "same", "same"]
    rows = {r.doc_id: r for r in media.media_columns(make_docs(texts).withColumn("media", F.lit(1))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes > r.payload_bytes
    assert rows[len(texts) - 1].feature == rows[len(texts) - 2].feature
    docs = make_docs(texts).where("doc_id < 3")
    assert media.media_columns(docs.unionByName(docs)).groupBy("doc_id", "media_sha256", "feature").count().where("count = 2").count() == 3
    assert media.media_columns(make_docs(["x"]).limit(0)).count() == 0


def test_op8_writes_the_tiles(spark, make_docs, tmp_path):
    import glob
    import io

    from gridlake.llm import queries, shared

    make_docs(["some text", "", None]).write.parquet(f"file://{tmp_path}/documents.parquet")
    folder = shared.shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/gridlake/tiles-*"))
    rows = {r.doc_id: r for r in queries.op8_media(spark, f"file://{tmp_path}").collect()}
    (new,) = set(glob.glob(f"{folder}/gridlake/tiles-*")) - before
    tiles = {r.doc_id: r.tile for r in spark.read.parquet(f"file://{new}").collect()}
    assert set(tiles) == set(rows) == {0, 1, 2} and "tile" not in rows[0]
    for i, tile in tiles.items():
        assert np.load(io.BytesIO(tile)).shape == (16, 16)
        assert rows[i].feature.endswith(f"tile:{hashlib.sha256(tile).hexdigest()[:16]}")
