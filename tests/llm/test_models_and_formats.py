"""Edge cases and brute force for models, tokens and file formats."""
import base64
import hashlib
import math
import struct
import time
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from genoloom.llm import bpe, langid, media, ppm, quality, warc, webp


def docs(spark, rows, more=""):
    return spark.createDataFrame(rows, f"doc_id long, text string{more}")


# --- archives ---

def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_archives_hold_what_was_written(spark, tmp_path):
    big = "<p>x</p>" * 40
    rows = [(5, "http://a/é?q=1\r\nX: y", big, "z"), (3, None, big, "z"), (3, None, big, "z"), (None, "u", big, "z"), (8, "u", None, "z"), (9, "u", "", "z"), (10, "u", "short", "z"), (11, "u", "short", "z"), (12, "u", "ü" * 70000, "z")]
    manifest = warc.write_archives(warc.page_records(pages(spark, rows)), f"file://{tmp_path}/a", archive_bytes=300, sample_bytes=400)
    got = {}
    for r in warc.read_archives(manifest).collect():
        got.setdefault(r["record_id"].rpartition(":")[2], []).append((r["record_type"], r["refers_to"], r["payload_bytes"], None if r["payload"] is None else bytes(r["payload"]).decode(), r["target_uri"]))
    assert got["3"] == [("response", None, 320, big, None)] * 2
    assert got["5"] == [("revisit", "urn:x-page:3", 320, None, "http://a/%C3%A9?q=1%0D%0AX:%20y")] and got[""][0][:2] == ("revisit", "urn:x-page:3")
    assert got["8"][0][3] == got["9"][0][3] == "" and got["10"][0][0] == got["11"][0][0] == "response"
    assert got["12"][0][2] == 140000
    assert sum(r["n_records"] for r in manifest.collect()) == len(rows)
    empty = warc.write_archives(warc.page_records(pages(spark, [])), f"file://{tmp_path}/b")
    assert warc.read_archives(empty).count() == 0


def test_dictionary_frame_is_loaded_and_faults_are_found():
    import io

    records = [warc.record_bytes(f"urn:{i}", "http://a", f"<html>{i} common words</html>".encode() * 20, __import__("hashlib").sha256(f"<html>{i} common words</html>".encode() * 20).hexdigest(), None, "2000-01-01T00:00:00Z") for i in range(400)]
    trained = warc.trained_dictionary(records, 2048)
    assert trained is not None
    pack = zstandard.ZstdCompressor(dict_data=trained).compress
    raw = trained.as_bytes()
    for body in (raw, zstandard.ZstdCompressor().compress(raw)):
        data = struct.pack("<II", warc.DICTIONARY_FRAME, len(body)) + body + pack(records[0]) + struct.pack("<II", warc.SKIPPABLE + 3, 2) + b"no" + pack(records[1])
        assert list(warc.frames(io.BytesIO(data))) == records[:2]
        for cut in (2, 7, 30, len(data) - 3):
            with pytest.raises(Exception):
                list(warc.frames(io.BytesIO(data[:cut])))
    good = records[0]
    for bad in (good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARC/9.1"), good.replace(b"WARC-Date", b"Other"), good.replace(b"common", b"commen"), good.replace(b"Content-Length: ", b"Content-Length: 1", 1), b""):
        with pytest.raises(ValueError):
            warc.parsed(bad)
    assert warc.parsed(good)["record_type"] == "response"


# --- images ---

def stream(image, transforms, cache_bits=5):
    """A stream of one image with the transforms, each computed pixel by pixel from the definition."""
    height, width = image.shape
    F_, one = webp.Fields, np.array([1])
    parts = [*webp._header(width, np.array([height]))]
    rng = np.random.default_rng(9)
    for name in transforms:
        tiles = (-(-height // 4), -(-image.shape[1] // 4))
        if name == "predict":
            modes = rng.integers(0, 14, tiles).astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)
            c, out = webp._channels(image).astype(int), np.zeros((*image.shape, 4), int)
            for y in range(height):
                for x in range(image.shape[1]):
                    if y == 0:
                        guess = c[0, x - 1] if x else np.array([0, 0, 0, 255])
                    elif x == 0:
                        guess = c[y - 1, 0]
                    else:
                        guess = webp.predicted(int(modes[y >> 2, x >> 2] >> 8 & 15), c[y, x - 1], c[y - 1, x], c[y - 1, x + 1] if x + 1 < image.shape[1] else c[y, 0], c[y - 1, x - 1])
                    out[y, x] = (c[y, x] - guess) & 255
            image = webp._pixels(out)
            parts += [F_.fixed(1, 1 | webp.PREDICTOR << 1 | 0 << 3, 6), webp.entropy_fields(modes.ravel(), one * modes.size, 0, False)]
        elif name == "cross":
            elements = rng.integers(0, 2**32, tiles).astype(np.uint32)
            image = webp.cross_colour(image, elements, 2, -1)
            parts += [F_.fixed(1, 1 | webp.CROSS_COLOUR << 1, 6), webp.entropy_fields(elements.ravel(), one * elements.size, 0, False)]
        elif name == "green":
            c = webp._channels(image).copy()
            c[..., 0] -= c[..., 1]
            c[..., 2] -= c[..., 1]
            image = webp._pixels(c)
            parts += [F_.fixed(1, 1 | webp.SUBTRACT_GREEN << 1, 3)]
    parts += [F_.fixed(1, 0, 1), webp.entropy_fields(image.ravel(), one * image.size, cache_bits, True)]
    return webp.Fields.woven(parts).packed()[0]


@pytest.mark.parametrize("transforms", [(), ("green",), ("cross",), ("predict",), ("predict", "cross", "green"), ("green", "cross", "predict")])
def test_transforms_are_inverted(transforms):
    rng = np.random.default_rng(len(transforms))
    images = [rng.integers(0, 2**32, (7, 13)).astype(np.uint32), np.cumsum(rng.integers(0, 3, (9, 10)), axis=1).astype(np.uint32) * np.uint32(0x01010101), np.full((3, 5), 0xFF112233, np.uint32)]
    for image, back in zip(images, webp.decode_streams([stream(i, transforms) for i in images]), strict=True):
        assert (image == back).all()


def test_predictions_by_definition():
    left, top, corner, before = (np.array(x) for x in ([10, 20, 30, 40], [50, 25, 5, 45], [1, 2, 3, 4], [12, 22, 200, 41]))
    assert webp.predicted(1, left, top, corner, before).tolist() == left.tolist() and webp.predicted(3, left, top, corner, before).tolist() == corner.tolist()
    assert webp.predicted(5, left, top, corner, before).tolist() == [(((a + c) // 2) + b) // 2 for a, b, c in zip(left, top, corner)]
    assert webp.predicted(12, left, top, corner, before).tolist() == [min(255, max(0, int(a + b - d))) for a, b, d in zip(left, top, before)]
    half = lambda a, b, d: min(255, max(0, (a + b) // 2 + int(((a + b) // 2 - d) / 2)))
    assert webp.predicted(13, left, top, corner, before).tolist() == [half(int(a), int(b), int(d)) for a, b, d in zip(left, top, before)]


def test_palettes_runs_and_broken_files():
    rng = np.random.default_rng(0)
    heights, width = np.array([1, 2, 3, 4, 5]), 21
    pixels = np.concatenate([rng.integers(0, 2**32, k).astype(np.uint32)[rng.integers(0, k, h * width)] for k, h in zip((1, 2, 4, 16, 200), heights)])
    files = webp.encode_images(pixels, heights, width)
    back = webp.decode_streams(webp.containers(b"".join(files)))
    assert (np.concatenate([b.ravel() for b in back]) == pixels).all()
    with pytest.raises(webp.WebpError):
        webp.containers(files[4][:-5])
    with pytest.raises(webp.WebpError):
        webp.decode_streams([b"\x30" + webp.containers(files[4])[0][1:]])
    with pytest.raises(webp.WebpError):
        webp.decode_streams([webp.containers(files[4])[0][:60]])
    assert webp.decode_streams([]) == []


def test_a_run_is_filled_at_once(monkeypatch):
    rng = np.random.default_rng(2)
    images = [np.r_[rng.integers(0, 1 << 32, 40, np.uint32), np.full(760 - k, 9 + k, np.uint32), rng.integers(0, 1 << 32, k, np.uint32)].reshape(8, 100) for k in (0, 0, 30)]
    plain, rounds = webp.cache_slot, []
    streams = [webp.containers(f)[0] for f in webp.encode_images(np.concatenate([i.ravel() for i in images[:2]]), np.array([8, 8]), 100)]
    monkeypatch.setattr(webp, "cache_slot", lambda *args: rounds.append(1) or plain(*args))
    assert all((a == b).all() for a, b in zip(webp.decode_streams(streams), images, strict=False)) and len(rounds) < 100
    (mixed,) = webp.encode_images(images[2].ravel(), np.array([8]), 100)
    assert all((a == b).all() for a, b in zip(webp.decode_streams([*streams, webp.containers(mixed)[0]]), images, strict=True))


def test_copies_from_the_row_above(monkeypatch):
    """The only distance that the writer knows, the pixel to the left, is turned into the one above."""
    plain = webp._code_fields
    monkeypatch.setattr(webp, "_code_fields", lambda x: plain(np.roll(x, -1, axis=1) if x.shape[1] == webp.DISTANCES else x))
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 1 << 32, (6, 50), np.uint32) for _ in range(3)]
    images[0][3:], images[1][5, 7:] = images[0][3, 0], images[1][5, 7]
    files = webp.encode_images(np.concatenate([i.ravel() for i in images]), np.array([6, 6, 6]), 50)
    images[0][3:, 1:], images[0][4:, 0], images[1][5, 8:] = images[0][2, 1:], images[0][3, 0], images[1][4, 8:]
    for image, back in zip(images, webp.decode_streams([webp.containers(f)[0] for f in files]), strict=True):
        assert (image == back).all()


def test_the_writer_uses_transforms_and_copies_where_they_shrink_an_image(monkeypatch):
    rng = np.random.default_rng(4)
    height, width = 40, 90
    pixel = lambda *bgra: webp._pixels(np.stack([np.broadcast_to(x, (height, width)) for x in bgra], axis=-1) & 255)
    noise, wide = (lambda n: rng.integers(0, n, (height, width))), rng.integers(0, 256, (height, width))
    smooth = np.cumsum(np.cumsum(noise(3), axis=0), axis=1)
    block = rng.integers(0, 1 << 32, 500, np.uint32)
    images = {
        "plain": pixel(noise(256), noise(256), noise(256), noise(256)),
        "green": pixel(wide + noise(2), wide, wide + noise(2), 255),
        "cross": pixel((wide.astype(np.int8).astype(int) * 25 >> 5) + noise(2), wide, (wide.astype(np.int8).astype(int) * -20 >> 5) + noise(2), 255),
        "predict": pixel(smooth, smooth + noise(2), 3 * smooth, 255),
        "copies": np.resize(block, height * width).reshape(height, width),
        "far": np.concatenate([block, rng.integers(0, 1 << 32, height * width - 1000, np.uint32), block]).reshape(height, width),
    }
    pixels, heights = np.concatenate([i.ravel() for i in images.values()]), np.full(len(images), height)
    files = dict(zip(images, webp.encode_images(pixels, heights, width), strict=True))
    size = {name: len(f) / image.nbytes for (name, f), image in zip(files.items(), images.values(), strict=True)}
    assert size["green"] < 0.4 and size["cross"] < 0.4 and size["predict"] < 0.4 and size["copies"] < 0.2 and size["far"] < 0.95
    used = []
    for name, found in (("unpredicted", "predict"), ("cross_colour", "cross"), ("_add_green", "green")):
        monkeypatch.setattr(webp, name, lambda *args, f=getattr(webp, name), found=found: used.append(found) or f(*args))
    for name, image in images.items():
        used.clear()
        (back,) = webp.decode_streams(webp.containers(files[name]))
        assert (back == image).all()
        assert name in used or name in ("plain", "copies", "far")
        assert files[name] == webp.encode_images(image.ravel(), np.array([height]), width)[0]  # whatever is beside it
    for a, b in zip(images.values(), webp.decode_streams([webp.containers(f)[0] for f in files.values()]), strict=True):
        assert (a == b).all()


def test_media_columns(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (None, "x" * 200_000), (1, "abc"), (5, "é" * 288)]
    table = docs(spark, [(*r, 7) for r in rows], ", media int").select("*", F.encode("text", "UTF-8").alias("data"))
    out = media.read(media.store(table, "doc_id", "data"), "doc_id").collect()
    assert [bytes(r["payload"]) for r in out] == [media.padded((t or "").encode()) for _, t in rows]
    assert out[0]["media_sha256"] == out[4]["media_sha256"] and out[1]["media_sha256"] == out[2]["media_sha256"]
    assert media.store(table.limit(0), "doc_id", "data").count() == 0


# --- tokens ---

@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_bpe_of_odd_texts(spark, vocabulary):
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    rng = np.random.default_rng(1)
    texts = ["", None, " ", "\n\n  a   b \t", "it's WE'LL 'quoted' 12345 x²", "日本語のテキスト 🙂🙂 é", "<|endoftext|>", "a" * 3000, "".join(chr(c) for c in rng.integers(33, 1200, 2000)), "word " * 5000, "aaaa aaaa", "aaaa aaaa"]
    rows = [(i if i else None, t, 1) for i, t in enumerate(texts)]
    out = bpe.encode(docs(spark, rows, ", tokens int"), vocabulary, public_tokenizers.PATTERN, chunk_bytes=2000).withColumn("back", bpe.decode(F.col("tokens"), vocabulary)).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == len(texts)
    for i, t, _ in rows:
        assert got[i]["tokens"] == other.encode_ordinary(t or "") and bytes(got[i]["back"]) == (t or "").encode()
    assert bpe.encode(docs(spark, []), vocabulary, public_tokenizers.PATTERN).count() == 0


def test_merges_in_rounds_and_by_heap(vocabulary):
    own = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=vocabulary.ranks, special_tokens={})
    rng, single, merges = np.random.default_rng(2), vocabulary.single_bytes(), bpe.Merges(vocabulary)
    words = sorted({"".join(rng.choice(list("aetns é日x1"), n)) for n in rng.integers(1, 90, 400)})
    for short in (0, 64, 1000):  # all by heap, mixed, all in rounds
        begins, sizes, flat = bpe.word_tokens(pa.array(["cut", *words])[1:], vocabulary, single, merges, rows=7, short=short)
        assert [flat[b : b + n].tolist() for b, n in zip(begins, sizes, strict=True)] == [own.encode_ordinary(w) for w in words]
    long = "".join(rng.choice(list("abcde"), 40_000))  # took the square of its length
    start = time.monotonic()
    assert bpe.word_tokens(pa.array([long]), vocabulary, single, merges)[2].tolist() == own.encode_ordinary(long)
    assert time.monotonic() - start < 20


def test_rank_map_holds_all_pairs(vocabulary):
    pairs = vocabulary.pairs()
    base, slots = bpe.rank_map(pairs)
    for left in list(pairs)[::97]:
        for right in range(0, 50_000, 501):
            at = base[left] + right
            found = slots[at] & bpe.NONE if 0 <= at < len(slots) and slots[at] >> bpe.ID_BITS == left else None
            assert found == pairs[left].get(right)


def test_rank_map_takes_few_seconds(vocabulary):
    """It is made on the driver and took 12 seconds, as every row searched its place from the first free slot."""
    pairs, start = vocabulary.pairs(), time.process_time()
    bpe.rank_map(pairs)
    assert time.process_time() - start < 6


def test_decoding_of_odd_arrays(spark, vocabulary):
    rows = [([],), (None,), ([0, 1, 2],), ([5, None, 99_999, -1, 6],), ([7] * 700,)] * 300  # more than are joined at a time
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, tokens array<int>").coalesce(2)
    piece = {rank: token for token, rank in vocabulary.ranks.items()}
    for r in table.select("id", "tokens", bpe.decode(F.col("tokens"), vocabulary).alias("b"), bpe.ids_digest(F.col("tokens")).alias("i")).collect():
        assert (r["b"] is None and r["i"] is None) if r["tokens"] is None else bytes(r["b"]) == b"".join(piece.get(i, b"") for i in r["tokens"])
        assert r["tokens"] is None or r["i"] == hashlib.sha256(" ".join(str(i) for i in r["tokens"] if i is not None).encode()).hexdigest()


# --- language models ---

def naive_ppm(texts, order):
    """The trie as dictionaries; probability of a symbol by walking the escapes."""
    counts = [{} for _ in range(order + 1)]
    for t in texts:
        s = [ppm.START] * order + list(t) + [ppm.END]
        for i in range(order, len(s)):
            for d in range(order + 1):
                counts[d].setdefault(tuple(s[i - d : i]), Counter())[s[i]] += 1

    def probability(before, symbol):
        p, excluded = 1.0, set()
        for d in range(order, -1, -1):
            seen = counts[d].get(tuple(before[len(before) - d :]))
            if seen is None:
                continue
            left = {k: n for k, n in seen.items() if k not in excluded}
            total = sum(left.values())
            if symbol in left:
                return p * (left[symbol] - 0.5) / total
            if left:
                p *= len(left) / 2 / total
            excluded |= set(seen)
        return p / (ppm.SYMBOLS - len(excluded))

    return lambda t: sum(math.log(probability(([ppm.START] * order + list(t) + [ppm.END])[i : i + order], ([*t, ppm.END])[i])) for i in range(len(t) + 1))


def test_ppm_equals_dictionaries_and_adds_up(spark):
    texts = ["abracadabra abra", "abra kadabra", "", "The THE the", None, "zzz é 語"]
    rows = [(i, t, 1.0) for i, t in enumerate(texts)]
    model, rare = ppm.train(docs(spark, rows, ", score double"), keep_grams=1e-9, keep_words=0.2)
    naive = naive_ppm([ppm.plain_bytes(t) for t in texts], ppm.ORDER)
    probe = [b"", b"abra", b"the cat", "ü".encode(), b"abracadabra abra"]
    assert model.trie.code_lengths(probe).tolist() == pytest.approx([naive(t) for t in probe])
    symbols = np.array([s for s in range(256) if s != ppm.START], np.uint64)
    for gram in ppm.packed_grams(probe)[0]:
        assert np.exp(model.trie.log_probabilities(gram & ~np.uint64(255) | symbols)).sum() == pytest.approx(1)
    out = ppm.score(docs(spark, [*rows, (None, "abra new", 0.0), (1, "abra kadabra", 0.0)], ", score double"), model, rare).collect()
    words = Counter(w for t in texts for w in (t or "").lower().split())
    assert len(out) == 8 and {r["train_tokens"] for r in out} == {sum(words.values()) + 6}
    new = next(r for r in out if r["doc_id"] is None)
    each = lambda c: math.log10((c + 1) / (sum(words.values()) + 6 + len(words) + 1 + 1))
    assert (new["n_tokens"], new["n_known"]) == (3, 2) and new["base_score"] == pytest.approx(each(2) + each(0) + each(6))
    nothing, none = ppm.train(docs(spark, []))
    r = ppm.score(docs(spark, [(1, "ab")]), nothing, none).first()
    assert (r["n_known"], r["base_score"], r["score"]) == (0, 0.0, pytest.approx(-3 * math.log10(255)))
    assert ppm.score(docs(spark, []), model, rare).count() == 0


def test_frequent_part_equals_plain_look_ups():
    rng = np.random.default_rng(4)
    texts = [bytes(rng.choice(np.frombuffer(b"aabc \xc3\xa9", np.uint8), n)) for n in (0, 1, 700, 3000, 5)]
    padded = [bytes([ppm.START]) * 5 + t + bytes([ppm.END]) for t in texts]
    plain = [[int.from_bytes(t[i - 5 : i + 1]) for i in range(5, len(t))] for t in padded]
    packed, sizes = ppm.packed_grams(texts)
    assert packed.tolist() == sum(plain, []) and sizes.tolist() == list(map(len, plain))
    kept = np.unique(packed)[::3]
    trie = SimpleNamespace(levels=[SimpleNamespace(grams=kept, log_top=-np.arange(1.0, len(kept) + 1))])
    scores, grams, times, places = ppm._frequent_part(trie, ppm._slots(kept), texts)
    value = dict(zip(kept.tolist(), trie.levels[0].log_top, strict=True))
    assert np.allclose(scores, [sum(value.get(g, 0) for g in own) for own in plain])
    where = {}
    for i, own in enumerate(plain):
        for g in own:
            where.setdefault(g, []).append(i)
    rest = [g for g in where if g not in value]
    assert grams.tolist() == rest and times.tolist() == [len(where[g]) for g in rest] and places.tolist() == sum((where[g] for g in rest), [])


def test_ppm_scores_by_all_counted_grams(spark):
    """By the defaults, on more text than 1 / keep_grams: grams that occur once or never are scored as the whole trie says."""
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefgh é"), 6)) for _ in range(3000)]
    texts = [" ".join(rng.choice(words, 6000)) for _ in range(30)] + ["seldom Σ", "x" * 40]
    probe = ["seldom Σ", "seldom words", "never 語", "", None, " ".join(words[:50]), texts[3], "x" * 30 + words[0]]
    model, rare = ppm.train(docs(spark, list(enumerate(texts))))
    assert sum(len(t.encode()) for t in texts) > 1 << 20 and len(model.trie.levels[-1].grams) < model.grams.count()
    out = {r["doc_id"]: r["score"] * math.log(10) for r in ppm.score(docs(spark, list(enumerate(probe))), model, rare, part_bytes=100).collect()}
    naive = naive_ppm([ppm.plain_bytes(t) for t in texts], ppm.ORDER)
    assert [out[i] for i in range(len(probe))] == pytest.approx([naive(ppm.plain_bytes(t)) for t in probe])


def test_kneser_ney_adds_up():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abc d"), 60)) for _ in range(20)]
    points, real, _ = langid.padded_points(texts, 4)
    grams, n = np.unique(points[real[:, None] + np.arange(-3, 1)], axis=0, return_counts=True)
    alphabet = len(set("".join(texts)))
    model = langid.Model(["x"], [langid.kneser_ney(grams, n, alphabet)], alphabet, 4)
    for context in ("abc", "zzz", "dd ", "\x02\x02a"):
        total = 0.0
        for c in [*sorted(set("".join(texts))), "一"]:
            p = np.array([ord(x) for x in context + c], np.uint32)
            total += math.exp(model._log_p(model.orders[0], langid.gram_hashes(p, 4), np.array([3]))[0])
        assert total == pytest.approx(1)


def naive_kneser_ney(texts, order, alphabet):
    """Interpolated Kneser-Ney by dictionaries: probability of a character after the characters before it."""
    top = Counter()
    for t in texts:
        padded = chr(langid.START) * (order - 1) + t
        top.update(padded[i - order + 1 : i + 1] for i in range(order - 1, len(padded)))
    levels = {order: top}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    levels[1].pop(chr(langid.START), None)

    def probability(context, c):
        if context is None:
            return 1 / (alphabet + 1)
        grams = levels[len(context) + 1]
        shorter = probability(context[1:] if context else None, c)
        once, twice = (sum(n == k for n in grams.values()) for k in (1, 2))
        discount = once / (once + 2 * twice) if once and twice else 0.5
        after = [n for g, n in grams.items() if g[:-1] == context]
        if not after:
            return shorter
        return (max(grams.get(context + c, 0) - discount, 0) + discount * len(after) * shorter) / sum(after)

    return probability


def test_kneser_ney_equals_dictionaries():
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcé d"), int(rng.integers(1, 40)))) for _ in range(25)]
    points, real, _ = langid.padded_points(texts, 4)
    grams, n = np.unique(points[real[:, None] + np.arange(-3, 1)], axis=0, return_counts=True)
    alphabet = len(set("".join(texts)))
    model = langid.Model(["x"], [langid.kneser_ney(grams, n, alphabet)], alphabet, 4)
    naive = naive_kneser_ney(texts, 4, alphabet)
    for probe in ("abcé", "d a b c", "zab", "bzz a", "a", "ééé d"):
        padded = chr(langid.START) * 3 + probe
        want = -sum(math.log(naive(padded[i - 3 : i], padded[i])) for i in range(3, len(padded))) / len(probe)
        assert model.entropies([probe])[0, 0] == pytest.approx(want)


def test_language_cases(spark):
    rng = np.random.default_rng(0)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["кот", "пёс", "дом"]}
    rows = [(i, " ".join(rng.choice(words[k], 12)), k) for i in range(60) for k in words]
    table = docs(spark, rows, ", lang string").withColumn("draw", langid.draw(F.col("doc_id"), F.col("text")))
    model = langid.train(table)
    probe = docs(spark, [(1, "ipsum dolor", 1), (2, "кот дом", 1), (3, None, 1), (4, "", 1), (5, "12 !?", 1), (None, "lorem " * 30000, 1), (7, "語語語", 1)], ", score int")
    got = {r["doc_id"]: r for r in langid.identify(probe, model).collect()}
    assert (got[1]["lang_pred"], got[2]["lang_pred"], got[None]["lang_pred"]) == ("aa", "bb", "aa")
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4, 5)) and not got[7]["accepted"]
    assert langid.train(table.limit(0)) is None
    assert {r["lang_pred"] for r in langid.identify(probe, None).collect()} == {"und"}


def test_rare_language_is_learned(spark):
    rows = [(i, f"lorem ipsum dolor {i}", "aa", i / 60) for i in range(60)] + [(60, "кот пёс дом", "bb", 0.1)]
    model = langid.train(docs(spark, rows, ", lang string, draw double"))
    assert model.languages == ["aa", "bb"]
    assert langid.identify(docs(spark, [(1, "пёс дом")]), model).first()["lang_pred"] == "bb"


def test_quality_cases(spark):
    rng = np.random.default_rng(0)
    common = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(common, 40))
        bad, toxic = i % 5 == 0, i % 7 == 0
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words[3] = "nasty"
        rows.append((i, " ".join(words), "de" if i % 3 else None, f"src{i % 4}", 200 if i % 11 else None, 0.5))
        if i < 500:
            labels.append((i, int(not bad), int(toxic)))
    labels += [(1, None, None), (None, 1, 1)]
    table = spark.createDataFrame([*rows, (None, None, None, None, None, None), (3, rows[3][1], "de", "src3", 200, 0.5)], "doc_id long, text string, lang string, source string, n_chars long, keep double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.score(table, quality.train(table, marks)).collect()
    wrong = sum(r["keep"] != (r["doc_id"] % 5 != 0 and r["doc_id"] % 7 != 0) for r in out if r["doc_id"] is not None and r["doc_id"] >= 500)
    assert len(out) == len(rows) + 2 and wrong <= 2
    assert quality.score(table, quality.train(table, marks.limit(0))).filter("keep").count() == len(out)
    assert quality.score(table.limit(0), quality.train(table, marks)).count() == 0


def test_co_training_takes_the_surest_of_all_documents(spark):
    """The chosen rows of a round are those that scoring every row of the pool by hand gives, however the pool is dealt."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(rng.choice(words[: 40 if i % 2 else 80], 30)) + ("!" if i % 2 else "") for i in range(400)]
    table = spark.createDataFrame([(i, t, f"s{i % 2}", "en", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, n_chars long")
    own = quality._features(table, "doc_id").collect()
    rows = {r["doc_id"]: (r["key"], quality._unpacked(bytes(r["features"]))) for r in own}
    model = quality.CoTrained([rows[i][1] for i in range(60)], np.array([float(i % 2) for i in range(60)]))
    pool = quality._features(table.filter("doc_id >= 60").union(table.filter("doc_id BETWEEN 60 AND 70")))
    want = set()
    for view in (0, 1):
        p = {rows[i][0]: 1 / (1 + math.exp(-model.views[view].logit([rows[i][1]])[0])) for i in range(60, 400)}
        for label, n in model.wanted(20).items():
            sure = sorted(((p[k] if label else 1 - p[k]), k) for k in p if (p[k] if label else 1 - p[k]) >= 0.9)
            want |= {(0, view, label, k) for _, k in sorted(sure, key=lambda x: (-x[0], x[1]))[:n]}
    for parts in (1, 7):
        chosen, features = quality._surest(pool.repartition(parts), {0: model}, 20, 0.9)
        assert {(h, v, label, key) for h, v, label, _, key in chosen} == want and len(want) == 40
        assert set(features) == {k for *_, k in want}


# --- pipeline ---

def test_pipeline_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    found = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", None, None, None), (10**6, "", None, None, None)], found.schema)
    seen = found.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, sf_dir).cache()
        assert out.columns == found.columns and 0 < out.count() <= seen.count(), name
        seen = out
    texts = [r["text"] for r in seen.collect()]
    assert len(texts) == len({" ".join((t or "").lower().split()) for t in texts})
    last = corpus_pipeline.STAGES[-1][1](spark, seen, sf_dir)
    assert last.count() == len(texts)


def test_pipeline_run(spark):
    sf_dir = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf_dir).collect()
    ids = [r["doc_id"] for r in out]
    assert len(ids) == len(set(ids)) > 100 and all(r["n_tokens"] >= 0 for r in out)
