"""Periodic runs against brute force."""
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from genoloom.llm import periodic


def brute(words, min_length=6, exponent=4):
    """All runs by looking at every period and every maximal stretch."""
    n, best = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, exponent * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def listed(words, **options):
    return [tuple(map(int, r)) for r in periodic.runs_of([words], **options)[0]]


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    for size in (1, 2, 4, 32):
        a, w = rng.integers(0, 3, (size, 50)).astype(np.uint64), rng.integers(0, 3, (2 * size - 1, 50)).astype(np.uint64)
        want = np.array([[(a[:, k] == w[j : j + size, k]).all() for k in range(50)] for j in range(size)])
        assert (periodic.block_matches(a, w) == want).all()
        x = rng.integers(0, periodic.PRIME, (2 * size, 3)).astype(np.uint64)
        assert (periodic.backward(periodic.forward(x)) * np.uint64(pow(2 * size, -1, periodic.PRIME)) % periodic.P == x).all()


@pytest.mark.parametrize("seed", range(150))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    words = []
    while len(words) < rng.choice([5, 40, 200]):
        piece = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 12))]
        words += (piece * 12)[: rng.randint(1, 7 * len(piece))]
    assert listed(words) == brute(words)
    assert listed(words, min_length=3, exponent=3) == brute(words, 3, 3)


def test_many_texts_at_once_and_long_ones():
    rng = random.Random(7)
    texts = [[rng.choice("ab") for _ in range(rng.randint(0, 60))] for _ in range(80)]
    assert [[tuple(map(int, r)) for r in rows] for rows in periodic.runs_of(texts)] == [brute(t) for t in texts]
    assert listed(["same"] * 300_000) == [(0, 300_000, 1)]
    period = [f"w{rng.randrange(500)}" for _ in range(9_001)]
    assert listed(["x", *(period * 5)[:40_000], "y"]) == [(1, 40_000, 9_001)]


def test_cases(spark):
    rows = [(1, "a a a a a a", "k"), (1, "a a a a a a", "k"), (2, None, "k"), (None, "", "k"), (3, " \t\n", None), (4, "x a b\ta b a b a b a y", "k"), (5, "one two three", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Runs string")
    out = periodic.periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    got = sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect())
    assert got == [(0, 0, [], ""), (1, 6, [(0, 6, 1)], "a"), (1, 6, [(0, 6, 1)], "a"), (2, 0, [], ""), (3, 0, [], ""), (4, 11, [(1, 9, 2)], "x a b y"), (5, 3, [], "one two three")]
    assert periodic.periodic_runs(docs.filter("false")).collect() == []


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want, planted = {}, 0
    for i, text in duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall():
        words = periodic.WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            planted += 1
        runs = brute(words)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        want[i] = (len(runs), s, m, q, 1000 * m // q if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))
    assert planted
    got = {r["doc_id"]: tuple(r)[1:] for r in periodic.query(spark, sf_dir).collect()}
    assert got == want
