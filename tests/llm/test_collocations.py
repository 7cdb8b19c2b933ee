"""Collocations against plain counting."""
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from genoloom.llm import collocations as col


def brute(rows, min_count, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in col.PIECE.split((text or "").translate(col.LOWER)):
            w = col.WORD.findall(piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    cand = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= min_count}
    out = []
    for (lang, p), a in cand.items():
        score, cut = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if not any(g == lang and len(q) > len(p) and inside(q) and 100 * c >= 80 * a for (g, q), c in cand.items()):
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]]))
    got, rank = [], Counter()
    for lang, score, a, p, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -score))
    return got


@pytest.mark.parametrize("chunk_words", [1 << 21, 50])
def test_equals_brute_force(spark, chunk_words):
    rng = random.Random(3)
    words = ["A", "a", "b", "Bé", "é", "c", "ß", " x", "😀", "\U0010ffff"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", ". ", "\n", "\v", "!", ""]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    rows += [("en", None), (None, None), ("fr", ""), ("fr", " . ,"), ("de", "new york city " * 40), ("de", "new york city " * 40), ("en", "x y " * 3000)]
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("lang", "text", "lang AS Phrase", "1 AS n", "2 AS id").repartition(3)
    got = col.collocations(docs, min_count=5, top=40, chunk_words=chunk_words)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *[(c, "bigint") for c in ("a", "l", "r", "n", "score")]]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 5, 40))


def test_empty_table_and_wide_products(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert col.collocations(docs).collect() == []
    docs = spark.createDataFrame([("en", "one two three")], "lang string, text string")
    assert col.collocations(docs).collect() == []
    got = col.collocations(docs, min_count=1, scale=10**17).collect()
    assert [(r["phrase"], r["score"]) for r in got] == [("one two three", 5 * 10**16)]


def test_phrases_travel_by_numbers(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([("en", " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40)) for _ in range(20_000)))], "lang string, text string")
    buckets, lang = 4, F.lit("en")
    words = col.occurrences(docs, "text", lang, 1 << 19).localCheckpoint()
    pairs = col._extended(words, col._counted(words, 1, True, buckets), 1, buckets, 4).localCheckpoint()
    answers = col._counted(pairs, 1, False, buckets)
    row = pairs.first()
    n_pairs = len(col._unpacked(bytes(row["n"])))
    sent = [sum(map(len, col._dealt(False, buckets, *(bytes(row[c]) for c in ("parts", "left", "right")))[:1]))]
    assert sent == [n_pairs] and sum(len(col._unpacked(bytes(r["at"]))) for r in answers.collect()) == n_pairs > 15_000
    assert len(row["parts"]) + len(row["left"]) + len(row["right"]) < 6 * n_pairs  # ids of 8 bytes a phrase before
