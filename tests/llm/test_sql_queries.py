"""Queries of the subpackage against their check SQL and against other libraries, over whole tables."""
import base64
import hashlib
import math
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken

from compare import compare, connect
from genoloom.llm import media, registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF_DIR}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", list(registry.CHECKS))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF_DIR), SF_DIR, name, registry.QUERIES[name], registry.CHECKS[name])[1] is None


def test_a_query_for_each_operator():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_bpe_equals_tiktoken(spark, documents):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for i, text, _ in documents:
        ids = other.encode_ordinary(text or "")
        want[i] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode()))
    got = {r["doc_id"]: tuple(r)[1:] for r in registry.QUERIES["op5_bpe"](spark, SF_DIR).collect()}
    assert got == want


def test_media_digests(spark, documents):
    got = {r["doc_id"]: r for r in registry.QUERIES["op2_webp_media"](spark, SF_DIR).collect()}
    assert len(got) == len(documents)
    for i, text, _ in documents:
        raw = (text or "").encode()
        full = media.padded(raw)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert len(r["feature"]) == 16 and r["media_bytes"] > 0


def test_word_base_line(spark, documents):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    words = {i: (t or "").encode().lower().split() for i, t, _ in documents}
    counts = Counter(w for i, ws in words.items() if not held(i) for w in ws)
    ends = sum(not held(i) for i in words)
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    for r in registry.QUERIES["op7_ppm_score"](spark, SF_DIR).collect():
        ws = words[r["doc_id"]]
        base = sum(math.log10((c + 1) / (total + kinds + 1)) for c in [*[counts[w] for w in ws], ends])
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(ws) + 1, sum(w in counts for w in ws) + 1, total)
        assert r["score"] < 0


def test_language_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf_dir}/documents.parquet'").fetchall())
    rows = [r for r in registry.QUERIES["op8_language_id"](spark, sf_dir).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.97 * len(rows) > 0
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_finds_bad_and_keeps_good_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {i: q == 1 and t == 0 for i, q, t in duckdb.sql(f"SELECT * FROM '{sf_dir}/labels.parquet'").fetchall()}
    rows = {r["doc_id"]: r for r in registry.QUERIES["op9_quality"](spark, sf_dir).collect()}
    kept = [rows[i]["keep"] for i, good in labels.items() if good]
    junk = [rows[i]["good_score"] < 0.5 for i, q in duckdb.sql(f"SELECT doc_id, quality FROM '{sf_dir}/labels.parquet'").fetchall() if q == 0]
    assert sum(kept) > 0.9 * len(kept) and sum(junk) > 0.9 * len(junk)
