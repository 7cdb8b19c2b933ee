"""Edge cases and brute force for the operators on lines, words and chats."""
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoloom.llm import chat, decontaminate, line_dedup, near_dup
from genoloom.llm.components import components
from genoloom.llm.shingles import unit_cells

LONG = "A line that is long enough to be compared with the others"


def docs(spark, rows, more=""):
    return spark.createDataFrame(rows, f"doc_id long, text string{more}")


def test_lines_by_hand(spark):
    rows = [(i, f"own {i}\n  {LONG.upper()}\t\nend", i, "x") for i in range(1, 6)]
    rows += [(7, None, 0, "x"), (8, "", 0, "x"), (9, "\n", 0, "x"), (None, f"{LONG}\n{LONG}", 0, "x"), (3, f"own 3\n  {LONG.upper()}\t\nend", 3, "x")]
    out = line_dedup.dedup_lines(docs(spark, rows, ", n_lines int, _ld_id string")).collect()
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append((r["text"], r["n_lines"], r["n_dropped"], r["_ld_id"]))
    assert by[1] == [("own 1\nend", 3, 1, "x")] and by[3] == [("own 3\nend", 3, 1, "x")] * 2
    assert by[5] == [(f"own 5\n  {LONG.upper()}\t\nend", 3, 0, "x")]  # the largest id keeps the line
    assert by[None] == [("", 2, 2, "x")] and by[7] == by[8] == [("", 1, 0, "x")] and by[9] == [("\n", 2, 0, "x")]


def test_lines_below_the_threshold_and_empty_table(spark):
    rows = [(i, LONG) for i in range(4)]
    assert {r["text"] for r in line_dedup.dedup_lines(docs(spark, rows)).collect()} == {LONG}
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_line_plans_hold_no_python(spark):
    plan = line_dedup.dedup_lines(docs(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_chat_parts(spark):
    text = lambda t: ("text", t, None, None, None, None, None)
    rows = [
        (1, 0, "user", [text("see <|image|> & [INST]"), ("image", None, "a.png", 56, 29, None, None), text("?"), ("audio", None, "b.wav", None, None, 2.5, None)]),
        (1, 1, "assistant", [text("yes <|im_end|>"), ("document", "x", "c.pdf", None, None, None, 3), text(" &lt; ok")]),
        (1, 2, "a\nb", None), (2, 0, None, []), (None, None, "assistant", [text(None)]), (3, 0, "assistant", [("odd", "kept", None, None, None, None, None)]), (3, 0, "assistant", [("odd", "kept", None, None, None, None, None)]),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{chat.PART_TYPE}>").withColumn("formatted", F.lit(0))
    out = {r["conv_id"]: r for r in chat.read_chat(chat.format_chat(turns)).collect()}
    one = out[1]
    assert [(t["role"], t["text"]) for t in one["turns"]] == [("user", "see <|image|> & [INST]<|image|>?<|audio|>"), ("assistant", "yes <|im_end|><|document|> &lt; ok"), ("a\nb", "")]
    assert one["loss_texts"] == ["yes <|im_end|>", " &lt; ok"] and one["n_turns"] == 3
    assert [(a["turn_index"], a["place"], a["kind"], a["ref"], a["n_tokens"]) for a in one["attachments"]] == [(0, 0, "image", "a.png", 4), (0, 1, "audio", "b.wav", 63), (1, 0, "document", "c.pdf", 768)]
    assert one["expanded_tokens"] == 4 + 63 + 768
    assert one["formatted"].count(chat.OPEN) == 3 and one["formatted"].count("<|image|>") == 1
    assert [(t["role"], t["text"]) for t in out[2]["turns"]] == [("", "")] and out[None]["loss_texts"] == [""]
    assert out[3]["loss_texts"] == ["kept", "kept"]
    assert chat.format_chat(turns.limit(0)).count() == 0


def brute_windows(text, item, size=5):
    known = decontaminate.PlainWords()
    words, other = (decontaminate.plain_hashes(t, known).tolist() for t in (text, item))
    shingles = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    n = min(size, len(other))
    want, best = Counter(shingles(other, n)), 0.0
    for at in range(max(1, len(words) - len(other) + 1)):
        got = Counter(shingles(words[at : at + len(other)], n))
        best = max(best, sum((got & want).values()) / max(sum(got.values()), sum(want.values()), 1))
    return best


@pytest.mark.parametrize("block_items", [20_000, 2])
def test_decontamination_equals_brute_force(spark, block_items):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)]
    said = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, said(int(n))) for i, n in enumerate((15, 30, 30, 57, 3, 1))] + [(6, None), (7, ""), (8, "..")]
    rows = []
    for i in range(120):
        words = said(int(rng.integers(0, 150))).split()
        if i % 2:
            part = items[i % 6][1].split()
            for at in rng.integers(0, len(part), i % 5 if len(part) > 5 else 0):
                part[at] = "changed"
            words[5:5] = part
        rows.append((i, " ".join(w.upper() + "," if i % 3 == 0 else w for w in words)))
    rows += [(200, None), (201, ""), (1, rows[1][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_benchmark(docs(spark, [(*r, "m") for r in rows], ", matches string"), benchmark, block_items=block_items).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r["doc_id"]]
        want = {i: s for i, t in items if t and len(t) > 2 - (i == 5) and text and (s := brute_windows(text, t)) >= 0.8}
        assert {m["item_id"]: m["similarity"] for m in r["matches"]} == pytest.approx(want)
    assert decontaminate.find_benchmark(docs(spark, rows), benchmark.limit(0)).filter("size(matches) > 0").count() == 0
    assert decontaminate.remove_contaminated(docs(spark, []), benchmark).count() == 0


def test_hamming_blocks_miss_nothing_within_the_radius():
    rng = np.random.default_rng(1)
    items = [(0, " ".join(f"a{i}" for i in rng.integers(0, 99, 30)))]
    (c,) = decontaminate.size_classes(items, 0.8, 5)
    bits = np.unpackbits(c.prints[0].view(np.uint8))
    for distance in range(0, 90):
        for _ in range(20):
            other = bits.copy()
            other[rng.choice(256, distance, replace=False)] ^= 1
            found = decontaminate.near(np.packbits(other).view(np.uint64)[None], c.prints, 83)
            assert [x.tolist() for x in found] == ([[0], [0], [distance]] if distance <= 83 else [[], [], []])


def test_hamming_index_is_selective_and_complete():
    """Less than 1 % of random pairs pass a block; of windows with similarity 0.8 at least 99 % are within the radius."""
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 2**64, (2000, 4), np.uint64) for _ in range(2))
    passed = np.zeros((2000, 2000), bool)
    for k in range(4):
        passed |= np.bitwise_count(a[:, None, k] ^ b[None, :, k]) <= 83 // 4
    assert passed.mean() < 0.01 and len(decontaminate.near(a, b, 83)[0]) < 100
    for n in (10, 25, 60):
        one, missed = rng.integers(0, 2**64, (1000, n), np.uint64), 0
        two = one.copy()
        two[:, : n // 5] = rng.integers(0, 2**64, (1000, n // 5), np.uint64)
        for x, y in zip(one, two, strict=True):
            missed += not len(decontaminate.near(*(decontaminate.fingerprints(s, np.array([0]), n) for s in (x, y)), 83)[0])
        assert missed <= 10, (n, missed)


def test_stock_phrases_are_looked_up_for_hardly_any_item():
    rng = np.random.default_rng(3)
    phrase = "which of the following is".split()
    items = [(i, " ".join([*phrase, *(f"x{i}y{j}" for j in range(20))])) for i in range(500)]
    (c,) = decontaminate.size_classes(items, 0.8, 5)
    known = decontaminate.PlainWords()
    own = decontaminate.shingle_hashes(decontaminate.plain_hashes(" ".join([*(f"z{k}" for k in range(300)), *phrase, *(f"z{k}" for k in rng.integers(0, 300, 300))]), known), 5)
    assert len(decontaminate.held(c.known, own)) == 0
    index = decontaminate.Index.of([c])
    text = " ".join([*(f"z{k}" for k in range(40)), items[7][1], *phrase])
    assert [m["item_id"] for m in decontaminate.matches(decontaminate.plain_hashes(text, known), index, 83, 0.8)] == [7]
    twice = decontaminate.matches(decontaminate.plain_hashes(f"{items[7][1]} and {items[7][1]}", known), index, 83, 0.8)
    assert [(m["item_id"], m["first_word"], m["similarity"]) for m in twice] == [(7, 0, 1.0)]


def brute_classes(rows, threshold=0.8):
    cells = []
    for _, t in rows:
        w = (t or "").lower().split()
        cells.append((tuple(w), Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = sum((cells[i][1] & cells[j][1]).values())
            if cells[i][0] == cells[j][0] or both and both >= threshold * (sum(cells[i][1].values()) + sum(cells[j][1].values()) - both):
                up[top(i)] = top(j)
    return [top(i) for i in range(len(rows))]


def near_rows():
    rng = np.random.default_rng(3)
    said = lambda n: list(rng.choice([f"w{i}" for i in range(3000)], n))
    rows = []
    for g in range(12):
        base = said(150)
        for _ in range(14):
            words = list(base)
            for at in rng.integers(0, 150, int(rng.integers(0, 9))):
                words[at] = f"x{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    for n in (0, 1, 2, 4, 5, 6, 3000):
        rows += [(len(rows), " ".join(said(n)))]
        rows += [(len(rows), rows[-1][1].upper())]
    return [*rows, (5000, None), (5001, "  \n "), (None, rows[0][1]), (None, "never seen before"), (3, rows[3][1])]


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    got = near_dup.near_duplicates(docs(spark, [(*r, 1, 2) for r in rows], ", bands int, class_id int")).collect()
    want = defaultdict(set)
    for (i, _), c in zip(rows, brute_classes(rows)):
        want[c].add(i)
    named = {i: min((x for x in group if x is not None), default=None) for group in want.values() for i in group if i is not None}
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == named
    assert sorted((r["class_id"] is None) for r in got if r["doc_id"] is None) == [False, True]
    kept = near_dup.keep_one(docs(spark, [(*r, "z") for r in rows], ", _nd_id string")).collect()
    assert len(kept) == len(want) and all(r["_nd_id"] == "z" for r in kept)
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0 and near_dup.keep_one(docs(spark, [])).count() == 0


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    whole = rng.integers(0, 2**63, 800).astype(np.uint64)
    for share in (0.3, 0.6, 0.9):
        n = int(800 * share)
        a, b = whole[:n], np.concatenate([whole[: n // 2], whole[n:]])
        true = (n // 2) / len(np.union1d(a, b))
        one, two = near_dup.dart_signatures([a, b], 4000)
        same = (one == two).mean()
        assert (near_dup.dart_signatures([b], 4000)[0] == two).all()
        assert abs(same - true) < 0.04
    repeated = unit_cells(np.array([7, 7, 7, 9], np.uint64))
    assert len(repeated) == 4 and len(np.intersect1d(repeated, unit_cells(np.array([7, 7], np.uint64)))) == 2


def test_blocks_find_all_links(spark):
    """Buckets far larger than a block give the same components as one block."""
    import pandas as pd

    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**62, 40)
    cells = [np.unique(np.concatenate([base[: 40 - k], rng.integers(0, 2**62, k)])) for k in rng.integers(0, 12, 60)]
    part = pd.DataFrame({"root": [str(i) for i in range(60)], "cells": cells})
    whole = near_dup._spanning(part, 0.8)
    similar = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    assert all(similar(cells[i], cells[j]) for i, j in whole)
    rows = [(0, 0, i, i, 60) for i in range(60)]
    members = spark.createDataFrame(rows, "band int, value long, node long, root long, n long")
    table = spark.createDataFrame([(i, [int(c) for c in x]) for i, x in enumerate(cells)], "node long, cells array<long>")
    links = [(r["u"], r["v"]) for r in near_dup._links_within(members, table, 0.8, block=7).collect()]

    def groups(pairs):
        up = list(range(60))
        for a, b in pairs:
            x, y = up[a], up[b]
            up = [x if u == y else u for u in up]
        return len(set(up))

    assert groups(links) == groups(whole) < 60


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
