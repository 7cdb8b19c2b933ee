import random

import pytest

from genoloom.operators import recovery as a


def scored(spark, groups):
    rows = [(g, i, float(s), bool(y)) for g, pairs in groups.items() for i, (s, y) in enumerate(pairs)]
    return spark.createDataFrame(rows, "g string, gene int, score double, label boolean")


def areas(spark, groups):
    return {r["g"]: (r["auroc"], r["auprc"]) for r in a.auc(scored(spark, groups), ["g"], "score", "label").collect()}


def brute(pairs):
    p, n = sum(y for _, y in pairs), sum(not y for _, y in pairs)
    if p == 0 or n == 0:
        return None, None
    cuts, tp, fp = sorted({s for s, _ in pairs}, reverse=True), 0, 0
    roc, pr = [(0.0, 0.0)], []
    for cut in cuts:
        tp += sum(y for s, y in pairs if s == cut)
        fp += sum(not y for s, y in pairs if s == cut)
        roc.append((fp / n, tp / p))
        pr.append((tp / p, tp / (tp + fp)))
    trap = lambda pts: sum((x2 - x1) * (y1 + y2) / 2 for (x1, y1), (x2, y2) in zip(pts, pts[1:]))
    return trap(roc), trap(pr) if len(pr) > 1 else None


def test_hand_examples(spark):
    out = areas(spark, {
        "plain": [(4, 1), (3, 0), (2, 1), (1, 0)],
        "tied": [(1, 1), (1, 0), (1, 0)],
        "no_negatives": [(2, 1), (1, 1)],
        "no_positives": [(2, 0), (1, 0)],
    })
    assert out["plain"] == (0.75, pytest.approx(0.5 * 0.5 * (2 / 3 + 1 / 2), abs=1e-9))
    assert out["tied"] == (0.5, None)
    assert out["no_negatives"] == (None, None)
    assert out["no_positives"] == (None, None)


def test_random_tied_scores_equal_the_curve(spark):
    rng = random.Random(2)
    groups = {f"g{i}": [(rng.randint(0, 6), rng.random() < 0.4) for _ in range(rng.randint(3, 25))] for i in range(80)}
    out = areas(spark, groups)
    for g, pairs in groups.items():
        roc, pr = brute(pairs)
        assert (out[g][0] is None) == (roc is None) and (out[g][1] is None) == (pr is None)
        assert roc is None or out[g][0] == pytest.approx(roc, abs=1e-9)
        assert pr is None or out[g][1] == pytest.approx(pr, abs=1e-9)


def test_null_sets_have_the_right_size_and_leave_the_regulator_out(spark):
    scores = spark.createDataFrame(
        [("Human", tf, g, float((g * 7 + tf) % 23)) for tf in (1, 2, 3) for g in range(1, 24)], "species string, tf int, gene int, score double"
    )
    labels = spark.createDataFrame([("Human", tf, g) for tf in (1, 2, 3) for g in range(5, 5 + 2 * tf)], "species string, tf int, gene int")
    universe = scores.select("species", "gene").distinct()
    null = a.null_auc(scores, labels, universe, 40, 1)
    sizes = {(r["tf"], r["n_targets"]) for r in null.select("tf", "n_targets").distinct().collect()}
    assert sizes == {(1, 2), (2, 4), (3, 6)}
    assert null.count() == 120
    mean = null.groupBy().avg("auroc").first()[0]
    assert 0.4 < mean < 0.6


def test_labels_follow_orthologs_and_drop_self(spark):
    gene_ref = spark.createDataFrame(
        [("Human", 1, "AA"), ("Human", 2, "BB"), ("Human", 3, "CC"), ("Mouse", 11, "Ax"), ("Mouse", 12, "Bb"), ("Mouse", 13, "Cc")],
        "species string, gene int, symbol string",
    )
    ortho = spark.createDataFrame([("AA", "Ax"), ("BB", "Bb")], "symbol_hg string, symbol_mm string")
    curated = spark.createDataFrame([("Ax", "bb"), ("AA", "AX"), ("AA", "CC"), ("BB", "BB")], "tf_symbol string, target_symbol string")
    out = {(r["species"], r["tf"], r["gene"]) for r in a.curated_labels(curated, gene_ref, ortho).collect()}
    assert out == {("Human", 1, 2), ("Human", 1, 3), ("Mouse", 11, 12), ("Mouse", 11, 13)}
