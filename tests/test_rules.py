"""Rules on labels and records, cells without counts, pairs by other methods: by hand."""
import numpy as np
import pytest

from genoloom.operators import correlate, enrich, labels, prep, similarity
from genoloom.schemas import GeneSpan


def records(spark, rows):
    return spark.createDataFrame(rows, "record_id int, tf_symbol string, target_symbol string, databases string")


def test_only_the_named_regulator_loses_records(spark):
    first = records(spark, [
        (1, "AAA", "X", "other"), (2, "AAA", "X", "mine;other"), (3, "AAA", "AAA", "other"), (4, "AAA", "BAD", "mine"), (5, "BBB", "BAD", "other"),
        (6, "BBB", "X", None), (7, "AAA", "X", None), (8, "Aaa", "bad", "mine"), (9, "Aaa", "X", "other"), (10, "BBB", None, None),
    ])
    out = labels.append_and_exclude(first, records(spark, [(11, "AAA", "Y", "mine")]), "AAA", "mine", ["BAD"])
    assert sorted(r["record_id"] for r in out.collect()) == [2, 3, 5, 6, 9, 10, 11]


def test_experiment_classes_in_order(spark):
    texts = ["Chromatin binding assay", "Perturbation, then binding", "luciferase Reporter", "ChIP-seq", None]
    df = spark.createDataFrame([(t,) for t in texts], "experiment_type string")
    assert [r["experiment_class"] for r in labels.experiment_class(df).collect()] == ["Binding", "Perturbation", "Reporter", "NA", "NA"]


def test_rules_with_groups(spark):
    df = spark.createDataFrame([("T-cell 12 ",)], "t string")
    apply = lambda *a, **k: prep.apply_rules(df, "t", *a, **k).first()["t"]
    assert apply([(r"(\w+)-cell", "$1", False)]) == "T 12 "
    assert apply([(r"(\w+)-cell", "$1", False)], trim=True) == "T 12"
    assert apply([(r"(l)\1", "[$0$1]", False)]) == "T-ce[lll] 12 "
    assert apply([("e|l", "", False)]) == "T-cll 12 " and apply([(r"\d", r"\$", False)]) == "T-cell $2 "


def test_cells_without_counts_have_a_row(spark):
    expr = spark.createDataFrame([(1, 1, 5, 10.0), (1, 1, 6, 30.0)], "dataset_id int, cell_id int, gene int, value double")
    cells = spark.createDataFrame([(1, 1), (1, 2), (3, 1)], "dataset_id int, cell_id int")
    mt = spark.createDataFrame([(5,)], "gene int")
    out = {(r["dataset_id"], r["cell_id"]): (r["umi_counts"], r["gene_counts"], r["mt_ratio"]) for r in prep.count_info(expr, mt, cells).collect()}
    assert out == {(1, 1): (40.0, 2, 0.25), (1, 2): (0.0, 0, None), (3, 1): (0.0, 0, None)}


def test_bicor_of_a_pair_equals_all_pairs_and_names_are_checked(spark):
    rng = np.random.default_rng(0)
    rows = [(0, "a", i, g, float(v)) for i in range(80) for g in range(3) if (v := rng.poisson(1 + g) + (i % 7 == 0) * 3)]
    expr = spark.createDataFrame(rows, "dataset_id int, cell_type string, cell_id int, gene int, value double")
    meta = spark.createDataFrame([(0, "a", i) for i in range(80)], "dataset_id int, cell_type string, cell_id int")
    want = correlate.bicor_correlation(expr, meta, GeneSpan(0, 3), 5).filter("gene_a = 2 AND gene_b = 1").first()["r"]
    got = correlate.celltype_correlation(expr, meta, 1, 2, 5, "bicor").first()["r"]
    assert got == pytest.approx(want, abs=1e-5)
    assert got != pytest.approx(correlate.celltype_correlation(expr, meta, 1, 2, 5).first()["r"], abs=1e-4)
    with pytest.raises(ValueError):
        correlate.celltype_correlation(expr, meta, 1, 2, 5, "kendal")


def test_incomplete_columns_are_refused(spark):
    rows = [("k", c, g, float(g * (c + 1) % 5)) for c in range(3) for g in range(6)]
    full = spark.createDataFrame(rows, "key string, dataset_id int, gene int, score double")
    assert similarity.column_correlations(full, ["key"], "dataset_id").count() == 3
    for bad in (full.filter("NOT (dataset_id = 1 AND gene = 2)"), full.selectExpr("key", "dataset_id", "gene", "CASE WHEN dataset_id = 1 AND gene = 2 THEN NULL ELSE score END AS score")):
        with pytest.raises(Exception, match="without a score"):
            similarity.column_correlations(bad, ["key"], "dataset_id").collect()


def test_set_p_values_count_the_null(spark):
    ranks = spark.createDataFrame([("s", 1, g, g) for g in range(1, 13)], "species string, tf int, gene int, rk int")
    sets = spark.createDataFrame([("first", g) for g in (1, 2, 3)] + [("last", g) for g in (10, 11, 12)], "set_id string, gene int")
    out = {r["set_id"]: r for r in enrich.enrichment(ranks, sets, "rk", 400, 3).collect()}
    assert out["first"]["avg_precision"] == 1.0 and out["first"]["p_value"] < 0.05 < 0.9 < out["last"]["p_value"] <= 1
    exact = 1 / 220  # of all sets of three
    assert out["first"]["p_value"] == pytest.approx(exact, abs=0.012)
