import math

import pytest
from pyspark.sql import functions as F

from genoloom.functions.stats import large_group_summary, normal_upper_tail, rank_sum_test, six_numbers
from genoloom.operators import enrich, integrate, labels, prep, rankings, saturation, similarity


def test_median_imputation_only_for_unmeasured(spark):
    profile = spark.createDataFrame(
        [("Human", 1, d, g, s) for d, g, s in [(0, 1, 1.0), (0, 2, 0.8), (0, 3, 0.2), (1, 1, 1.0), (1, 2, 0.6), (1, 3, 0.9)]],
        "species string, tf int, dataset_id int, gene int, score double",
    )
    msr = spark.createDataFrame([(d, g, (d, g) != (1, 3)) for d in (0, 1) for g in (1, 2, 3)], "dataset_id int, gene int, measured boolean")
    out = {(r["dataset_id"], r["gene"]): r["score"] for r in rankings.impute_to_median(profile, msr).collect()}
    assert out[(0, 1)] is None and out[(1, 1)] is None
    assert out[(1, 3)] == pytest.approx((0.6 + 0.8) / 2)
    assert out[(0, 3)] == 0.2


def test_bind_rank_puts_zero_blocks_and_missing_last(spark):
    df = spark.createDataFrame([("a", g, s) for g, s in [(1, 5.0), (2, 0.0), (3, 0.0), (4, None), (5, None)]], "k string, gene int, s double")
    out = [r["r"] for r in df.select("gene", integrate.bind_rank(["k"], "s", "gene").alias("r")).orderBy("gene").collect()]
    assert out == [1, 3, 3, 4, 5]


def test_tally_tells_not_eligible_from_empty(spark):
    rows = spark.createDataFrame([("a", "Human")], "tf_id string, tier string")
    elig = spark.createDataFrame([("a", True, True, True), ("b", True, False, False)], "tf_id string, has_hg boolean, has_mm boolean, has_ortho boolean")
    out = {r["tf_id"]: r for r in integrate.tally(rows, elig).collect()}
    assert out["a"]["Human"] == 1 and out["a"]["Stringent"] == 0 and out["a"]["Mouse"] == 0
    assert out["b"]["Human"] == 0 and out["b"]["Stringent"] is None and out["b"]["Mouse"] is None


def test_normal_tail_and_rank_sum(spark):
    df = spark.createDataFrame([(z,) for z in (-2.0, -0.5, 0.0, 1.0, 3.0)], "z double")
    for r in df.select("z", normal_upper_tail("z").alias("p")).collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(r["z"] / math.sqrt(2)), abs=2e-7)
    rows = spark.createDataFrame([(float(v), v > 5) for v in range(1, 11)], "v double, f boolean")
    out = rank_sum_test(rows.withColumn("k", F.lit(1)), ["k"], "v", "f").first()
    assert (out["n_first"], out["n_second"], out["u"]) == (5, 5, 25.0)
    assert out["p_greater"] == pytest.approx(0.0061, abs=2e-4)
    flat = spark.createDataFrame([(1, 2.0, True), (1, 2.0, False)], "k int, v double, f boolean")
    assert rank_sum_test(flat, ["k"], "v", "f").first()["p_two_sided"] is None


def test_large_group_summary_equals_six_numbers(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % 613 / 7.0).alias("v"))
    one = {r["k"]: r for r in df.groupBy("k").agg(*six_numbers("v")).collect()}
    for r in large_group_summary(df, ["k"], "v").collect():
        for name in ("min", "q1", "median", "mean", "q3", "max"):
            assert r[name] == pytest.approx(one[r["k"]][name], abs=1e-9)


def test_first_match_only_and_every_match(spark):
    df = spark.createDataFrame([("neuron_12_x_3",)], "t string")
    assert prep.apply_rules(df, "t", [("_[0-9]+", "", False)]).first()["t"] == "neuron_x_3"
    assert prep.apply_rules(df, "t", [("_[0-9]+", "", True)]).first()["t"] == "neuron_x"


def test_ambiguous_labels(spark):
    df = spark.createDataFrame([(x,) for x in ["Neuron", "unknown", "", "-", None, "Low UMI", "doublet", "Other glia"]], "cell_type string")
    assert {r["cell_type"] for r in prep.drop_ambiguous(df).collect()} == {"Neuron", "Other glia"}


def test_quality_limits(spark):
    cols = "cell_id int, assay string, umi_counts double, gene_counts int, rna_novelty double, mt_ratio double"
    df = spark.createDataFrame(
        [(1, "10x", 600.0, 300, 0.9, None), (2, "10x", 600.0, 300, 0.7, 0.1), (3, "Smart-seq2", 600.0, 300, 0.7, 0.1),
         (4, "10x", 600.0, 300, 0.9, 0.3), (5, "10x", 499.0, 300, 0.9, 0.1), (6, "10x", 600.0, 300, None, 0.1)], cols)
    assert {r["cell_id"] for r in prep.quality_cells(df).collect()} == {1, 3}


def test_layer_fallback(spark):
    df = spark.createDataFrame([(1, "counts", 0.0), (1, "data", 2.0), (2, "counts", 3.0), (2, "data", 9.0), (3, "data", 4.0)], "dataset_id int, layer string, value double")
    assert {(r["dataset_id"], r["value"]) for r in prep.choose_layer(df).collect()} == {(1, 2.0), (2, 3.0), (3, 4.0)}


def test_one_regulator_is_kept_from_one_source(spark):
    schema = "tf_symbol string, target_symbol string, databases string"
    a = spark.createDataFrame([("TT", "AA", "x"), ("TT", "TT", "x"), ("UU", "AA", "x")], schema)
    b = spark.createDataFrame([("TT", "BB", "y"), ("UU", "GONE", "y")], schema)
    out = {(r["tf_symbol"], r["target_symbol"]) for r in labels.append_and_exclude(a, b, "TT", "y", ["GONE"]).collect()}
    assert out == {("TT", "TT"), ("UU", "AA"), ("TT", "BB"), ("UU", "GONE")}  # the named targets go for that regulator only


def test_recovery_step_follows_the_mean(spark):
    steps = spark.createDataFrame([("Human", 1, s, m) for s, m in [(2, 7.0), (3, 8.6), (4, 8.2), (5, 9.0)]], "species string, tf int, n_step int, mean double")
    assert saturation.datasets_for_recovery(steps, 10).first()["min_step"] == 4
    assert saturation.datasets_for_recovery(steps, 10, by="step").first()["min_step"] == 3
    assert saturation.datasets_for_recovery(steps, 20).count() == 0


def test_exponential_fit_finds_the_rate(spark):
    steps = spark.createDataFrame([("Human", 1, n, 9.5 * (1 - math.exp(-0.37 * n))) for n in range(2, 15)], "species string, tf int, n_step int, mean double")
    fit = saturation.exponential_fit(steps).first()
    assert fit["b"] == pytest.approx(0.37, rel=0.01) and fit["a"] == pytest.approx(9.5, rel=0.01)


def test_single_dataset_has_no_similarity_and_no_saturation(spark):
    rows = [("Human", 1, 0, g, g / 10) for g in range(2, 9)]
    df = spark.createDataFrame(rows, "species string, tf int, dataset_id int, gene int, score double")
    assert similarity.similarity(df, ["species", "tf"], "dataset_id", 3).count() == 0
    assert saturation.step_overlaps(df, 3, 5, 1).count() == 0


def test_adjusted_p_values(spark):
    df = spark.createDataFrame([("H", 1, i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5])], "species string, tf int, set_id int, p double")
    out = {r["set_id"]: r["p_corrected"] for r in enrich.adjust(df, ["species", "tf"], "p", "set_id").collect()}
    assert out == {0: pytest.approx(0.04), 1: pytest.approx(0.16 / 3), 2: pytest.approx(0.16 / 3), 3: 0.5}


def test_planted_set_is_significant(spark):
    ranks = spark.createDataFrame([("H", 1, g, g) for g in range(1, 61)], "species string, tf int, gene int, rank int")
    sets = spark.createDataFrame([("top", g) for g in range(1, 7)] + [("spread", g) for g in range(5, 60, 10)], "set_id string, gene int")
    out = {r["set_id"]: r["p_value"] for r in enrich.enrichment(ranks, sets, "rank", 199, 1).collect()}
    assert out["top"] == pytest.approx(1 / 200) and out["spread"] > 0.2


def test_orthologs_drop_both_sides_of_a_double_match(spark):
    cols = "symbol_hg string, symbol_mm string, score double, id_type string, best_score string, best_score_rev string"
    src = spark.createDataFrame([("A", "a", 9.0, "MGI", "Yes", "Yes"), ("A", "b", 8.0, "MGI", "Yes", "Yes"), ("B", "b", 8.0, "MGI", "Yes", "Yes"), ("C", "c", 8.0, "MGI", "Yes", "Yes"), ("D", "d", 4.0, "MGI", "Yes", "Yes")], cols)
    names = lambda xs: spark.createDataFrame([(x,) for x in xs], "symbol string")
    out = enrich.format_orthologs(src, names("ABCD"), names("abcd")).collect()
    assert [r["id"] for r in out] == ["C_c"]


def test_union_of_partitioned_inputs_groups_right(spark):
    """Guards the union setting in genoloom.session.prepare."""
    df = spark.range(4000).select((F.col("id") % 97).alias("k"), "id")
    from pyspark.sql import Window as W

    top = lambda order: df.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy(order))).filter("r <= 3").select("k", "id")
    both = top(F.col("id")).unionByName(top(F.col("id").desc()))
    assert both.groupBy("k").count().count() == 97
