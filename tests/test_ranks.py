import random

import numpy as np
import pandas as pd

import pytest
from pyspark.sql import functions as F

from genoloom.functions.ranks import avg_rank, grouped_rank, max_rank, min_rank, random_rank, range_of, range_splits, tie_adjusted_k, top_set, value_positions


def column(spark, scores):
    rows = [("a", i, None if s is None else float(s)) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "k string, gene int, v double")


@pytest.mark.parametrize(
    "scores, k, k_eff",
    [
        ([5, 4, 4, 4, 1], 3, 1),
        ([5, 4, 3, 3, 3], 3, 3),
        ([2, 2, 2, 1], 2, 0),
        ([5, 4, None, 3], 3, 3),
        ([5, 4], 3, 2),
    ],
)
def test_tie_adjusted_k(spark, scores, k, k_eff):
    assert tie_adjusted_k(column(spark, scores), ["k"], "v", k).first()["k_eff"] == k_eff


@pytest.mark.parametrize(
    "scores, k, genes",
    [
        ([5, 4, 4, 4, 1], 3, {0}),
        ([5, 4, 3, 3, 3], 3, {0, 1, 2}),  # a block that starts at k is cut by gene order
        ([2, 2, 2, 1], 2, {0}),  # never an empty set
    ],
)
def test_top_set(spark, scores, k, genes):
    assert {r["gene"] for r in top_set(column(spark, scores), ["k"], "v", "gene", k).collect()} == genes


def test_bottom_set_and_no_check(spark):
    df = column(spark, [5, 4, 3, 2, 1])
    assert {r["gene"] for r in top_set(df, ["k"], "v", "gene", 2, descending=False).collect()} == {3, 4}
    tied = column(spark, [5, 4, 4, 4, 1])
    assert {r["gene"] for r in top_set(tied, ["k"], "v", "gene", 3, check_k=False).collect()} == {0, 1, 2}


def test_rank_kinds(spark):
    df = column(spark, [3, 2, 2, 1, None])
    out = df.select(
        "gene", min_rank(["k"], "v").alias("mn"), max_rank(["k"], "v").alias("mx"), avg_rank(["k"], "v", True).alias("av")
    ).orderBy("gene").collect()
    assert [r["mn"] for r in out] == [1, 2, 2, 4, None]
    assert [r["mx"] for r in out] == [1, 3, 3, 4, 5]
    assert [r["av"] for r in out] == [1.0, 2.5, 2.5, 4.0, None]


def test_random_rank_repeats_and_permutes_ties(spark):
    df = column(spark, [1] * 20)
    one = [r["r"] for r in df.select("gene", random_rank(["k"], "v", 1, "gene").alias("r")).orderBy("gene").collect()]
    again = [r["r"] for r in df.repartition(5).select("gene", random_rank(["k"], "v", 1, "gene").alias("r")).orderBy("gene").collect()]
    other = [r["r"] for r in df.select("gene", random_rank(["k"], "v", 2, "gene").alias("r")).orderBy("gene").collect()]
    assert one == again and sorted(one) == list(range(1, 21)) and one != other


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("method", ["min", "avg"])
def test_grouped_rank_equals_window(spark, descending, method):
    rng = random.Random(3)
    rows = []
    for g in range(3):
        for i in range(700):
            # one value holds a third of the rows, some are NULL, zero has both signs
            v = rng.choice([0.0, -0.0, round(rng.gauss(0, 1), 2), 7.5, 7.5, None])
            rows.append((g, i, v))
    df = spark.createDataFrame(rows, "g int, i int, v double").repartition(6)
    window = min_rank(["g"], F.col("v") + 0.0, descending) if method == "min" else avg_rank(["g"], F.col("v") + 0.0, descending)
    want = {(r["g"], r["i"]): r["w"] for r in df.withColumn("v", F.when(F.col("v") == 0, 0.0).otherwise(F.col("v"))).select("g", "i", window.alias("w")).collect()}
    got = {(r["g"], r["i"]): r["rk"] for r in grouped_rank(df, ["g"], "v", "rk", descending, range_rows=64, method=method).collect()}
    assert got == want


def test_ranges_are_even_whatever_the_distribution(spark):
    """One extreme value, a group of ties and a small group beside 200,000 log-normal values: no range exceeds four times its share."""
    rng = np.random.default_rng(5)
    skewed = np.append(rng.lognormal(3, 2, 200_000), 1e9)
    rows = pd.concat([pd.DataFrame({"g": "skewed", "v": skewed}), pd.DataFrame({"g": "ties", "v": np.repeat([1.0, 2.0], 5000)}), pd.DataFrame({"g": "small", "v": np.arange(50.0)})])
    df = spark.createDataFrame(rows).repartition(8)
    dist = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    cut = dist.join(range_splits(dist, ["g"], "v", 4096, "n"), ["g"], "left").withColumn("range", range_of("v"))
    sizes = {}
    for r in cut.groupBy("g", "range").count().collect():
        sizes.setdefault(r["g"], {})[r["range"]] = r["count"]
    assert len(sizes["ties"]) == len(sizes["small"]) == 1
    own = sizes["skewed"]
    assert 40 <= len(own) <= 60 and sorted(own) == list(range(len(own))) and max(own.values()) <= 4 * 200_001 / len(own)
    got = value_positions(df.filter("g = 'skewed'"), ["g"], "v", False, 4096).toPandas().sort_values("v")
    values, counts = np.unique(skewed, return_counts=True)
    assert (got["v"].to_numpy() == values).all() and (got["n_before"].to_numpy() == np.cumsum(counts) - counts).all()


def test_range_of_counts_splits(spark):
    df = spark.createDataFrame([(v, s) for v in (-1.0, 0.0, 1.5, 2.0, 9.0) for s in ([], [0.0], [0.0, 2.0], [-1.0, 0.0, 1.0, 2.0, 3.0])] + [(1.0, None)], "v double, _splits array<double>")
    for r in df.withColumn("n", range_of("v")).collect():
        assert r["n"] == sum(x <= r["v"] for x in r["_splits"] or [])
