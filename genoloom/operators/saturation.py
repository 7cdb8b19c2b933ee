"""How many datasets a regulator's consensus needs: subsample, average, compare top sets."""
from __future__ import annotations

import hashlib
import math
from collections.abc import Collection, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import fix10
from ..functions.ranks import random_rank
from ..functions.stats import six_numbers
from .rankings import average_profile
from .similarity import overlap, packed_top

TF = ["species", "tf"]


def average_top(imputed: DataFrame, k: int) -> DataFrame:
    """Top k of the average over all datasets, one array per regulator."""
    return packed_top(average_profile(imputed), ["species"], "tf", k).withColumnRenamed("genes", "global_top")


def dataset_overlap(imputed: DataFrame, k: int) -> DataFrame:
    """Top-k overlap of every single dataset with the average."""
    sets = packed_top(imputed, TF, "dataset_id", k)
    return sets.join(average_top(imputed, k), TF).select(*TF, "dataset_id", overlap("genes", "global_top").alias("topk"))


def sample_overlap(imputed: DataFrame, sample: DataFrame, k: int) -> DataFrame:
    """Overlap of the average of a chosen sample (species, tf, dataset_id) with the global average."""
    part = average_profile(imputed.join(sample, [*TF, "dataset_id"], "left_semi"))
    sets = packed_top(part, ["species"], "tf", k)
    return sets.join(average_top(imputed, k), TF).select(*TF, overlap("genes", "global_top").alias("topk"))


def _top(score: np.ndarray, genes: np.ndarray, k: int) -> np.ndarray:
    """The genes of the tie-adjusted top k of one profile, by the rule of ``ranks.top_set``; ``genes`` are in rising order."""
    have = np.flatnonzero(~np.isnan(score))
    if len(have) > k:
        # the k largest and all that tie with the last of them
        least = np.partition(score[have], len(have) - k)[len(have) - k]
        have = have[score[have] >= least]
    best = have[np.argsort(-score[have], kind="stable")][:k]
    if not len(best):
        return genes[:0]
    before = int((score[best] > score[best[-1]]).sum())
    return genes[best[: len(best) if before + 1 >= len(best) else max(before, 1)]]


def _running(key: tuple[Any, ...], rows: pd.DataFrame, k: int, n_iter: int, seed: int, steps: Collection[int] | None) -> Iterator[tuple[int, int, int]]:
    """(step, iter, overlap) of one regulator: its profiles are laid out once, all orders run over them."""
    genes, column = np.unique(rows["gene"].to_numpy(), return_inverse=True)
    datasets, line = np.unique(rows["dataset_id"].to_numpy(), return_inverse=True)
    n = len(datasets)
    if n < 3:
        return
    profile = np.full((n, len(genes)), np.nan)
    profile[line, column] = rows["score"].to_numpy(float)
    known = ~np.isnan(profile)
    profile[~known] = 0.0

    def mean(total: np.ndarray, count: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return np.floor(total / count * 1e10 + 0.5) / 1e10

    overall = set(_top(mean(profile.sum(0), known.sum(0)), genes, k).tolist())
    last = n - 1 if steps is None else min(n - 1, max(steps, default=0))
    for i in range(1, n_iter + 1):
        keys = [(hashlib.md5("|".join(map(str, (seed, *key, i, d))).encode()).hexdigest(), d) for d in datasets.tolist()]
        total, count = np.zeros(len(genes)), np.zeros(len(genes), np.int64)
        for step, at in enumerate(sorted(range(n), key=keys.__getitem__)[:last], 1):
            total += profile[at]
            count += known[at]
            if step >= 2 and (steps is None or step in steps):
                yield step, i, len(overall.intersection(_top(mean(total, count), genes, k).tolist()))


def step_overlaps(imputed: DataFrame, k: int, n_iter: int, seed: int, steps: Collection[int] | None = None) -> DataFrame:
    """Overlap of every (iteration, step) average with the global average; ``steps`` picks some steps.

    The sample of size ``step`` is the first ``step`` datasets of the iteration's seeded order, so the
    averages of all steps are one running mean; each step still sees uniform samples. At least three
    datasets are needed. A regulator's profiles (datasets x genes, bounded by the gene list) meet in
    one task, which runs through all orders: what is shuffled does not grow with the iterations.
    """
    kind = {f.name: f.dataType.simpleString() for f in imputed.schema.fields}

    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(_running(key, rows, k, n_iter, seed, steps), columns=["step", "iter", "topk"], dtype="int64")
        return found.assign(species=key[0], tf=key[1])[[*TF, "step", "iter", "topk"]]

    schema = f"species {kind['species']}, tf {kind['tf']}, step long, iter int, topk long"
    return imputed.select(*TF, "dataset_id", "gene", "score").groupBy(*TF).applyInPandas(run, schema)


def step_summary(steps: DataFrame) -> DataFrame:
    """Six numbers over the iterations of each step."""
    out = steps.groupBy(*TF, "step").agg(*six_numbers("topk"))
    return out.withColumn("mean", fix10("mean")).withColumnRenamed("step", "n_step")


def single_step(imputed: DataFrame, step: int, k: int, n_iter: int, seed: int) -> DataFrame:
    return step_summary(step_overlaps(imputed, k, n_iter, seed, {step}))


def saturation(imputed: DataFrame, k: int, n_iter: int, seed: int) -> DataFrame:
    """Both result tables of all regulators in long form: single datasets and step means."""
    single = dataset_overlap(imputed, k).select(
        *TF, F.lit("experiments").alias("part"), F.col("dataset_id").cast("string").alias("item"), F.col("topk").cast("double").alias("value")
    )
    steps = step_summary(step_overlaps(imputed, k, n_iter, seed)).select(
        *TF, F.lit("steps").alias("part"), F.col("n_step").cast("string").alias("item"), F.col("mean").alias("value")
    )
    return single.join(steps.select(*TF).distinct(), TF, "left_semi").unionByName(steps)


def rank_datasets(single: DataFrame, seed: int) -> DataFrame:
    """Datasets of a regulator ranked by overlap, ties at random; rs is 1 for the best."""
    n = F.count(F.lit(1)).over(W.partitionBy(*TF))
    ranked = single.withColumn("rank", random_rank(TF, "topk", seed, F.concat_ws("|", *TF, "dataset_id")))
    return ranked.withColumn("rs", (n + 1 - F.col("rank")) / n.cast("double"))


def rank_table(ranked: DataFrame, datasets: DataFrame) -> DataFrame:
    """Regulator by dataset of the same species; 0 where the regulator is not measured."""
    spine = ranked.select(*TF).distinct().join(datasets.select("species", "dataset_id"), "species")
    return spine.join(ranked.select(*TF, "dataset_id", "rs"), [*TF, "dataset_id"], "left").select(
        *TF, "dataset_id", F.coalesce("rs", F.lit(0.0)).alias("rs")
    )


def dataset_agreement(table: DataFrame, info: DataFrame) -> DataFrame:
    """Mean rs per dataset with its metadata and a flag for one platform family."""
    mean = table.groupBy("species", "dataset_id").agg(F.avg("rs").alias("mean_rs"))
    return mean.join(info, ["species", "dataset_id"], "left").withColumn("is_10x", F.col("platform").rlike("^10x"))


def datasets_for_recovery(steps: DataFrame, k: int, recover: float = 0.8, by: str = "mean") -> DataFrame:
    """Step whose mean overlap is the smallest that still reaches ``recover * k``.

    ``by="step"`` takes the smallest such step instead. Regulators that never reach it drop out.
    """
    order = F.struct("mean", "n_step") if by == "mean" else F.struct("n_step", "mean")
    total = steps.groupBy(*TF).agg(F.max("n_step").alias("_max"))
    first = steps.filter(F.col("mean") >= k * recover).groupBy(*TF).agg(F.min_by("n_step", order).alias("min_step"))
    return first.join(total, TF).select(*TF, "min_step", (F.col("min_step") / (F.col("_max") + 1)).alias("prop_total"))


def _grid_fit(steps: DataFrame, grid: Column) -> DataFrame:
    f = 1 - F.exp(-F.col("b") * F.col("n_step"))
    y = F.col("mean")
    sums = (
        steps.withColumn("b", F.explode(grid))
        .groupBy(*TF, "b")
        .agg(F.sum(y * f).alias("yf"), F.sum(f * f).alias("ff"), F.sum(y * y).alias("yy"))
        .withColumn("a", F.try_divide(F.col("yf"), F.col("ff")))
        .withColumn("sse", F.round(F.col("yy") - F.col("a") * F.col("yf"), 9))
    )
    return sums.groupBy(*TF).agg(F.min_by(F.struct("a", "b", "sse"), F.struct("sse", "b")).alias("_f")).select(*TF, "_f.*")


GRID = [math.exp(math.log(0.001) + i * (math.log(10.0) - math.log(0.001)) / 60) for i in range(61)]
FINE = [-1.0 + i / 20.0 for i in range(41)]  # in coarse grid steps around the coarse optimum


def exponential_fit(steps: DataFrame) -> DataFrame:
    """Least-squares fit of mean = a (1 - exp(-b n)): grid over b, refined once around the best.

    For a given b the best a is a ratio of sums, so each candidate is a row of one aggregate.
    """
    steps = steps.select(*TF, "n_step", "mean")
    ratio = math.log(GRID[1] / GRID[0])
    coarse = _grid_fit(steps, F.array(*[F.lit(b) for b in GRID])).select(*TF, F.col("b").alias("b0"))
    fine = F.transform(F.array(*[F.lit(x) for x in FINE]), lambda x: F.col("b0") * F.exp(x * F.lit(ratio)))
    return _grid_fit(steps.join(coarse, TF), fine)
