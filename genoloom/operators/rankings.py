"""Ranks within and across datasets, imputation, consensus ranking per regulator."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import count_true, fix10
from ..functions.stats import large_group_median
from ..functions.ranks import grouped_rank, min_rank, random_rank, tie_adjusted_k

TF = ("species", "tf")
AVG = "Avg"


def rank_columns(df: DataFrame, column: list[str], value: str, ties: str = "random", item: str = "gene", seed: int = 1) -> DataFrame:
    """Rank within each column, 1 = largest; NULL stays NULL."""
    if ties == "min":
        return df.withColumn("rank", min_rank(column, value))
    return df.withColumn("rank", random_rank(column, value, seed, item))


def rank_matrix(df: DataFrame, keys: list[str], value: str, distributed: bool = True) -> DataFrame:
    """Rank over all cells of a matrix; a matrix may exceed one task, so the rank is distributed."""
    return grouped_rank(df, keys, value, "rank") if distributed else df.withColumn("rank", min_rank(keys, value))


def without_self(profile: DataFrame) -> DataFrame:
    """The regulator's own row becomes NULL."""
    return profile.withColumn("score", F.when(F.col("gene") != F.col("tf"), F.col("score")))


def impute_to_median(profile: DataFrame, msr: DataFrame) -> DataFrame:
    """Genes a dataset does not measure take the median of the regulator's whole profile block.

    The block is datasets by genes, so its median is the distributed one.
    """
    own = without_self(profile)
    med = large_group_median(own, TF, "score", "_med")
    return (
        own.join(msr, ["dataset_id", "gene"])
        .join(med, list(TF), "left")
        .select(
            *TF, "dataset_id", "gene", F.when(~F.col("measured"), F.col("_med")).otherwise(F.col("score")).alias("score")
        )
    )


def average_profile(profile: DataFrame) -> DataFrame:
    return profile.groupBy(*TF, "gene").agg(fix10(F.avg("score")).alias("score"))


def with_average(imputed: DataFrame) -> DataFrame:
    """Append the mean over datasets as one more column named Avg."""
    rows = imputed.withColumn("dataset_id", F.col("dataset_id").cast("string"))
    avg = average_profile(imputed).withColumn("dataset_id", F.lit(AVG))
    return rows.unionByName(avg.select(rows.columns))


def topk_threshold(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """Value at the tie-adjusted k of each group; groups with k' = 0 have none."""
    k_eff = tie_adjusted_k(df, keys, value, k).filter("k_eff > 0")
    ranked = df.filter(F.col(value).isNotNull()).withColumn("_rk", min_rank(keys, value))
    return (
        ranked.join(k_eff, keys)
        .filter(F.col("_rk") <= F.col("k_eff"))
        .groupBy(*keys)
        .agg(F.min(value).alias("threshold"))
    )


def topk_count(df: DataFrame, k: int) -> DataFrame:
    """Per regulator and gene: datasets in which the score reaches the k-th value."""
    keys = [*TF, "dataset_id"]
    thr = topk_threshold(df, keys, "score", k)
    hit = F.col("score") >= F.col("threshold")
    return df.join(thr, keys, "left").groupBy(*TF, "gene").agg(count_true(hit).alias("topk_count"))


def consensus_ranks(profile: DataFrame, msr: DataFrame, comsr: DataFrame, k: int) -> DataFrame:
    """Consensus table per regulator: average, its rank, best single rank, top-k count, datasets."""
    imputed = impute_to_median(profile, msr)
    keys = [*TF, "dataset_id"]
    thr = topk_threshold(imputed, keys, "score", k)
    per_gene = (
        imputed.withColumn("_rk", min_rank(keys, "score"))
        .join(thr, keys, "left")
        .groupBy(*TF, "gene")
        .agg(
            fix10(F.avg("score")).alias("avg_aggr_coexpr"),
            F.min("_rk").alias("rank_single_best"),
            count_true(F.col("score") >= F.col("threshold")).alias("topk_count"),
        )
        .withColumn("rank_aggr_coexpr", min_rank(TF, "avg_aggr_coexpr"))
    )
    n = comsr.select("species", F.col("gene"), F.col("partner").alias("tf"), "n_comeasured")
    own = F.col("gene") == F.col("tf")
    out = per_gene.join(n, ["species", "tf", "gene"], "left")
    blank = {c: F.when(~own, F.col(c)) for c in ("avg_aggr_coexpr", "rank_single_best", "topk_count", "rank_aggr_coexpr")}
    return out.withColumns(blank).select(
        *TF, "gene", "rank_aggr_coexpr", "n_comeasured", "avg_aggr_coexpr", "rank_single_best", "topk_count"
    )


def species_side(ranks: DataFrame, ortho: DataFrame, species: str, tag: str, columns: list[str]) -> DataFrame:
    """One species' rank rows on ortholog genes and regulators, keyed by ortholog ids."""
    tf = ortho.select(F.col(f"gene_{tag}").alias("tf"), F.col("id").alias("tf_id"))
    gene = ortho.select(F.col(f"gene_{tag}").alias("gene"), "id")
    side = ranks.filter(F.col("species") == species).join(tf, "tf").join(gene, "gene")
    return side.select("tf_id", "id", *[F.col(c).alias(f"{c}_{tag}") for c in columns])


def join_ortholog_ranks(ranks: DataFrame, ortho: DataFrame) -> DataFrame:
    """Consensus tables of both species on their orthologs, re-ranked there, with a rank product."""
    cols = ["avg_aggr_coexpr", "n_comeasured", "rank_single_best", "topk_count"]
    hg = species_side(ranks, ortho, "Human", "hg", cols)
    mm = species_side(ranks, ortho, "Mouse", "mm", cols)
    hg = hg.join(mm.select("tf_id").distinct(), "tf_id", "left_semi")
    hg = hg.withColumn("rank_aggr_coexpr_hg", min_rank(["tf_id"], "avg_aggr_coexpr_hg"))
    mm = mm.withColumn("rank_aggr_coexpr_mm", min_rank(["tf_id"], "avg_aggr_coexpr_mm"))
    both = hg.join(mm, ["tf_id", "id"], "left")
    product = F.col("rank_aggr_coexpr_hg") * F.col("rank_aggr_coexpr_mm")
    return both.withColumn("_p", product).withColumn("rank_aggr_coexpr_ortho", min_rank(["tf_id"], "_p", False)).drop("_p")


def top_partners(ranks: DataFrame, n: int) -> DataFrame:
    """The first n rows of each consensus table, ties in gene order."""
    w = W.partitionBy(*TF).orderBy(F.col("rank_aggr_coexpr").asc_nulls_last(), "gene")
    return ranks.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def count_set_members(ranks: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """How many of the top n partners of each set member belong to the set."""
    lists = ranks.join(members.select(F.col("gene").alias("tf")), "tf", "left_semi")
    flag = members.select("gene", F.lit(1).alias("_in"))
    return top_partners(lists, n).join(flag, "gene", "left").groupBy(*TF).agg(F.count("_in").alias("n_in_set"))


def count_non_members(ranks: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """Genes outside the set by how often they reach the top n."""
    lists = ranks.join(members.select(F.col("gene").alias("tf")), "tf", "left_semi")
    return (
        top_partners(lists, n)
        .join(members.select("gene"), "gene", "left_anti")
        .groupBy("species", "gene")
        .agg(F.count(F.lit(1)).alias("n_lists"))
    )


def binary_block(ranks: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Set by set block, 1 where the rank is within k."""
    m = members.select("gene")
    block = ranks.join(m, "gene", "left_semi").join(m.select(F.col("gene").alias("tf")), "tf", "left_semi")
    return block.select(*TF, "gene", (F.col("rank_aggr_coexpr") <= k).cast("int").alias("in_top"))


def reverse_score(df: DataFrame, column: str) -> DataFrame:
    """Change the direction of a score or a rank."""
    return df.withColumn(column, -F.col(column))
