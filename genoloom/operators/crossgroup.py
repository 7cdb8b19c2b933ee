"""Two groups of the same profiles (two species) compared through an ortholog key.

``ranks`` is the joined table of :func:`rankings.join_ortholog_ranks`: tf_id, id and the scores of
both sides with suffixes _hg and _mm. ``overlap_table`` is sparse: an absent pair of regulators has
overlap zero, and the summaries below count those pairs without making them rows; ``overlap_matrix``
has them all.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import fix10
from ..functions.ranks import min_rank
from ..functions.sampling import hash_key, with_draws
from ..functions.stats import spearman


def side_correlation(ranks: DataFrame) -> DataFrame:
    """Spearman of both averages per regulator."""
    return spearman(ranks, ["tf_id"], "avg_aggr_coexpr_hg", "avg_aggr_coexpr_mm").withColumnRenamed("spearman", "cor")


def top_with_ties(ranks: DataFrame, column: str, k: int, reverse: bool = False) -> DataFrame:
    """The k best genes per regulator on one side; ties at k are all kept."""
    rows = ranks.filter(F.col(column).isNotNull()).withColumn("_r", min_rank(["tf_id"], column, not reverse))
    return rows.filter(F.col("_r") <= k).select("tf_id", "id")


def overlap_table(ranks: DataFrame, k: int, reverse: bool = False) -> DataFrame:
    """Non-zero top-k overlaps of every regulator on one side with every regulator on the other.

    The join is on the gene, and the count combines before the shuffle.
    """
    hg = top_with_ties(ranks, "avg_aggr_coexpr_hg", k, reverse).withColumnRenamed("tf_id", "tf_hg")
    mm = top_with_ties(ranks, "avg_aggr_coexpr_mm", k, reverse).withColumnRenamed("tf_id", "tf_mm")
    return hg.join(mm, "id").groupBy("tf_hg", "tf_mm").agg(F.count(F.lit(1)).alias("overlap"))


def overlap_matrix(ranks: DataFrame, k: int, reverse: bool = False, blocks: int = 32) -> DataFrame:
    """The whole matrix of overlaps, zeros included: every regulator of one side in every block of the other."""
    tfs = ranks.select("tf_id").distinct()
    rows = tfs.select(F.col("tf_id").alias("tf_hg"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    columns = tfs.select(F.col("tf_id").alias("tf_mm"), F.pmod(F.xxhash64("tf_id"), F.lit(blocks)).cast("int").alias("_b"))
    found = overlap_table(ranks, k, reverse)
    dense = rows.join(columns, "_b").join(found, ["tf_hg", "tf_mm"], "left")
    return dense.select("tf_hg", "tf_mm", F.coalesce("overlap", F.lit(0).cast("long")).alias("overlap"))


def overlap_quantiles(overlaps: DataFrame, tfs: DataFrame) -> DataFrame:
    """Overlap with the own ortholog and its ecdf among the others, by row and by column."""
    n_other = F.lit(tfs.count() - 1).cast("double")  # the length of the regulator list
    own = tfs.select("tf_id").join(
        overlaps.filter("tf_hg = tf_mm").select(F.col("tf_hg").alias("tf_id"), F.col("overlap").alias("count")), "tf_id", "left"
    ).withColumn("count", F.coalesce("count", F.lit(0)))

    def larger(side: str, name: str) -> DataFrame:
        other = overlaps.filter("tf_hg <> tf_mm").select(F.col(side).alias("tf_id"), "overlap")
        return other.join(own, "tf_id").groupBy("tf_id").agg(F.count_if(F.col("overlap") > F.col("count")).alias(name))

    out = own.join(larger("tf_hg", "_a"), "tf_id", "left").join(larger("tf_mm", "_b"), "tf_id", "left")
    below = lambda c: (n_other - F.coalesce(c, F.lit(0))) / n_other
    return out.select("tf_id", "count", below("_a").alias("quant_hg_in_mm"), below("_b").alias("quant_mm_in_hg")).withColumn(
        "quant_ortho", (F.col("quant_hg_in_mm") + F.col("quant_mm_in_hg")) / 2
    )


def random_pairs(tfs: DataFrame, n_draws: int, seed: int) -> DataFrame:
    """Per draw two different regulators: the two smallest hashes, by aggregates with map-side combine."""
    key = F.struct(hash_key(seed, "iter", "tf_id").alias("h"), F.col("tf_id").alias("t"))
    drawn = with_draws(tfs.select("tf_id"), n_draws).withColumn("_k", key)
    first = drawn.groupBy("iter").agg(F.min("_k").alias("_k1"))
    second = drawn.join(first, "iter").filter(F.col("_k") > F.col("_k1")).groupBy("iter").agg(F.min("_k").alias("_k2"))
    return first.join(second, "iter").select("iter", F.col("_k1.t").alias("tf_hg"), F.col("_k2.t").alias("tf_mm"))


def null_overlap(overlaps: DataFrame, tfs: DataFrame, n_draws: int, seed: int) -> DataFrame:
    pairs = random_pairs(tfs, n_draws, seed)
    return pairs.join(overlaps, ["tf_hg", "tf_mm"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))


def null_correlation(ranks: DataFrame, tfs: DataFrame, n_draws: int, seed: int) -> DataFrame:
    """Spearman of the ranks of two different regulators, both removed as genes."""
    pairs = random_pairs(tfs, n_draws, seed)
    hg = ranks.select(F.col("tf_id").alias("tf_hg"), "id", F.col("rank_aggr_coexpr_hg").alias("x"))
    mm = ranks.select(F.col("tf_id").alias("tf_mm"), "id", F.col("rank_aggr_coexpr_mm").alias("y"))
    rows = pairs.join(hg, "tf_hg").join(mm, ["tf_mm", "id"]).filter("id <> tf_hg AND id <> tf_mm")
    return pairs.join(spearman(rows, ["iter"], "x", "y"), "iter", "left")


def enough_datasets(ranks: DataFrame, n_exp: DataFrame, ortho: DataFrame, min_exp: int) -> DataFrame:
    """Regulators measured in enough datasets on both sides."""

    def ok(species: str, tag: str) -> DataFrame:
        tf = ortho.select(F.col(f"gene_{tag}").alias("tf"), F.col("id").alias("tf_id"))
        return n_exp.filter((F.col("species") == species) & (F.col("n_exp") >= min_exp)).join(tf, "tf").select("tf_id")

    tfs = ranks.select("tf_id").distinct()
    return tfs.join(ok("Human", "hg"), "tf_id", "left_semi").join(ok("Mouse", "mm"), "tf_id", "left_semi")


def prefixed(df: DataFrame, prefix: str, key: str = "tf_id") -> DataFrame:
    return df.select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != key])


def wide_similarity(cor: DataFrame, top: DataFrame, bottom: DataFrame) -> DataFrame:
    """All similarity columns of a regulator in one row."""
    return cor.join(prefixed(top, "topk"), "tf_id", "left").join(prefixed(bottom, "bottomk"), "tf_id", "left")


def rank_differences(ranks: DataFrame, tf_id: str) -> DataFrame:
    a, b = F.col("rank_aggr_coexpr_hg"), F.col("rank_aggr_coexpr_mm")
    return ranks.filter(F.col("tf_id") == tf_id).select("id", (a - b).alias("diff_rank"), (a + b).alias("add_rank"))


def one_against_all(overlaps: DataFrame, tfs: DataFrame, tf_id: str) -> DataFrame:
    """Row and column of one regulator, zeros included."""
    row = overlaps.filter(F.col("tf_hg") == tf_id).select(F.col("tf_mm").alias("tf_id"), F.col("overlap").alias("hg_in_mm"))
    column = overlaps.filter(F.col("tf_mm") == tf_id).select(F.col("tf_hg").alias("tf_id"), F.col("overlap").alias("mm_in_hg"))
    zero = F.lit(0).cast("long")
    return tfs.select("tf_id").join(row, "tf_id", "left").join(column, "tf_id", "left").select(
        "tf_id", F.coalesce("hg_in_mm", zero).alias("hg_in_mm"), F.coalesce("mm_in_hg", zero).alias("mm_in_hg")
    )


def shared_top(ranks: DataFrame, k: int) -> DataFrame:
    """Genes in the top k of both sides of a regulator."""
    return top_with_ties(ranks, "avg_aggr_coexpr_hg", k).join(top_with_ties(ranks, "avg_aggr_coexpr_mm", k), ["tf_id", "id"], "left_semi")


def generic_overlap(overlaps: DataFrame, tfs: DataFrame) -> DataFrame:
    """Mean overlap of a regulator with all regulators of the other side, in both directions."""
    n = F.lit(float(tfs.count()))
    row = overlaps.groupBy(F.col("tf_hg").alias("tf_id")).agg((F.sum("overlap") / n).alias("hg_in_mm"))
    column = overlaps.groupBy(F.col("tf_mm").alias("tf_id")).agg((F.sum("overlap") / n).alias("mm_in_hg"))
    return tfs.select("tf_id").join(row, "tf_id", "left").join(column, "tf_id", "left").select(
        "tf_id", fix10(F.coalesce("hg_in_mm", F.lit(0.0))).alias("hg_in_mm"), fix10(F.coalesce("mm_in_hg", F.lit(0.0))).alias("mm_in_hg")
    )


def hubs(common: DataFrame, wide: DataFrame, n: int = 5) -> DataFrame:
    """Regulators among the n most generic in either direction, with their similarity row."""
    w = lambda c: F.rank().over(W.orderBy(F.col(c).desc()))
    top = common.withColumn("_a", w("hg_in_mm")).withColumn("_b", w("mm_in_hg")).filter(f"_a <= {n} OR _b <= {n}").drop("_a", "_b")
    return top.join(wide, "tf_id", "left")


def extremes(quantiles: DataFrame) -> DataFrame:
    """How many regulators have no overlap, or the largest one by row, by column, by both."""
    return quantiles.agg(
        F.count_if(F.col("count") == 0).alias("count0"),
        F.count_if(F.col("quant_hg_in_mm") == 1).alias("quant_hg1"),
        F.count_if(F.col("quant_mm_in_hg") == 1).alias("quant_mm1"),
        F.count_if(F.col("quant_ortho") == 1).alias("quant_ortho1"),
    )


def slices(wide: DataFrame, low_cor: float, high_cor: float) -> DataFrame:
    """One row per regulator with the flags that define the slices."""
    return wide.select(
        "tf_id",
        (F.col("topk_count") == 0).alias("no_topk"),
        (F.col("bottomk_count") == 0).alias("no_bottomk"),
        (F.col("cor") < low_cor).alias("low_cor"),
        (F.col("cor") > high_cor).alias("high_cor"),
        ((F.col("bottomk_quant_ortho") == 1) & (F.col("topk_quant_ortho") < 1)).alias("bottom_not_top"),
        ((F.col("topk_quant_ortho") == 1) & (F.col("topk_count") > 0)).alias("most_specific"),
    )


def top_in_both_directions(ranks: DataFrame, k: int) -> DataFrame:
    """Per regulator: genes in both top sets and genes in both bottom sets."""
    top = shared_top(ranks, k).groupBy("tf_id").agg(F.count(F.lit(1)).alias("n_top"))
    bottom = top_with_ties(ranks, "avg_aggr_coexpr_hg", k, True).join(
        top_with_ties(ranks, "avg_aggr_coexpr_mm", k, True), ["tf_id", "id"], "left_semi"
    ).groupBy("tf_id").agg(F.count(F.lit(1)).alias("n_bottom"))
    tfs = ranks.select("tf_id").distinct()
    zero = F.lit(0).cast("long")
    return tfs.join(top, "tf_id", "left").join(bottom, "tf_id", "left").select(
        "tf_id", F.coalesce("n_top", zero).alias("n_top"), F.coalesce("n_bottom", zero).alias("n_bottom")
    )
