"""Agreement between profiles: tie-aware top-k overlap, Spearman, Jaccard, AUC; and summaries.

A profile is a column: ``keys`` name the matrix (a regulator, a draw), ``col`` the column (a
dataset), ``gene`` the row. Top-k sets are short arrays, so a pair of columns is one row and the
set comparison one expression. Correlations of all column pairs use the blocked product.
"""
from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import fix10, pearson_agg
from ..functions.ranks import avg_rank, min_rank, top_set
from ..functions.sampling import below, hash_key, with_draws
from ..functions.stats import six_numbers, spearman
from ..schemas import GeneSpan
from .correlate import pair_correlation
from .recovery import auc_from_positions, positions
from .tiles import fields


def packed_top(df: DataFrame, keys: list[str], col: str, k: int, descending: bool = True, value: str = "score", check_k: bool = True) -> DataFrame:
    """Top (or bottom) k genes of each column as one array of at most k entries; ``check_k`` shrinks k where it would cut a tie block."""
    top = top_set(df, [*keys, col], value, "gene", k, descending, check_k)
    return top.groupBy(*keys, col).agg(F.collect_list("gene").alias("genes"))


def top_and_bottom(df: DataFrame, keys: list[str], col: str, k: int, check_k: bool = True) -> DataFrame:
    """Per column the arrays t (top k), b (bottom k) and u (either)."""
    top = packed_top(df, keys, col, k, check_k=check_k).withColumnRenamed("genes", "t")
    bottom = packed_top(df, keys, col, k, False, check_k=check_k).withColumnRenamed("genes", "b")
    return top.join(bottom, [*keys, col]).withColumn("u", F.array_union("t", "b"))


def binarize(df: DataFrame, keys: list[str], col: str, k: int, check_k: bool = True) -> DataFrame:
    """Genes in the top or the bottom k of their column."""
    return top_and_bottom(df, keys, col, k, check_k).select(*keys, col, F.explode("u").alias("gene"))


def column_pairs(packed: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Unordered pairs of columns of the same matrix, with both arrays."""
    a = packed.select(*keys, F.col(col).alias("col_a"), F.col("genes").alias("genes_a"))
    b = packed.select(*keys, F.col(col).alias("col_b"), F.col("genes").alias("genes_b"))
    return a.join(b, keys).filter(F.col("col_a") < F.col("col_b"))


def overlap(a: str = "genes_a", b: str = "genes_b") -> Column:
    return F.size(F.array_intersect(a, b)).cast("long")


def column_overlaps(df: DataFrame, keys: list[str], col: str, k: int, descending: bool = True, check_k: bool = True) -> DataFrame:
    pairs = column_pairs(packed_top(df, keys, col, k, descending, check_k=check_k), keys, col)
    return pairs.select(*keys, "col_a", "col_b", overlap().alias("overlap"))


def column_jaccard(df: DataFrame, keys: list[str], col: str, k: int, check_k: bool = True) -> DataFrame:
    packed = top_and_bottom(df, keys, col, k, check_k).select(*keys, col, F.col("u").alias("genes"))
    i = overlap()
    j = F.try_divide(i.cast("double"), F.size("genes_a") + F.size("genes_b") - i)
    return column_pairs(packed, keys, col).select(*keys, "col_a", "col_b", j.alias("jaccard"))


def _average_ranks(x: np.ndarray) -> np.ndarray:
    _, back, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2.0)[back]


def _correlated(rows: pd.DataFrame, col: str, method: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smaller column, larger column and r of all pairs of columns of one matrix that vary."""
    names, line = np.unique(rows[col].to_numpy(), return_inverse=True)
    genes, place = np.unique(rows["gene"].to_numpy(), return_inverse=True)
    x = np.full((len(names), len(genes)), np.nan)
    x[line, place] = rows["score"].to_numpy(float)
    if np.isnan(x).any():
        raise ValueError(f"column without a score for some gene: {names[np.isnan(x).any(1)][0]}")
    if method == "spearman":
        x = np.stack([_average_ranks(v) for v in x])
    n, total = float(len(genes)), x.sum(1)
    spread = n * (x * x).sum(1) - total * total
    i, j = np.triu_indices(len(names), 1)
    keep = (spread[i] > 0) & (spread[j] > 0)
    i, j = i[keep], j[keep]
    r = (n * (x @ x.T)[i, j] - total[i] * total[j]) / (np.sqrt(spread[i]) * np.sqrt(spread[j]))
    return names[i], names[j], np.floor(r * 1e10 + 0.5) / 1e10


def column_correlations(df: DataFrame, keys: list[str], col: str, method: str = "spearman") -> DataFrame:
    """Spearman or Pearson of every pair of columns of each matrix; ranks are shared by all pairs.

    A matrix has a column per dataset and a row per gene, which bounds it whatever the number of
    cells; each is one product in its task. Shared ranks need complete columns: the job fails on a
    column that has no score for a gene of its keys. Columns without variance have no pairs.
    """
    if method not in ("spearman", "pearson"):
        raise ValueError(f"unknown method {method!r}")

    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        low, high, r = _correlated(rows, col, method)
        return pd.DataFrame({**dict.fromkeys(keys), "col_a": low, "col_b": high, "scor": r}).assign(**dict(zip(keys, key)))

    kind = df.schema[col].dataType.simpleString()
    schema = f"{fields(df, tuple(keys))}, col_a {kind}, col_b {kind}, scor double"
    return df.select(*keys, col, "gene", "score").groupBy(*keys).applyInPandas(run, schema)


def column_aucs(df: DataFrame, keys: list[str], col: str, k: int, descending: bool = True, check_k: bool = True) -> DataFrame:
    """AUROC and AUPRC of column i as score and the top (or bottom) k of column j as labels; 1 on the diagonal, n_targets the size of the label set."""
    group = [*keys, col]
    pos = positions(df, group, "score").withColumnRenamed(col, "col_i")
    top = top_set(df, group, "score", "gene", k, descending, check_k)
    labels = top.select(*keys, F.col(col).alias("col_j"), "gene")
    aucs = auc_from_positions(pos.join(labels, [*keys, "gene"]), [*keys, "col_i", "col_j"])
    own = F.col("col_i") == F.col("col_j")
    return aucs.withColumns({c: F.when(own, F.lit(1.0)).otherwise(F.col(c)) for c in ("auroc", "auprc")})


# ---------------------------------------------------------------- matching columns of two matrices

def matched_correlation(m1: DataFrame, m2: DataFrame, col: str, method: str = "spearman") -> DataFrame:
    """Spearman or Pearson of the columns that both matrices have, over rows present in both."""
    a = m1.select(col, "gene", F.col("score").alias("x"))
    b = m2.select(col, "gene", F.col("score").alias("y"))
    both = a.join(b, [col, "gene"])
    if method == "spearman":
        return spearman(both, [col], "x", "y").withColumnRenamed("spearman", "scor")
    if method != "pearson":
        raise ValueError(f"unknown method {method!r}")
    both = both.filter("x IS NOT NULL AND y IS NOT NULL")
    return both.groupBy(col).agg(pearson_agg("x", "y").alias("scor"), F.count(F.lit(1)).alias("n"))


def matched_overlap(m1: DataFrame, m2: DataFrame, col: str, k: int, descending: bool = True, check_k: bool = True) -> DataFrame:
    a = packed_top(m1, [], col, k, descending, check_k=check_k).withColumnRenamed("genes", "genes_a")
    b = packed_top(m2, [], col, k, descending, check_k=check_k).withColumnRenamed("genes", "genes_b")
    return a.join(b, col).select(col, overlap().alias("overlap"))


def shuffled_columns(m1: DataFrame, m2: DataFrame, col: str, seed: int) -> DataFrame:
    """A seeded pairing of the columns of two matrices (the column lists are short)."""
    common = m1.select(col).distinct().join(m2.select(col).distinct(), col, "left_semi")

    def side(name: str, part: int) -> DataFrame:
        w = W.orderBy(hash_key(seed, F.lit(part), col), col)
        return common.select(F.col(col).alias(name), F.row_number().over(w).cast("long").alias("pair"))

    return side("col_1", 1).join(side("col_2", 2), "pair")


def _renamed(m: DataFrame, col: str, pairs: DataFrame, side: str) -> DataFrame:
    return m.withColumnRenamed(col, side).join(pairs.select("pair", side), side).drop(side)


def shuffled_correlation(m1: DataFrame, m2: DataFrame, col: str, seed: int, method: str = "spearman") -> DataFrame:
    pairs = shuffled_columns(m1, m2, col, seed)
    scor = matched_correlation(_renamed(m1, col, pairs, "col_1"), _renamed(m2, col, pairs, "col_2"), "pair", method)
    return pairs.join(scor, "pair")


def shuffled_overlap(m1: DataFrame, m2: DataFrame, col: str, k: int, seed: int, descending: bool = True, check_k: bool = True) -> DataFrame:
    pairs = shuffled_columns(m1, m2, col, seed)
    hit = matched_overlap(_renamed(m1, col, pairs, "col_1"), _renamed(m2, col, pairs, "col_2"), "pair", k, descending, check_k)
    return pairs.join(hit, "pair")


# ---------------------------------------------------------------- similarity table

def similarity(df: DataFrame, keys: list[str], col: str, k: int) -> DataFrame:
    """Spearman, top overlap, bottom overlap and Jaccard of every pair of columns."""
    on = [*keys, "col_a", "col_b"]
    sets = top_and_bottom(df, keys, col, k).select(*keys, col, F.struct("t", "b", "u").alias("genes"))
    i = F.size(F.array_intersect("genes_a.u", "genes_b.u"))
    pairs = column_pairs(sets, keys, col).select(
        *on,
        overlap("genes_a.t", "genes_b.t").alias("topk"),
        overlap("genes_a.b", "genes_b.b").alias("bottomk"),
        F.try_divide(i.cast("double"), F.size("genes_a.u") + F.size("genes_b.u") - i).alias("jaccard"),
    )
    return pairs.join(column_correlations(df, keys, col), on, "left")


def regulator_similarity(profile: DataFrame, k: int) -> DataFrame:
    """:func:`similarity` of every regulator's datasets, the regulator's own row removed."""
    return similarity(profile.filter("gene <> tf"), ["species", "tf"], "dataset_id", k)


def null_profiles(full: DataFrame, msr: DataFrame, candidates: DataFrame, species: DataFrame, n_draws: int, seed: int) -> DataFrame:
    """Per draw and species, the profile of one random measured gene of every dataset."""
    pool = msr.filter("measured").join(candidates.select("gene"), "gene", "left_semi").join(species, "dataset_id")
    numbered = pool.select("dataset_id", F.col("gene").alias("partner"), F.row_number().over(W.partitionBy("dataset_id").orderBy("gene")).cast("long").alias("_at"))
    # a row per draw and dataset: a random place among the dataset's genes
    sizes = pool.groupBy("species", "dataset_id").agg(F.count(F.lit(1)).alias("_n"))
    places = with_draws(sizes, n_draws).select("species", "iter", "dataset_id", (below(F.col("_n"), seed, "iter", "dataset_id") + 1).alias("_at"))
    drawn = places.join(numbered, ["dataset_id", "_at"])
    return full.join(drawn, ["dataset_id", "partner"]).select(
        "species", "iter", "dataset_id", "partner", "gene", F.col("rsr").alias("score")
    )


def null_similarity(null: DataFrame, k: int) -> DataFrame:
    return similarity(null, ["species", "iter"], "dataset_id", k)


# ---------------------------------------------------------------- one gene queried in other datasets

def query_overlap(full: DataFrame, gene: int, k: int, query: int | None = None) -> DataFrame:
    """Overlap of the gene's top k in one dataset with the top k of every column of another.

    With ``query`` that dataset alone is asked, and every column of the others has a row; without it
    all datasets are asked, and columns without a common gene have no row (overlap zero).
    """
    top = top_set(full, ["dataset_id", "partner"], "rsr", "gene", k).select("dataset_id", "partner", "gene")
    q = top.filter(F.col("partner") == gene).select(F.col("dataset_id").alias("query"), "gene")
    s = top.select(F.col("dataset_id").alias("subject"), "partner", "gene")
    if query is not None:
        q, s = q.filter(F.col("query") == query), s.filter(F.col("subject") != query)
    found = (
        q.join(s, "gene")
        .filter("query <> subject")
        .groupBy("query", "subject", "partner")
        .agg(F.count(F.lit(1)).alias("overlap"))
    )
    if query is None:
        return found
    columns = full.filter(F.col("dataset_id") != query).select(F.col("dataset_id").alias("subject"), "partner").distinct()
    dense = columns.join(found.drop("query"), ["subject", "partner"], "left")
    return dense.select(F.lit(query).alias("query"), "subject", "partner", F.coalesce("overlap", F.lit(0).cast("long")).alias("overlap"))


def match_rank(scores: DataFrame, gene: int, value: str, first: int) -> DataFrame:
    """Position of the matching gene when columns are sorted by ``value``, ties in gene order.

    Rows that are absent count as zero; their number follows from the gene ordinals.
    """
    own = scores.filter(F.col("partner") == gene).select("query", "subject", F.col(value).alias("_m"))
    s = scores.join(own, ["query", "subject"], "left").withColumn("_m", F.coalesce(F.col("_m"), F.lit(0)))
    v, before = F.col(value), F.col("partner") < gene
    agg = s.groupBy("query", "subject").agg(
        F.max("_m").alias("_m"),
        F.count_if(v > F.col("_m")).alias("_gt"),
        F.count_if((v == F.col("_m")) & before).alias("_eq"),
        F.count_if(before).alias("_seen"),
    )
    zeros = F.when(F.col("_m") == 0, F.lit(gene - first) - F.col("_seen")).otherwise(0)
    return agg.select("query", "subject", (F.col("_gt") + F.col("_eq") + zeros + 1).alias("rank"))


def query_correlation(full: DataFrame, gene: int, genes: GeneSpan, gene_block: int = 1024, query: int | None = None) -> DataFrame:
    """Spearman of the gene's column in one dataset (``query``, or each) with every column of every other dataset.

    Per subject dataset this is one rectangular product: its columns against the query columns of the
    asked datasets, which get ordinals of their own, in as many blocks as they fill.
    """
    ranked = full.select("dataset_id", "partner", "gene", avg_rank(["dataset_id", "partner"], "rsr").alias("value"))
    asked = F.lit(True) if query is None else F.col("dataset_id") == query
    block = min(gene_block, genes.first + genes.n)
    first = -(-(genes.first + genes.n) // block)  # the first block of queries
    ids = full.filter((F.col("partner") == gene) & asked).select("dataset_id").distinct()
    ids = ids.select("dataset_id", (F.row_number().over(W.orderBy("dataset_id")) - 1 + first * block).alias("_q"))
    own = ranked.filter((F.col("partner") == gene) & asked).join(ids, "dataset_id").select("_q", F.col("dataset_id").alias("_own"), F.col("gene").alias("cell_id"), "value")
    columns = ranked.select(F.col("dataset_id").alias("subject"), F.col("gene").alias("cell_id"), F.col("partner").alias("gene"), "value")
    # a subject sees the query columns over its own genes
    rows = full.select(F.col("dataset_id").alias("subject"), "gene").distinct()
    queries = own.join(rows.withColumnRenamed("gene", "cell_id"), "cell_id").filter("_own <> subject").select("subject", "cell_id", F.col("_q").alias("gene"), "value")
    n_ids = max(ids.count(), 1)
    r = pair_correlation(
        columns.unionByName(queries), rows, GeneSpan(genes.first, first * block + n_ids - genes.first), min_cell=0, gene_block=block, keys=("subject",), queries_from=first,
    )
    names = ids.select(F.col("_q").alias("gene_a"), F.col("dataset_id").alias("query"))
    return r.join(names, "gene_a").select("query", "subject", F.col("gene_b").alias("partner"), F.col("r").alias("scor"))


def query_auprc(full: DataFrame, gene: int, k: int) -> DataFrame:
    """AUPRC of the gene's column as score, the top k of every other column as labels."""
    own = full.filter(F.col("partner") == gene)
    pos = positions(own, ["dataset_id"], "rsr").select(F.col("dataset_id").alias("query"), "gene", "s", "e", "n")
    top = top_set(full, ["dataset_id", "partner"], "rsr", "gene", k)
    labels = top.select(F.col("dataset_id").alias("subject"), "partner", "gene")
    hits = pos.join(labels, "gene").filter("query <> subject")
    return auc_from_positions(hits, ["query", "subject", "partner"]).select(
        "query", "subject", "partner", fix10("auprc").alias("auprc")
    )


def rank_of_match(scores: DataFrame, gene: int, value: str) -> DataFrame:
    """Rank of the matching column among all columns that have a score."""
    w = W.partitionBy("query", "subject").orderBy(F.col(value).desc_nulls_last(), "partner")
    return (
        scores.withColumn("rank", F.row_number().over(w).cast("long"))
        .filter(F.col("partner") == gene)
        .select("query", "subject", "rank")
    )


def with_diagonal(ranks: DataFrame) -> DataFrame:
    """All ordered pairs of datasets: a dataset finds its own column first."""
    own = ranks.select("query").distinct().select("query", F.col("query").alias("subject"), F.lit(1).cast("long").alias("rank"))
    return ranks.select("query", "subject", "rank").unionByName(own)


# ---------------------------------------------------------------- summaries

STATS = ("scor", "topk", "bottomk", "jaccard")


def long_stats(sim: DataFrame, keys: list[str]) -> DataFrame:
    rows = sim.select(*keys, *[F.col(s).cast("double").alias(s) for s in STATS])
    return rows.unpivot(keys, list(STATS), "stat", "value")


def similarity_summary(sim: DataFrame, keys: list[str], n_exp: DataFrame | None = None) -> DataFrame:
    """Six numbers per matrix and statistic, with the number of datasets when given."""
    out = long_stats(sim, keys).groupBy(*keys, "stat").agg(*six_numbers("value"))
    out = out.withColumn("mean", fix10("mean"))
    return out.join(n_exp, keys, "left") if n_exp is not None else out


def with_family(summary: DataFrame, tfs: DataFrame, min_exp: int) -> DataFrame:
    return summary.filter(F.col("n_exp") >= min_exp).join(tfs, "tf", "left")


def share_above_null(summary: DataFrame, null_summary: DataFrame) -> DataFrame:
    """Share of regulators whose mean exceeds the largest mean of the null, per statistic."""
    top = null_summary.groupBy("species", "stat").agg(F.max("mean").alias("null_max"))
    return (
        summary.join(top, ["species", "stat"])
        .groupBy("species", "stat")
        .agg(F.count_if(F.col("mean") > F.col("null_max")).alias("n_above"), F.avg((F.col("mean") > F.col("null_max")).cast("double")).alias("share"))
    )


def null_means(null_summary: DataFrame) -> DataFrame:
    """One row per species: mean of the null means of both overlaps."""
    is_stat = lambda s: F.avg(F.when(F.col("stat") == s, F.col("mean")))
    return null_summary.groupBy("species").agg(
        fix10(is_stat("topk")).alias("null_topk"), fix10(is_stat("bottomk")).alias("null_bottomk")
    )


def overlap_means(summary: DataFrame) -> DataFrame:
    """Mean top and bottom overlap of every regulator in one row."""
    pick = lambda s: F.max(F.when(F.col("stat") == s, F.col("mean")))
    return summary.groupBy("species", "tf").agg(pick("topk").alias("topk"), pick("bottomk").alias("bottomk"))


def divergent(summary: DataFrame, null_summary: DataFrame) -> DataFrame:
    """Regulators below the null in top overlap and above it in bottom overlap, with counts."""
    flags = overlap_means(summary).join(null_means(null_summary), "species").select(
        "species",
        "tf",
        "topk",
        "bottomk",
        (F.col("topk") < F.col("null_topk")).alias("lo_top"),
        (F.col("bottomk") > F.col("null_bottomk")).alias("hi_bottom"),
    )
    both = F.col("lo_top") & F.col("hi_bottom")
    return flags.groupBy("species").agg(
        F.count_if("lo_top").alias("n_low_top"),
        F.count_if("hi_bottom").alias("n_high_bottom"),
        F.count_if(both).alias("n_divergent"),
        F.avg(both.cast("double")).alias("share_divergent"),
        F.array_join(F.array_sort(F.collect_list(F.when(both, F.format_string("%05d", F.col("tf"))))), ", ").alias("tfs"),
    )


def overlap_ratios(summary: DataFrame, null_summary: DataFrame) -> DataFrame:
    """Top and bottom overlap against the null, their odds and its log."""
    top = F.try_divide(F.col("topk"), F.col("null_topk"))
    bottom = F.try_divide(F.col("bottomk"), F.col("null_bottomk"))
    odds = F.try_divide(top, bottom)
    return (
        overlap_means(summary)
        .join(null_means(null_summary), "species")
        .select(
            "species", "tf", top.alias("topk_ratio"), bottom.alias("bottomk_ratio"), odds.alias("odds"),
            F.when(odds > 0, F.ln(F.when(odds > 0, odds))).alias("log_odds"),
        )
    )


def most_similar_pairs(summary: DataFrame, sim: DataFrame, n_tfs: int = 3, n_pairs: int = 3) -> DataFrame:
    """The regulators with the largest single overlap, and their best dataset pairs (ties kept)."""
    top = summary.filter("stat = 'topk'").withColumn("_r", min_rank(["species"], "max")).filter(F.col("_r") <= n_tfs)
    pairs = sim.join(top.select("species", "tf"), ["species", "tf"], "left_semi")
    ranked = pairs.withColumn("_r", min_rank(["species", "tf"], "topk")).filter(F.col("_r") <= n_pairs)
    return ranked.select("species", "tf", "col_a", "col_b", "topk")


def cross_species_means(summary: DataFrame, ortho: DataFrame, min_exp: int) -> DataFrame:
    """Mean similarity of ortholog regulators in both species and their average."""
    ok = summary.filter(F.col("n_exp") >= min_exp)

    def side(species: str, tag: str) -> DataFrame:
        tf = ortho.select(F.col(f"gene_{tag}").alias("tf"), "id")
        return ok.filter(F.col("species") == species).join(tf, "tf").select("id", "stat", F.col("mean").alias(f"mean_{tag}"))

    both = side("Human", "hg").join(side("Mouse", "mm"), ["id", "stat"])
    return both.withColumn("avg", fix10((F.col("mean_hg") + F.col("mean_mm")) / 2))


def family_summary(summary: DataFrame, tfs: DataFrame) -> DataFrame:
    return (
        summary.join(tfs, "tf")
        .groupBy("species", "stat", "family")
        .agg(F.avg("mean").alias("mean"), F.count(F.lit(1)).alias("n_tfs"), F.avg("n_exp").alias("mean_n_exp"))
    )
