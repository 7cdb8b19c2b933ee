"""Recovery of labelled genes: AUROC and AUPRC in closed form, against sampled label sets.

A score column is turned once into positions (rows before the tie block, its end, the number of
rows); after that only the labelled rows take part, so a null of many draws costs draws times
labels, not draws times genes.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import fix10, rnd
from ..functions.ranks import max_rank, min_rank, value_positions
from ..functions.sampling import permutation_keys, permuted, with_draws
from ..functions.stats import six_numbers


def positions(df: DataFrame, keys: list[str], value: str, item: str = "gene") -> DataFrame:
    """Per row: s rows are strictly better, the tie block ends at e, the column has n rows."""
    rows = df.filter(F.col(value).isNotNull())
    return rows.select(
        *keys,
        item,
        (min_rank(keys, value) - 1).alias("s"),
        max_rank(keys, value).alias("e"),
        F.count(F.lit(1)).over(W.partitionBy(*keys)).alias("n"),
    )


def auc_from_positions(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Both areas from the positive rows of :func:`positions`.

    AUROC is the mid-rank sum; AUPRC is the trapezoid over recall, where the block at the very top
    adds nothing because its left precision is undefined. NULL without positives or negatives, and
    AUPRC is NULL if one tie block covers the column.
    """
    return _auc_counted(hits.groupBy(*keys, "s", "e", "n").agg(F.count(F.lit(1)).alias("_p")), keys)


def auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Both areas of a labelled score table; a group may hold any number of rows.

    Positions and positives seen so far come from the distributed value positions, after which
    both areas are plain sums over the tie blocks that hold a positive.
    """
    positive = F.when(F.col(label), 1).otherwise(0).cast("long")
    pos = value_positions(df, keys, score, sums={"p": positive})
    n = df.filter(F.col(score).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    blocks = pos.filter("p_equal > 0").join(n, keys).select(
        *keys, F.col("n_before").alias("s"), (F.col("n_before") + F.col("n_equal")).alias("e"), "n", F.col("p_equal").alias("_p"), F.col("p_before").alias("tp")
    )
    return df.select(*keys).distinct().join(_areas(blocks, keys), keys, "left")


def _auc_counted(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The areas of :func:`auc_from_positions`; a row is a tie block with its number of positives.

    The window holds labelled rows of one column only.
    """
    tp = F.sum("_p").over(W.partitionBy(*keys).orderBy("s")) - F.col("_p")
    return _areas(blocks.withColumn("tp", tp), keys)


def _areas(blocks: DataFrame, keys: list[str]) -> DataFrame:
    s, e, n, t, tp = F.col("s"), F.col("e"), F.col("n"), F.col("_p").cast("double"), F.col("tp")
    area = F.when(s > 0, 0.5 * t * ((tp + t) / e + F.try_divide(tp, s))).otherwise(0.0)
    agg = blocks.groupBy(*keys).agg(
        F.sum(t).alias("p"), F.max("n").alias("n"), F.sum(area).alias("a"),
        F.sum((n + 1 - (s + 1 + e) / 2.0) * t).alias("r"), F.max((s == 0) & (e == n)).alias("flat"),
    )
    p, neg = F.col("p"), F.col("n") - F.col("p")
    both = (p > 0) & (neg > 0)
    return agg.select(
        *keys,
        p.cast("long").alias("n_targets"),
        F.when(both, fix10(F.try_divide(F.col("r") - p * (p + 1) / 2, p * neg))).alias("auroc"),
        F.when(both & ~F.col("flat"), fix10(F.col("a") / p)).alias("auprc"),
    )


def curve(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """ROC and precision-recall points at every distinct cutoff, with the (0, 0) start."""
    positive = F.when(F.col(label), 1).otherwise(0).cast("long")
    rows = df.select(*keys, F.col(score).cast("double").alias("cutoff"), label).filter(F.col("cutoff").isNotNull())
    total = rows.groupBy(*keys).agg(F.sum(positive).alias("p"), F.sum(1 - positive).alias("n"))
    tp = F.col("p_before") + F.col("p_equal")
    points = value_positions(rows, keys, "cutoff", sums={"p": positive}).join(total, keys).select(
        *keys, "cutoff", tp.alias("tp"), (F.col("n_before") + F.col("n_equal") - tp).alias("fp"), "p", "n"
    )
    start = points.groupBy(*keys).agg(
        F.lit(None).cast("double").alias("cutoff"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.max("p").alias("p"), F.max("n").alias("n")
    )
    tp, fp = F.col("tp"), F.col("fp")
    return points.unionByName(start).select(
        *keys, "cutoff",
        F.try_divide(tp.cast("double"), F.col("p")).alias("tpr"),
        F.try_divide(fp.cast("double"), F.col("n")).alias("fpr"),
        F.try_divide(tp.cast("double"), tp + fp).alias("precision"),
    )


# ---------------------------------------------------------------- labels

def tf_aliases(gene_ref: DataFrame, ortho: DataFrame) -> DataFrame:
    """Every upper-case name a regulator goes by: its symbol and both symbols of its ortholog."""
    own = gene_ref.select("species", F.col("gene").alias("tf"), F.upper("symbol").alias("name"))
    pair = F.explode(F.array(F.upper("symbol_hg"), F.upper("symbol_mm"))).alias("name")
    hg = ortho.select(F.col("symbol_hg").alias("symbol"), "symbol_hg", "symbol_mm").withColumn("species", F.lit("Human"))
    mm = ortho.select(F.col("symbol_mm").alias("symbol"), "symbol_hg", "symbol_mm").withColumn("species", F.lit("Mouse"))
    both = hg.unionByName(mm)
    other = gene_ref.join(both, ["species", "symbol"]).select("species", F.col("gene").alias("tf"), pair)
    return own.unionByName(other).distinct()


def curated_labels(curated: DataFrame, gene_ref: DataFrame, ortho: DataFrame, remove_self: bool = True) -> DataFrame:
    """(species, tf, gene): targets of every regulator under any of its names, as species genes."""
    names = tf_aliases(gene_ref, ortho)
    pairs = curated.select(F.upper("tf_symbol").alias("name"), F.upper("target_symbol").alias("target")).distinct()
    hits = names.join(pairs, "name").select("species", "tf", "target").distinct()
    if remove_self:
        own = names.withColumnRenamed("name", "target")
        hits = hits.join(own, ["species", "tf", "target"], "left_anti")
    genes = gene_ref.select("species", "gene", F.upper("symbol").alias("target"))
    return hits.join(genes, ["species", "target"]).select("species", "tf", "gene").distinct()


def eligible_universe(curated: DataFrame, column: str, present: DataFrame, gene_ref: DataFrame, ortho: DataFrame) -> DataFrame:
    """Genes of ``present`` (species, gene) named in the curated column, directly or by ortholog."""
    named = curated.select(F.upper(column).alias("name")).distinct()
    direct = gene_ref.withColumn("name", F.upper("symbol")).join(named, "name", "left_semi").select("species", "gene")

    def by_ortholog(species: str, tag: str) -> DataFrame:
        names = F.explode(F.array(F.upper("symbol_hg"), F.upper("symbol_mm"))).alias("name")
        rows = ortho.select(F.lit(species).alias("species"), F.col(f"gene_{tag}").alias("gene"), names)
        return rows.join(named, "name", "left_semi").select("species", "gene")

    all_rows = direct.unionByName(by_ortholog("Human", "hg")).unionByName(by_ortholog("Mouse", "mm")).distinct()
    return all_rows.join(present, ["species", "gene"], "left_semi")


# ---------------------------------------------------------------- observed against sampled

ST = ["species", "tf"]


def labelled_positions(scores: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positions of all scored genes (the regulator left out) and of the labelled ones."""
    pos = positions(scores.filter("gene <> tf"), ST, "score")
    return pos, pos.join(labels, [*ST, "gene"], "left_semi")


def observed_auc(scores: DataFrame, labels: DataFrame) -> DataFrame:
    _, hits = labelled_positions(scores, labels)
    return auc_from_positions(hits, ST)


def null_auc(scores: DataFrame, labels: DataFrame, universe: DataFrame, n_draws: int, seed: int) -> DataFrame:
    """AUCs of ``n_draws`` label sets of each regulator's own size, sampled from the universe.

    One keyed permutation of the universe per draw serves all regulators: a set of n labels are the
    genes at its first n places, with the regulator itself skipped. Only these places are evaluated,
    so the work is draws x labels and nothing is sorted.
    """
    pos, hits = labelled_positions(scores, labels)
    sizes = hits.groupBy(*ST).agg(F.count(F.lit(1)).alias("n_target"))
    numbered = universe.select("species", "gene", (F.row_number().over(W.partitionBy("species").orderBy("gene")) - 1).cast("long").alias("x"))
    draws = with_draws(universe.groupBy("species").agg(F.count(F.lit(1)).alias("n")), n_draws).withColumn("keys", permutation_keys(seed, "species", "iter"))
    # one place more than labels, for the sets that would hold the regulator
    last = F.least(F.col("n_target"), F.col("n") - 1)
    places = sizes.join(draws, "species").repartition(*ST, "iter").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    drawn = places.withColumn("x", permuted(F.col("at"), F.col("n"), F.col("keys"))).select(*ST, "iter", "n_target", "at", "x").join(numbered, ["species", "x"])
    own = F.max((F.col("gene") == F.col("tf")) & (F.col("at") < F.col("n_target"))).over(W.partitionBy(*ST, "iter"))
    drawn = drawn.withColumn("_own", own).filter((F.col("gene") != F.col("tf")) & ((F.col("at") < F.col("n_target")) | F.col("_own")))
    return auc_from_positions(drawn.select(*ST, "iter", "gene").join(pos, [*ST, "gene"]), [*ST, "iter"])


def compare_to_null(observed: DataFrame, null: DataFrame) -> DataFrame:
    """Quantile of the observed area in its null and the distance to the null median."""
    n = null.select(*ST, F.col("auprc").alias("np"), F.col("auroc").alias("nr"))
    agg = (
        n.join(observed, ST)
        .groupBy(*ST)
        .agg(
            F.avg((F.col("np") <= F.col("auprc")).cast("double")).alias("auprc_quantile"),
            F.percentile("np", F.lit(0.5)).alias("_mp"),
            F.avg((F.col("nr") <= F.col("auroc")).cast("double")).alias("auroc_quantile"),
            F.percentile("nr", F.lit(0.5)).alias("_mr"),
        )
    )
    return observed.join(agg, ST, "left").select(
        *ST, "n_targets", "auprc", "auprc_quantile", (F.col("auprc") - F.col("_mp")).alias("auprc_diff"),
        "auroc", "auroc_quantile", (F.col("auroc") - F.col("_mr")).alias("auroc_diff"),
    )


def recovery_table(scores: DataFrame, labels: DataFrame, universe: DataFrame, n_draws: int, seed: int) -> DataFrame:
    """Observed and null-relative areas of every regulator that has labels."""
    return compare_to_null(observed_auc(scores, labels), null_auc(scores, labels, universe, n_draws, seed))


def column_auc(profile: DataFrame, labels: DataFrame) -> DataFrame:
    """Both areas of every dataset column of every regulator."""
    keys = [*ST, "dataset_id"]
    pos = positions(profile.filter("gene <> tf"), keys, "score")
    return auc_from_positions(pos.join(labels, [*ST, "gene"], "left_semi"), keys)


def average_against_single(with_avg: DataFrame, labels: DataFrame, avg_name: str = "Avg") -> DataFrame:
    """Quantile of the averaged profile's areas among the single datasets."""
    cols = column_auc(with_avg, labels)
    avg = cols.filter(F.col("dataset_id") == avg_name).select(
        *ST, "n_targets", F.col("auprc").alias("avg_auprc"), F.col("auroc").alias("avg_auroc")
    )
    one = cols.filter(F.col("dataset_id") != avg_name).select(*ST, "auprc", "auroc")
    return (
        one.join(avg, ST)
        .groupBy(*ST, "n_targets", "avg_auprc", "avg_auroc")
        .agg(
            F.count(F.lit(1)).alias("n_datasets"),
            F.avg((F.col("auprc") <= F.col("avg_auprc")).cast("double")).alias("auprc_quantile"),
            F.avg((F.col("auroc") <= F.col("avg_auroc")).cast("double")).alias("auroc_quantile"),
        )
    )


# ---------------------------------------------------------------- summaries of recovery tables

MEASURES = ("auprc", "auprc_quantile", "auprc_diff", "auroc", "auroc_quantile", "auroc_diff")


def nonzero_scores(bind: DataFrame) -> DataFrame:
    """Long form of a score matrix per regulator; order is a property of readers."""
    return bind.select("tf", "gene", F.col("bind_score").alias("score")).filter(F.col("score").isNotNull())


def extreme_shares(df: DataFrame, keys: list[str], columns: list[str], upper: float = 0.9, lower: float = 0.1) -> DataFrame:
    """Per column: rows, share equal to 1, share above upper, share below lower (3 decimals)."""
    long = df.unpivot(keys, columns, "stat", "value").filter(F.col("value").isNotNull())
    v = F.col("value")
    part = lambda c: rnd(F.avg(c.cast("double")), 3)
    return long.groupBy(*keys, "stat").agg(
        F.count(F.lit(1)).alias("n"), part(v == 1).alias("eq1"), part(v > upper).alias("gt_upper"), part(v < lower).alias("lt_lower")
    )


def suffixed(df: DataFrame, tag: str) -> DataFrame:
    return df.select(*ST, "n_targets", *[F.col(c).alias(f"{c}_{tag}") for c in MEASURES if c in df.columns])


def join_sources(first: tuple[str, DataFrame], *others: tuple[str, DataFrame], min_targets: int = 0) -> DataFrame:
    """Recovery tables of several sources side by side, the first one leading."""
    out = suffixed(first[1], first[0])
    for tag, df in others:
        out = out.join(suffixed(df, tag), [*ST, "n_targets"], "left")
    return out.filter(F.col("n_targets") >= min_targets)


def deltas(wide: DataFrame, a: str, b: str) -> DataFrame:
    return wide.select(
        *ST, *[(F.col(f"{m}_{a}") - F.col(f"{m}_{b}")).alias(f"delta_{m}") for m in ("auprc", "auroc", "auprc_diff", "auroc_diff")]
    )


def performance_class(wide: DataFrame, a: str, b: str, upper: float = 0.9, lower: float = 0.5) -> DataFrame:
    """Flags: both sources well above the null, or one well above and the other below."""
    def either(f):
        parts = [f(F.col(f"{m}_quantile_{a}"), F.col(f"{m}_quantile_{b}")) for m in ("auprc", "auroc")]
        return F.coalesce(parts[0], F.lit(False)) | F.coalesce(parts[1], F.lit(False))

    return wide.select(
        *ST,
        either(lambda x, y: (x > upper) & (y > upper)).alias("both"),
        either(lambda x, y: (x > upper) & (y < lower)).alias(f"only_{a}"),
        either(lambda x, y: (y > upper) & (x < lower)).alias(f"only_{b}"),
    )


def ortholog_share(flags: DataFrame, flag: str, ortho: DataFrame) -> DataFrame:
    """Regulators with the flag per species, of these with the ortholog's flag, and the share."""
    hit = flags.filter(flag)
    hg = hit.filter("species = 'Human'").select(F.col("tf").alias("gene_hg"))
    mm = hit.filter("species = 'Mouse'").select(F.col("tf").alias("gene_mm"))
    both = ortho.join(hg, "gene_hg", "left_semi").join(mm, "gene_mm", "left_semi")
    zero = F.lit(0).cast("long")
    # each shared ortholog counts once for either species
    shared = both.select(F.explode(F.array(F.lit("Human"), F.lit("Mouse"))).alias("species")).groupBy("species").agg(
        zero.alias("n_flag"), F.count(F.lit(1)).alias("n_both")
    )
    per = flags.groupBy("species").agg(F.count_if(flag).alias("n_flag")).withColumn("n_both", zero)
    return per.unionByName(shared).groupBy("species").agg(F.sum("n_flag").alias("n_flag"), F.sum("n_both").alias("n_both")).select(
        "species", "n_flag", "n_both", F.try_divide(F.col("n_both").cast("double"), F.col("n_flag")).alias("share")
    )


def null_summary(null: DataFrame, observed: DataFrame) -> DataFrame:
    return null.join(observed.select(*ST), ST, "left_semi").groupBy(*ST).agg(*six_numbers("auroc"))


def generic_check(wide: DataFrame, tag: str, below: float = 0.5, above: float = 0.5) -> DataFrame:
    """Regulators whose quantile in the null is ``below`` although the area is ``above``: the largest per species."""
    rows = wide.filter((F.col(f"auroc_quantile_{tag}") < below) & (F.col(f"auroc_{tag}") > above))
    ranked = rows.withColumn("_r", min_rank(["species"], f"auroc_{tag}"))
    return ranked.filter("_r = 1").select("species", "tf", F.col(f"auroc_{tag}").alias("auroc"))


def label_ranks(ranks: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Labelled targets of every regulator that reach the cutoff in either ranking."""
    hit = ranks.join(labels, [*ST, "gene"], "left_semi")
    return hit.groupBy(*ST).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank_aggr_coexpr") <= k).alias("n_coexpr"), F.count_if(F.col("rank_bind") <= k).alias("n_bind")
    )


def stacked(wide: DataFrame, measure: str, tags: list[str]) -> DataFrame:
    """One measure of several sources in long form."""
    cols = {f"{measure}_{t}": t for t in tags}
    return wide.select(*ST, *[F.col(c).alias(t) for c, t in cols.items()]).unpivot(ST, tags, "source", "value")
