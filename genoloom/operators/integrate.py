"""Two evidence sources per regulator and gene brought together, and tiers of evidence.

Tiers are one long table (tf_id, tier, genes, ranks); which regulators could have a tier at all is
a second small table, so that "not eligible" and "no rows" stay different.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..functions.ranks import max_rank, min_rank, tie_adjusted_k
from ..functions.stats import six_numbers
from .rankings import species_side

ST = ["species", "tf"]
TIERS = ("Stringent", "Elevated", "Human", "Human_specific", "Mouse", "Mouse_specific", "Mixed")
RANKS4 = ("rank_aggr_coexpr_hg", "rank_aggr_coexpr_mm", "rank_bind_hg", "rank_bind_mm")


def bind_rank(keys: list[str], score: str, item: str) -> Column:
    """Max rank, so that a block of zero scores falls to the bottom; missing scores come last."""
    order = W.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), item)
    return F.when(F.col(score).isNotNull(), max_rank(keys, score)).otherwise(F.row_number().over(order)).cast("long")


def join_binding(ranks: DataFrame, bind: DataFrame) -> DataFrame:
    """Consensus ranks with binding: bind rank and the min-rank of the rank product.

    ``bind`` holds the measured (species, tf, gene); a regulator-gene pair absent from it counts as
    zero when the gene occurs anywhere in the species' binding data, else it is missing.
    """
    tfs = bind.select(*ST).distinct()
    genes = bind.select("species", "gene").distinct().withColumn("bind_measured", F.lit(True))
    rows = (
        ranks.join(tfs, ST, "left_semi")
        .join(genes, ["species", "gene"], "left")
        .join(bind, [*ST, "gene"], "left")
        .withColumn("bind_measured", F.coalesce("bind_measured", F.lit(False)))
        .withColumn("bind_score", F.when(F.col("bind_measured"), F.coalesce("bind_score", F.lit(0.0))))
    )
    rows = rows.withColumn("rank_bind", bind_rank(ST, "bind_score", "gene"))
    rows = rows.withColumn("_p", F.col("rank_aggr_coexpr") * F.col("rank_bind"))
    return rows.withColumn("rank_integrated", min_rank(ST, "_p", False)).drop("_p")


def ortholog_evidence(rank_all: DataFrame, ortho: DataFrame, method: str = "sum") -> DataFrame:
    """Both species on their orthologs with all four ranks renewed and combined.

    The combination ranks the sum of the four ranks; ``method="product"`` ranks their product.
    """
    cols = ["avg_aggr_coexpr", "bind_score"]
    hg, mm = species_side(rank_all, ortho, "Human", "hg", cols), species_side(rank_all, ortho, "Mouse", "mm", cols)
    genes = ortho.select("id", "gene_hg", "gene_mm")
    both = hg.join(mm.select("tf_id").distinct(), "tf_id", "left_semi").join(mm, ["tf_id", "id"], "left").join(genes, "id")
    key = ["tf_id"]
    both = both.withColumns(
        {
            "rank_aggr_coexpr_hg": min_rank(key, "avg_aggr_coexpr_hg"),
            "rank_aggr_coexpr_mm": min_rank(key, "avg_aggr_coexpr_mm"),
            "rank_bind_hg": bind_rank(key, "bind_score_hg", "gene_hg"),
            "rank_bind_mm": bind_rank(key, "bind_score_mm", "gene_hg"),
        }
    )
    a, b, c, d = (F.col(x) for x in RANKS4)
    both = both.withColumn("_s", a + b + c + d if method == "sum" else a * b * c * d)
    return both.withColumn("rank_integrated", min_rank(key, "_s", False)).drop("_s")


def _cutoffs(df: DataFrame, keys: list[str], values: dict[str, str], k: int) -> DataFrame:
    """Tie-adjusted k of several score columns per group, one column each."""
    long = df.unpivot(keys, [F.col(v).cast("double").alias(name) for name, v in values.items()], "ranking", "score")
    k_eff = tie_adjusted_k(long, [*keys, "ranking"], "score", k)
    pick = lambda name: F.max(F.when(F.col("ranking") == name, F.col("k_eff"))).alias(f"k_{name}")
    return k_eff.groupBy(*keys).agg(*[pick(name) for name in values])


def species_cutoffs(rank_all: DataFrame, k: int) -> DataFrame:
    """Genes within the cutoff of both data types in the full gene list of a species."""
    ks = _cutoffs(rank_all, ST, {"coexpr": "avg_aggr_coexpr", "bind": "bind_score"}, k)
    hit = (F.col("rank_aggr_coexpr") <= F.col("k_coexpr")) & (F.col("rank_bind") <= F.col("k_bind"))
    return rank_all.join(ks, ST).filter(hit).drop("k_coexpr", "k_bind")


def ortholog_cutoffs(evidence: DataFrame, k: int) -> DataFrame:
    """The four cutoff flags of every ortholog gene; NULL ranks give NULL flags."""
    names = {"coexpr_hg": "avg_aggr_coexpr_hg", "coexpr_mm": "avg_aggr_coexpr_mm", "bind_hg": "bind_score_hg", "bind_mm": "bind_score_mm"}
    ks = _cutoffs(evidence, ["tf_id"], names, k)
    flags = {f"cut_{n}": F.col(f"rank_{'aggr_' if n.startswith('coexpr') else ''}{n}") <= F.col(f"k_{n}") for n in names}
    return evidence.join(ks, "tf_id", "left").withColumns(flags).drop(*[f"k_{n}" for n in names])


def eligibility(rank_all: DataFrame, ortho: DataFrame) -> DataFrame:
    """Per ortholog regulator: ranked with binding in human, in mouse, in both."""
    have = rank_all.select(*ST).distinct()

    def side(species: str, tag: str) -> DataFrame:
        tf = ortho.select(F.col(f"gene_{tag}").alias("tf"), F.col("id").alias("tf_id"))
        return have.filter(F.col("species") == species).join(tf, "tf").select("tf_id", F.lit(True).alias(f"has_{tag}"))

    both = side("Human", "hg").join(side("Mouse", "mm"), "tf_id", "full")
    no = F.lit(False)
    return both.select(
        "tf_id", F.coalesce("has_hg", no).alias("has_hg"), F.coalesce("has_mm", no).alias("has_mm")
    ).withColumn("has_ortho", F.col("has_hg") & F.col("has_mm"))


def tiers(rank_all: DataFrame, evidence: DataFrame, ortho: DataFrame, k: int) -> DataFrame:
    """All tiers as (tf_id, tier, gene_hg, gene_mm, rank_integrated, the four ranks)."""
    cut = ortholog_cutoffs(evidence, k)
    c_hg, c_mm, b_hg, b_mm = (F.col(f"cut_{n}") for n in ("coexpr_hg", "coexpr_mm", "bind_hg", "bind_mm"))
    n_cut = sum((c.cast("int") for c in (c_mm, b_hg, b_mm)), c_hg.cast("int"))  # NULL if any is NULL
    cut = cut.withColumn("_n", n_cut)
    cols = ["tf_id", "gene_hg", "gene_mm", "rank_integrated", *RANKS4]
    reproducible = cut.filter("_n >= 3").select(
        *cols, F.when(F.col("_n") == 4, "Stringent").otherwise("Elevated").alias("tier")
    )
    one = species_cutoffs(rank_all, k)
    elig = eligibility(rank_all, ortho).filter("has_ortho").select("tf_id")

    def species(name: str, tag: str, other: str) -> DataFrame:
        tf = ortho.select(F.col(f"gene_{tag}").alias("tf"), F.col("id").alias("tf_id"))
        null = F.lit(None).cast("long")
        return (
            one.filter(F.col("species") == name)
            .join(tf, "tf")
            .select(
                "tf_id",
                F.col("gene").alias(f"gene_{tag}"),
                F.lit(None).cast("int").alias(f"gene_{other}"),
                "rank_integrated",
                F.col("rank_aggr_coexpr").alias(f"rank_aggr_coexpr_{tag}"),
                null.alias(f"rank_aggr_coexpr_{other}"),
                F.col("rank_bind").alias(f"rank_bind_{tag}"),
                null.alias(f"rank_bind_{other}"),
                F.lit(name).alias("tier"),
            )
            .select(*cols, "tier")
        )

    hg, mm = species("Human", "hg", "mm"), species("Mouse", "mm", "hg")
    seen = reproducible.select("tf_id", "gene_hg", "gene_mm")
    hg_only = hg.join(elig, "tf_id", "left_semi").join(seen.select("tf_id", "gene_hg"), ["tf_id", "gene_hg"], "left_anti")
    mm_only = mm.join(elig, "tf_id", "left_semi").join(seen.select("tf_id", "gene_mm"), ["tf_id", "gene_mm"], "left_anti")
    hg_only = hg_only.withColumn("tier", F.lit("Human_specific")).select(*cols, "tier")
    mm_only = mm_only.withColumn("tier", F.lit("Mouse_specific")).select(*cols, "tier")
    mixed = (
        cut.filter((c_hg & b_mm) | (c_mm & b_hg))
        .join(seen.select("tf_id", "gene_hg"), ["tf_id", "gene_hg"], "left_anti")
        .join(hg_only.select("tf_id", "gene_hg"), ["tf_id", "gene_hg"], "left_anti")
        .join(mm_only.select("tf_id", "gene_mm"), ["tf_id", "gene_mm"], "left_anti")
        .select(*cols, F.lit("Mixed").alias("tier"))
    )
    out = reproducible.select(*cols, "tier")
    for part in (hg, hg_only, mm, mm_only, mixed):
        out = out.unionByName(part)
    return out


def one_tier(tier_table: DataFrame, tier: str) -> DataFrame:
    return tier_table.filter(F.col("tier") == tier).drop("tier")


def tally(tier_table: DataFrame, elig: DataFrame) -> DataFrame:
    """Rows per regulator and tier; NULL where the regulator is not eligible for the tier."""
    counts = tier_table.groupBy("tf_id").pivot("tier", list(TIERS)).agg(F.count(F.lit(1)))
    need = {"Human": "has_hg", "Mouse": "has_mm"}
    cols = [F.when(F.col(need.get(t, "has_ortho")), F.coalesce(F.col(t), F.lit(0))).alias(t) for t in TIERS]
    return elig.join(counts, "tf_id", "left").select("tf_id", *cols)


def long_tally(tallied: DataFrame) -> DataFrame:
    return tallied.unpivot(["tf_id"], list(TIERS), "tier", "n")


def tier_totals(tallied: DataFrame) -> DataFrame:
    """Pairs and regulators per tier, with a summary over the regulators that have any."""
    some = F.when(F.col("n") > 0, F.col("n"))
    return long_tally(tallied).groupBy("tier").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.count(some).alias("n_tfs"), *six_numbers(some)
    )


def one_species_binding(tallied: DataFrame) -> DataFrame:
    """Regulators with binding in one species only: counts and the one with most genes."""
    rows = tallied.filter(F.col("Stringent").isNull())
    best = lambda c: F.max_by("tf_id", F.when(F.col(c).isNotNull(), F.struct(F.col(c), F.col("tf_id"))))
    return rows.agg(
        F.count("Human").alias("n_human"), best("Human").alias("max_human"), F.count("Mouse").alias("n_mouse"), best("Mouse").alias("max_mouse")
    )


def gene_key() -> Column:
    """Human gene of a row, or the mouse gene where the tier has no human side."""
    return F.when(F.col("tier").isin("Mouse", "Mouse_specific"), F.col("gene_mm")).otherwise(F.col("gene_hg"))


def recurrence(tier_table: DataFrame) -> DataFrame:
    """How often a gene occurs in a tier."""
    return tier_table.withColumn("gene", gene_key()).groupBy("tier", "gene").agg(F.count(F.lit(1)).alias("n"))


def recurrence_summary(tier_table: DataFrame) -> DataFrame:
    """Per tier: genes of more than one regulator, the most frequent genes and their regulators."""
    counts = recurrence(tier_table)
    top = counts.withColumn("_r", F.rank().over(W.partitionBy("tier").orderBy(F.col("n").desc()))).filter("_r = 1")
    tfs = tier_table.withColumn("gene", gene_key()).join(top.select("tier", "gene"), ["tier", "gene"], "left_semi")
    per = counts.groupBy("tier").agg(F.count_if(F.col("n") > 1).alias("n_multi"), F.max("n").alias("max_n"))
    # a regulator list: bounded by the number of regulators
    names = tfs.groupBy("tier").agg(F.array_join(F.sort_array(F.collect_set("tf_id")), ", ").alias("tfs"))
    genes = top.groupBy("tier").agg(F.count(F.lit(1)).alias("n_max_genes"))
    return per.join(genes, "tier").join(names, "tier")


MISSED = {"coexpr_hg": RANKS4[0], "coexpr_mm": RANKS4[1], "bind_hg": RANKS4[2], "bind_mm": RANKS4[3]}


def elevated_missing(tier_table: DataFrame, k: int) -> DataFrame:
    """Which ranking missed the cutoff in the elevated tier: counts, sums and shares."""
    c = {n: F.count_if(F.col(col) > k).alias(f"n_{n}") for n, col in MISSED.items()}
    out = one_tier(tier_table, "Elevated").groupBy("tf_id").agg(F.count(F.lit(1)).alias("n"), *c.values())
    n = lambda x: F.col(f"n_{x}")
    out = out.withColumns(
        {
            "n_human": n("bind_hg") + n("coexpr_hg"),
            "n_mouse": n("bind_mm") + n("coexpr_mm"),
            "n_coexpr": n("coexpr_hg") + n("coexpr_mm"),
            "n_bind": n("bind_hg") + n("bind_mm"),
        }
    )
    names = [*MISSED, "human", "mouse", "coexpr", "bind"]
    return out.withColumns({f"prop_{x}": rnd(n(x) / F.col("n"), 3) for x in names})


def not_ortholog(tier_table: DataFrame, elig: DataFrame, ortho: DataFrame) -> DataFrame:
    """Species-specific genes with and without an ortholog per regulator."""
    out = elig.filter("has_ortho").select("tf_id")
    zero = F.lit(0).cast("long")
    for tier, tag in (("Human_specific", "hg"), ("Mouse_specific", "mm")):
        flag = ortho.select(F.col(f"gene_{tag}"), F.lit(True).alias("_o"))
        rows = one_tier(tier_table, tier).join(flag, f"gene_{tag}", "left").groupBy("tf_id").agg(
            F.count(F.lit(1)).alias("_n"), F.count("_o").alias("_with")
        )
        out = out.join(rows, "tf_id", "left").withColumns({"_n": F.coalesce("_n", zero), "_with": F.coalesce("_with", zero)})
        lost = F.col("_n") - F.col("_with")
        out = out.withColumns(
            {
                f"n_specific_{tag}": F.col("_n"),
                f"n_ortho_{tag}": F.col("_with"),
                f"n_not_ortho_{tag}": lost,
                f"prop_not_ortho_{tag}": F.try_divide(lost.cast("double"), F.col("_n")),
            }
        ).drop("_n", "_with")
    return out


def top_not_ortholog(counts: DataFrame, tag: str, min_n: int = 3, n: int = 10) -> DataFrame:
    rows = counts.filter(F.col(f"n_not_ortho_{tag}") >= min_n)
    ranked = rows.withColumn("_r", F.rank().over(W.orderBy(F.col(f"prop_not_ortho_{tag}").desc())))
    return ranked.filter(F.col("_r") <= n).select("tf_id", f"n_not_ortho_{tag}", f"prop_not_ortho_{tag}")


def divergent_candidates(evidence: DataFrame, k: int) -> DataFrame:
    """Top k in both data types of one species, bottom half in both of the other."""
    cut = ortholog_cutoffs(evidence, k)
    sizes = evidence.groupBy("tf_id").agg(F.count(F.lit(1)).alias("n"))
    mid = (sizes.agg(F.min_by("n", "tf_id")).first()[0] or 0) / 2  # one number: half of the first table
    low = lambda tag: (F.col(f"rank_aggr_coexpr_{tag}") >= mid) & (F.col(f"rank_bind_{tag}") >= mid)
    human = F.col("cut_coexpr_hg") & F.col("cut_bind_hg") & low("mm")
    mouse = F.col("cut_coexpr_mm") & F.col("cut_bind_mm") & low("hg")
    out = cut.withColumn("side", F.when(human, "Human").when(mouse, "Mouse")).filter(F.col("side").isNotNull())
    return out.select("tf_id", "id", "side", *RANKS4)


def candidate_counts(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    per = candidates.groupBy("tf_id").agg(F.count_if(F.col("side") == "Human").alias("human"), F.count_if(F.col("side") == "Mouse").alias("mouse"))
    zero = F.lit(0).cast("long")
    tfs = evidence.select("tf_id").distinct()
    return tfs.join(per, "tf_id", "left").select("tf_id", F.coalesce("human", zero).alias("human"), F.coalesce("mouse", zero).alias("mouse"))


def collect_gene_ranks(rank_all: DataFrame, species: str, tfs: list[int]) -> DataFrame:
    """Ranks of several regulators side by side, best joint rank first."""
    rows = rank_all.filter((F.col("species") == species) & F.col("tf").isin(tfs))
    stats = ("rank_bind", "rank_aggr_coexpr", "rank_integrated")
    cols = [F.max(F.when(F.col("tf") == tf, F.col(s))).alias(f"{s}_{tf}") for tf in tfs for s in stats]
    wide = rows.groupBy("gene").agg(*cols)
    names = [f"{s}_{tf}" for tf in tfs for s in stats]
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    return wide.withColumn("rank_sum", total).orderBy(F.col("rank_sum").asc_nulls_last(), "gene")


def with_other_species(tier_table: DataFrame, rank_all: DataFrame, ortho: DataFrame) -> DataFrame:
    """Species-specific rows completed with the ranks of the ortholog in the other species."""
    out = None
    for tier, tag, other, species in (("Human_specific", "hg", "mm", "Mouse"), ("Mouse_specific", "mm", "hg", "Human")):
        tf = ortho.select(F.col(f"gene_{other}").alias("tf"), F.col("id").alias("tf_id"))
        ranks = rank_all.filter(F.col("species") == species).join(tf, "tf").select(
            "tf_id", F.col("gene").alias(f"gene_{other}"), F.col("rank_aggr_coexpr").alias("_c"), F.col("rank_bind").alias("_b")
        )
        rows = one_tier(tier_table, tier).drop(f"gene_{other}")
        rows = rows.join(ortho.select("gene_hg", "gene_mm"), f"gene_{tag}", "left").join(ranks, ["tf_id", f"gene_{other}"], "left")
        rows = rows.withColumns({f"rank_aggr_coexpr_{other}": F.col("_c"), f"rank_bind_{other}": F.col("_b")})
        part = rows.select(
            "tf_id", F.coalesce("gene_hg", "gene_mm").alias("gene"), *RANKS4, F.lit(tier).alias("tier")
        )
        out = part if out is None else out.unionByName(part)
    return out


def rank_buckets(tier_table: DataFrame, k: int, near: int = 500) -> DataFrame:
    """0 within the cutoff, 1 a near miss, 2 beyond; NULL stays NULL."""
    bucket = lambda c: F.when(F.col(c) <= k, 0).when(F.col(c) <= k + near, 1).when(F.col(c).isNotNull(), 2)
    return tier_table.withColumns({c: bucket(c) for c in RANKS4})


def with_curated(tier_table: DataFrame, labels: DataFrame, ortho: DataFrame) -> DataFrame:
    """Flag the pairs that are curated for the human regulator (or the mouse one)."""
    lab = []
    for species, tag in (("Human", "hg"), ("Mouse", "mm")):
        tf = ortho.select(F.col(f"gene_{tag}").alias("tf"), F.col("id").alias("tf_id"))
        lab.append(labels.filter(F.col("species") == species).join(tf, "tf").select("tf_id", F.col("gene").alias(f"gene_{tag}"), F.lit(True).alias(f"_{tag}")))
    out = tier_table.join(lab[0], ["tf_id", "gene_hg"], "left").join(lab[1], ["tf_id", "gene_mm"], "left")
    return out.withColumn("curated", F.coalesce("_hg", "_mm", F.lit(False))).drop("_hg", "_mm")
