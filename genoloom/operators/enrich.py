"""Gene-set enrichment of rankings, its summaries, and reference-table shaping."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import fix10
from ..functions.ranks import min_rank
from ..functions.sampling import permutation_keys, permuted, with_draws

ST = ["species", "tf"]
SET = "set_id"


def set_positions(ranks: DataFrame, rank: str) -> DataFrame:
    """Position of every gene in its ranking (small is good), ties in gene order."""
    rows = ranks.filter(F.col(rank).isNotNull())
    w = W.partitionBy(*ST).orderBy(F.col(rank), F.col("gene"))
    return rows.select(*ST, "gene", F.row_number().over(w).alias("pos"))


def _average_precision(hits: DataFrame, keys: list[str]) -> DataFrame:
    seen = F.row_number().over(W.partitionBy(*keys).orderBy("pos"))
    return hits.withColumn("_h", seen / F.col("pos")).groupBy(*keys).agg(
        fix10(F.avg("_h")).alias("avg_precision"), F.count(F.lit(1)).alias("n_members")
    )


def enrichment(ranks: DataFrame, sets: DataFrame, rank: str, n_iter: int, seed: int, min_size: int = 2) -> DataFrame:
    """Average precision of every set in every ranking against random sets of the same size.

    The null depends on the ranking's length and the set size only, so it is drawn once per
    (length, size): the first ``size`` places of one keyed permutation per iteration, evaluated for
    these places alone. The corrected p-value is the Benjamini-Hochberg step-up within a ranking.
    """
    pos = set_positions(ranks, rank)
    n_genes = pos.groupBy(*ST).agg(F.count(F.lit(1)).alias("n_genes"))
    observed = (
        _average_precision(pos.join(sets.select(SET, "gene").distinct(), "gene"), [*ST, SET])
        .filter(F.col("n_members") >= min_size)
        .join(n_genes, ST)
    )
    sizes = observed.select("n_genes", "n_members").distinct()
    # the largest set's places per length and iteration; a smaller set of m genes takes the first m of them
    most = sizes.groupBy("n_genes").agg(F.max("n_members").alias("_most"))
    draws = with_draws(most, n_iter).repartition("n_genes", "iter").withColumn("_keys", permutation_keys(seed, "n_genes", "iter"))
    places = draws.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_most") - 1)))
    order = places.select("n_genes", "iter", "_at", (permuted(F.col("_at"), F.col("n_genes"), F.col("_keys")) + 1).alias("pos"))
    drawn = order.join(sizes, "n_genes").filter(F.col("_at") < F.col("n_members"))
    null = _average_precision(drawn.withColumnRenamed("n_members", "size"), ["n_genes", "size", "iter"]).select(
        "n_genes", F.col("size").alias("n_members"), F.col("avg_precision").alias("null_ap")
    )
    # null values at least as large as each observed one: a running count over at most n_iter rows and the distinct observed values
    same = ["n_genes", "n_members"]
    rows = null.select(*same, F.col("null_ap").alias("avg_precision"), F.lit(1).alias("drawn")).unionByName(observed.select(*same, "avg_precision", F.lit(0).alias("drawn")).distinct())
    down = W.partitionBy(*same).orderBy(F.col("avg_precision").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    above = rows.withColumn("at_least", F.sum("drawn").over(down)).filter("drawn = 0").drop("drawn")
    p = (F.col("at_least") + 1) / F.lit(float(n_iter + 1))
    scored = observed.join(above, [*same, "avg_precision"]).select(*ST, SET, "n_members", "avg_precision", p.alias("p_value"))
    return adjust(scored, ST, "p_value", SET)


def adjust(df: DataFrame, keys: list[str], p: str, item: str) -> DataFrame:
    """Benjamini-Hochberg: smallest p * m / rank over the equal or larger p-values."""
    m = F.count(F.lit(1)).over(W.partitionBy(*keys))
    i = F.row_number().over(W.partitionBy(*keys).orderBy(p, item))
    rows = df.withColumn("_q", F.col(p) * m / i)
    back = W.partitionBy(*keys).orderBy(F.col(p).desc(), F.col(item).desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("p_corrected", F.least(F.lit(1.0), F.min("_q").over(back))).drop("_q")


def significant(results: DataFrame, cutoff: float = 0.05) -> DataFrame:
    return results.filter(F.col("p_corrected") <= cutoff)


def terms_per_tf(hits: DataFrame, tfs: DataFrame) -> DataFrame:
    """Number of terms of every tested regulator, zero included."""
    n = hits.groupBy(*ST).agg(F.count(F.lit(1)).alias("n"))
    return tfs.select(*ST).join(n, ST, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ortholog_term_counts(counts: DataFrame, ortho: DataFrame) -> DataFrame:
    def side(species: str, tag: str) -> DataFrame:
        return counts.filter(F.col("species") == species).select(F.col("tf").alias(f"gene_{tag}"), F.col("n").alias(f"n_{tag}"))

    return ortho.join(side("Human", "hg"), "gene_hg").join(side("Mouse", "mm"), "gene_mm").select("id", "n_hg", "n_mm")


def term_jaccard(hits: DataFrame, counts: DataFrame, ortho: DataFrame) -> DataFrame:
    """Jaccard of the term sets of ortholog regulators; NULL where both are empty."""
    both = ortholog_term_counts(counts, ortho)

    def side(species: str, tag: str) -> DataFrame:
        tf = ortho.select(F.col(f"gene_{tag}").alias("tf"), "id")
        return hits.filter(F.col("species") == species).join(tf, "tf").select("id", SET)

    shared = side("Human", "hg").join(side("Mouse", "mm"), ["id", SET]).groupBy("id").agg(F.count(F.lit(1)).alias("_i"))
    i = F.coalesce("_i", F.lit(0))
    return both.join(shared, "id", "left").select("id", F.try_divide(i.cast("double"), F.col("n_hg") + F.col("n_mm") - i).alias("jaccard"))


def tfs_per_term(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Regulators per term, with their list (bounded by the regulator list)."""
    return hits.groupBy(*keys, SET).agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_set("tf")), lambda x: x.cast("string")), ", ").alias("tfs")
    )


def terms_across_species(per_term: DataFrame) -> DataFrame:
    """Terms of either species side by side, absent counts as 0."""

    def side(species: str, tag: str) -> DataFrame:
        return per_term.filter(F.col("species") == species).select(SET, F.col("n").alias(f"n_{tag}"), F.col("tfs").alias(f"tfs_{tag}"))

    both = side("Human", "hg").join(side("Mouse", "mm"), SET, "full")
    return both.na.fill(0, ["n_hg", "n_mm"]).na.fill("0", ["tfs_hg", "tfs_mm"])


def top_terms(results: DataFrame, n: int) -> DataFrame:
    """The n smallest corrected p-values of a regulator as -log10, ties kept."""
    rows = results.withColumn("_r", min_rank(ST, "p_corrected", False)).filter(F.col("_r") <= n).drop("_r")
    return rows.withColumn("score", -F.log10("p_corrected"))


# ---------------------------------------------------------------- reference tables

def format_orthologs(source: DataFrame, genes_hg: DataFrame, genes_mm: DataFrame, min_score: float = 5) -> DataFrame:
    """One-to-one orthologs: mutual best matches among coding genes; any symbol matched more than
    once on either side is dropped, counted before anything is removed."""
    ok = (
        source.filter((F.col("score") >= min_score) & (F.col("id_type") == "MGI") & (F.col("best_score") == "Yes") & (F.col("best_score_rev") == "Yes"))
        .join(genes_hg.select(F.col("symbol").alias("symbol_hg")), "symbol_hg", "left_semi")
        .join(genes_mm.select(F.col("symbol").alias("symbol_mm")), "symbol_mm", "left_semi")
    )
    one_hg = ok.groupBy("symbol_hg").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("symbol_hg")
    one_mm = ok.groupBy("symbol_mm").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("symbol_mm")
    out = ok.join(one_hg, "symbol_hg", "left_semi").join(one_mm, "symbol_mm", "left_semi")
    return out.select("symbol_hg", "symbol_mm", F.concat_ws("_", "symbol_hg", "symbol_mm").alias("id"))


def chromosome_order(chromosomes: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in chromosomes]), F.col("chromosome"))


def shape_transcripts(raw: DataFrame, chromosomes: list[str]) -> DataFrame:
    """Strand as 1/-1, start site by strand, plain chromosome names, main chromosomes in order."""
    plus = F.col("strand") == "+"
    out = raw.withColumns(
        {
            "strand": F.when(plus, 1).otherwise(-1),
            "tss": F.when(plus, F.col("start")).otherwise(F.col("end")),
            "chromosome": F.regexp_replace("chromosome", "^chr", ""),
        }
    )
    return out.filter(F.col("chromosome").isin(chromosomes)).orderBy(chromosome_order(chromosomes), "tss")


def coding_transcripts(raw: DataFrame, chromosomes: list[str], biotype: str = "protein_coding") -> DataFrame:
    out = raw.filter((F.col("biotype") == biotype) & F.col("chromosome").isin(chromosomes)).drop("biotype")
    return out.orderBy(chromosome_order(chromosomes), "tss")


def match_tables(ref: DataFrame, ens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two transcript tables of the same genes: no Y copy of a symbol that occurs twice, the first
    row per symbol, rows in the order of the reference table."""
    dupl = ref.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("symbol", F.lit(True).alias("_d"))
    twice_on_y = F.coalesce("_d", F.lit(False)) & (F.col("chromosome") == "Y")
    kept = ref.join(dupl, "symbol", "left").filter(~twice_on_y).drop("_d")
    by_symbol = kept.groupBy("symbol").agg(F.min_by("refseq_id", "ordinal").alias("refseq_id"), F.min("ordinal").alias("ref_ordinal"))
    named = ens.filter(F.col("symbol") != "")
    out = named.join(by_symbol, "symbol", "right").join(dupl, "symbol", "left")
    # a reference symbol without a transcript keeps its row, all its columns NULL
    out = out.filter(~F.coalesce(twice_on_y, F.lit(False))).drop("_d")
    cols = [c for c in out.columns if c != "symbol"]
    first = out.groupBy("symbol").agg(F.min_by(F.struct(*cols), F.coalesce("ordinal", F.lit(0))).alias("_r"))
    return kept, first.select("symbol", "_r.*").orderBy("ref_ordinal")


def coding_regulators(tfs: DataFrame, coding: DataFrame) -> DataFrame:
    """Regulators that are coding genes, first row per symbol."""
    rows = tfs.join(coding.select("symbol"), "symbol", "left_semi")
    return rows.groupBy("symbol").agg(F.min_by("family", "ordinal").alias("family"))


def ribosomal_set(list1: DataFrame, list2: DataFrame, ortho: DataFrame) -> DataFrame:
    """Ortholog pairs whose human symbol is in either list."""
    either = list1.select("symbol").unionByName(list2.select("symbol")).distinct()
    return ortho.join(either.select(F.col("symbol").alias("symbol_hg")), "symbol_hg", "left_semi")
