"""Queries: correlation, rank aggregation, measurement."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import fix10, rnd
from ..functions.stats import rank_sum_test
from ..operators import correlate as c
from ..operators import measure as m
from .catalog import query
from .fixtures import MIN_CELL_B, aggregate_ctes, f10
from .oracle import cte

r6 = lambda name, c=None: rnd(F.col(c or name), 6).alias(name)

# Two genes of fixture B that many cells hold
G1, G2 = 12, 30


@query("c1_pearson", "SELECT dataset_id, cell_type, gene_a, gene_b, round(r, 6) AS r FROM pair_cor_a")
def _(t):
    return c.pair_correlation(t.expr_a, t.meta_a, t.genes_a).withColumn("r", rnd("r", 6))


cte("pair_cor_f0", """
SELECT cell_type, gene_a, gene_b, CASE WHEN gene_a = gene_b THEN 1.0::DOUBLE ELSE floor((n * sxy - sa * sb) / (sqrt(n * saa - sa * sa) * sqrt(n * sbb - sb * sb)) * 1e10 + 0.5) / 1e10 END AS r
FROM (SELECT a.cell_type, a.gene AS gene_a, b.gene AS gene_b, count(*)::DOUBLE AS n, sum(a.value) AS sa, sum(b.value) AS sb,
      sum(a.value * a.value) AS saa, sum(b.value * b.value) AS sbb, sum(a.value * b.value) AS sxy,
      count(*) FILTER (a.value > 0) AS na, count(*) FILTER (b.value > 0) AS nb
      FROM expr_f a JOIN expr_f b USING (cell_type, cell_id) WHERE a.gene >= b.gene GROUP BY ALL)
WHERE na >= 20 AND nb >= 20""")


@query("c2_dense_blocks", "SELECT cell_type, gene_a, gene_b, round(r, 6) AS r FROM pair_cor_f0")
def _(t):
    # small blocks, so that several tiles and chunks take part
    out = c.pair_correlation(t.expr_f, t.meta_f, t.genes_f, gene_block=16, chunk_cells=64)
    return out.select("cell_type", "gene_a", "gene_b", rnd("r", 6).alias("r"))


cte("dense_rank_a", """
SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY dataset_id, cell_type, gene, value) - 1) / 2.0::DOUBLE AS rk
FROM (SELECT m.dataset_id, m.cell_type, m.cell_id, g.gene, coalesce(e.value, 0) AS value
      FROM meta_a m JOIN elig_a g USING (dataset_id, cell_type)
      LEFT JOIN expr_a e ON e.dataset_id = m.dataset_id AND e.cell_type = m.cell_type AND e.cell_id = m.cell_id AND e.gene = g.gene)
WINDOW w AS (PARTITION BY dataset_id, cell_type, gene ORDER BY value)""")


@query("c3_spearman", """
SELECT dataset_id, cell_type, gene_a, gene_b, round(CASE WHEN gene_a = gene_b THEN 1.0::DOUBLE ELSE floor((n * sxy - sa * sb) / (sqrt(n * saa - sa * sa) * sqrt(n * sbb - sb * sb)) * 1e10 + 0.5) / 1e10 END, 6) AS r
FROM (SELECT dataset_id, cell_type, a.gene AS gene_a, b.gene AS gene_b, count(*)::DOUBLE AS n, sum(a.rk) AS sa, sum(b.rk) AS sb,
      sum(a.rk * a.rk) AS saa, sum(b.rk * b.rk) AS sbb, sum(a.rk * b.rk) AS sxy
      FROM dense_rank_a a JOIN dense_rank_a b USING (dataset_id, cell_type, cell_id) WHERE a.gene >= b.gene GROUP BY ALL)
WHERE n * saa - sa * sa > 0 AND n * sbb - sb * sb > 0""")
def _(t):
    return c.spearman_correlation(t.expr_a, t.meta_a, t.genes_a).withColumn("r", rnd("r", 6))


cte("mid_f", """
SELECT e.*, CASE WHEN mad > 0 THEN (value - med) * CASE WHEN abs((value - med) / (9.0 * mad)) < 1
       THEN pow(1 - pow((value - med) / (9.0 * mad), 2), 2) ELSE 0 END ELSE value - mean END AS x
FROM expr_f e JOIN (SELECT cell_type, gene, quantile_cont(abs(value - med), 0.5) AS mad, max(med) AS med, max(mean) AS mean
  FROM expr_f JOIN (SELECT cell_type, gene, quantile_cont(value, 0.5) AS med, avg(value) AS mean FROM expr_f
                    GROUP BY ALL HAVING count(*) FILTER (value > 0) >= 20) USING (cell_type, gene)
  GROUP BY ALL) USING (cell_type, gene)""")


@query("c4_bicor", """
SELECT cell_type, gene_a, gene_b, round(CASE WHEN gene_a = gene_b THEN 1.0::DOUBLE ELSE floor(sxy / sqrt(saa * sbb) * 1e10 + 0.5) / 1e10 END, 6) AS r
FROM (SELECT cell_type, a.gene AS gene_a, b.gene AS gene_b, sum(a.x * a.x) AS saa, sum(b.x * b.x) AS sbb, sum(a.x * b.x) AS sxy
      FROM mid_f a JOIN mid_f b USING (cell_type, cell_id) WHERE a.gene >= b.gene GROUP BY ALL)
WHERE saa > 0 AND sbb > 0""")
def _(t):
    out = c.bicor_correlation(t.expr_f, t.meta_f, t.genes_f)
    return out.select("cell_type", "gene_a", "gene_b", rnd("r", 6).alias("r"))


@query("c5_min_count", "SELECT dataset_id, cell_type, gene, nz FROM elig_a")
def _(t):
    return c.eligible_genes(t.expr_a)


@query("c6_subset_and_filter", """
SELECT e.dataset_id, e.cell_type, e.cell_id, e.gene, e.value FROM expr_a e SEMI JOIN elig_a USING (dataset_id, cell_type, gene)
WHERE e.cell_type = '1-URGENT'""")
def _(t):
    return c.subset_and_filter(t.expr_a, "1-URGENT")


@query("c7_impute_triangle", """
SELECT dataset_id, cell_type, gene_a, gene_b, round(CASE WHEN gene_a = gene_b THEN 1 ELSE coalesce(r, 0) END, 6) AS r
FROM full_cor_b WHERE (dataset_id, cell_type) IN (SELECT dataset_id, cell_type FROM pair_cor_b)""")
def _(t):
    pairs = t.pairs_b
    return c.fill_triangle(pairs, t.genes_b).withColumn("r", rnd("r", 6))


@query("c8_pair_spine", "SELECT DISTINCT n_regionkey AS dataset_id, a.gene AS gene_a, b.gene AS gene_b FROM nation, genes_a a, genes_a b WHERE a.gene >= b.gene")
def _(t):
    return c.pair_spine(t.meta_a.select("dataset_id").distinct(), t.genes_a)


@query("c9_rsr", "SELECT dataset_id, gene_a, gene_b, round(rsr, 8) AS rsr, n_na FROM agg_a")
def _(t):
    return c.rank_sum_rank(t.expr_a, t.meta_a, t.genes_a).withColumn("rsr", rnd("rsr", 8))


@query("c9_rsr_ranks", f"SELECT dataset_id, gene_a, gene_b, round(rsr * (SELECT count(*) * (count(*) + 1) / 2 FROM genes_a), 0) AS rsr, n_na FROM agg_a")
def _(t):
    return c.rank_sum_rank(t.expr_a, t.meta_a, t.genes_a, standardize=False)


@query("c9_rsr_many_datasets", "SELECT dataset_id, gene_a, gene_b, round(rsr, 8) AS rsr, n_na FROM agg_b")
def _(t):
    return t.agg_b.withColumn("rsr", rnd("rsr", 8))


cte("dense_rank_b", """
SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY dataset_id, cell_type, gene, value) - 1) / 2.0::DOUBLE AS rk
FROM (SELECT m.dataset_id, m.cell_type, m.cell_id, g.gene, coalesce(e.value, 0) AS value
      FROM meta_b m JOIN elig_b g USING (dataset_id, cell_type)
      LEFT JOIN expr_b e ON e.dataset_id = m.dataset_id AND e.cell_type = m.cell_type AND e.cell_id = m.cell_id AND e.gene = g.gene)
WINDOW w AS (PARTITION BY dataset_id, cell_type, gene ORDER BY value)""")
cte("pair_cor_bs", """
SELECT dataset_id, cell_type, gene_a, gene_b, CASE WHEN gene_a = gene_b THEN 1.0::DOUBLE ELSE floor((n * sxy - sa * sb) / (sqrt(n * saa - sa * sa) * sqrt(n * sbb - sb * sb)) * 1e10 + 0.5) / 1e10 END AS r
FROM (SELECT dataset_id, cell_type, a.gene AS gene_a, b.gene AS gene_b, count(*)::DOUBLE AS n, sum(a.rk) AS sa, sum(b.rk) AS sb,
      sum(a.rk * a.rk) AS saa, sum(b.rk * b.rk) AS sbb, sum(a.rk * b.rk) AS sxy
      FROM dense_rank_b a JOIN dense_rank_b b USING (dataset_id, cell_type, cell_id) WHERE a.gene >= b.gene GROUP BY ALL)
WHERE n * saa - sa * sa > 0 AND n * sbb - sb * sb > 0""")
aggregate_ctes("bs", "b", "genes_b")


@query("c9_rsr_spearman", "SELECT dataset_id, gene_a, gene_b, round(rsr, 8) AS rsr, n_na FROM agg_bs")
def _(t):
    out = c.rank_sum_rank(t.expr_b, t.meta_b, t.genes_b, MIN_CELL_B, method="spearman")
    return out.withColumn("rsr", rnd("rsr", 8))


@query("c10_celltype_spearman", f"SELECT dataset_id, cell_type, round(r, 5) AS r FROM pair_cor_bs WHERE gene_a = {G2} AND gene_b = {G1}")
def _(t):
    return c.celltype_correlation(t.expr_b, t.meta_b, G1, G2, MIN_CELL_B, "spearman")


@query("c10_celltype_bicor", """
SELECT cell_type, round(floor(sxy / sqrt(saa * sbb) * 1e10 + 0.5) / 1e10, 5) AS r
FROM (SELECT cell_type, sum(a.x * a.x) AS saa, sum(b.x * b.x) AS sbb, sum(a.x * b.x) AS sxy
      FROM mid_f a JOIN mid_f b USING (cell_type, cell_id) WHERE a.gene = 7 AND b.gene = 3 GROUP BY ALL)
WHERE saa > 0 AND sbb > 0""")
def _(t):
    return c.celltype_correlation(t.expr_f, t.meta_f, 3, 7, method="bicor").select("cell_type", "r")


@query("c10_celltype_cor", f"""
SELECT dataset_id, cell_type, round(r, 5) AS r FROM pair_cor_b WHERE dataset_id = 3 AND gene_a = {G2} AND gene_b = {G1}""")
def _(t):
    one = t.expr_b.filter("dataset_id = 3"), t.meta_b.filter("dataset_id = 3")
    return c.celltype_correlation(*one, G1, G2, MIN_CELL_B).orderBy(F.col("r").desc())


@query("c11_all_datasets_cor", f"SELECT dataset_id, cell_type, round(r, 5) AS r FROM pair_cor_b WHERE gene_a = {G2} AND gene_b = {G1}")
def _(t):
    return c.celltype_correlation(t.expr_b, t.meta_b, G1, G2, MIN_CELL_B)


@query("c12_pair_by_symbol", f"""
SELECT dataset_id, cell_type, round(r, 5) AS r FROM pair_cor_b JOIN species USING (dataset_id)
WHERE species = 'Mouse' AND gene_a = {G2} AND gene_b = {G1}""")
def _(t):
    expr, meta = t.expr_b.join(t.species, "dataset_id"), t.meta_b.join(t.species, "dataset_id")
    return c.pair_correlation_by_symbol(expr, meta, t.gene_ref, "mouse", f"GN{G1}", f"gn{G2}", MIN_CELL_B)


@query("c13_pair_dataset_means", f"""
SELECT dataset_id, round(avg(round(r, 5)), 6) AS mean_r, count(*) AS n_types FROM pair_cor_b
WHERE gene_a = {G2} AND gene_b = {G1} GROUP BY ALL""")
def _(t):
    means = c.dataset_means(c.celltype_correlation(t.expr_b, t.meta_b, G1, G2, MIN_CELL_B))
    return means.withColumn("mean_r", rnd("mean_r", 6)).orderBy(F.col("mean_r").desc())


@query("c14_pair_scatter", f"""
SELECT m.dataset_id, m.cell_type, m.cell_id, coalesce(a.value, 0) AS x, coalesce(b.value, 0) AS y
FROM meta_b m LEFT JOIN (SELECT * FROM expr_b WHERE gene = {G1}) a USING (dataset_id, cell_type, cell_id)
LEFT JOIN (SELECT * FROM expr_b WHERE gene = {G2}) b USING (dataset_id, cell_type, cell_id)""")
def _(t):
    return c.pair_cells(t.expr_b, t.meta_b, G1, G2).select("dataset_id", "cell_type", "cell_id", "x", "y")


cte("avg_pairs", "SELECT species, gene_a, gene_b, avg(rsr) AS avg_rsr FROM agg_b JOIN species USING (dataset_id) WHERE gene_a <> gene_b GROUP BY ALL")


@query("c15_avg_coexpr_head_tail", f"""
SELECT species, gene_a, gene_b, round(avg_rsr, 6) AS avg_rsr, side FROM (
  SELECT *, 'top' AS side, row_number() OVER (PARTITION BY species ORDER BY {f10('avg_rsr')} DESC, gene_a, gene_b) AS i FROM avg_pairs
  UNION ALL
  SELECT *, 'bottom', row_number() OVER (PARTITION BY species ORDER BY {f10('avg_rsr')}, gene_a, gene_b) FROM avg_pairs)
WHERE i <= 20""")
def _(t):
    means = c.mean_pair_score(t.agg_b.join(t.species, "dataset_id"), by=("species",))
    return c.head_and_tail(means, 20, ("species",)).withColumn("avg_rsr", rnd("avg_rsr", 6))


@query("c15_avg_coexpr", "SELECT gene_a, gene_b, round(avg_rsr, 6) AS avg_rsr FROM (SELECT gene_a, gene_b, avg(rsr) AS avg_rsr FROM agg_a WHERE gene_a <> gene_b GROUP BY ALL)")
def _(t):
    return c.mean_pair_score(t.agg_a).withColumn("avg_rsr", rnd("avg_rsr", 6))


@query("c16_matrix_to_long", 'SELECT dataset_id, gene AS "row", partner AS col, round(rsr, 8) AS rsr FROM full_b WHERE gene > partner')
def _(t):
    return c.long_to_pairs(c.mirrored(t.agg_b, "rsr"), True, "rsr").withColumn("rsr", rnd("rsr", 8))


# ---------------------------------------------------------------- measurement

@query("m1_cell_counts", "SELECT dataset_id, cell_type, count(*) AS n_cells FROM meta_a GROUP BY ALL")
def _(t):
    return m.cell_counts(t.meta_a)


@query("m1_dataset_counts", "SELECT dataset_id, n_celltypes, CAST(n_cells AS BIGINT) AS n_cells FROM types_b")
def _(t):
    return m.type_counts(t.meta_b)


@query("m2_measured", "SELECT dataset_id, gene, measured FROM msr_b")
def _(t):
    return t.msr_b


@query("m3_comeasured", "SELECT species, gene AS gene_a, partner AS gene_b, n_comeasured FROM comsr_b WHERE gene >= partner")
def _(t):
    return m.comeasured_pairs(t.expr_b, t.meta_b, t.genes_b, t.species, MIN_CELL_B)


@query("m3_undefined_types", "SELECT dataset_id, gene_a, gene_b, CAST(n_na AS BIGINT) AS n_na FROM agg_a")
def _(t):
    defined = m.defined_types(t.expr_a, t.meta_a, t.genes_a, c.MIN_CELL).join(F.broadcast(m.type_counts(t.meta_a)), "dataset_id")
    return defined.select("dataset_id", "gene_a", "gene_b", (F.col("n_celltypes") - F.col("n_types")).alias("n_na"))


cte("info_b", """
SELECT s.dataset_id, species, n_cells, n_celltypes, n_genes, n_name AS label,
       CASE WHEN n_nationkey % 3 = 0 THEN '10x 3'' v' || (1 + n_nationkey % 2) ELSE 'Smart-seq' || (n_nationkey % 3) END AS platform
FROM species s JOIN types_b USING (dataset_id) JOIN nation ON n_nationkey = s.dataset_id
LEFT JOIN (SELECT dataset_id, count(*) AS n_genes FROM msr_b WHERE measured GROUP BY ALL) USING (dataset_id)""")


@query("m4_genes_per_dataset", "SELECT dataset_id, species, CAST(n_cells AS BIGINT) AS n_cells, n_celltypes, n_genes, platform FROM info_b")
def _(t):
    return t.info_b.select("dataset_id", "species", "n_cells", "n_celltypes", "n_genes", "platform")


cte("gene_summary", """
SELECT species, gene, count(*) FILTER (measured) AS n_msr, avg(CASE WHEN measured THEN 1.0::DOUBLE ELSE 0 END) AS prop_msr,
       gene IN (SELECT tf FROM tfs) AS is_tf
FROM msr_b JOIN species USING (dataset_id) GROUP BY ALL""")


@query("m5_gene_summary", "SELECT species, gene, n_msr, round(prop_msr, 6) AS prop_msr, is_tf FROM gene_summary")
def _(t):
    s = m.gene_summary(t.msr_b, t.species, t.tfs)
    return s.select("species", "gene", "n_msr", r6("prop_msr"), "is_tf")


@query("m6_measurement_classes", """
SELECT species, count(*) FILTER (prop_msr = 0) AS never, count(*) FILTER (prop_msr <= 0.1) AS rarely,
       count(*) FILTER (prop_msr >= 0.9) AS mostly, count(*) FILTER (prop_msr = 1) AS always
FROM gene_summary GROUP BY ALL""")
def _(t):
    return m.measurement_classes(m.gene_summary(t.msr_b, t.species, t.tfs))


@query("m7_always_measured_orthologs", """
SELECT id FROM ortho WHERE gene_hg IN (SELECT gene FROM gene_summary WHERE species = 'Human' AND prop_msr = 1)
AND gene_mm IN (SELECT gene FROM gene_summary WHERE species = 'Mouse' AND prop_msr = 1)""")
def _(t):
    return m.always_measured_orthologs(m.gene_summary(t.msr_b, t.species, t.tfs), t.ortho).select("id")


@query("m8_median_by_tf", "SELECT species, is_tf, quantile_cont(n_msr, 0.5) AS median_msr FROM gene_summary GROUP BY ALL")
def _(t):
    return m.median_by_tf_status(m.gene_summary(t.msr_b, t.species, t.tfs))


def _phi(z: str) -> str:
    """Upper tail of the normal law, same erf approximation as the engine."""
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    tt = f"(1.0 / (1.0 + 0.3275911::DOUBLE * {x}))"
    poly = f"((((1.061405429::DOUBLE * {tt} - 1.453152027) * {tt} + 1.421413741) * {tt} - 0.284496736) * {tt} + 0.254829592)"
    tail = f"(0.5 * {poly} * {tt} * exp(-{x} * {x}))"
    return f"CASE WHEN {z} >= 0 THEN {tail} WHEN {z} < 0 THEN 1.0 - {tail} END"


def rank_sum_sql(source: str, keys: str, value: str, flag: str) -> str:
    """Check SQL of the rank-sum test over ``source``."""
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}," if keys else ""
    return f"""
SELECT {lead} CAST(n1 AS BIGINT) AS n_first, CAST(n2 AS BIGINT) AS n_second, round(u, 4) AS u,
       round(CASE WHEN z2 IS NOT NULL THEN least(1.0::DOUBLE, 2 * ({_phi('z2')})) END, 5) AS p_two_sided, round({_phi('z1')}, 5) AS p_greater
FROM (SELECT {lead} n1, n2, u, abs((d - sign(d) * 0.5) / nullif(sigma, 0)) AS z2, (d - 0.5) / nullif(sigma, 0) AS z1
  FROM (SELECT *, u - n1 * n2 / 2 AS d, sqrt(n1 * n2 / 12 * ((n + 1) - ties / nullif(n * (n - 1), 0))) AS sigma
    FROM (SELECT {lead} n1, n - n1 AS n2, n, ties, r1 - n1 * (n1 + 1) / 2 AS u
      FROM (SELECT {lead} sum(f)::DOUBLE AS n1, count(*)::DOUBLE AS n, sum(f * mid) AS r1, sum(tc::DOUBLE * tc - 1) AS ties
        FROM (SELECT {lead} CASE WHEN {flag} THEN 1 ELSE 0 END AS f,
                count(*) OVER (PARTITION BY {lead} {value}) AS tc,
                rank() OVER ({part} ORDER BY {value}) + (count(*) OVER (PARTITION BY {lead} {value}) - 1) / 2.0::DOUBLE AS mid
              FROM {source} WHERE {value} IS NOT NULL)
        {'GROUP BY ' + keys if keys else ''}))))"""


def rounded_test(df):
    return df.withColumns({"u": rnd("u", 4), "p_two_sided": rnd("p_two_sided", 5), "p_greater": rnd("p_greater", 5)})


@query("m9_rank_sum_tf", rank_sum_sql("gene_summary", "species", "n_msr", "is_tf"))
def _(t):
    return rounded_test(rank_sum_test(m.gene_summary(t.msr_b, t.species, t.tfs), ["species"], "n_msr", "is_tf"))


def six_sql(v: str) -> str:
    return (
        f"round(min({v}), 6) AS min, round(quantile_cont({v}, 0.25), 6) AS q1, round(quantile_cont({v}, 0.5), 6) AS median, "
        f"round(avg({v}), 6) AS mean, round(quantile_cont({v}, 0.75), 6) AS q3, round(max({v}), 6) AS max"
    )


def round_six(df):
    return df.withColumns({c: rnd(c, 6) for c in ("min", "q1", "median", "mean", "q3", "max")})


@query("m10_species_summaries", f"""
SELECT species, stat, {six_sql('value')} FROM (
  SELECT species, 'n_cells' AS stat, CAST(n_cells AS DOUBLE) AS value FROM info_b
  UNION ALL SELECT species, 'n_celltypes', n_celltypes FROM info_b UNION ALL SELECT species, 'n_genes', n_genes FROM info_b) GROUP BY ALL""")
def _(t):
    return round_six(m.species_summaries(t.info_b, ["n_cells", "n_celltypes", "n_genes"]))


@query("m11_subset_to_measured", "SELECT f.partner AS tf, f.dataset_id, f.gene, round(f.rsr, 8) AS score FROM full_b f JOIN msr_b m ON m.dataset_id = f.dataset_id AND m.gene = f.partner AND measured")
def _(t):
    rows = c.mirrored(t.agg_b, "rsr").select(F.col("partner").alias("tf"), "dataset_id", "gene", rnd("rsr", 8).alias("score"))
    return m.measured_subset(rows, t.msr_b).select("tf", "dataset_id", "gene", "score")


@query("m12_gene_profiles", "SELECT species, tf, dataset_id, gene, round(score, 8) AS score FROM profile")
def _(t):
    return t.profile.withColumn("score", rnd("score", 8))


@query("m13_dataset_tally", "SELECT species, platform, count(*) AS n FROM info_b GROUP BY ALL")
def _(t):
    return m.dataset_tally(t.info_b, ["species", "platform"])
