"""Queries: saturation analysis and cross-species comparison."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import six_numbers, spearman_matrix
from ..operators import crossgroup as x
from ..operators import saturation as u
from .catalog import query
from .fixtures import K, N_ITER, SEED, f10
from .oracle import cte
from .q_core import round_six, six_sql
from .q_profiles import MIN_EXP, rd, spearman_sql, top_sql

N_NULL = 1000

# ---------------------------------------------------------------- U

cte("imp_top", f"SELECT species, tf, dataset_id, gene FROM {top_sql('imputed', 'species, tf, dataset_id', 'score', K)}")
cte("global_top", f"SELECT species, tf, gene FROM {top_sql('avg_profile', 'species, tf', 'score', K)}")
cte("expwise", """
SELECT i.species, i.tf, i.dataset_id, count(g.gene) AS topk FROM imp_top i
LEFT JOIN global_top g ON g.species = i.species AND g.tf = i.tf AND g.gene = i.gene GROUP BY ALL""")


@query("u1_dataset_overlap", "SELECT species, tf, dataset_id, topk FROM expwise")
def _(t):
    return u.dataset_overlap(t.imputed, K)


@query("u2_sample_overlap", f"""
SELECT t.species, t.tf, count(g.gene) AS topk FROM (SELECT species, tf, gene FROM {top_sql(f"(SELECT species, tf, gene, {f10('avg(score)')} AS score FROM imputed SEMI JOIN info_b USING (dataset_id) WHERE dataset_id IN (SELECT dataset_id FROM info_b WHERE platform LIKE '10x%') GROUP BY ALL)", 'species, tf', 'score', K)}) t
LEFT JOIN global_top g ON g.species = t.species AND g.tf = t.tf AND g.gene = t.gene GROUP BY ALL""")
def _(t):
    picked = t.info_b.filter("platform LIKE '10x%'").select("dataset_id")
    sample = t.imputed.select("species", "tf", "dataset_id").distinct().join(picked, "dataset_id", "left_semi")
    return u.sample_overlap(t.imputed, sample, K)


cte("draw_orders", f"""
SELECT species, tf, iter, dataset_id, n, row_number() OVER (PARTITION BY species, tf, iter
  ORDER BY md5(concat_ws('|', '{SEED}', species, tf, iter, dataset_id)), dataset_id) AS step
FROM (SELECT species, tf, dataset_id, count(*) OVER (PARTITION BY species, tf) AS n FROM (SELECT DISTINCT species, tf, dataset_id FROM imputed)),
     (SELECT unnest(range(1, {N_ITER} + 1)) AS iter) WHERE n >= 3""")
cte("step_means", f"""
SELECT * FROM (SELECT i.species, i.tf, iter, step, n, i.gene,
  {f10('avg(score) OVER (PARTITION BY i.species, i.tf, iter, i.gene ORDER BY step ROWS UNBOUNDED PRECEDING)')} AS score
  FROM imputed i JOIN draw_orders d ON d.species = i.species AND d.tf = i.tf AND d.dataset_id = i.dataset_id)
WHERE step >= 2 AND step < n""")
cte("step_overlaps", f"""
SELECT t.species, t.tf, t.step, CAST(t.iter AS INTEGER) AS iter, count(g.gene) AS topk
FROM {top_sql('step_means', 'species, tf, iter, step', 'score', K)} t
LEFT JOIN global_top g ON g.species = t.species AND g.tf = t.tf AND g.gene = t.gene GROUP BY ALL""")
cte("step_summ", f"SELECT species, tf, step AS n_step, min(topk)::DOUBLE AS min, quantile_cont(topk, 0.25) AS q1, quantile_cont(topk, 0.5) AS median, {f10('avg(topk)')} AS mean, quantile_cont(topk, 0.75) AS q3, max(topk)::DOUBLE AS max FROM step_overlaps GROUP BY ALL")
SIX = ", ".join(f"round({c}, 6) AS {c}" for c in ("min", "q1", "median", "mean", "q3", "max"))


@query("u3_single_step", f"SELECT species, tf, n_step, {SIX} FROM step_summ WHERE n_step = 4")
def _(t):
    return round_six(u.single_step(t.imputed, 4, K, N_ITER, SEED))


@query("u4_all_steps", f"SELECT species, tf, n_step, {SIX} FROM step_summ")
def _(t):
    return round_six(t.step_summ)


@query("u5_saturation", """
SELECT species, tf, 'experiments' AS part, CAST(dataset_id AS VARCHAR) AS item, topk::DOUBLE AS value FROM expwise SEMI JOIN step_summ USING (species, tf)
UNION ALL SELECT species, tf, 'steps', CAST(n_step AS VARCHAR), round(mean, 6) FROM step_summ""")
def _(t):
    return rd(u.saturation(t.imputed, K, N_ITER, SEED), value=6)


cte("ranked_ds", f"""
SELECT *, (n + 1 - rank)::DOUBLE / n AS rs FROM (SELECT species, tf, dataset_id, topk, count(*) OVER (PARTITION BY species, tf) AS n,
  row_number() OVER (PARTITION BY species, tf ORDER BY topk DESC, md5(concat_ws('|', '{SEED}', concat_ws('|', species, tf, dataset_id)))) AS rank FROM expwise)""")


@query("u6_rank_datasets", "SELECT species, tf, dataset_id, topk, rank, round(rs, 6) AS rs FROM ranked_ds")
def _(t):
    return rd(u.rank_datasets(u.dataset_overlap(t.imputed, K), SEED), rs=6)


cte("rs_table", """
SELECT r.species, r.tf, s.dataset_id, coalesce(d.rs, 0) AS rs FROM (SELECT DISTINCT species, tf FROM ranked_ds) r JOIN species s ON s.species = r.species
LEFT JOIN ranked_ds d ON d.species = r.species AND d.tf = r.tf AND d.dataset_id = s.dataset_id""")


@query("u7_rank_table", "SELECT species, tf, dataset_id, round(rs, 6) AS rs FROM rs_table")
def _(t):
    return rd(u.rank_table(u.rank_datasets(u.dataset_overlap(t.imputed, K), SEED), t.species), rs=6)


@query("u8_dataset_agreement", """
SELECT species, dataset_id, round(mean_rs, 6) AS mean_rs, platform, platform LIKE '10x%' AS is_10x
FROM (SELECT species, dataset_id, avg(rs) AS mean_rs FROM rs_table GROUP BY ALL) LEFT JOIN info_b USING (species, dataset_id)""")
def _(t):
    table = u.rank_table(u.rank_datasets(u.dataset_overlap(t.imputed, K), SEED), t.species)
    out = u.dataset_agreement(table, t.info_b).select("species", "dataset_id", "mean_rs", "platform", "is_10x")
    return rd(out, mean_rs=6)


def recovery_sql(order: str) -> str:
    return f"""SELECT species, tf, min_step, min_step::DOUBLE / (mx + 1) AS prop_total FROM
(SELECT species, tf, n_step AS min_step, row_number() OVER (PARTITION BY species, tf ORDER BY {order}) AS i FROM step_summ WHERE mean >= 0.8 * {K})
JOIN (SELECT species, tf, max(n_step) AS mx FROM step_summ GROUP BY ALL) USING (species, tf) WHERE i = 1"""


cte("recov", recovery_sql("mean, n_step"))


@query("u9_recovery_step", "SELECT species, tf, min_step, round(prop_total, 6) AS prop_total FROM recov")
def _(t):
    return rd(u.datasets_for_recovery(t.step_summ, K), prop_total=6)


@query("u9_recovery_first_step", f"SELECT species, tf, min_step, round(prop_total, 6) AS prop_total FROM ({recovery_sql('n_step')})")
def _(t):
    return rd(u.datasets_for_recovery(t.step_summ, K, by="step"), prop_total=6)


def fit_sql(grid: str) -> str:
    return f"""SELECT species, tf, a, b, sse FROM (SELECT *, row_number() OVER (PARTITION BY species, tf ORDER BY sse, b) AS i FROM (
  SELECT species, tf, b, yf / nullif(ff, 0) AS a, round(yy - yf / nullif(ff, 0) * yf, 9) AS sse FROM (
    SELECT species, tf, b, sum(mean * f) AS yf, sum(f * f) AS ff, sum(mean * mean) AS yy FROM (
      SELECT species, tf, b, mean, 1 - exp(-b * n_step) AS f FROM step_summ JOIN {grid}) GROUP BY ALL))) WHERE i = 1"""


_coarse = ", ".join(f"({b!r}::DOUBLE)" for b in u.GRID)
_fine = ", ".join(f"({v!r}::DOUBLE)" for v in u.FINE)
cte("coarse_fit", fit_sql(f"(SELECT * FROM (VALUES {_coarse}) v(b)) ON true"))
cte("exp_fit", fit_sql(f"(SELECT species AS s2, tf AS t2, b * exp(x * ln({u.GRID[1] / u.GRID[0]!r}::DOUBLE)) AS b FROM coarse_fit, (VALUES {_fine}) v(x)) ON s2 = species AND t2 = tf"))


@query("u10_exponential_fit", "SELECT species, tf, round(a, 4) AS a, round(b, 5) AS b FROM exp_fit")
def _(t):
    return rd(u.exponential_fit(t.step_summ), a=4, b=5).drop("sse")


cte("sat_wide", """
SELECT species || tf AS id, min_step, prop_total, floor(b * 1e6) AS b, mean AS topk_mean, n_exp
FROM recov JOIN exp_fit USING (species, tf) JOIN summ_tf USING (species, tf) WHERE stat = 'topk'""")
_cols = ["min_step", "prop_total", "b", "topk_mean", "n_exp"]


@query("u11_join_and_spearman", f"SELECT column_a, column_b, round(spearman, 6) AS spearman, n FROM " + spearman_sql(
    "(" + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM sat_wide" for i, a in enumerate(_cols) for b in _cols[i + 1:]) + ")",
    "column_a, column_b", "x", "y"))
def _(t):
    key = ["species", "tf"]
    sim = t.summ_tf.filter("stat = 'topk'").select(*key, F.col("mean").alias("topk_mean"), "n_exp")
    fit = u.exponential_fit(t.step_summ).select(*key, F.floor(F.col("b") * 1e6).alias("b"))
    wide = u.datasets_for_recovery(t.step_summ, K).join(fit, key).join(sim, key)
    wide = wide.withColumn("id", F.concat("species", F.col("tf").cast("string")))
    return rd(spearman_matrix(wide, "id", _cols), spearman=6)


# ---------------------------------------------------------------- X

@query("x1_ortholog_spearman", f"SELECT tf_id, round(spearman, 6) AS cor, n FROM {spearman_sql('rank_ortho', 'tf_id', 'avg_aggr_coexpr_hg', 'avg_aggr_coexpr_mm')}")
def _(t):
    return rd(x.side_correlation(t.rank_ortho_s), cor=6)


def tied_top(tag: str, desc: str) -> str:
    return f"(SELECT tf_id, id FROM (SELECT *, rank() OVER (PARTITION BY tf_id ORDER BY avg_aggr_coexpr_{tag} {desc}) AS r FROM rank_ortho WHERE avg_aggr_coexpr_{tag} IS NOT NULL) WHERE r <= {K})"


def overlap_cte(desc: str) -> str:
    return f"SELECT h.tf_id AS tf_hg, m.tf_id AS tf_mm, count(*) AS overlap FROM {tied_top('hg', desc)} h JOIN {tied_top('mm', desc)} m ON h.id = m.id GROUP BY ALL"


cte("ov_top", overlap_cte("DESC"))
cte("ov_bottom", overlap_cte("ASC"))
cte("ortho_tfs", "SELECT DISTINCT tf_id FROM rank_ortho")


def dense_ov(src: str) -> str:
    return f"(SELECT a.tf_id AS tf_hg, b.tf_id AS tf_mm, coalesce(overlap, 0) AS overlap FROM ortho_tfs a CROSS JOIN ortho_tfs b LEFT JOIN {src} o ON o.tf_hg = a.tf_id AND o.tf_mm = b.tf_id)"


@query("x2_overlap_table", f"SELECT tf_hg, tf_mm, overlap FROM {dense_ov('ov_top')}")
def _(t):
    return x.overlap_matrix(t.rank_ortho_s, K)


@query("x2_overlap_table_bottom", f"SELECT tf_hg, tf_mm, overlap FROM {dense_ov('ov_bottom')}")
def _(t):
    return x.overlap_matrix(t.rank_ortho_s, K, reverse=True)


def quant_cte(src: str) -> str:
    d = dense_ov(src)
    return f"""SELECT tf_id, count, qa AS quant_hg_in_mm, qb AS quant_mm_in_hg, (qa + qb) / 2 AS quant_ortho FROM (
  SELECT o.tf_hg AS tf_id, o.overlap AS count,
   (SELECT avg(CASE WHEN r.overlap <= o.overlap THEN 1.0::DOUBLE ELSE 0 END) FROM {d} r WHERE r.tf_hg = o.tf_hg AND r.tf_mm <> o.tf_hg) AS qa,
   (SELECT avg(CASE WHEN r.overlap <= o.overlap THEN 1.0::DOUBLE ELSE 0 END) FROM {d} r WHERE r.tf_mm = o.tf_hg AND r.tf_hg <> o.tf_hg) AS qb
  FROM {d} o WHERE o.tf_hg = o.tf_mm)"""


cte("quant_top", quant_cte("ov_top"))
cte("quant_bottom", quant_cte("ov_bottom"))
Q = "count, round(quant_hg_in_mm, 6) AS quant_hg_in_mm, round(quant_mm_in_hg, 6) AS quant_mm_in_hg, round(quant_ortho, 6) AS quant_ortho"


def r_quant(df):
    return rd(df, quant_hg_in_mm=6, quant_mm_in_hg=6, quant_ortho=6)


@query("x3_overlap_quantiles", f"SELECT tf_id, {Q} FROM quant_top")
def _(t):
    return r_quant(t.quant_top)


cte("rand_pairs", f"""
SELECT CAST(iter AS INTEGER) AS iter, max(tf_id) FILTER (i = 1) AS tf_hg, max(tf_id) FILTER (i = 2) AS tf_mm FROM (
 SELECT iter, tf_id, row_number() OVER (PARTITION BY iter ORDER BY md5(concat_ws('|', '{SEED}', iter, tf_id)), tf_id) AS i
 FROM ortho_tfs, (SELECT unnest(range(1, {N_NULL} + 1)) AS iter)) WHERE i <= 2 GROUP BY ALL""")


@query("x4_null_overlap", "SELECT iter, tf_hg, tf_mm, coalesce(overlap, 0) AS overlap FROM rand_pairs LEFT JOIN ov_top USING (tf_hg, tf_mm)")
def _(t):
    return x.null_overlap(x.overlap_table(t.rank_ortho_s, K), t.ortho_tfs, N_NULL, SEED)


cte("null_cor_rows", """
SELECT iter, h.rank_aggr_coexpr_hg AS x, m.rank_aggr_coexpr_mm AS y FROM rand_pairs p JOIN rank_ortho h ON h.tf_id = p.tf_hg
JOIN rank_ortho m ON m.tf_id = p.tf_mm AND m.id = h.id WHERE h.id <> p.tf_hg AND h.id <> p.tf_mm""")


@query("x5_null_spearman", f"SELECT iter, tf_hg, tf_mm, round(spearman, 6) AS spearman, n FROM rand_pairs LEFT JOIN {spearman_sql('null_cor_rows', 'iter', 'x', 'y')} USING (iter)")
def _(t):
    return rd(x.null_correlation(t.rank_ortho_s, t.ortho_tfs, N_NULL, SEED), spearman=6)


@query("x6_enough_datasets", f"""
SELECT tf_id FROM ortho_tfs WHERE tf_id IN (SELECT id FROM ortho JOIN n_exp ON tf = gene_hg WHERE species = 'Human' AND n_exp >= {MIN_EXP})
AND tf_id IN (SELECT id FROM ortho JOIN n_exp ON tf = gene_mm WHERE species = 'Mouse' AND n_exp >= {MIN_EXP})""")
def _(t):
    return x.enough_datasets(t.rank_ortho_s, t.n_exp, t.ortho, MIN_EXP)


cte("ortho_cor", f"SELECT tf_id, spearman AS cor, n FROM {spearman_sql('rank_ortho', 'tf_id', 'avg_aggr_coexpr_hg', 'avg_aggr_coexpr_mm')}")
cte("wide_sim", """
SELECT c.tf_id, cor, a.count AS topk_count, a.quant_hg_in_mm AS topk_quant_hg_in_mm, a.quant_mm_in_hg AS topk_quant_mm_in_hg, a.quant_ortho AS topk_quant_ortho,
 b.count AS bottomk_count, b.quant_ortho AS bottomk_quant_ortho
FROM ortho_cor c LEFT JOIN quant_top a ON a.tf_id = c.tf_id LEFT JOIN quant_bottom b ON b.tf_id = c.tf_id""")


@query("x7_wide_similarity", "SELECT tf_id, round(cor, 6) AS cor, topk_count, round(topk_quant_ortho, 6) AS topk_quant_ortho, bottomk_count, round(bottomk_quant_ortho, 6) AS bottomk_quant_ortho FROM wide_sim")
def _(t):
    out = t.wide_sim.select("tf_id", "cor", "topk_count", "topk_quant_ortho", "bottomk_count", "bottomk_quant_ortho")
    return rd(out, cor=6, topk_quant_ortho=6, bottomk_quant_ortho=6)


ONE = "GN10_Gn10"


@query("x8_rank_differences", f"SELECT id, rank_aggr_coexpr_hg - rank_aggr_coexpr_mm AS diff_rank, rank_aggr_coexpr_hg + rank_aggr_coexpr_mm AS add_rank FROM rank_ortho WHERE tf_id = '{ONE}'")
def _(t):
    return x.rank_differences(t.rank_ortho_s, ONE)


@query("x9_one_against_all", f"""
SELECT t.tf_id, coalesce(a.overlap, 0) AS hg_in_mm, coalesce(b.overlap, 0) AS mm_in_hg FROM ortho_tfs t
LEFT JOIN ov_top a ON a.tf_hg = '{ONE}' AND a.tf_mm = t.tf_id LEFT JOIN ov_top b ON b.tf_mm = '{ONE}' AND b.tf_hg = t.tf_id""")
def _(t):
    return x.one_against_all(x.overlap_table(t.rank_ortho_s, K), t.ortho_tfs, ONE)


@query("x9_shared_top", f"SELECT tf_id, id FROM {tied_top('hg', 'DESC')} SEMI JOIN {tied_top('mm', 'DESC')} USING (tf_id, id)")
def _(t):
    return x.shared_top(t.rank_ortho_s, K)


cte("generic_top", f"""
SELECT tf_id, {f10('hg_in_mm')} AS hg_in_mm, {f10('mm_in_hg')} AS mm_in_hg FROM (SELECT tf_hg AS tf_id, avg(overlap) AS hg_in_mm FROM {dense_ov('ov_top')} GROUP BY ALL)
JOIN (SELECT tf_mm AS tf_id, avg(overlap) AS mm_in_hg FROM {dense_ov('ov_top')} GROUP BY ALL) USING (tf_id)""")


@query("x10_generic_hubs", """
SELECT g.tf_id, round(hg_in_mm, 6) AS hg_in_mm, round(mm_in_hg, 6) AS mm_in_hg, round(cor, 6) AS cor, topk_count FROM
(SELECT *, rank() OVER (ORDER BY hg_in_mm DESC) AS a, rank() OVER (ORDER BY mm_in_hg DESC) AS b FROM generic_top) g
LEFT JOIN wide_sim w ON w.tf_id = g.tf_id WHERE a <= 5 OR b <= 5""")
def _(t):
    common = x.generic_overlap(x.overlap_table(t.rank_ortho_s, K), t.ortho_tfs)
    out = x.hubs(common, t.wide_sim).select("tf_id", "hg_in_mm", "mm_in_hg", "cor", "topk_count")
    return rd(out, hg_in_mm=6, mm_in_hg=6, cor=6)


@query("x11_extremes", "SELECT count(*) FILTER (count = 0) AS count0, count(*) FILTER (quant_hg_in_mm = 1) AS quant_hg1, count(*) FILTER (quant_mm_in_hg = 1) AS quant_mm1, count(*) FILTER (quant_ortho = 1) AS quant_ortho1 FROM quant_top")
def _(t):
    return x.extremes(t.quant_top)


@query("x11_slices", """
SELECT tf_id, topk_count = 0 AS no_topk, bottomk_count = 0 AS no_bottomk, cor < 0.0 AS low_cor, cor > 0.2 AS high_cor,
 bottomk_quant_ortho = 1 AND topk_quant_ortho < 1 AS bottom_not_top, topk_quant_ortho = 1 AND topk_count > 0 AS most_specific FROM wide_sim""")
def _(t):
    return x.slices(t.wide_sim, 0.0, 0.2)


@query("x11_both_directions", f"""
SELECT t.tf_id, (SELECT count(*) FROM {tied_top('hg', 'DESC')} h JOIN {tied_top('mm', 'DESC')} m USING (tf_id, id) WHERE h.tf_id = t.tf_id) AS n_top,
 (SELECT count(*) FROM {tied_top('hg', 'ASC')} h JOIN {tied_top('mm', 'ASC')} m USING (tf_id, id) WHERE h.tf_id = t.tf_id) AS n_bottom FROM ortho_tfs t""")
def _(t):
    return x.top_in_both_directions(t.rank_ortho_s, K)


_xc = ["cor", "topk_count", "topk_quant_ortho", "bottomk_count", "bottomk_quant_ortho"]


@query("x12_summaries", f"SELECT stat, {six_sql('value')} FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS stat, {c}::DOUBLE AS value FROM wide_sim" for c in _xc) + ") GROUP BY ALL")
def _(t):
    long = t.wide_sim.unpivot(["tf_id"], [F.col(c).cast("double").alias(c) for c in _xc], "stat", "value")
    return round_six(long.groupBy("stat").agg(*six_numbers("value")))


@query("x12_spearman_matrix", "SELECT column_a, column_b, round(spearman, 6) AS spearman, n FROM " + spearman_sql(
    "(" + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, floor({a}::DOUBLE * 1e9) AS x, floor({b}::DOUBLE * 1e9) AS y FROM wide_sim" for i, a in enumerate(_xc) for b in _xc[i + 1:]) + ")",
    "column_a, column_b", "x", "y"))
def _(t):
    fixed = t.wide_sim.select("tf_id", *[F.floor(F.col(c) * 1e9).alias(c) for c in _xc])
    return rd(spearman_matrix(fixed, "tf_id", _xc), spearman=6)
