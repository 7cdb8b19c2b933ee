"""Queries: ranking across datasets, profile similarity and its summaries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..functions.ranks import tie_adjusted_k, top_set
from ..functions.stats import spearman
from ..operators import rankings as r
from ..operators import similarity as s
from .catalog import query
from .fixtures import DRAWS, SEED, K, f10
from .oracle import cte
from .q_core import round_six

TD = ["species", "tf", "dataset_id"]
MIN_EXP = 5


def top_sql(source: str, keys: str, value: str, k: int, desc: bool = True) -> str:
    d = "DESC" if desc else "ASC"
    p = f"PARTITION BY {keys}" if keys else ""
    return f"""(SELECT * FROM (SELECT *, CASE WHEN lastrk < cnt THEN lastrk - 1 ELSE cnt END AS k_eff FROM (
SELECT *, max(rk) OVER ({p}) AS lastrk, count(*) OVER ({p}) AS cnt FROM (
SELECT *, row_number() OVER ({p} ORDER BY {value} {d}, gene) AS rn, rank() OVER ({p} ORDER BY {value} {d}) AS rk
FROM {source} WHERE {value} IS NOT NULL) WHERE rn <= {k})) WHERE rn <= greatest(k_eff, 1))"""


def rd(df, **digits):
    return df.withColumns({c: rnd(c, n) for c, n in digits.items()})


# ---------------------------------------------------------------- R

@query("r1_colrank_min", "SELECT species, tf, dataset_id, gene, rank() OVER (PARTITION BY species, tf, dataset_id ORDER BY score DESC) AS rank FROM profile")
def _(t):
    return r.rank_columns(t.profile, TD, "score", "min").drop("score")


@query("r1_colrank_random", f"""SELECT species, tf, dataset_id, gene, row_number() OVER (PARTITION BY species, tf, dataset_id
ORDER BY score DESC, md5(concat_ws('|', '{SEED}', gene)), gene) AS rank FROM profile""")
def _(t):
    return r.rank_columns(t.profile, TD, "score", "random", "gene", SEED).drop("score")


@query("r2_rowrank_min", "SELECT species, tf, dataset_id, gene, rank() OVER (PARTITION BY species, tf, gene ORDER BY score DESC) AS rank FROM profile")
def _(t):
    return r.rank_columns(t.profile, ["species", "tf", "gene"], "score", "min").drop("score")


@query("r3_allrank", "SELECT dataset_id, gene_a, gene_b, rank() OVER (PARTITION BY dataset_id ORDER BY rsr DESC) AS rank FROM agg_a")
def _(t):
    return r.rank_matrix(t.agg_a, ["dataset_id"], "rsr").select("dataset_id", "gene_a", "gene_b", "rank")


cte("own_profile", "SELECT species, tf, dataset_id, gene, CASE WHEN gene <> tf THEN score END AS score FROM profile")
cte("imputed", """
SELECT p.species, p.tf, p.dataset_id, p.gene, CASE WHEN NOT m.measured THEN med ELSE score END AS score
FROM own_profile p JOIN msr_b m ON m.dataset_id = p.dataset_id AND m.gene = p.gene
LEFT JOIN (SELECT species, tf, quantile_cont(score, 0.5) AS med FROM own_profile GROUP BY ALL) q
  ON q.species = p.species AND q.tf = p.tf""")
cte("avg_profile", f"SELECT species, tf, gene, {f10('avg(score)')} AS score FROM imputed GROUP BY ALL")


@query("r4_impute_median", "SELECT species, tf, dataset_id, gene, round(score, 8) AS score FROM imputed")
def _(t):
    return rd(t.imputed, score=8)


@query("r5_with_average", """
SELECT species, tf, CAST(dataset_id AS VARCHAR) AS dataset_id, gene, round(score, 8) AS score FROM imputed
UNION ALL SELECT species, tf, 'Avg', gene, round(score, 8) FROM avg_profile""")
def _(t):
    return rd(r.with_average(t.imputed), score=8)


cte("thresholds", f"SELECT species, tf, dataset_id, min(score) AS thr FROM {top_sql('imputed', 'species, tf, dataset_id', 'score', K)} WHERE k_eff > 0 GROUP BY ALL")
cte("topk_counts", "SELECT i.species, i.tf, i.gene, count(*) FILTER (score >= thr) AS topk_count FROM imputed i LEFT JOIN thresholds t ON t.species = i.species AND t.tf = i.tf AND t.dataset_id = i.dataset_id GROUP BY ALL")


@query("r6_topk_count", "SELECT species, tf, gene, topk_count FROM topk_counts")
def _(t):
    return r.topk_count(t.imputed, K)


cte("rank_tf", """
SELECT a.species, a.tf, a.gene,
  CASE WHEN a.gene <> a.tf THEN rank() OVER (PARTITION BY a.species, a.tf ORDER BY a.score DESC NULLS LAST) END AS rank_aggr_coexpr,
  n_comeasured, a.score AS avg_aggr_coexpr,
  CASE WHEN a.gene <> a.tf THEN best END AS rank_single_best, CASE WHEN a.gene <> a.tf THEN topk_count END AS topk_count
FROM avg_profile a JOIN topk_counts k ON k.species = a.species AND k.tf = a.tf AND k.gene = a.gene
JOIN (SELECT species, tf, gene, min(rk) AS best FROM (SELECT *, CASE WHEN score IS NOT NULL THEN
        rank() OVER (PARTITION BY species, tf, dataset_id ORDER BY score DESC NULLS LAST) END AS rk FROM imputed) GROUP BY ALL) b
  ON b.species = a.species AND b.tf = a.tf AND b.gene = a.gene
LEFT JOIN comsr_b c ON c.species = a.species AND c.gene = a.gene AND c.partner = a.tf""")


@query("r7_consensus_ranks", "SELECT species, tf, gene, rank_aggr_coexpr, n_comeasured, round(avg_aggr_coexpr, 6) AS avg_aggr_coexpr, rank_single_best, topk_count FROM rank_tf")
def _(t):
    return rd(t.rank_tf, avg_aggr_coexpr=6)


def ortho_side(tag: str, species: str) -> str:
    return f"""(SELECT ot.id AS tf_id, og.id, rt.avg_aggr_coexpr, rt.n_comeasured, rt.rank_single_best, rt.topk_count,
  CASE WHEN avg_aggr_coexpr IS NOT NULL THEN rank() OVER (PARTITION BY ot.id ORDER BY avg_aggr_coexpr DESC NULLS LAST) END AS rk
  FROM rank_tf rt JOIN ortho ot ON rt.tf = ot.gene_{tag} JOIN ortho og ON rt.gene = og.gene_{tag} WHERE rt.species = '{species}')"""


cte("rank_ortho", f"""
SELECT *, CASE WHEN rank_aggr_coexpr_hg * rank_aggr_coexpr_mm IS NOT NULL THEN
  rank() OVER (PARTITION BY tf_id ORDER BY rank_aggr_coexpr_hg * rank_aggr_coexpr_mm NULLS LAST) END AS rank_aggr_coexpr_ortho
FROM (SELECT h.tf_id, h.id, h.rk AS rank_aggr_coexpr_hg, m.rk AS rank_aggr_coexpr_mm, h.avg_aggr_coexpr AS avg_aggr_coexpr_hg,
        m.avg_aggr_coexpr AS avg_aggr_coexpr_mm, h.topk_count AS topk_count_hg, m.topk_count AS topk_count_mm
      FROM {ortho_side('hg', 'Human')} h LEFT JOIN {ortho_side('mm', 'Mouse')} m ON m.tf_id = h.tf_id AND m.id = h.id
      WHERE h.tf_id IN (SELECT ot.id FROM rank_tf rt JOIN ortho ot ON rt.tf = ot.gene_mm WHERE rt.species = 'Mouse'))""")


@query("r8_ortholog_ranks", "SELECT tf_id, id, rank_aggr_coexpr_ortho, rank_aggr_coexpr_hg, rank_aggr_coexpr_mm, round(avg_aggr_coexpr_hg, 6) AS avg_aggr_coexpr_hg, round(avg_aggr_coexpr_mm, 6) AS avg_aggr_coexpr_mm, topk_count_hg, topk_count_mm FROM rank_ortho")
def _(t):
    out = t.rank_ortho.select(
        "tf_id", "id", "rank_aggr_coexpr_ortho", "rank_aggr_coexpr_hg", "rank_aggr_coexpr_mm",
        "avg_aggr_coexpr_hg", "avg_aggr_coexpr_mm", "topk_count_hg", "topk_count_mm",
    )
    return rd(out, avg_aggr_coexpr_hg=6, avg_aggr_coexpr_mm=6)


cte("top_partners", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY species, tf ORDER BY rank_aggr_coexpr NULLS LAST, gene) AS prn FROM rank_tf) WHERE prn <= 9")


@query("r9_count_set_members", "SELECT species, tf, count(*) FILTER (gene IN (SELECT tf FROM tfs)) AS n_in_set FROM top_partners GROUP BY ALL")
def _(t):
    return r.count_set_members(t.rank_tf, t.tf_genes, 9)


@query("r10_count_non_members", "SELECT species, gene, count(*) AS n_lists FROM top_partners WHERE gene NOT IN (SELECT tf FROM tfs) GROUP BY ALL")
def _(t):
    return r.count_non_members(t.rank_tf, t.tf_genes, 9)


@query("r11_binary_block", f"SELECT species, tf, gene, CAST(rank_aggr_coexpr <= {K} AS INTEGER) AS in_top FROM rank_tf WHERE gene IN (SELECT tf FROM tfs)")
def _(t):
    return r.binary_block(t.rank_tf, t.tf_genes, K)


@query("r12_reverse_score", "SELECT species, tf, gene, round(-avg_aggr_coexpr, 6) AS avg_aggr_coexpr, -rank_aggr_coexpr AS rank_aggr_coexpr FROM rank_tf")
def _(t):
    out = r.reverse_score(r.reverse_score(t.rank_tf, "avg_aggr_coexpr"), "rank_aggr_coexpr")
    return rd(out.select("species", "tf", "gene", "avg_aggr_coexpr", "rank_aggr_coexpr"), avg_aggr_coexpr=6)


# ---------------------------------------------------------------- K

@query("k1_tie_adjusted_k", f"SELECT DISTINCT species, tf, dataset_id, CAST(k_eff AS BIGINT) AS k_eff FROM {top_sql('profile', 'species, tf, dataset_id', 'score', K)}")
def _(t):
    return tie_adjusted_k(t.profile, TD, "score", K)


cte("no_self", "SELECT * FROM profile WHERE gene <> tf")
cte("top_p", f"SELECT species, tf, dataset_id, gene FROM {top_sql('no_self', 'species, tf, dataset_id', 'score', K)}")
cte("bottom_p", f"SELECT species, tf, dataset_id, gene FROM {top_sql('no_self', 'species, tf, dataset_id', 'score', K, False)}")
cte("both_p", "SELECT * FROM top_p UNION SELECT * FROM bottom_p")
cte("ds_pairs", "SELECT a.species, a.tf, a.dataset_id AS col_a, b.dataset_id AS col_b FROM (SELECT DISTINCT species, tf, dataset_id FROM profile) a JOIN (SELECT DISTINCT species, tf, dataset_id FROM profile) b ON a.species = b.species AND a.tf = b.tf AND a.dataset_id < b.dataset_id")


def pair_count(src: str, name: str) -> str:
    return f"(SELECT a.species, a.tf, a.dataset_id AS col_a, b.dataset_id AS col_b, count(*) AS {name} FROM {src} a JOIN {src} b ON a.species = b.species AND a.tf = b.tf AND a.gene = b.gene AND a.dataset_id < b.dataset_id GROUP BY ALL)"


@query("k2_topk_sets", "SELECT *, 'top' AS side FROM top_p UNION ALL SELECT *, 'bottom' FROM bottom_p")
def _(t):
    p = t.profile.filter("gene <> tf")
    top = top_set(p, TD, "score", "gene", K).select(*TD, "gene", F.lit("top").alias("side"))
    return top.unionByName(top_set(p, TD, "score", "gene", K, False).select(*TD, "gene", F.lit("bottom").alias("side")))


cte("avg_hg", "SELECT tf, gene, score FROM avg_profile WHERE species = 'Human'")
cte("avg_mm", "SELECT tf, gene, score FROM avg_profile WHERE species = 'Mouse'")
cte("top_hg", f"SELECT tf, gene FROM {top_sql('avg_hg', 'tf', 'score', K)}")
cte("top_mm", f"SELECT tf, gene FROM {top_sql('avg_mm', 'tf', 'score', K)}")


def sides(t):
    avg = r.average_profile(t.imputed)
    cols = ["tf", "gene", "score"]
    return avg.filter("species = 'Human'").select(*cols), avg.filter("species = 'Mouse'").select(*cols)


@query("k3_topk_intersect", f"""
SELECT t.species, t.tf, t.dataset_id, count(*) FILTER (g.gene IS NOT NULL) AS overlap
FROM top_p t LEFT JOIN (SELECT species, tf, gene FROM {top_sql('avg_profile', 'species, tf', 'score', K)}) g
ON g.species = t.species AND g.tf = t.tf AND g.gene = t.gene GROUP BY ALL""")
def _(t):
    sets = s.packed_top(t.profile.filter("gene <> tf"), ["species", "tf"], "dataset_id", K)
    avg = s.packed_top(r.average_profile(t.imputed), ["species"], "tf", K).withColumnRenamed("genes", "genes_b")
    return sets.join(avg, ["species", "tf"]).select(*TD, s.overlap("genes", "genes_b").alias("overlap"))


@query("k4_length_intersect", """
SELECT h.tf, count(*) FILTER (c.target IS NOT NULL) AS n FROM top_hg h LEFT JOIN curated c ON c.tf = h.tf AND c.target = h.gene GROUP BY ALL""")
def _(t):
    hg, _mm = sides(t)
    sets = s.packed_top(hg, [], "tf", K)
    targets = t.curated.groupBy("tf").agg(F.collect_set("target").alias("targets"))
    n = F.coalesce(s.overlap("genes", "targets"), F.lit(0).cast("long"))
    return sets.join(targets, "tf", "left").select("tf", F.when(F.col("targets").isNull(), 0).otherwise(n).cast("long").alias("n"))


@query("k5_binarize", "SELECT * FROM both_p")
def _(t):
    return s.binarize(t.profile.filter("gene <> tf"), ["species", "tf"], "dataset_id", K)


@query("k6_colwise_topk", f"SELECT p.*, coalesce(n, 0) AS overlap FROM ds_pairs p LEFT JOIN {pair_count('top_p', 'n')} USING (species, tf, col_a, col_b)")
def _(t):
    return s.column_overlaps(t.profile.filter("gene <> tf"), ["species", "tf"], "dataset_id", K)


cte("prof_rank", "SELECT *, rank() OVER (PARTITION BY species, tf, dataset_id ORDER BY score) + (count(*) OVER (PARTITION BY species, tf, dataset_id, score) - 1) / 2.0::DOUBLE AS rk FROM no_self")
cte("scor_p", f"""
SELECT species, tf, col_a, col_b, CASE WHEN n * saa - sa * sa > 0 AND n * sbb - sb * sb > 0 THEN
{f10('(n * sxy - sa * sb) / (sqrt(n * saa - sa * sa) * sqrt(n * sbb - sb * sb))')} END AS scor
FROM (SELECT a.species, a.tf, a.dataset_id AS col_a, b.dataset_id AS col_b, count(*)::DOUBLE AS n, sum(a.rk) AS sa, sum(b.rk) AS sb,
        sum(a.rk * a.rk) AS saa, sum(b.rk * b.rk) AS sbb, sum(a.rk * b.rk) AS sxy
      FROM prof_rank a JOIN prof_rank b ON a.species = b.species AND a.tf = b.tf AND a.gene = b.gene AND a.dataset_id < b.dataset_id GROUP BY ALL)""")


@query("k7_colwise_spearman", "SELECT species, tf, col_a, col_b, round(scor, 6) AS scor FROM scor_p")
def _(t):
    return rd(s.column_correlations(t.profile.filter("gene <> tf"), ["species", "tf"], "dataset_id"), scor=6)


cte("jacc_p", f"""
SELECT p.species, p.tf, p.col_a, p.col_b, coalesce(n, 0)::DOUBLE / (na + nb - coalesce(n, 0)) AS jaccard
FROM ds_pairs p LEFT JOIN {pair_count('both_p', 'n')} USING (species, tf, col_a, col_b)
JOIN (SELECT species, tf, dataset_id AS col_a, count(*) AS na FROM both_p GROUP BY ALL) USING (species, tf, col_a)
JOIN (SELECT species, tf, dataset_id AS col_b, count(*) AS nb FROM both_p GROUP BY ALL) USING (species, tf, col_b)""")


@query("k8_colwise_jaccard", "SELECT species, tf, col_a, col_b, round(jaccard, 6) AS jaccard FROM jacc_p")
def _(t):
    return rd(s.column_jaccard(t.profile.filter("gene <> tf"), ["species", "tf"], "dataset_id", K), jaccard=6)


def auc_sql(source: str, keys: str, extra: str = "") -> str:
    """AUROC and AUPRC from rows (keys, s, e, n) of positives, one row per positive."""
    return f"""
SELECT {keys}, CAST(p AS BIGINT) AS n_targets, CASE WHEN n > p THEN {f10('(rsum - p * (p + 1) / 2) / (p * (n - p))')} END AS auroc,
  CASE WHEN n > p AND NOT flat THEN {f10('area / p')} END AS auprc {extra}
FROM (SELECT {keys}, sum(t) AS p, max(n) AS n, sum((n + 1 - (s + 1 + e) / 2.0::DOUBLE) * t) AS rsum, bool_or(s = 0 AND e = n) AS flat,
        sum(CASE WHEN s > 0 THEN 0.5 * t * ((tp + t) / e + tp / s) ELSE 0 END) AS area
  FROM (SELECT *, sum(t) OVER (PARTITION BY {keys} ORDER BY s) - t AS tp
    FROM (SELECT {keys}, s::DOUBLE AS s, e::DOUBLE AS e, n::DOUBLE AS n, count(*)::DOUBLE AS t FROM {source} GROUP BY ALL)) GROUP BY {keys})"""


def pos_sql(source: str, keys: str, value: str) -> str:
    return f"""(SELECT {keys}, gene, rank() OVER (PARTITION BY {keys} ORDER BY {value} DESC) - 1 AS s,
  count(*) OVER (PARTITION BY {keys} ORDER BY {value} DESC) AS e, count(*) OVER (PARTITION BY {keys}) AS n
  FROM {source} WHERE {value} IS NOT NULL)"""


@query("k9_colwise_auc", "SELECT species, tf, col_i, col_j, n_targets, CASE WHEN col_i = col_j THEN 1 ELSE round(auroc, 6) END AS auroc, CASE WHEN col_i = col_j THEN 1 ELSE round(auprc, 6) END AS auprc FROM (" + auc_sql(
    f"(SELECT p.species, p.tf, p.dataset_id AS col_i, l.dataset_id AS col_j, s, e, n FROM {pos_sql('no_self', 'species, tf, dataset_id', 'score')} p "
    "JOIN top_p l ON l.species = p.species AND l.tf = p.tf AND l.gene = p.gene)", "species, tf, col_i, col_j") + ")")
def _(t):
    return rd(s.column_aucs(t.profile.filter("gene <> tf"), ["species", "tf"], "dataset_id", K), auroc=6, auprc=6)


def spearman_sql(source: str, keys: str, x: str, y: str) -> str:
    """Spearman over complete rows; yields keys, spearman, n."""
    p = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}," if keys else ""
    rk = lambda v: f"rank() OVER ({p} ORDER BY {v}) + (count(*) OVER (PARTITION BY {lead} {v}) - 1) / 2.0::DOUBLE"
    return f"""(SELECT {lead} CASE WHEN n * saa - sa * sa > 0 AND n * sbb - sb * sb > 0 THEN
 (n * sxy - sa * sb) / (sqrt(n * saa - sa * sa) * sqrt(n * sbb - sb * sb)) END AS spearman, CAST(n AS BIGINT) AS n
 FROM (SELECT {lead} count(*)::DOUBLE AS n, sum(rx) AS sa, sum(ry) AS sb, sum(rx * rx) AS saa, sum(ry * ry) AS sbb, sum(rx * ry) AS sxy
 FROM (SELECT {lead} {rk(x)} AS rx, {rk(y)} AS ry FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) {'GROUP BY ' + keys if keys else ''}))"""


cte("avg_both", "SELECT tf, gene, h.score AS x, m.score AS y FROM avg_hg h JOIN avg_mm m USING (tf, gene)")


@query("k10_matched_spearman", f"SELECT tf, round(spearman, 6) AS scor, n FROM {spearman_sql('avg_both', 'tf', 'x', 'y')}")
def _(t):
    return rd(s.matched_correlation(*sides(t), "tf"), scor=6)


@query("k11_matched_topk", "SELECT h.tf, count(m.gene) AS overlap FROM top_hg h LEFT JOIN top_mm m ON m.tf = h.tf AND m.gene = h.gene GROUP BY ALL")
def _(t):
    return s.matched_overlap(*sides(t), "tf", K)


def shuffled(side: int) -> str:
    return f"SELECT tf AS col_{side}, row_number() OVER (ORDER BY md5(concat_ws('|', '{SEED}', {side}, tf)), tf) AS pair FROM (SELECT DISTINCT tf FROM avg_hg SEMI JOIN avg_mm USING (tf))"


cte("shuffled_cols", f"SELECT pair, col_1, col_2 FROM ({shuffled(1)}) JOIN ({shuffled(2)}) USING (pair)")


@query("k12_shuffled_spearman", f"""
SELECT pair, col_1, col_2, round(spearman, 6) AS scor, n FROM shuffled_cols JOIN
{spearman_sql("(SELECT pair, h.score AS x, m.score AS y FROM shuffled_cols JOIN avg_hg h ON h.tf = col_1 JOIN avg_mm m ON m.tf = col_2 AND m.gene = h.gene)", 'pair', 'x', 'y')} USING (pair)""")
def _(t):
    return rd(s.shuffled_correlation(*sides(t), "tf", SEED), scor=6)


@query("k13_shuffled_topk", "SELECT pair, col_1, col_2, count(m.gene) AS overlap FROM shuffled_cols JOIN top_hg h ON h.tf = col_1 LEFT JOIN top_mm m ON m.tf = col_2 AND m.gene = h.gene GROUP BY ALL")
def _(t):
    return s.shuffled_overlap(*sides(t), "tf", K, SEED)


cte("sim_tf", f"""
SELECT p.species, p.tf, p.col_a, p.col_b, scor, coalesce(nt, 0) AS topk, coalesce(nb, 0) AS bottomk, jaccard
FROM ds_pairs p LEFT JOIN scor_p USING (species, tf, col_a, col_b) JOIN jacc_p USING (species, tf, col_a, col_b)
LEFT JOIN {pair_count('top_p', 'nt')} USING (species, tf, col_a, col_b)
LEFT JOIN {pair_count('bottom_p', 'nb')} USING (species, tf, col_a, col_b)""")
SIM = "round(scor, 6) AS scor, topk, bottomk, round(jaccard, 6) AS jaccard"


@query("k14_similarity_one_tf", f"SELECT col_a, col_b, {SIM} FROM sim_tf WHERE species = 'Mouse' AND tf = 10")
def _(t):
    one = t.profile.filter("species = 'Mouse' AND tf = 10 AND gene <> tf")
    return rd(s.similarity(one, ["species", "tf"], "dataset_id", K).drop("species", "tf"), scor=6, jaccard=6)


@query("k15_similarity_all_tfs", f"SELECT species, tf, col_a, col_b, {SIM} FROM sim_tf")
def _(t):
    return rd(t.sim_tf, scor=6, jaccard=6)


cte("null_pool", "SELECT species, m.dataset_id, m.gene, row_number() OVER (PARTITION BY m.dataset_id ORDER BY m.gene) - 1 AS place, count(*) OVER (PARTITION BY m.dataset_id) AS n FROM msr_b m JOIN species s ON s.dataset_id = m.dataset_id WHERE measured AND m.gene IN (SELECT tf FROM tfs)")
cte("null_draws", f"""
SELECT species, iter, dataset_id, gene AS partner FROM null_pool, (SELECT unnest(range(1, {DRAWS} + 1)) AS iter)
WHERE place = ('0x' || substr(md5(concat_ws('|', '{SEED}', iter, dataset_id)), 1, 15))::BIGINT % n""")
cte("null_prof", "SELECT d.species, CAST(d.iter AS INTEGER) AS iter, d.dataset_id, f.gene, f.rsr AS score FROM null_draws d JOIN full_b f ON f.dataset_id = d.dataset_id AND f.partner = d.partner")
cte("null_top", f"SELECT species, iter, dataset_id, gene FROM {top_sql('null_prof', 'species, iter, dataset_id', 'score', K)}")
cte("null_bottom", f"SELECT species, iter, dataset_id, gene FROM {top_sql('null_prof', 'species, iter, dataset_id', 'score', K, False)}")
cte("null_both", "SELECT * FROM null_top UNION SELECT * FROM null_bottom")
cte("null_rank", "SELECT *, rank() OVER (PARTITION BY species, iter, dataset_id ORDER BY score) + (count(*) OVER (PARTITION BY species, iter, dataset_id, score) - 1) / 2.0::DOUBLE AS rk FROM null_prof")


def null_pairs(src: str, name: str) -> str:
    return pair_count(src, name).replace(".tf", ".iter")


cte("null_sim", f"""
SELECT p.species, p.iter, p.col_a, p.col_b, scor, coalesce(nt, 0) AS topk, coalesce(nb, 0) AS bottomk,
       coalesce(nu, 0)::DOUBLE / (na + nc - coalesce(nu, 0)) AS jaccard
FROM (SELECT species, iter, col_a, col_b, CASE WHEN n * saa - sa * sa > 0 AND n * sbb - sb * sb > 0 THEN
  {f10('(n * sxy - sa * sb) / (sqrt(n * saa - sa * sa) * sqrt(n * sbb - sb * sb))')} END AS scor
  FROM (SELECT a.species, a.iter, a.dataset_id AS col_a, b.dataset_id AS col_b, count(*)::DOUBLE AS n, sum(a.rk) AS sa, sum(b.rk) AS sb,
        sum(a.rk * a.rk) AS saa, sum(b.rk * b.rk) AS sbb, sum(a.rk * b.rk) AS sxy
      FROM null_rank a JOIN null_rank b ON a.species = b.species AND a.iter = b.iter AND a.gene = b.gene AND a.dataset_id < b.dataset_id GROUP BY ALL)) p
LEFT JOIN {null_pairs('null_top', 'nt')} USING (species, iter, col_a, col_b)
LEFT JOIN {null_pairs('null_bottom', 'nb')} USING (species, iter, col_a, col_b)
LEFT JOIN {null_pairs('null_both', 'nu')} USING (species, iter, col_a, col_b)
JOIN (SELECT species, iter, dataset_id AS col_a, count(*) AS na FROM null_both GROUP BY ALL) USING (species, iter, col_a)
JOIN (SELECT species, iter, dataset_id AS col_b, count(*) AS nc FROM null_both GROUP BY ALL) USING (species, iter, col_b)""")


@query("k16_null_similarity", f"SELECT species, iter, col_a, col_b, {SIM} FROM null_sim")
def _(t):
    return rd(t.null_sim, scor=6, jaccard=6)


QG = 10  # the queried gene
cte("top_cols", f"SELECT dataset_id, partner, gene FROM {top_sql('full_b', 'dataset_id, partner', 'rsr', K)}")
cte("q_overlap", f"""
SELECT q.dataset_id AS query, s.dataset_id AS subject, s.partner, count(q2.gene) AS overlap
FROM (SELECT DISTINCT dataset_id FROM top_cols) q JOIN top_cols s ON s.dataset_id <> q.dataset_id
LEFT JOIN (SELECT dataset_id, gene FROM top_cols WHERE partner = {QG}) q2 ON q2.dataset_id = q.dataset_id AND q2.gene = s.gene GROUP BY ALL""")


@query("k17_query_topk", "SELECT query, subject, partner, overlap FROM q_overlap WHERE query = 0")
def _(t):
    return s.query_overlap(t.full_b, QG, K, query=0)


cte("col_rank", "SELECT *, rank() OVER (PARTITION BY dataset_id, partner ORDER BY rsr) + (count(*) OVER (PARTITION BY dataset_id, partner, rsr) - 1) / 2.0::DOUBLE AS rk FROM full_b")
cte("q_cor", f"""
SELECT query, subject, partner, CASE WHEN n * saa - sa * sa > 0 AND n * sbb - sb * sb > 0 THEN
{f10('(n * sxy - sa * sb) / (sqrt(n * saa - sa * sa) * sqrt(n * sbb - sb * sb))')} END AS scor
FROM (SELECT a.dataset_id AS query, b.dataset_id AS subject, b.partner, count(*)::DOUBLE AS n, sum(a.rk) AS sa, sum(b.rk) AS sb,
        sum(a.rk * a.rk) AS saa, sum(b.rk * b.rk) AS sbb, sum(a.rk * b.rk) AS sxy
      FROM col_rank a JOIN col_rank b ON a.gene = b.gene AND a.dataset_id <> b.dataset_id WHERE a.partner = {QG} GROUP BY ALL)""")


@query("k18_query_cor", "SELECT query, subject, partner, round(scor, 6) AS scor FROM q_cor WHERE query = 0")
def _(t):
    return rd(s.query_correlation(t.full_b, QG, t.genes_b, query=0), scor=6)


cte("q_auprc", auc_sql(f"(SELECT p.dataset_id AS query, l.dataset_id AS subject, l.partner, s, e, n FROM {pos_sql(f'(SELECT * FROM full_b WHERE partner = {QG})', 'dataset_id', 'rsr')} p JOIN top_cols l ON l.gene = p.gene AND l.dataset_id <> p.dataset_id)", "query, subject, partner"))


@query("k19_query_auprc", "SELECT query, subject, rank FROM (SELECT query, subject, partner, row_number() OVER (PARTITION BY query, subject ORDER BY auprc DESC NULLS LAST, partner) AS rank FROM q_auprc) WHERE partner = 10")
def _(t):
    return s.rank_of_match(s.query_auprc(t.full_b, QG, K), QG, "auprc")


@query("k20_query_topk_all", "SELECT query, subject, rank FROM (SELECT query, subject, partner, row_number() OVER (PARTITION BY query, subject ORDER BY overlap DESC, partner) AS rank FROM q_overlap) WHERE partner = 10 UNION ALL SELECT DISTINCT query, query, 1 FROM q_overlap")
def _(t):
    return s.with_diagonal(s.match_rank(s.query_overlap(t.full_b, QG, K), QG, "overlap", t.genes_b.first))


@query("k21_query_cor_all", "SELECT query, subject, rank FROM (SELECT query, subject, partner, row_number() OVER (PARTITION BY query, subject ORDER BY scor DESC NULLS LAST, partner) AS rank FROM q_cor) WHERE partner = 10 UNION ALL SELECT DISTINCT query, query, 1 FROM q_cor")
def _(t):
    return s.with_diagonal(s.rank_of_match(s.query_correlation(t.full_b, QG, t.genes_b), QG, "scor"))


# ---------------------------------------------------------------- Y

def summary_sql(source: str, key: str) -> str:
    parts = " UNION ALL ".join(f"SELECT species, {key}, '{x}' AS stat, CAST({x} AS DOUBLE) AS v FROM {source}" for x in s.STATS)
    return f"""SELECT species, {key}, stat, min(v) AS min, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, {f10('avg(v)')} AS mean,
quantile_cont(v, 0.75) AS q3, max(v) AS max FROM ({parts}) GROUP BY ALL"""


cte("n_exp", "SELECT species, tf, count(DISTINCT dataset_id) AS n_exp FROM profile GROUP BY ALL")
cte("summ_tf", f"SELECT * FROM ({summary_sql('sim_tf', 'tf')}) LEFT JOIN n_exp USING (species, tf)")
cte("summ_null", summary_sql("null_sim", "iter"))
SIX = ", ".join(f"round({x}, 6) AS {x}" for x in ("min", "q1", "median", "mean", "q3", "max"))


@query("y1_similarity_summary", f"SELECT species, tf, stat, n_exp, {SIX} FROM summ_tf")
def _(t):
    return round_six(t.summ_tf)


@query("y1_null_summary", f"SELECT species, iter, stat, {SIX} FROM summ_null")
def _(t):
    return round_six(t.summ_null)


@query("y2_family_filter", f"SELECT species, tf, stat, n_exp, family, round(mean, 6) AS mean FROM summ_tf JOIN tfs USING (tf) WHERE n_exp >= {MIN_EXP}")
def _(t):
    return rd(s.with_family(t.summ_tf, t.tfs, MIN_EXP).select("species", "tf", "stat", "n_exp", "family", "mean"), mean=6)


@query("y3_share_above_null", f"""
SELECT species, stat, count(*) FILTER (mean > nm) AS n_above, round(avg(CASE WHEN mean > nm THEN 1.0::DOUBLE ELSE 0 END), 6) AS share
FROM summ_tf JOIN (SELECT species, stat, max(mean) AS nm FROM summ_null GROUP BY ALL) USING (species, stat) WHERE n_exp >= {MIN_EXP} GROUP BY ALL""")
def _(t):
    return rd(s.share_above_null(t.summ_tf.filter(F.col("n_exp") >= MIN_EXP), t.summ_null), share=6)


cte("null_means", f"SELECT species, {f10('avg(mean) FILTER (stat = ' + chr(39) + 'topk' + chr(39) + ')')} AS nt, {f10('avg(mean) FILTER (stat = ' + chr(39) + 'bottomk' + chr(39) + ')')} AS nb FROM summ_null GROUP BY ALL")
cte("ov_means", "SELECT species, tf, max(mean) FILTER (stat = 'topk') AS topk, max(mean) FILTER (stat = 'bottomk') AS bottomk FROM summ_tf GROUP BY ALL")


@query("y4_divergent", """
SELECT species, count(*) FILTER (topk < nt) AS n_low_top, count(*) FILTER (bottomk > nb) AS n_high_bottom,
  count(*) FILTER (topk < nt AND bottomk > nb) AS n_divergent, round(avg(CASE WHEN topk < nt AND bottomk > nb THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_divergent,
  coalesce(string_agg(CASE WHEN topk < nt AND bottomk > nb THEN printf('%05d', tf) END, ', ' ORDER BY tf), '') AS tfs
FROM ov_means JOIN null_means USING (species) GROUP BY ALL""")
def _(t):
    return rd(s.divergent(t.summ_tf, t.summ_null), share_divergent=6)


@query("y5_overlap_ratios", """
SELECT species, tf, round(topk / nt, 6) AS topk_ratio, round(bottomk / nullif(nb, 0), 6) AS bottomk_ratio,
 round((topk / nt) / nullif(bottomk / nullif(nb, 0), 0), 6) AS odds, round(ln(nullif((topk / nt) / nullif(bottomk / nullif(nb, 0), 0), 0)), 6) AS log_odds
FROM ov_means JOIN null_means USING (species)""")
def _(t):
    return rd(s.overlap_ratios(t.summ_tf, t.summ_null), topk_ratio=6, bottomk_ratio=6, odds=6, log_odds=6)


@query("y6_most_similar_pairs", """
SELECT species, tf, col_a, col_b, topk FROM (SELECT *, rank() OVER (PARTITION BY species, tf ORDER BY topk DESC) AS pr FROM sim_tf
  WHERE (species, tf) IN (SELECT (species, tf) FROM (SELECT *, rank() OVER (PARTITION BY species ORDER BY max DESC) AS tr FROM summ_tf WHERE stat = 'topk') WHERE tr <= 3))
WHERE pr <= 3""")
def _(t):
    return s.most_similar_pairs(t.summ_tf, t.sim_tf)


cte("cross_means", f"""
SELECT id, h.stat, h.mean AS mean_hg, m.mean AS mean_mm, {f10('(h.mean + m.mean) / 2')} AS avg_mean
FROM summ_tf h JOIN ortho ON h.tf = gene_hg JOIN summ_tf m ON m.tf = gene_mm AND m.stat = h.stat
WHERE h.species = 'Human' AND m.species = 'Mouse' AND h.n_exp >= {MIN_EXP} AND m.n_exp >= {MIN_EXP}""")


@query("y7_cross_species_top", """
SELECT id, stat, round(mean_hg, 6) AS mean_hg, round(mean_mm, 6) AS mean_mm, round(avg_mean, 6) AS avg FROM
 (SELECT *, rank() OVER (PARTITION BY stat ORDER BY avg_mean DESC) AS i FROM cross_means) WHERE i <= 10""")
def _(t):
    both = s.cross_species_means(t.summ_tf, t.ortho, MIN_EXP)
    top = both.withColumn("_r", s.min_rank(["stat"], "avg")).filter("_r <= 10").drop("_r")
    return rd(top, mean_hg=6, mean_mm=6, avg=6)


@query("y8_cross_species_spearman", f"SELECT stat, round(spearman, 6) AS spearman, n FROM {spearman_sql('cross_means', 'stat', 'mean_hg', 'mean_mm')}")
def _(t):
    return rd(spearman(s.cross_species_means(t.summ_tf, t.ortho, MIN_EXP), ["stat"], "mean_hg", "mean_mm"), spearman=6)


@query("y9_family_summary", "SELECT species, stat, family, round(avg(mean), 6) AS mean, count(*) AS n_tfs, round(avg(n_exp), 6) AS mean_n_exp FROM summ_tf JOIN tfs USING (tf) GROUP BY ALL")
def _(t):
    return rd(s.family_summary(t.summ_tf, t.tfs), mean=6, mean_n_exp=6)
