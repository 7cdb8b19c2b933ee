"""Queries: curated labels and their recovery."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import fix10, rnd
from ..functions.sampling import permuted_sql
from ..functions.stats import rank_sum_test, six_numbers
from ..operators import labels as lb
from ..operators import rankings as r
from ..operators import recovery as a
from .catalog import query
from .fixtures import K, MIN_TARGETS, N_DRAWS, SEED, f10
from .oracle import cte
from .q_core import rank_sum_sql, round_six, rounded_test, six_sql
from .q_profiles import auc_sql, pos_sql, rd


# ---------------------------------------------------------------- L

EXPERIMENT = "CASE p_partkey % 5 WHEN 0 THEN 'ChIP-seq' WHEN 1 THEN 'Reporter assay (Luciferase)' WHEN 2 THEN 'siRNA Perturbation, then binding' WHEN 3 THEN 'Chromatin binding assay' END"
SOURCES = "CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Survey;Other' ELSE p_type END"
cte("records_1", f"""
SELECT p_partkey AS record_id, 'GN' || (1 + p_partkey % 50) AS tf, 'GN' || p_size AS target,
  CASE WHEN p_partkey % 2 = 0 THEN 'human' ELSE 'mouse' END AS species_name, {EXPERIMENT} AS experiment, {SOURCES} AS source_list
FROM part""")
cte("records_2", "SELECT p_partkey AS record_id, 'GN' || (1 + p_partkey % 50) AS tf, p_name AS cell_type, CAST(10000000 + p_partkey AS VARCHAR) AS pubmed FROM part")
cte("records_3", """
SELECT p_partkey AS record_id, CASE WHEN p_partkey % 2 = 0 THEN 'GN' ELSE 'Gn' END || (1 + p_partkey % 47) AS tf,
  CASE WHEN p_partkey % 2 = 0 THEN 'GN' ELSE 'Gn' END || p_size AS target, p_name AS cell_type FROM part""")
cte("built_1", "SELECT record_id, tf AS tf_symbol, target AS target_symbol, upper(species_name[1]) || lower(species_name[2:]) AS tf_species, experiment AS experiment_type, source_list AS databases, 'Resource' AS source FROM records_1")


@query("l1_build_table", "SELECT * FROM built_1")
def _(t):
    return lb.build_table(t.records_1, "Resource")


cte("joined_rec", "SELECT b.*, r.cell_type, r.pubmed FROM built_1 b LEFT JOIN records_2 r ON r.record_id = b.record_id")


@query("l2_join_records", "SELECT * FROM joined_rec")
def _(t):
    return lb.join_records(lb.build_table(t.records_1, "Resource"), t.records_2)


cte("tf_names", "SELECT upper(symbol) AS symbol FROM gene_ref WHERE gene % 5 <> 4 GROUP BY ALL")
cte("known_rec", "SELECT * FROM joined_rec WHERE tf_symbol IN (SELECT symbol FROM tf_names) AND target_symbol IN (SELECT upper(symbol) FROM gene_ref)")


@query("l3_known_genes", "SELECT record_id, tf_symbol, target_symbol FROM known_rec")
def _(t):
    joined = lb.join_records(lb.build_table(t.records_1, "Resource"), t.records_2)
    return lb.known_genes(joined, t.tf_names, t.gene_ref).select("record_id", "tf_symbol", "target_symbol")


cte("cased_rec", """
SELECT record_id, CASE WHEN tf_species = 'Mouse' THEN upper(tf_symbol[1]) || lower(tf_symbol[2:]) ELSE tf_symbol END AS tf_symbol,
 CASE WHEN tf_species = 'Mouse' THEN upper(target_symbol[1]) || lower(target_symbol[2:]) ELSE target_symbol END AS target_symbol,
 tf_species, experiment_type, source, databases FROM known_rec""")


def cased(t):
    joined = lb.join_records(lb.build_table(t.records_1, "Resource"), t.records_2)
    return lb.species_casing(lb.known_genes(joined, t.tf_names, t.gene_ref))


@query("l4_species_casing", "SELECT record_id, tf_symbol, target_symbol, tf_species FROM cased_rec")
def _(t):
    return cased(t).select("record_id", "tf_symbol", "target_symbol", "tf_species")


cte("inferred_rec", """
SELECT record_id, tf AS tf_symbol, target AS target_symbol, CASE WHEN tf IN (SELECT symbol FROM gene_ref WHERE species = 'Human') THEN 'Human' ELSE 'Mouse' END AS tf_species,
 CAST(NULL AS VARCHAR) AS experiment_type, 'Survey' AS source, 'Survey' AS databases FROM records_3""")


@query("l5_infer_species", "SELECT record_id, tf_symbol, target_symbol, tf_species FROM inferred_rec")
def _(t):
    return lb.infer_species(t.records_3, t.gene_ref, "Survey").select("record_id", "tf_symbol", "target_symbol", "tf_species")


EXCLUDED = ["GN1", "GN2", "GN3"]
cte("all_rec", f"""
SELECT * FROM (SELECT * FROM cased_rec UNION ALL SELECT * FROM inferred_rec)
WHERE NOT (tf_symbol = 'GN6' AND NOT coalesce(contains(databases, 'Survey'), false) AND upper(target_symbol) <> 'GN6')
  AND NOT (upper(tf_symbol) = 'GN6' AND upper(target_symbol) IN {tuple(EXCLUDED)})""")


def appended(t):
    return lb.append_and_exclude(cased(t), lb.infer_species(t.records_3, t.gene_ref, "Survey"), "GN6", "Survey", EXCLUDED)


@query("l6_append_and_exclude", "SELECT record_id, tf_symbol, target_symbol, tf_species, source FROM all_rec")
def _(t):
    return appended(t).select("record_id", "tf_symbol", "target_symbol", "tf_species", "source")


@query("l7_experiment_class", """
SELECT record_id, source, CASE WHEN regexp_matches(lower(experiment_type), '.*perturbation,*') THEN 'Perturbation' WHEN regexp_matches(lower(experiment_type), '.*binding*') THEN 'Binding'
 WHEN regexp_matches(lower(experiment_type), '.*reporter*') THEN 'Reporter' ELSE 'NA' END AS experiment_class FROM all_rec""")
def _(t):
    return lb.experiment_class(appended(t)).select("record_id", "source", "experiment_class")


cte("targets_per_tf", "SELECT upper(tf_symbol) AS tf, count(DISTINCT upper(target_symbol)) AS n_targets FROM all_rec GROUP BY ALL HAVING count(DISTINCT upper(target_symbol)) >= 5")


@query("l8_targets_per_tf", "SELECT tf, n_targets FROM targets_per_tf")
def _(t):
    return lb.targets_per_tf(appended(t), 5)


@query("l8_label_counts", f"SELECT count(*) AS n_tfs, CAST(sum(n_targets) AS BIGINT) AS n_pairs, {six_sql('n_targets::DOUBLE')} FROM targets_per_tf")
def _(t):
    out = lb.targets_per_tf(appended(t), 5).agg(F.count(F.lit(1)).alias("n_tfs"), F.sum("n_targets").alias("n_pairs"), *six_numbers("n_targets"))
    return round_six(out)


@query("l9_targets_without_ortholog", "SELECT DISTINCT target_symbol FROM all_rec WHERE target_symbol NOT IN (SELECT symbol_hg FROM ortho) AND target_symbol NOT IN (SELECT symbol_mm FROM ortho)")
def _(t):
    return lb.without_ortholog(appended(t), t.ortho)


cte("curated_sym", """
SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'GN' ELSE 'Gn' END || (1 + p_partkey % 50) AS tf_symbol,
  CASE WHEN p_partkey % 2 = 0 THEN 'GN' ELSE 'Gn' END || p_size AS target_symbol FROM part""")
cte("lab_names", """
SELECT species, gene AS tf, upper(symbol) AS name FROM gene_ref
UNION SELECT g.species, g.gene, upper(o.symbol_hg) FROM gene_ref g JOIN ortho o ON g.symbol IN (o.symbol_hg, o.symbol_mm)
UNION SELECT g.species, g.gene, upper(o.symbol_mm) FROM gene_ref g JOIN ortho o ON g.symbol IN (o.symbol_hg, o.symbol_mm)""")
cte("lab_rows", """
SELECT DISTINCT n.species, n.tf, g.gene FROM lab_names n JOIN curated_sym c ON upper(c.tf_symbol) = n.name
JOIN gene_ref g ON g.species = n.species AND upper(g.symbol) = upper(c.target_symbol)
WHERE NOT EXISTS (SELECT 1 FROM lab_names s WHERE s.species = n.species AND s.tf = n.tf AND s.name = upper(c.target_symbol))""")


@query("l10_curated_labels", "SELECT species, tf, gene FROM lab_rows")
def _(t):
    return t.labels


def universe_sql(column: str, present: str) -> str:
    return f"""SELECT species, gene FROM gene_ref SEMI JOIN {present} USING (species, gene) WHERE upper(symbol) IN (SELECT upper({column}) FROM curated_sym)
UNION SELECT g.species, g.gene FROM gene_ref g SEMI JOIN {present} USING (species, gene) JOIN ortho o ON g.symbol IN (o.symbol_hg, o.symbol_mm)
WHERE upper(o.symbol_hg) IN (SELECT upper({column}) FROM curated_sym) OR upper(o.symbol_mm) IN (SELECT upper({column}) FROM curated_sym)"""


cte("target_universe", universe_sql("target_symbol", "(SELECT DISTINCT species, gene FROM rank_tf)"))


@query("l11_target_universe", "SELECT species, gene FROM target_universe")
def _(t):
    return t.universe


@query("l11_eligible_tfs", universe_sql("tf_symbol", "(SELECT DISTINCT species, tf AS gene FROM rank_tf)"))
def _(t):
    present = t.rank_tf.select("species", F.col("tf").alias("gene")).distinct()
    return a.eligible_universe(t.curated_sym, "tf_symbol", present, t.gene_ref, t.ortho)


# ---------------------------------------------------------------- A1-A3 on scored documents

cte("doc_scores", "SELECT lang, doc_id AS gene, n_chars::DOUBLE AS score, quality = 1 AS label FROM documents JOIN labels USING (doc_id)")


@query("a1_performance_curves", """
SELECT lang, cutoff, round(tp / nullif(p, 0), 6) AS tpr, round(fp / nullif(n, 0), 6) AS fpr, round(tp / nullif(tp + fp, 0), 6) AS precision FROM (
 SELECT lang, cutoff, sum(ps) OVER w AS tp, sum(ns) OVER w AS fp, sum(ps) OVER (PARTITION BY lang) AS p, sum(ns) OVER (PARTITION BY lang) AS n FROM (
  SELECT lang, score AS cutoff, count(*) FILTER (label)::DOUBLE AS ps, count(*) FILTER (NOT label)::DOUBLE AS ns FROM doc_scores GROUP BY ALL)
 WINDOW w AS (PARTITION BY lang ORDER BY cutoff DESC)
 UNION ALL SELECT lang, NULL, 0, 0, count(*) FILTER (label), count(*) FILTER (NOT label) FROM doc_scores GROUP BY ALL)""")
def _(t):
    return rd(a.curve(t.doc_scores, ["lang"], "score", "label"), tpr=6, fpr=6, precision=6)


cte("doc_auc", auc_sql(f"(SELECT p.lang, s, e, n FROM {pos_sql('doc_scores', 'lang', 'score')} p JOIN doc_scores d ON d.gene = p.gene WHERE d.label)", "lang"))
LANGS = "(SELECT DISTINCT lang FROM doc_scores) LEFT JOIN doc_auc USING (lang)"


@query("a2_auroc", f"SELECT lang, n_targets, round(auroc, 6) AS auroc FROM {LANGS}")
def _(t):
    return rd(a.auc(t.doc_scores, ["lang"], "score", "label"), auroc=6).drop("auprc")


@query("a3_auprc", f"SELECT lang, n_targets, round(auprc, 6) AS auprc FROM {LANGS}")
def _(t):
    return rd(a.auc(t.doc_scores, ["lang"], "score", "label"), auprc=6).drop("auroc")


# ---------------------------------------------------------------- A4-A8 on regulators

def score_ctes(tag: str, sql: str) -> None:
    """Observed areas, null areas and the recovery table of one score."""
    cte(f"score_{tag}", sql)
    cte(f"pos_{tag}", f"SELECT * FROM {pos_sql(f'(SELECT * FROM score_{tag} WHERE gene <> tf)', 'species, tf', 'score')}")
    cte(f"hit_{tag}", f"SELECT p.* FROM pos_{tag} p SEMI JOIN lab_rows USING (species, tf, gene)")
    cte(f"obs_{tag}", auc_sql(f"hit_{tag}", "species, tf"))
    cte(f"null_{tag}", auc_sql(f"""(
SELECT p.species, p.tf, d.iter, p.s, p.e, p.n FROM
 (SELECT h.species, h.tf, o.iter, o.gene, row_number() OVER (PARTITION BY h.species, h.tf, o.iter ORDER BY o.pos_at) AS i, h.nt
  FROM (SELECT species, tf, count(*) AS nt FROM hit_{tag} GROUP BY ALL) h JOIN shuffled_universe o ON o.species = h.species AND o.gene <> h.tf) d
 JOIN pos_{tag} p ON p.species = d.species AND p.tf = d.tf AND p.gene = d.gene WHERE d.i <= d.nt)""", "species, tf, iter"))
    cte(f"recovery_{tag}", f"""
SELECT o.species, o.tf, o.n_targets, o.auprc, qp AS auprc_quantile, o.auprc - mp AS auprc_diff, o.auroc, qr AS auroc_quantile, o.auroc - mr AS auroc_diff
FROM obs_{tag} o LEFT JOIN (SELECT n.species, n.tf, avg(CASE WHEN n.auprc <= o.auprc THEN 1.0::DOUBLE WHEN n.auprc > o.auprc THEN 0 END) AS qp, quantile_cont(n.auprc, 0.5) AS mp,
  avg(CASE WHEN n.auroc <= o.auroc THEN 1.0::DOUBLE WHEN n.auroc > o.auroc THEN 0 END) AS qr, quantile_cont(n.auroc, 0.5) AS mr
  FROM null_{tag} n JOIN obs_{tag} o ON o.species = n.species AND o.tf = n.tf GROUP BY ALL) q ON q.species = o.species AND q.tf = o.tf""")


cte("shuffled_universe", "SELECT o.species, CAST(o.iter AS INTEGER) AS iter, u.gene, o.place + 1 AS pos_at FROM (" + permuted_sql(
    f"SELECT species, iter, n, unnest(range(0, n)) AS place FROM (SELECT species, count(*) AS n FROM target_universe GROUP BY ALL), (SELECT unnest(range(1, {N_DRAWS} + 1)) AS iter)",
    "place", "n", SEED, "species, iter", 50) + """) o
JOIN (SELECT species, gene, row_number() OVER (PARTITION BY species ORDER BY gene) - 1 AS i FROM target_universe) u ON u.species = o.species AND u.i = o.x""")
score_ctes("coexpr", "SELECT species, tf, gene, avg_aggr_coexpr AS score FROM rank_tf")
score_ctes("reverse", "SELECT species, tf, gene, -avg_aggr_coexpr AS score FROM rank_tf")
score_ctes("bind", "SELECT species, tf, gene, bind_score AS score FROM rank_all")
score_ctes("integrated", "SELECT species, tf, gene, -rank_integrated AS score FROM rank_all")
REC = "n_targets, " + ", ".join(f"round({m}, 6) AS {m}" for m in a.MEASURES)


def r_rec(df):
    return df.withColumns({m: rnd(m, 6) for m in a.MEASURES})


@query("a4_null_performance", "SELECT species, tf, iter, n_targets, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM null_coexpr")
def _(t):
    return rd(t.null_auc("coexpr"), auroc=6, auprc=6)


@query("a5_obs_against_null", f"SELECT species, tf, {REC} FROM recovery_bind")
def _(t):
    return r_rec(a.compare_to_null(a.observed_auc(t.scores("bind"), t.labels), t.null_auc("bind")))


@query("a6_recovery_table", f"SELECT species, tf, {REC} FROM recovery_coexpr")
def _(t):
    return r_rec(a.recovery_table(t.scores("coexpr"), t.labels, t.universe, N_DRAWS, SEED))


cte("col_auc", auc_sql(f"(SELECT p.* FROM {pos_sql('(SELECT * FROM profile WHERE gene <> tf)', 'species, tf, dataset_id', 'score')} p SEMI JOIN lab_rows USING (species, tf, gene))", "species, tf, dataset_id"))


@query("a7_column_auc", "SELECT species, tf, dataset_id, n_targets, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM col_auc")
def _(t):
    return rd(a.column_auc(t.profile, t.labels), auroc=6, auprc=6)


cte("with_avg", "SELECT species, tf, CAST(dataset_id AS VARCHAR) AS dataset_id, gene, score FROM imputed UNION ALL SELECT species, tf, 'Avg', gene, score FROM avg_profile")
cte("avg_auc", auc_sql(f"(SELECT p.* FROM {pos_sql('(SELECT * FROM with_avg WHERE gene <> tf)', 'species, tf, dataset_id', 'score')} p SEMI JOIN lab_rows USING (species, tf, gene))", "species, tf, dataset_id"))


@query("a8_average_against_single", """
SELECT i.species, i.tf, v.n_targets, round(v.auprc, 6) AS avg_auprc, round(v.auroc, 6) AS avg_auroc, count(*) AS n_datasets,
 round(avg(CASE WHEN i.auprc <= v.auprc THEN 1.0::DOUBLE ELSE 0 END), 6) AS auprc_quantile, round(avg(CASE WHEN i.auroc <= v.auroc THEN 1.0::DOUBLE ELSE 0 END), 6) AS auroc_quantile
FROM avg_auc i JOIN avg_auc v ON v.species = i.species AND v.tf = i.tf AND v.dataset_id = 'Avg' WHERE i.dataset_id <> 'Avg'
GROUP BY i.species, i.tf, v.n_targets, v.auprc, v.auroc""")
def _(t):
    return rd(a.average_against_single(r.with_average(t.imputed), t.labels), avg_auprc=6, avg_auroc=6, auprc_quantile=6, auroc_quantile=6)


@query("a9_split_bind_matrix", "SELECT tf, gene, bind_score AS score FROM bind")
def _(t):
    return a.nonzero_scores(t.bind)


# ---------------------------------------------------------------- A10-A21 summaries

SOURCES = ("coexpr", "bind", "integrated", "reverse")


def wide_sql(*tags: str) -> str:
    cols = ", ".join(f"r_{t}.{m} AS {m}_{t}" for t in tags for m in a.MEASURES)
    joins = " ".join(
        f"LEFT JOIN recovery_{t} r_{t} ON r_{t}.species = r_{tags[0]}.species AND r_{t}.tf = r_{tags[0]}.tf AND r_{t}.n_targets = r_{tags[0]}.n_targets" for t in tags[1:]
    )
    return f"SELECT r_{tags[0]}.species, r_{tags[0]}.tf, r_{tags[0]}.n_targets, {cols} FROM recovery_{tags[0]} r_{tags[0]} {joins} WHERE r_{tags[0]}.n_targets >= {MIN_TARGETS}"


cte("wide_auc", wide_sql(*SOURCES))
QCOLS = [f"{m}_quantile_{s}" for m in ("auprc", "auroc") for s in ("coexpr", "bind")]


@query("a10_extreme_shares", "SELECT species, stat, count(*) AS n, round(avg(CASE WHEN v = 1 THEN 1.0::DOUBLE ELSE 0 END), 3) AS eq1, round(avg(CASE WHEN v > 0.9 THEN 1.0::DOUBLE ELSE 0 END), 3) AS gt_upper, round(avg(CASE WHEN v < 0.1 THEN 1.0::DOUBLE ELSE 0 END), 3) AS lt_lower FROM ("
       + " UNION ALL ".join(f"SELECT species, '{c}' AS stat, {c} AS v FROM wide_auc" for c in QCOLS) + ") WHERE v IS NOT NULL GROUP BY ALL")
def _(t):
    return a.extreme_shares(t.wide_auc, ["species"], QCOLS)


@query("a11_join_sources", "SELECT species, tf, n_targets, round(auprc_coexpr, 6) AS auprc_coexpr, round(auroc_coexpr, 6) AS auroc_coexpr, round(auprc_bind, 6) AS auprc_bind, round(auroc_bind, 6) AS auroc_bind FROM wide_auc")
def _(t):
    out = a.join_sources(("coexpr", t.recovery("coexpr")), ("bind", t.recovery("bind")), min_targets=MIN_TARGETS)
    return rd(out.select("species", "tf", "n_targets", "auprc_coexpr", "auroc_coexpr", "auprc_bind", "auroc_bind"), auprc_coexpr=6, auroc_coexpr=6, auprc_bind=6, auroc_bind=6)


@query("a12_deltas", "SELECT species, tf, " + ", ".join(f"round({m}_coexpr - {m}_bind, 6) AS delta_{m}" for m in ("auprc", "auroc", "auprc_diff", "auroc_diff")) + " FROM wide_auc")
def _(t):
    return rd(a.deltas(t.wide_auc, "coexpr", "bind"), delta_auprc=6, delta_auroc=6, delta_auprc_diff=6, delta_auroc_diff=6)


def flags_sql(x: str, y: str) -> str:
    def either(cx: str, cy: str) -> str:
        return " OR ".join(f"coalesce({m}_quantile_{x} {cx} AND {m}_quantile_{y} {cy}, false)" for m in ("auprc", "auroc"))

    return f"SELECT species, tf, ({either('> 0.9', '> 0.9')}) AS both, ({either('> 0.9', '< 0.5')}) AS only_{x}, ({either('< 0.5', '> 0.9')}) AS only_{y} FROM wide_auc"


cte("perf_flags", flags_sql("coexpr", "bind"))


@query("a13_performance_slices", "SELECT * FROM perf_flags")
def _(t):
    return a.performance_class(t.wide_auc, "coexpr", "bind")


@query("a13_reverse_slices", flags_sql("reverse", "coexpr"))
def _(t):
    return a.performance_class(t.wide_auc, "reverse", "coexpr")


@query("a14_ortholog_share", """
SELECT species, count(*) FILTER (only_bind) AS n_flag, max(nb) AS n_both, round(max(nb)::DOUBLE / nullif(count(*) FILTER (only_bind), 0), 6) AS share
FROM perf_flags, (SELECT count(*) AS nb FROM ortho WHERE gene_hg IN (SELECT tf FROM perf_flags WHERE species = 'Human' AND only_bind)
  AND gene_mm IN (SELECT tf FROM perf_flags WHERE species = 'Mouse' AND only_bind)) GROUP BY ALL""")
def _(t):
    return rd(a.ortholog_share(a.performance_class(t.wide_auc, "coexpr", "bind"), "only_bind", t.ortho), share=6)


@query("a15_null_summary", f"SELECT species, tf, {six_sql('auroc')} FROM null_coexpr SEMI JOIN wide_auc USING (species, tf) GROUP BY ALL")
def _(t):
    return round_six(a.null_summary(t.null_auc("coexpr"), t.wide_auc)).orderBy(F.col("median").desc())


@query("a16_generic_check", """
SELECT species, tf, round(auroc_coexpr, 6) AS auroc FROM (SELECT *, rank() OVER (PARTITION BY species ORDER BY auroc_coexpr DESC) AS i FROM wide_auc
WHERE auroc_quantile_coexpr < 0.5 AND auroc_coexpr > 0.5) WHERE i = 1""")
def _(t):
    return rd(a.generic_check(t.wide_auc, "coexpr"), auroc=6)


@query("a16_generic_check_wide", """
SELECT species, tf, round(auroc_coexpr, 6) AS auroc FROM (SELECT *, rank() OVER (PARTITION BY species ORDER BY auroc_coexpr DESC) AS i FROM wide_auc
WHERE auroc_quantile_coexpr < 0.75 AND auroc_coexpr > 0.25) WHERE i = 1""")
def _(t):
    # no regulator of this data is generic by the strict limits
    return rd(a.generic_check(t.wide_auc, "coexpr", below=0.75, above=0.25), auroc=6)


@query("a17_reverse_join", f"SELECT r.species, r.tf, r.n_targets, round(r.auroc, 6) AS auroc_reverse, round(c.auroc, 6) AS auroc_coexpr FROM recovery_reverse r LEFT JOIN recovery_coexpr c USING (species, tf, n_targets) WHERE r.n_targets >= {MIN_TARGETS}")
def _(t):
    out = a.join_sources(("reverse", t.recovery("reverse")), ("coexpr", t.recovery("coexpr")), min_targets=MIN_TARGETS)
    return rd(out.select("species", "tf", "n_targets", "auroc_reverse", "auroc_coexpr"), auroc_reverse=6, auroc_coexpr=6)


@query("a18_label_ranks", f"SELECT species, tf, count(*) AS n, count(*) FILTER (rank_aggr_coexpr <= {K}) AS n_coexpr, count(*) FILTER (rank_bind <= {K}) AS n_bind FROM rank_all SEMI JOIN lab_rows USING (species, tf, gene) GROUP BY ALL")
def _(t):
    return a.label_ranks(t.rank_all, t.labels, K)


@query("a19_performance_export", "SELECT species, tf, n_targets, " + ", ".join(f"round({m}_{s}, 6) AS {m}_{s}" for s in SOURCES for m in a.MEASURES) + " FROM wide_auc")
def _(t):
    cols = [f"{m}_{s}" for s in SOURCES for m in a.MEASURES]
    return t.wide_auc.withColumns({c: rnd(c, 6) for c in cols})


def stack_sql(measure: str, tags: tuple[str, ...]) -> str:
    return "(" + " UNION ALL ".join(f"SELECT species, tf, '{s}' AS source, {measure}_{s} AS value FROM wide_auc" for s in tags) + ")"


_tests = [(m, s) for m in ("auprc", "auroc") for s in ("coexpr", "bind")]


@query("a20_test_integrated", " UNION ALL ".join(
    f"SELECT '{m}_{s}' AS test, * FROM (" + rank_sum_sql(f"(SELECT species, {f10('value')} AS value, source = 'integrated' AS first FROM {stack_sql(m, ('integrated', s))})", "species", "value", "first") + ")"
    for m, s in _tests))
def _(t):
    rows = None
    for m, s in _tests:
        one = a.stacked(t.wide_auc, m, ["integrated", s]).select("species", fix10("value").alias("value"), (F.col("source") == "integrated").alias("first"), F.lit(f"{m}_{s}").alias("test"))
        rows = one if rows is None else rows.unionByName(one)
    return rounded_test(rank_sum_test(rows, ["test", "species"], "value", "first"))


@query("a21_median_by_source", f"SELECT species, source, round(quantile_cont(value, 0.5), 6) AS median FROM {stack_sql('auroc', SOURCES)} GROUP BY ALL")
def _(t):
    long = a.stacked(t.wide_auc, "auroc", list(SOURCES))
    return rd(long.groupBy("species", "source").agg(F.percentile("value", F.lit(0.5)).alias("median")), median=6)
