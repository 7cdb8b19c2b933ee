"""Queries: integrated evidence and tiers."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import integrate as n
from .catalog import query
from .fixtures import TIER_K as K
from .oracle import cte
from .q_core import round_six, six_sql
from .q_profiles import rd, top_sql

cte("bind_all", """
SELECT 'Human' AS species, tf, gene, bind_score FROM bind
UNION ALL SELECT 'Mouse', tf, gene, bind_score FROM (SELECT CAST(1 + (p_partkey * 7) % 50 AS INTEGER) AS tf, p_size AS gene, round(avg(p_retailprice), 2) AS bind_score FROM part GROUP BY ALL) WHERE tf % 3 <> 0""")


def bind_rank_sql(part: str, score: str, item: str) -> str:
    return f"""CASE WHEN {score} IS NOT NULL THEN count(*) OVER (PARTITION BY {part} ORDER BY {score} DESC NULLS LAST)
 ELSE row_number() OVER (PARTITION BY {part} ORDER BY {score} DESC NULLS LAST, {item}) END"""


cte("rank_all", f"""
SELECT *, CASE WHEN rank_aggr_coexpr * rank_bind IS NOT NULL THEN rank() OVER (PARTITION BY species, tf ORDER BY rank_aggr_coexpr * rank_bind NULLS LAST) END AS rank_integrated
FROM (SELECT *, {bind_rank_sql('species, tf', 'bind_score', 'gene')} AS rank_bind FROM (
  SELECT r.*, g.gene IS NOT NULL AS bind_measured, CASE WHEN g.gene IS NOT NULL THEN coalesce(b.bind_score, 0) END AS bind_score
  FROM (SELECT * FROM rank_tf SEMI JOIN (SELECT DISTINCT species, tf FROM bind_all) USING (species, tf)) r
  LEFT JOIN (SELECT DISTINCT species, gene FROM bind_all) g ON g.species = r.species AND g.gene = r.gene
  LEFT JOIN bind_all b ON b.species = r.species AND b.tf = r.tf AND b.gene = r.gene))""")


@query("i1_join_binding", "SELECT species, tf, gene, rank_integrated, rank_aggr_coexpr, rank_bind, round(bind_score, 2) AS bind_score, bind_measured FROM rank_all")
def _(t):
    cols = ["species", "tf", "gene", "rank_integrated", "rank_aggr_coexpr", "rank_bind", "bind_score", "bind_measured"]
    return rd(t.rank_all.select(*cols), bind_score=2)


def ev_side(tag: str, species: str) -> str:
    return f"(SELECT ot.id AS tf_id, og.id, og.gene_hg, og.gene_mm, avg_aggr_coexpr, bind_score FROM rank_all r JOIN ortho ot ON r.tf = ot.gene_{tag} JOIN ortho og ON r.gene = og.gene_{tag} WHERE r.species = '{species}')"


def mr(v: str) -> str:
    return f"CASE WHEN {v} IS NOT NULL THEN rank() OVER (PARTITION BY tf_id ORDER BY {v} DESC NULLS LAST) END"


cte("evid", f"""
SELECT h.tf_id, h.id, h.gene_hg, h.gene_mm, h.avg_aggr_coexpr AS avg_aggr_coexpr_hg, h.bind_score AS bind_score_hg,
  m.avg_aggr_coexpr AS avg_aggr_coexpr_mm, m.bind_score AS bind_score_mm
FROM {ev_side('hg', 'Human')} h LEFT JOIN {ev_side('mm', 'Mouse')} m ON m.tf_id = h.tf_id AND m.id = h.id
WHERE h.tf_id IN (SELECT tf_id FROM {ev_side('mm', 'Mouse')})""")


def evidence_sql(op: str) -> str:
    s = op.join(f" {c} " for c in n.RANKS4)
    return f"""SELECT *, CASE WHEN {s} IS NOT NULL THEN rank() OVER (PARTITION BY tf_id ORDER BY {s} NULLS LAST) END AS rank_integrated FROM (
SELECT *, {mr('avg_aggr_coexpr_hg')} AS rank_aggr_coexpr_hg, {mr('avg_aggr_coexpr_mm')} AS rank_aggr_coexpr_mm,
 {bind_rank_sql('tf_id', 'bind_score_hg', 'gene_hg')} AS rank_bind_hg, {bind_rank_sql('tf_id', 'bind_score_mm', 'gene_hg')} AS rank_bind_mm FROM evid)"""


cte("evidence", evidence_sql("+"))
EV = "tf_id, id, rank_integrated, rank_aggr_coexpr_hg, rank_aggr_coexpr_mm, rank_bind_hg, rank_bind_mm"
EV_COLS = [c.strip() for c in EV.split(",")]


@query("i2_ortholog_evidence", f"SELECT {EV} FROM evidence")
def _(t):
    return t.evidence.select(*EV_COLS)


@query("i2_rank_product", f"SELECT {EV} FROM ({evidence_sql('*')})")
def _(t):
    return n.ortholog_evidence(t.rank_all, t.ortho, "product").select(*EV_COLS)


def k_sql(src: str, keys: str, value: str, name: str) -> str:
    return f"(SELECT {keys}, max(k_eff) AS {name} FROM {top_sql(f'(SELECT *, 0 AS g0 FROM {src})'.replace('0 AS g0', '0 AS zero'), keys, value, K)} GROUP BY ALL)"


def ev_k(value: str, name: str) -> str:
    return k_sql("(SELECT tf_id, gene_hg AS gene, " + value + " FROM evidence)", "tf_id", value, name)


cte("cuts", f"""
SELECT e.*, rank_aggr_coexpr_hg <= k1 AS cut_coexpr_hg, rank_aggr_coexpr_mm <= k2 AS cut_coexpr_mm, rank_bind_hg <= k3 AS cut_bind_hg, rank_bind_mm <= k4 AS cut_bind_mm
FROM evidence e LEFT JOIN {ev_k('avg_aggr_coexpr_hg', 'k1')} USING (tf_id) LEFT JOIN {ev_k('avg_aggr_coexpr_mm', 'k2')} USING (tf_id)
LEFT JOIN {ev_k('bind_score_hg', 'k3')} USING (tf_id) LEFT JOIN {ev_k('bind_score_mm', 'k4')} USING (tf_id)""")


@query("i3_cutoffs", "SELECT tf_id, id, cut_coexpr_hg, cut_coexpr_mm, cut_bind_hg, cut_bind_mm FROM cuts")
def _(t):
    return n.ortholog_cutoffs(t.evidence, K).select("tf_id", "id", "cut_coexpr_hg", "cut_coexpr_mm", "cut_bind_hg", "cut_bind_mm")


N_CUT = "(cut_coexpr_hg::INT + cut_coexpr_mm::INT + cut_bind_hg::INT + cut_bind_mm::INT)"
cte("repro", f"SELECT *, CASE WHEN {N_CUT} = 4 THEN 'Stringent' ELSE 'Elevated' END AS tier FROM cuts WHERE {N_CUT} >= 3")
cte("one_sp", f"""
SELECT r.* FROM rank_all r JOIN {k_sql('(SELECT species, tf, gene, avg_aggr_coexpr FROM rank_all)', 'species, tf', 'avg_aggr_coexpr', 'kc')} USING (species, tf)
JOIN {k_sql('(SELECT species, tf, gene, bind_score FROM rank_all)', 'species, tf', 'bind_score', 'kb')} USING (species, tf)
WHERE rank_aggr_coexpr <= kc AND rank_bind <= kb""")
cte("elig_tf", """
SELECT tf_id, bool_or(hg) AS has_hg, bool_or(mm) AS has_mm, bool_or(hg) AND bool_or(mm) AS has_ortho FROM (
 SELECT o.id AS tf_id, true AS hg, false AS mm FROM ortho o JOIN (SELECT DISTINCT tf FROM rank_all WHERE species = 'Human') r ON r.tf = o.gene_hg
 UNION ALL SELECT o.id, false, true FROM ortho o JOIN (SELECT DISTINCT tf FROM rank_all WHERE species = 'Mouse') r ON r.tf = o.gene_mm) GROUP BY ALL""")
NI = "CAST(NULL AS BIGINT)"
cte("tier_hg", f"SELECT o.id AS tf_id, r.gene AS gene_hg, CAST(NULL AS INTEGER) AS gene_mm, rank_integrated, rank_aggr_coexpr AS rank_aggr_coexpr_hg, {NI} AS rank_aggr_coexpr_mm, rank_bind AS rank_bind_hg, {NI} AS rank_bind_mm FROM one_sp r JOIN ortho o ON r.tf = o.gene_hg WHERE r.species = 'Human'")
cte("tier_mm", f"SELECT o.id AS tf_id, CAST(NULL AS INTEGER) AS gene_hg, r.gene AS gene_mm, rank_integrated, {NI} AS rank_aggr_coexpr_hg, rank_aggr_coexpr AS rank_aggr_coexpr_mm, {NI} AS rank_bind_hg, rank_bind AS rank_bind_mm FROM one_sp r JOIN ortho o ON r.tf = o.gene_mm WHERE r.species = 'Mouse'")
ELIG = "(SELECT tf_id FROM elig_tf WHERE has_ortho)"
cte("spec_hg", f"SELECT * FROM tier_hg WHERE tf_id IN {ELIG} AND (tf_id, gene_hg) NOT IN (SELECT (tf_id, gene_hg) FROM repro)")
cte("spec_mm", f"SELECT * FROM tier_mm WHERE tf_id IN {ELIG} AND (tf_id, gene_mm) NOT IN (SELECT (tf_id, gene_mm) FROM repro)")
TC = "tf_id, gene_hg, gene_mm, rank_integrated, rank_aggr_coexpr_hg, rank_aggr_coexpr_mm, rank_bind_hg, rank_bind_mm"
cte("tier_rows", f"""
SELECT {TC}, tier FROM repro UNION ALL SELECT {TC}, 'Human' FROM tier_hg UNION ALL SELECT {TC}, 'Mouse' FROM tier_mm
UNION ALL SELECT {TC}, 'Human_specific' FROM spec_hg UNION ALL SELECT {TC}, 'Mouse_specific' FROM spec_mm
UNION ALL SELECT {TC}, 'Mixed' FROM cuts WHERE ((cut_coexpr_hg AND cut_bind_mm) OR (cut_coexpr_mm AND cut_bind_hg))
 AND (tf_id, gene_hg) NOT IN (SELECT (tf_id, gene_hg) FROM repro) AND (tf_id, gene_hg) NOT IN (SELECT (tf_id, gene_hg) FROM spec_hg)
 AND (tf_id, gene_mm) NOT IN (SELECT (tf_id, gene_mm) FROM spec_mm)""")


def tier_query(name: str, tier: str) -> None:
    @query(name, f"SELECT {TC} FROM tier_rows WHERE tier = '{tier}'")
    def _(t):
        return n.one_tier(t.tiers, tier)


for _name, _tier in (
    ("i4_stringent", "Stringent"), ("i5_elevated", "Elevated"), ("i6_human", "Human"), ("i6_mouse", "Mouse"),
    ("i7_human_specific", "Human_specific"), ("i7_mouse_specific", "Mouse_specific"), ("i8_mixed", "Mixed"),
):
    tier_query(_name, _tier)


@query("i9_flat_tiers", f"SELECT {TC}, tier FROM tier_rows")
def _(t):
    return t.tiers


cte("tally_long", "SELECT e.tf_id, v.tier, CASE WHEN CASE v.tier WHEN 'Human' THEN has_hg WHEN 'Mouse' THEN has_mm ELSE has_ortho END THEN coalesce(c.n, 0) END AS n FROM elig_tf e, (VALUES "
    + ", ".join(f"('{x}')" for x in n.TIERS) + ") v(tier) LEFT JOIN (SELECT tf_id, tier, count(*) AS n FROM tier_rows GROUP BY ALL) c ON c.tf_id = e.tf_id AND c.tier = v.tier")
cte("tally_wide", "SELECT tf_id, " + ", ".join(f"max(n) FILTER (tier = '{x}') AS {x}" for x in n.TIERS) + " FROM tally_long GROUP BY ALL")


@query("i10_tally", "SELECT * FROM tally_wide")
def _(t):
    return n.tally(t.tiers, t.eligibility)


@query("i11_tier_totals", f"SELECT tier, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_pairs, count(*) FILTER (n > 0) AS n_tfs, {six_sql('(CASE WHEN n > 0 THEN n END)::DOUBLE')} FROM tally_long GROUP BY ALL")
def _(t):
    return round_six(n.tier_totals(n.tally(t.tiers, t.eligibility)))


@query("i12_one_species_binding", """
SELECT count(Human) AS n_human, max_by(tf_id, printf('%09d', Human) || tf_id) FILTER (Human IS NOT NULL) AS max_human, count(Mouse) AS n_mouse,
 max_by(tf_id, printf('%09d', Mouse) || tf_id) FILTER (Mouse IS NOT NULL) AS max_mouse FROM tally_wide WHERE Stringent IS NULL""")
def _(t):
    return n.one_species_binding(n.tally(t.tiers, t.eligibility))


cte("recur", "SELECT tier, CASE WHEN tier IN ('Mouse', 'Mouse_specific') THEN gene_mm ELSE gene_hg END AS gene, count(*) AS n FROM tier_rows GROUP BY ALL")


@query("i13_gene_recurrence", "SELECT * FROM recur")
def _(t):
    return n.recurrence(t.tiers)


@query("i13_recurrence_summary", """
SELECT tier, count(*) FILTER (n > 1) AS n_multi, max(n) AS max_n, count(*) FILTER (n = mx) AS n_max_genes,
 (SELECT string_agg(tf_id, ', ' ORDER BY tf_id) FROM (SELECT DISTINCT tf_id FROM tier_rows w JOIN
   (SELECT tier, gene FROM (SELECT *, max(n) OVER (PARTITION BY tier) AS m2 FROM recur) WHERE n = m2) g
   ON g.tier = w.tier AND g.gene = CASE WHEN w.tier IN ('Mouse', 'Mouse_specific') THEN gene_mm ELSE gene_hg END WHERE w.tier = r.tier)) AS tfs
FROM (SELECT *, max(n) OVER (PARTITION BY tier) AS mx FROM recur) r GROUP BY tier""")
def _(t):
    return n.recurrence_summary(t.tiers)


_names = [*n.MISSED, "human", "mouse", "coexpr", "bind"]


@query("i14_elevated_missing", f"""
SELECT *, {', '.join(f'round(n_{x} / n::DOUBLE, 3) AS prop_{x}' for x in _names)} FROM (
SELECT *, n_bind_hg + n_coexpr_hg AS n_human, n_bind_mm + n_coexpr_mm AS n_mouse, n_coexpr_hg + n_coexpr_mm AS n_coexpr, n_bind_hg + n_bind_mm AS n_bind FROM (
SELECT tf_id, count(*) AS n, {', '.join(f'count(*) FILTER ({c} > {K}) AS n_{x}' for x, c in n.MISSED.items())} FROM tier_rows WHERE tier = 'Elevated' GROUP BY ALL))""")
def _(t):
    return n.elevated_missing(t.tiers, K)


def no_ortho_sql(tag: str, tier: str) -> str:
    return f"(SELECT tf_id, count(*) AS n_specific_{tag}, count(*) FILTER (gene_{tag} IN (SELECT gene_{tag} FROM ortho)) AS n_ortho_{tag} FROM tier_rows WHERE tier = '{tier}' GROUP BY ALL)"


def no_ortho_cols(tag: str) -> str:
    a, b = f"coalesce(n_specific_{tag}, 0)", f"coalesce(n_ortho_{tag}, 0)"
    return f"{a} AS n_specific_{tag}, {b} AS n_ortho_{tag}, {a} - {b} AS n_not_ortho_{tag}, ({a} - {b})::DOUBLE / nullif({a}, 0) AS prop_not_ortho_{tag}"


cte("no_ortho", f"SELECT e.tf_id, {no_ortho_cols('hg')}, {no_ortho_cols('mm')} FROM {ELIG} e LEFT JOIN {no_ortho_sql('hg', 'Human_specific')} USING (tf_id) LEFT JOIN {no_ortho_sql('mm', 'Mouse_specific')} USING (tf_id)")


@query("i15_not_ortholog", "SELECT tf_id, n_specific_hg, n_ortho_hg, n_not_ortho_hg, round(prop_not_ortho_hg, 6) AS prop_not_ortho_hg, n_specific_mm, n_ortho_mm, n_not_ortho_mm, round(prop_not_ortho_mm, 6) AS prop_not_ortho_mm FROM no_ortho")
def _(t):
    return rd(n.not_ortholog(t.tiers, t.eligibility, t.ortho), prop_not_ortho_hg=6, prop_not_ortho_mm=6)


@query("i15_top_not_ortholog", "SELECT tf_id, n_not_ortho_hg, round(prop_not_ortho_hg, 6) AS prop_not_ortho_hg FROM (SELECT *, rank() OVER (ORDER BY prop_not_ortho_hg DESC) AS i FROM no_ortho WHERE n_not_ortho_hg >= 1) WHERE i <= 10")
def _(t):
    return rd(n.top_not_ortholog(n.not_ortholog(t.tiers, t.eligibility, t.ortho), "hg", min_n=1), prop_not_ortho_hg=6)


cte("divergent_rows", """
SELECT tf_id, id, CASE WHEN cut_coexpr_hg AND cut_bind_hg AND rank_aggr_coexpr_mm >= mid AND rank_bind_mm >= mid THEN 'Human'
  WHEN cut_coexpr_mm AND cut_bind_mm AND rank_aggr_coexpr_hg >= mid AND rank_bind_hg >= mid THEN 'Mouse' END AS side, rank_aggr_coexpr_hg, rank_aggr_coexpr_mm, rank_bind_hg, rank_bind_mm
FROM cuts, (SELECT min_by(c, tf_id) / 2 AS mid FROM (SELECT tf_id, count(*) AS c FROM evidence GROUP BY ALL))""")


@query("i16_divergent_candidates", "SELECT * FROM divergent_rows WHERE side IS NOT NULL")
def _(t):
    return n.divergent_candidates(t.evidence, K)


@query("i16_candidate_counts", "SELECT tf_id, count(*) FILTER (side = 'Human') AS human, count(*) FILTER (side = 'Mouse') AS mouse FROM divergent_rows GROUP BY ALL")
def _(t):
    return n.candidate_counts(n.divergent_candidates(t.evidence, K), t.evidence)


AP = [5, 10, 20]
_wide = [(tf, s) for tf in AP for s in ("rank_bind", "rank_aggr_coexpr", "rank_integrated")]


@query("i17_collect_gene_ranks", "SELECT *, " + " + ".join(f"{s}_{tf}" for tf, s in _wide) + " AS rank_sum FROM (SELECT gene, "
       + ", ".join(f"max({s}) FILTER (tf = {tf}) AS {s}_{tf}" for tf, s in _wide) + " FROM rank_all WHERE species = 'Human' AND tf IN (5, 10, 20) GROUP BY ALL)")
def _(t):
    return n.collect_gene_ranks(t.rank_all, "Human", AP)


@query("i18_other_species_ranks", """
SELECT s.tf_id, s.gene_hg AS gene, s.rank_aggr_coexpr_hg, r.rank_aggr_coexpr AS rank_aggr_coexpr_mm, s.rank_bind_hg, r.rank_bind AS rank_bind_mm, 'Human_specific' AS tier
FROM spec_hg s LEFT JOIN ortho o ON o.gene_hg = s.gene_hg LEFT JOIN (SELECT t.id, x.* FROM rank_all x JOIN ortho t ON t.gene_mm = x.tf WHERE x.species = 'Mouse') r ON r.id = s.tf_id AND r.gene = o.gene_mm
UNION ALL
SELECT s.tf_id, coalesce(o.gene_hg, s.gene_mm), r.rank_aggr_coexpr, s.rank_aggr_coexpr_mm, r.rank_bind, s.rank_bind_mm, 'Mouse_specific'
FROM spec_mm s LEFT JOIN ortho o ON o.gene_mm = s.gene_mm LEFT JOIN (SELECT t.id, x.* FROM rank_all x JOIN ortho t ON t.gene_hg = x.tf WHERE x.species = 'Human') r ON r.id = s.tf_id AND r.gene = o.gene_hg""")
def _(t):
    return n.with_other_species(t.tiers, t.rank_all, t.ortho)


def bucket(c: str) -> str:
    return f"CAST(CASE WHEN {c} <= {K} THEN 0 WHEN {c} <= {K} + 5 THEN 1 WHEN {c} IS NOT NULL THEN 2 END AS INTEGER) AS {c}"


@query("i19_rank_buckets", f"SELECT tf_id, tier, gene_hg, gene_mm, {', '.join(bucket(c) for c in n.RANKS4)} FROM tier_rows")
def _(t):
    rows = t.tiers.select("tf_id", "tier", "gene_hg", "gene_mm", *n.RANKS4)
    return n.rank_buckets(rows, K, 5)


@query("i20_curated_flag", """
SELECT w.tf_id, w.tier, w.gene_hg, w.gene_mm, coalesce((SELECT true FROM lab_rows l JOIN ortho o ON o.gene_hg = l.tf WHERE l.species = 'Human' AND o.id = w.tf_id AND l.gene = w.gene_hg),
 (SELECT true FROM lab_rows l JOIN ortho o ON o.gene_mm = l.tf WHERE l.species = 'Mouse' AND o.id = w.tf_id AND l.gene = w.gene_mm), false) AS curated FROM tier_rows w""")
def _(t):
    return n.with_curated(t.tiers, t.labels, t.ortho).select("tf_id", "tier", "gene_hg", "gene_mm", "curated")


@query("i21_long_tally", "SELECT tf_id, tier, n FROM tally_long")
def _(t):
    return n.long_tally(n.tally(t.tiers, t.eligibility))
