"""Queries: enrichment, reference tables, statistics, relational verbs, checks (G, T, V, Q)."""
from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats as st
from ..functions.exprs import rnd, share, title
from ..functions.sampling import permuted_sql, shuffled_position, with_draws
from ..operators import checks as ck
from ..operators import enrich as g
from .catalog import query
from .fixtures import N_SETS_ITER, SEED, f10
from .oracle import cte
from .q_core import rank_sum_sql, round_six, rounded_test, six_sql
from .q_profiles import rd, spearman_sql

CUT = 0.9  # few sets are significant in this data; the filter is the point

# ---------------------------------------------------------------- G

cte("set_pos", "SELECT species, tf, gene, row_number() OVER (PARTITION BY species, tf ORDER BY rank_aggr_coexpr, gene) AS pos FROM rank_tf WHERE rank_aggr_coexpr IS NOT NULL")
cte("set_rows", "SELECT DISTINCT p_brand AS set_id, p_size AS gene FROM part")


def ap_sql(source: str, keys: str) -> str:
    return f"SELECT {keys}, {f10('avg(h)')} AS avg_precision, count(*) AS n_members FROM (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY pos) / pos::DOUBLE AS h FROM {source}) GROUP BY ALL"


cte("set_ap", f"SELECT a.*, n_genes FROM ({ap_sql('(SELECT p.species, p.tf, s.set_id, p.pos FROM set_pos p JOIN set_rows s ON s.gene = p.gene)', 'species, tf, set_id')}) a JOIN (SELECT species, tf, count(*) AS n_genes FROM set_pos GROUP BY ALL) n ON n.species = a.species AND n.tf = a.tf WHERE n_members >= 2")
cte("set_places", permuted_sql(f"SELECT n_genes, iter, unnest(range(0, most)) AS place FROM (SELECT n_genes, max(n_members) AS most FROM set_ap GROUP BY n_genes), (SELECT unnest(range(1, {N_SETS_ITER} + 1)) AS iter)", "place", "n_genes", SEED, "n_genes, iter", 50))
cte("set_null", ap_sql("""(SELECT z.n_genes, z.n_members AS size, o.iter, o.x + 1 AS pos FROM (SELECT DISTINCT n_genes, n_members FROM set_ap) z JOIN
 set_places o ON o.n_genes = z.n_genes AND o.place < z.n_members)""", "n_genes, size, iter"))
cte("set_p", f"SELECT a.species, a.tf, a.set_id, a.n_members, a.avg_precision, (count(*) FILTER (u.avg_precision >= a.avg_precision) + 1) / ({N_SETS_ITER} + 1)::DOUBLE AS p_value FROM set_ap a JOIN set_null u ON u.n_genes = a.n_genes AND u.size = a.n_members GROUP BY ALL")
cte("enriched", """
SELECT species, tf, set_id, n_members, avg_precision, p_value, least(1.0::DOUBLE, min(q) OVER (PARTITION BY species, tf ORDER BY p_value DESC, set_id DESC ROWS UNBOUNDED PRECEDING)) AS p_corrected
FROM (SELECT *, p_value * count(*) OVER (PARTITION BY species, tf) / row_number() OVER (PARTITION BY species, tf ORDER BY p_value, set_id) AS q FROM set_p)""")
cte("sig_sets", f"SELECT * FROM enriched WHERE p_corrected <= {CUT}")


@query("g1_enrichment", "SELECT species, tf, set_id, n_members, round(avg_precision, 6) AS avg_precision, round(p_value, 6) AS p_value, round(p_corrected, 6) AS p_corrected FROM enriched")
def _(t):
    return rd(t.enriched, avg_precision=6, p_value=6, p_corrected=6)


@query("g2_significant", "SELECT species, tf, set_id FROM sig_sets")
def _(t):
    return g.significant(t.enriched, CUT).select("species", "tf", "set_id")


cte("term_counts", "SELECT species, tf, count(s.set_id) AS n FROM (SELECT DISTINCT species, tf FROM rank_tf) LEFT JOIN sig_sets s USING (species, tf) GROUP BY ALL")


@query("g3_terms_per_tf", "SELECT species, tf, n FROM term_counts")
def _(t):
    return t.term_counts(CUT)


cte("ortho_terms", "SELECT o.id, h.n AS n_hg, m.n AS n_mm FROM ortho o JOIN term_counts h ON h.species = 'Human' AND h.tf = gene_hg JOIN term_counts m ON m.species = 'Mouse' AND m.tf = gene_mm")


@query("g4_ortholog_term_counts", "SELECT * FROM ortho_terms")
def _(t):
    return g.ortholog_term_counts(t.term_counts(CUT), t.ortho)


@query("g5_term_jaccard", """
SELECT t.id, round(coalesce(i, 0)::DOUBLE / nullif(n_hg + n_mm - coalesce(i, 0), 0), 6) AS jaccard FROM ortho_terms t LEFT JOIN
 (SELECT o.id, count(*) AS i FROM ortho o JOIN sig_sets h ON h.species = 'Human' AND h.tf = gene_hg JOIN sig_sets m ON m.species = 'Mouse' AND m.tf = gene_mm AND m.set_id = h.set_id GROUP BY ALL) j USING (id)""")
def _(t):
    return rd(g.term_jaccard(g.significant(t.enriched, CUT), t.term_counts(CUT), t.ortho), jaccard=6)


cte("term_tfs", "SELECT species, set_id, count(*) AS n, string_agg(CAST(tf AS VARCHAR), ', ' ORDER BY tf) AS tfs FROM sig_sets GROUP BY ALL")


@query("g6_tfs_per_term", "SELECT * FROM term_tfs")
def _(t):
    return g.tfs_per_term(g.significant(t.enriched, CUT), ["species"])


@query("g7_terms_across_species", """
SELECT coalesce(h.set_id, m.set_id) AS set_id, coalesce(h.n, 0) AS n_hg, coalesce(m.n, 0) AS n_mm, coalesce(h.tfs, '0') AS tfs_hg, coalesce(m.tfs, '0') AS tfs_mm
FROM (SELECT * FROM term_tfs WHERE species = 'Human') h FULL JOIN (SELECT * FROM term_tfs WHERE species = 'Mouse') m ON h.set_id = m.set_id""")
def _(t):
    return g.terms_across_species(g.tfs_per_term(g.significant(t.enriched, CUT), ["species"]))


@query("g8_top_terms", "SELECT species, tf, set_id, round(-log10(p_corrected), 6) AS score FROM (SELECT *, rank() OVER (PARTITION BY species, tf ORDER BY p_corrected) AS i FROM enriched) WHERE i <= 5")
def _(t):
    return rd(g.top_terms(t.enriched, 5).select("species", "tf", "set_id", "score"), score=6)


cte("ortho_source", """
SELECT 'H' || (s_suppkey % 40) AS symbol_hg, 'm' || s_nationkey AS symbol_mm, s_acctbal / 1000 AS score, CASE WHEN s_suppkey % 9 = 0 THEN 'RGD' ELSE 'MGI' END AS id_type,
 CASE WHEN s_suppkey % 11 = 0 THEN 'No' ELSE 'Yes' END AS best_score, CASE WHEN s_suppkey % 7 = 0 THEN 'No' ELSE 'Yes' END AS best_score_rev FROM supplier""")
cte("ortho_ok", "SELECT * FROM ortho_source WHERE score >= 5 AND id_type = 'MGI' AND best_score = 'Yes' AND best_score_rev = 'Yes' AND symbol_hg <> 'H3' AND symbol_mm <> 'm4'")


def ortho_source(t):
    k = F.col("s_suppkey")
    return t.raw("supplier").select(
        F.concat(F.lit("H"), (k % 40).cast("string")).alias("symbol_hg"), F.concat(F.lit("m"), F.col("s_nationkey").cast("string")).alias("symbol_mm"),
        (F.col("s_acctbal") / 1000).alias("score"), F.when(k % 9 == 0, "RGD").otherwise("MGI").alias("id_type"),
        F.when(k % 11 == 0, "No").otherwise("Yes").alias("best_score"), F.when(k % 7 == 0, "No").otherwise("Yes").alias("best_score_rev"),
    )


@query("g9_format_orthologs", "SELECT symbol_hg, symbol_mm, symbol_hg || '_' || symbol_mm AS id FROM ortho_ok WHERE symbol_hg IN (SELECT symbol_hg FROM ortho_ok GROUP BY ALL HAVING count(*) = 1) AND symbol_mm IN (SELECT symbol_mm FROM ortho_ok GROUP BY ALL HAVING count(*) = 1)")
def _(t):
    src = ortho_source(t)
    hg = src.select(F.col("symbol_hg").alias("symbol")).distinct().filter("symbol <> 'H3'")
    mm = src.select(F.col("symbol_mm").alias("symbol")).distinct().filter("symbol <> 'm4'")
    return g.format_orthologs(src, hg, mm)


CHROMOSOMES = ["1", "2", "3", "X", "Y"]
CHR = "CASE p_size % 6 WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3' WHEN 4 THEN 'X' WHEN 5 THEN 'Y' ELSE 'Un_1' END"
cte("transcripts", f"""
SELECT 'chr' || {CHR} AS chromosome, p_partkey * 10 AS start, p_partkey * 10 + p_size AS "end", CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
 'NM_' || p_partkey AS refseq_id, 'S' || (p_partkey % (SELECT count(*) * 4 // 5 FROM part)) AS symbol, CASE WHEN p_partkey % 8 = 0 THEN 'lincRNA' ELSE 'protein_coding' END AS biotype, p_partkey AS ordinal FROM part""")


def transcripts(t):
    k, m = F.col("p_partkey"), F.col("p_size") % 6
    chrom = F.when(m == 0, "Un_1")
    for i, c in enumerate(CHROMOSOMES, 1):
        chrom = chrom.when(m == i, c)
    n_symbols = t.raw("part").count() * 4 // 5
    return t.raw("part").select(
        F.concat(F.lit("chr"), chrom).alias("chromosome"), (k * 10).alias("start"), (k * 10 + F.col("p_size")).alias("end"),
        F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), F.concat(F.lit("NM_"), k.cast("string")).alias("refseq_id"),
        F.concat(F.lit("S"), (k % n_symbols).cast("string")).alias("symbol"),
        F.when(k % 8 == 0, "lincRNA").otherwise("protein_coding").alias("biotype"), k.alias("ordinal"),
    )


cte("shaped", """SELECT substr(chromosome, 4) AS chromosome, start, "end", CASE WHEN strand = '+' THEN 1 ELSE -1 END AS strand, CASE WHEN strand = '+' THEN start ELSE "end" END AS tss, refseq_id, symbol, biotype, ordinal
FROM transcripts WHERE chromosome IN ('chr1', 'chr2', 'chr3', 'chrX', 'chrY')""")
TX = ["chromosome", "tss", "strand", "refseq_id", "symbol"]


@query("g10_shape_transcripts", f"SELECT {', '.join(TX)} FROM shaped")
def _(t):
    return g.shape_transcripts(transcripts(t), CHROMOSOMES).select(*TX)


@query("g11_coding_transcripts", f"SELECT {', '.join(TX)} FROM shaped WHERE biotype = 'protein_coding'")
def _(t):
    return g.coding_transcripts(g.shape_transcripts(transcripts(t), CHROMOSOMES), CHROMOSOMES).select(*TX)


cte("ens", "SELECT CASE WHEN ordinal % 17 = 0 THEN '' ELSE symbol END AS symbol, chromosome, 'ENST' || ordinal AS transcript_id, ordinal FROM shaped WHERE ordinal % 5 <> 2")
cte("dupl_sym", "SELECT symbol FROM shaped GROUP BY ALL HAVING count(*) > 1")


@query("g12_match_tables", """
SELECT symbol, transcript_id, refseq_id FROM (SELECT r.symbol, e.transcript_id, r.refseq_id, row_number() OVER (PARTITION BY r.symbol ORDER BY coalesce(e.ordinal, 0)) AS i
 FROM (SELECT symbol, min_by(refseq_id, ordinal) AS refseq_id FROM shaped WHERE NOT (symbol IN (SELECT symbol FROM dupl_sym) AND chromosome = 'Y') GROUP BY ALL) r
 LEFT JOIN (SELECT * FROM ens WHERE symbol <> '') e ON e.symbol = r.symbol
 WHERE NOT coalesce(r.symbol IN (SELECT symbol FROM dupl_sym) AND e.chromosome = 'Y', false)) WHERE i = 1""")
def _(t):
    ref = g.shape_transcripts(transcripts(t), CHROMOSOMES)
    k = F.col("ordinal")
    ens = ref.filter("ordinal % 5 <> 2").select(
        F.when(k % 17 == 0, "").otherwise(F.col("symbol")).alias("symbol"), "chromosome", F.concat(F.lit("ENST"), k.cast("string")).alias("transcript_id"), "ordinal"
    )
    return g.match_tables(ref, ens)[1].select("symbol", "transcript_id", "refseq_id")


@query("g13_coding_regulators", "SELECT symbol, min_by(p_brand, p_partkey) AS family FROM (SELECT 'S' || (p_partkey % 300) AS symbol, p_brand, p_partkey FROM part) WHERE symbol IN (SELECT symbol FROM shaped WHERE biotype = 'protein_coding') GROUP BY ALL")
def _(t):
    tfs = t.raw("part").select(F.concat(F.lit("S"), (F.col("p_partkey") % 300).cast("string")).alias("symbol"), F.col("p_brand").alias("family"), F.col("p_partkey").alias("ordinal"))
    coding = g.coding_transcripts(g.shape_transcripts(transcripts(t), CHROMOSOMES), CHROMOSOMES)
    return g.coding_regulators(tfs, coding.select("symbol").distinct())


@query("g14_ribosomal_set", "SELECT id FROM ortho WHERE gene_hg % 6 = 0 OR gene_hg % 11 = 0")
def _(t):
    hg = t.gene_ref.filter("species = 'Human'")
    return g.ribosomal_set(hg.filter("gene % 6 = 0"), hg.filter("gene % 11 = 0"), t.ortho).select("id")


# ---------------------------------------------------------------- T

cte("qty_rows", "SELECT l_linestatus, l_quantity, l_returnflag = 'R' AS returned FROM lineitem")


@query("t1_rank_sum", rank_sum_sql("qty_rows", "l_linestatus", "l_quantity", "returned"))
def _(t):
    rows = t.raw("lineitem").select("l_linestatus", "l_quantity", (F.col("l_returnflag") == "R").alias("returned"))
    return rounded_test(st.rank_sum_test(rows, ["l_linestatus"], "l_quantity", "returned"))


@query("t2_correlation_test", """
SELECT l_returnflag, round(r, 6) AS r, CAST(n AS BIGINT) AS n, round(r * sqrt((n - 2) / nullif(1 - r * r, 0)), 4) AS t FROM (
 SELECT l_returnflag, n, (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)) AS r FROM (
 SELECT l_returnflag, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy
 FROM (SELECT l_returnflag, l_quantity AS x, round(l_discount * 100, 0) AS y FROM lineitem) GROUP BY ALL))""")
def _(t):
    rows = t.raw("lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), rnd(F.col("l_discount") * 100, 0).alias("y"))
    return rd(rows.groupBy("l_returnflag").agg(*st.correlation_test("x", "y")), r=6, t=4)


@query("t2_two_by_two", """
SELECT l_linestatus, n11, n10, n01, n00, round((n11 * n00)::DOUBLE / nullif(n10 * n01, 0), 6) AS odds_ratio FROM (SELECT l_linestatus, count(*) FILTER (a AND b) AS n11, count(*) FILTER (a AND NOT b) AS n10,
 count(*) FILTER (NOT a AND b) AS n01, count(*) FILTER (NOT a AND NOT b) AS n00 FROM (SELECT l_linestatus, l_quantity > 25 AS a, l_discount > 0.05 AS b FROM lineitem) GROUP BY ALL)""")
def _(t):
    rows = t.raw("lineitem").groupBy("l_linestatus").agg(*st.two_by_two(F.col("l_quantity") > 25, F.col("l_discount") > 0.05))
    return rd(rows, odds_ratio=6)


_tc = ["n_cells", "n_celltypes", "n_genes"]


@query("t3_spearman_matrix", "SELECT column_a, column_b, round(spearman, 6) AS spearman, n FROM " + spearman_sql(
    "(" + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM info_b" for i, a in enumerate(_tc) for b in _tc[i + 1:]) + ")", "column_a, column_b", "x", "y"))
def _(t):
    return rd(st.spearman_matrix(t.info_b, "dataset_id", _tc), spearman=6)


@query("t4_six_numbers", f"SELECT l_returnflag, {six_sql('l_quantity')} FROM lineitem GROUP BY ALL")
def _(t):
    return round_six(t.raw("lineitem").groupBy("l_returnflag").agg(*st.six_numbers("l_quantity")))


@query("t4_large_group_summary", f"SELECT o_orderstatus, {six_sql('o_totalprice').replace(', 6)', ', 3)')} FROM orders GROUP BY ALL")
def _(t):
    out = st.large_group_summary(t.raw("orders").select("o_orderstatus", "o_totalprice"), ["o_orderstatus"], "o_totalprice")
    return out.withColumns({c: rnd(c, 3) for c in ("min", "q1", "median", "mean", "q3", "max")})


@query("t5_ecdf", "SELECT l_returnflag, round(avg(CASE WHEN l_quantity <= 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS at_10, round(avg(CASE WHEN l_quantity <= 40 THEN 1.0::DOUBLE ELSE 0 END), 6) AS at_40 FROM lineitem GROUP BY ALL")
def _(t):
    at = lambda v: share(F.col("l_quantity") <= v)
    return rd(t.raw("lineitem").groupBy("l_returnflag").agg(at(10).alias("at_10"), at(40).alias("at_40")), at_10=6, at_40=6)


@query("t6_seeded_draws", f"""
SELECT c_nationkey, CAST(iter AS INTEGER) AS iter, c_custkey, i AS at FROM (SELECT c_nationkey, iter, c_custkey, row_number() OVER (PARTITION BY c_nationkey, iter ORDER BY md5(concat_ws('|', '{SEED}', iter, c_custkey)), c_custkey) AS i
FROM customer, (SELECT unnest(range(1, 4)) AS iter)) WHERE i <= 5""")
def _(t):
    rows = with_draws(t.raw("customer").select("c_nationkey", "c_custkey"), 3)
    return rows.withColumn("at", shuffled_position(["c_nationkey", "iter"], "c_custkey", SEED, "iter")).filter("at <= 5")


@query("t7_histogram", """
SELECT o_orderstatus, CAST(least(20, floor((o_totalprice - lo) * 20 / nullif(hi - lo, 0)) + 1) AS INTEGER) AS bin, count(*) AS n
FROM orders JOIN (SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY ALL) USING (o_orderstatus) GROUP BY ALL""")
def _(t):
    return st.histogram(t.raw("orders"), ["o_orderstatus"], "o_totalprice", 20)


@query("t8_linear_trend", """
SELECT l_returnflag, round(slope, 6) AS slope, round((sy - slope * sx) / n, 5) AS intercept FROM (SELECT *, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS slope FROM (
 SELECT l_returnflag, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM (SELECT l_returnflag, l_quantity AS x, round(l_discount * 100, 0) AS y FROM lineitem) GROUP BY ALL))""")
def _(t):
    rows = t.raw("lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), rnd(F.col("l_discount") * 100, 0).alias("y"))
    return rd(rows.groupBy("l_returnflag").agg(*st.linear_trend("x", "y")), slope=6, intercept=5)


# ---------------------------------------------------------------- V

@query("v1_filter_select", "SELECT p_partkey, p_size * 2 AS double_size FROM part WHERE p_size > 10 AND p_type = 'ECONOMY'")
def _(t):
    return t.raw("part").filter("p_size > 10 AND p_type = 'ECONOMY'").select("p_partkey", (F.col("p_size") * 2).alias("double_size"))


@query("v2_rename_with", "SELECT s_suppkey AS sup_s_suppkey, s_name AS sup_s_name FROM supplier")
def _(t):
    s = t.raw("supplier").select("s_suppkey", "s_name")
    return s.toDF(*[f"sup_{c}" for c in s.columns])


@query("v3_joins", "SELECT n_name, r_name, c_custkey FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal < 0) ON c_nationkey = n_nationkey")
def _(t):
    nation = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cust = t.raw("customer").filter("c_acctbal < 0").select("c_custkey", "c_nationkey")
    return nation.join(cust, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", "r_name", "c_custkey")


@query("v3_right_join", "SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 400000) RIGHT JOIN customer ON o_custkey = c_custkey")
def _(t):
    big = t.raw("orders").filter("o_totalprice > 400000").select("o_orderkey", "o_custkey")
    return big.join(t.raw("customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "right").select("o_orderkey", "c_custkey")


@query("v4_semi_anti", "SELECT c_custkey, 'with' AS side FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'without' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    c, o = t.raw("customer").select("c_custkey"), t.raw("orders").select(F.col("o_custkey").alias("c_custkey"))
    yes, no = c.join(o, "c_custkey", "left_semi"), c.join(o, "c_custkey", "left_anti")
    return yes.withColumn("side", F.lit("with")).unionByName(no.withColumn("side", F.lit("without")))


@query("v5_key_pairs", "SELECT a.tf AS tf_a, b.tf AS tf_b, count(*) AS shared FROM curated a JOIN curated b ON a.target = b.target AND a.tf < b.tf GROUP BY ALL")
def _(t):
    a = t.curated.select(F.col("tf").alias("tf_a"), "target")
    b = t.curated.select(F.col("tf").alias("tf_b"), "target")
    return a.join(b, "target").filter("tf_a < tf_b").groupBy("tf_a", "tf_b").agg(F.count(F.lit(1)).alias("shared"))


@query("v6_set_operations", """
SELECT 'union' AS op, n FROM (SELECT n_nationkey AS n FROM nation UNION SELECT p_size FROM part) UNION ALL SELECT 'intersect', n FROM (SELECT n_nationkey AS n FROM nation INTERSECT SELECT p_size FROM part)
UNION ALL SELECT 'except', n FROM (SELECT n_nationkey AS n FROM nation EXCEPT SELECT p_size FROM part)""")
def _(t):
    a, b = t.raw("nation").select(F.col("n_nationkey").alias("n")), t.raw("part").select(F.col("p_size").alias("n"))
    tag = lambda df, op: df.select(F.lit(op).alias("op"), "n")
    return tag(a.union(b).distinct(), "union").union(tag(a.intersect(b), "intersect")).union(tag(a.subtract(b), "except"))


@query("v7_group_summaries", "SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS n_customers, round(avg(o_totalprice), 2) AS mean_price FROM orders GROUP BY ALL")
def _(t):
    out = t.raw("orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("n_customers"), F.avg("o_totalprice").alias("mean_price"))
    return rd(out, mean_price=2)


@query("v8_distinct_keep_all", "SELECT p_brand, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1")
def _(t):
    from ..operators.prep import keep_first

    return keep_first(t.raw("part").select("p_brand", "p_partkey", "p_name"), ["p_brand"], "p_partkey")


@query("v9_arrange_by_list", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def _(t):
    wanted = F.array(*[F.lit(x) for x in ("5-LOW", "1-URGENT", "3-MEDIUM", "2-HIGH", "4-NOT SPECIFIED")])
    out = t.raw("orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.array_position(wanted, F.col("o_orderpriority")))


@query("v10_slices", """
SELECT 'ties' AS kind, c_nationkey, c_custkey FROM (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS i FROM customer) WHERE i <= 3
UNION ALL SELECT 'exact', c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer) WHERE i <= 3""")
def _(t):
    c = t.raw("customer")
    by = W.partitionBy("c_nationkey")
    ties = c.withColumn("i", F.rank().over(by.orderBy("c_mktsegment"))).filter("i <= 3").withColumn("kind", F.lit("ties"))
    exact = c.withColumn("i", F.row_number().over(by.orderBy(F.col("c_acctbal").desc(), "c_custkey"))).filter("i <= 3").withColumn("kind", F.lit("exact"))
    return ties.unionByName(exact).select("kind", "c_nationkey", "c_custkey")


@query("v11_pivot_longer", "SELECT l_orderkey, l_linenumber, stat, value FROM (SELECT l_orderkey, l_linenumber, 'l_tax' AS stat, l_tax AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem)")
def _(t):
    return t.raw("lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"], "stat", "value")


@query("v12_case_and_fill", "SELECT doc_id, CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars < 2000 THEN 'middle' ELSE 'long' END AS size, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    rows = t.raw("documents").join(t.raw("labels").select("doc_id", "quality"), "doc_id", "left")
    n = F.col("n_chars")
    return rows.select("doc_id", F.when(n < 200, "short").when(n < 2000, "middle").otherwise("long").alias("size"), "quality").na.fill(-1, ["quality"])


@query("v13_strings", """
SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, upper(p_name[1]) || lower(p_name[2:]) AS title, regexp_replace(p_name, '[aeiou]', '_') AS first_vowel,
 regexp_replace(p_name, '[aeiou]', '_', 'g') AS vowels, regexp_matches(p_brand, '1[0-9]$') AS teen, p_brand || '|' || p_type AS pasted, trim('  ' || p_name || ' ') AS trimmed FROM part""")
def _(t):
    from ..operators.prep import apply_rules

    rows = apply_rules(t.raw("part").withColumn("first_vowel", F.col("p_name")), "first_vowel", [("[aeiou]", "_", False)])
    return rows.select(
        "p_partkey", F.upper("p_name").alias("up"), F.lower("p_brand").alias("low"), title("p_name").alias("title"), "first_vowel",
        F.regexp_replace("p_name", "[aeiou]", "_").alias("vowels"), F.col("p_brand").rlike("1[0-9]$").alias("teen"),
        F.concat_ws("|", "p_brand", "p_type").alias("pasted"), F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("trimmed"),
    )


@query("v14_math", "SELECT p_partkey, round(ln(p_size), 6) AS ln_size, round(log10(p_size), 6) AS log10_size, round(exp(p_size / 50.0::DOUBLE), 6) AS e, abs(p_size - 25) AS dist, round((p_size + p_retailprice) / 2, 4) AS row_mean FROM part")
def _(t):
    s = F.col("p_size").cast("double")
    out = t.raw("part").select("p_partkey", F.ln(s).alias("ln_size"), F.log10(s).alias("log10_size"), F.exp(s / 50.0).alias("e"), F.abs(F.col("p_size") - 25).alias("dist"), ((s + F.col("p_retailprice")) / 2).alias("row_mean"))
    return rd(out, ln_size=6, log10_size=6, e=6, row_mean=4)


@query("q1_invariants", """
SELECT 'meta_key' AS check_name, CAST(count(*) - count(DISTINCT (dataset_id, cell_id)) AS BIGINT) AS n_violations FROM meta_a
UNION ALL SELECT 'expr_key', CAST(count(*) - count(DISTINCT (dataset_id, cell_id, gene)) AS BIGINT) FROM expr_a
UNION ALL SELECT 'line_key', CAST(count(*) - count(DISTINCT (l_orderkey, l_suppkey)) AS BIGINT) FROM lineitem
UNION ALL SELECT 'expr_cells_in_meta', count(*) FROM (SELECT DISTINCT dataset_id, cell_id FROM expr_a) WHERE (dataset_id, cell_id) NOT IN (SELECT (dataset_id, cell_id) FROM meta_a)
UNION ALL SELECT 'meta_cells_in_expr', count(*) FROM (SELECT DISTINCT dataset_id, cell_id FROM meta_a) WHERE (dataset_id, cell_id) NOT IN (SELECT (dataset_id, cell_id) FROM expr_a)
UNION ALL SELECT 'value_positive', count(*) FILTER (NOT value > 0) FROM expr_a
UNION ALL SELECT 'rsr_range', count(*) FILTER (NOT (rsr > 0 AND rsr <= 1)) FROM agg_a""")
def _(t):
    cell = ["dataset_id", "cell_id"]
    return ck.all_checks(
        ck.duplicate_keys(t.meta_a, cell, "meta_key"),
        ck.duplicate_keys(t.expr_a, [*cell, "gene"], "expr_key"),
        ck.duplicate_keys(t.raw("lineitem"), ["l_orderkey", "l_suppkey"], "line_key"),
        ck.missing_in(t.expr_a, t.meta_a, cell, "expr_cells_in_meta"),
        ck.missing_in(t.meta_a, t.expr_a, cell, "meta_cells_in_expr"),
        ck.values_outside(t.expr_a, "value > 0", "value_positive"),
        ck.values_outside(t.agg_a, "rsr > 0 AND rsr <= 1", "rsr_range"),
    )
