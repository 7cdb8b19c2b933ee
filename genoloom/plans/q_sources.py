"""Queries: scans, sinks and cleaning (S1-S16, N1-N23). Text inputs are exports of the given tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import rnd
from ..operators import prep as p
from ..sources import readers as s
from ..sources.stage import exists, materialize
from .catalog import query
from .dataset_build import build_counts, top_pairs
from .oracle import cte


def export(t, name: str, write) -> str:
    """Write a text input once per session; returns its path."""
    path = t.path(name)
    if not exists(t.spark, path):
        write(path)
    return path


def write_lines(df: DataFrame, path: str) -> None:
    """Text lines in the order of ``ord`` over several files."""
    rows = df.repartitionByRange(4, "ord").sortWithinPartitions("ord").select("line")
    rows.write.mode("overwrite").text(path)


# ---------------------------------------------------------------- S

@query("s1_reference_scan", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(t):
    path = export(t, "tsv_supplier", lambda x: s.write_tsv(t.raw("supplier"), x))
    return s.read_tsv(t.spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@query("s2_positional_scan", "SELECT CAST(s_nationkey AS VARCHAR) AS chromosome, CAST(s_suppkey AS VARCHAR) AS start, s_name AS symbol FROM supplier")
def _(t):
    path = export(t, "headerless", lambda x: t.raw("supplier").write.mode("overwrite").csv(x, sep="\t", header=False))
    return s.read_positional(t.spark, path, {3: "chromosome", 1: "start", 2: "symbol"})


@query("s3_after_banner", "SELECT p_partkey, p_brand, p_size FROM part")
def _(t):
    names = ["p_partkey", "p_brand", "p_size"]

    def write(path):
        body = t.raw("part").select(F.concat_ws("\t", *[F.col(c).cast("string") for c in names]).alias("Table 1"))
        head = body.limit(1).select(F.lit("\t".join(names)).alias("Table 1"))
        head.unionByName(body).write.mode("overwrite").csv(path, sep="\u0001", header=True, quote="\u0000")

    schema = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_brand", T.StringType()), T.StructField("p_size", T.IntegerType())])
    return s.read_after_banner(t.spark, export(t, "banner", write), schema)


cte("nation_lines", "SELECT l_suppkey, p_size, c_nationkey, c_custkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON p_partkey = l_partkey")


def nation_lines(t):
    return (
        t.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
        .join(t.raw("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.raw("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.raw("part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    )


@query("s4_dense_matrix", "SELECT CAST(l_suppkey AS VARCHAR) AS gene, CAST(c_nationkey AS VARCHAR) AS cell_id, sum(l_quantity) AS value FROM nation_lines GROUP BY ALL")
def _(t):
    def write(path):
        cells = list(range(25))
        wide = nation_lines(t).groupBy("l_suppkey").pivot("c_nationkey", cells).agg(F.sum("l_quantity")).na.fill(0)
        s.write_tsv(wide.withColumnRenamed("l_suppkey", "V1"), path)

    return s.read_dense(t.spark, export(t, "dense", write))


@query("s5_dense_transposed", "SELECT CAST(p_size AS VARCHAR) AS gene, CAST(c_custkey AS VARCHAR) AS cell_id, sum(l_quantity) AS value FROM nation_lines GROUP BY ALL")
def _(t):
    def write(path):
        wide = nation_lines(t).groupBy("c_custkey").pivot("p_size", list(range(1, 51))).agg(F.sum("l_quantity")).na.fill(0)
        s.write_tsv(wide, path)

    return s.read_dense(t.spark, export(t, "dense_t", write), cells_as_rows=True)


def market_files(t, transposed: bool):
    entries = t.raw("lineitem").groupBy((F.col("l_suppkey") + 1).alias("g"), (F.col("l_orderkey") + 1).alias("c")).agg(F.sum("l_quantity").alias("v"))
    i, j = ("c", "g") if transposed else ("g", "c")
    tag = "_t" if transposed else ""

    def matrix(path):
        body = entries.select(
            (F.col("g") * 1_000_000_000 + F.col("c")).alias("ord"), F.concat_ws(" ", *[F.col(x).cast("string") for x in (i, j, "v")]).alias("line")
        )
        size = entries.agg(F.lit(0).cast("long").alias("ord"), F.concat_ws(" ", *[F.max(x).cast("string") for x in (i, j)], F.count(F.lit(1)).cast("string")).alias("line"))
        head = size.select(F.lit(-1).cast("long").alias("ord"), F.lit("%%MatrixMarket matrix coordinate real general").alias("line"))
        write_lines(body.unionByName(size).unionByName(head), path)

    def names(table, key, lead):
        return lambda path: write_lines(t.raw(table).select(F.col(key).alias("ord"), F.concat(F.lit(lead), F.col(key).cast("string")).alias("line")), path)

    return (
        export(t, f"mtx{tag}", matrix),
        export(t, "mtx_features", names("supplier", "s_suppkey", "S")),
        export(t, "mtx_barcodes", names("orders", "o_orderkey", "cell")),
    )


MTX = "SELECT 'S' || l_suppkey AS gene, 'cell' || l_orderkey AS cell_id, sum(l_quantity) AS value FROM lineitem GROUP BY ALL"


@query("s6_matrix_market", MTX)
def _(t):
    return s.read_matrix_market(t.spark, *market_files(t, False))


@query("s6_matrix_market_transposed", MTX)
def _(t):
    return s.read_matrix_market(t.spark, *market_files(t, True), transposed=True)


@query("s7_multi_file", "SELECT l_returnflag AS part, l_orderkey, l_suppkey, l_quantity FROM lineitem")
def _(t):
    cols = t.raw("lineitem").select(F.col("l_returnflag").alias("part"), "l_orderkey", "l_suppkey", "l_quantity")
    path = export(t, "parts", lambda x: s.write_tsv(cols, x, ["part"]))
    return s.read_parts(t.spark, path + "/part=*", "l_orderkey long, l_suppkey long, l_quantity double", "part=([A-Z])")


def agg_parts(t) -> str:
    path = t.path("agg_by_dataset")
    materialize(t.spark, path, lambda: t.agg_b.repartition("dataset_id"), partition_by=("dataset_id",))
    return path


@query("s8_aggregate_columns", "SELECT dataset_id, gene_a, gene_b, round(rsr, 8) AS rsr FROM agg_b WHERE dataset_id = 3 AND gene_b IN (5, 10)")
def _(t):
    return s.read_aggregates(t.spark, agg_parts(t), [3], [5, 10]).withColumn("rsr", rnd("rsr", 8))


@query("s9_many_aggregates", "SELECT dataset_id, gene_a, gene_b, n_na FROM agg_b WHERE dataset_id IN (0, 1, 2)")
def _(t):
    return s.read_aggregates(t.spark, agg_parts(t), [0, 1, 2], value="n_na")


@query("s10_load_or_generate", "SELECT dataset_id, gene_a, gene_b, round(rsr, 8) AS rsr FROM agg_b WHERE gene_b % 5 = 0")
def _(t):
    out = materialize(t.spark, t.path("tf_columns"), lambda: t.agg_b.filter("gene_b % 5 = 0").select("dataset_id", "gene_a", "gene_b", "rsr"))
    return out.withColumn("rsr", rnd("rsr", 8))


@query("s11_saved_step", "SELECT dataset_id, count(*) AS n_cells FROM meta_b GROUP BY ALL")
def _(t):
    build = lambda: t.meta_b.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_cells"))
    materialize(t.spark, t.path("saved_step"), build)
    return materialize(t.spark, t.path("saved_step"), build, force=True)


@query("s12_load_datasets", "SELECT dataset_id, cell_type, cell_id, gene, value FROM expr_a WHERE dataset_id IN (1, 3)")
def _(t):
    path = t.path("expr_by_dataset")
    materialize(t.spark, path, lambda: t.expr_a.repartition("dataset_id", "cell_type"), partition_by=("dataset_id",))
    return s.read_datasets(t.spark, path, [1, 3]).select("dataset_id", "cell_type", "cell_id", "gene", "value")


@query("s13_tsv_sink", "SELECT dataset_id, gene_a, gene_b, round(rsr, 6) AS rsr FROM agg_b")
def _(t):
    path = export(t, "agg_tsv", lambda x: s.write_tsv(t.agg_b.select("dataset_id", "gene_a", "gene_b", "rsr"), x))
    return s.read_tsv(t.spark, path, "dataset_id int, gene_a int, gene_b int, rsr double").withColumn("rsr", rnd("rsr", 6))


@query("s14_batch_list", "SELECT e.dataset_id, e.cell_id, e.gene, e.value FROM expr_b e SEMI JOIN (SELECT dataset_id FROM species WHERE species = 'Human') USING (dataset_id)")
def _(t):
    wanted = t.species.filter("species = 'Human'").select("dataset_id")
    return s.pick_datasets(t.expr_b, wanted).select("dataset_id", "cell_id", "gene", "value")


@query("s15_merge_parts", "SELECT l_returnflag AS part, count(DISTINCT l_orderkey) AS n_cells, count(*) OVER (PARTITION BY count(DISTINCT l_orderkey)) = 1 AS distinct_size FROM lineitem GROUP BY l_returnflag")
def _(t):
    li = t.raw("lineitem").select(F.col("l_orderkey").alias("cell_id"), F.col("l_returnflag").alias("part"), "l_quantity")
    merged = s.merge_parts(*[li.filter(F.col("part") == x) for x in ("A", "N", "R")])
    return s.parts_share_size(merged)


@query("s16_tissue_clusters", """
SELECT c_custkey AS cell_id, r_name AS tissue, 'c-' || c_nationkey AS cluster, CASE WHEN c_nationkey % 4 <> 3 THEN replace(r_name || '_' || n_name, ' ', '_') END AS cell_type,
 CASE WHEN c_nationkey % 4 <> 3 THEN r_name END AS cell_type_group, c_custkey || '_' || CASE WHEN c_nationkey % 4 <> 3 THEN replace(r_name || '_' || n_name, ' ', '_') ELSE 'NA' END AS id
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def _(t):
    nation = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cells = t.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("cell_id"), F.col("r_name").alias("tissue"), F.col("c_nationkey").alias("cluster")
    )
    clusters = nation.filter("n_nationkey % 4 <> 3").select(
        F.col("r_name").alias("tissue"), F.concat(F.lit("c-"), F.col("n_nationkey").cast("string")).alias("cluster"),
        F.col("n_name").alias("cell_type"), F.col("r_name").alias("cell_type_group"),
    )
    return s.attach_clusters(cells, clusters)


cte("built_cells", """
SELECT c.dataset_id, c.cell_id, m.cell_type, c.gene_counts FROM count_info c JOIN (SELECT dataset_id, cell_id, substr(cell_type, 3) AS cell_type,
 CASE WHEN dataset_id % 2 = 0 THEN '10x 3'' v2' ELSE 'Smart-seq2' END AS assay FROM meta_a WHERE cell_type <> '4-NOT SPECIFIED') m USING (dataset_id, cell_id)
WHERE umi_counts >= 50 AND gene_counts >= 2 AND rna_novelty > CASE WHEN assay = 'Smart-seq2' THEN 0.2 ELSE 0.3 END AND (mt_ratio IS NULL OR mt_ratio < 0.2)""")
cte("built_counts", """
SELECT dataset_id, cell_type, cell_id, gene, value / sum(value) OVER (PARTITION BY dataset_id, cell_id) * 1e6 AS value
FROM (SELECT e.dataset_id, b.cell_type, e.cell_id, e.gene, e.value FROM expr_a e JOIN built_cells b USING (dataset_id, cell_id) WHERE e.gene % 13 <> 0)""")


@query("s14_dataset_build", "SELECT dataset_id, cell_type, cell_id, gene, round(value, 4) AS value FROM built_counts")
def _(t):
    key = F.col("s_suppkey").cast("int")
    mt = t.raw("supplier").filter("s_suppkey % 10 = 0").select(key.alias("gene"))
    coding = t.raw("supplier").filter("s_suppkey % 13 <> 0").select(key.alias("gene"), key.alias("gene_out"))
    label = F.when(F.col("cell_type") == "4-NOT SPECIFIED", "unknown").otherwise(F.substring("cell_type", 3, 100))
    meta = t.meta_a.withColumn("cell_type", label).withColumn("assay", F.when(F.col("dataset_id") % 2 == 0, "10x 3' v2").otherwise("Smart-seq2"))
    counts, _cells = build_counts(
        t.expr_a, meta, mt, coding, min_counts=50, min_genes=2, min_novelty=0.3, min_novelty_full_length=0.2, max_mt_ratio=0.2
    )
    return counts.withColumn("value", rnd("value", 4))


@query("s14_top_pairs", "SELECT dataset_id, gene_a, gene_b, round(rsr, 8) AS rsr, n_na, place FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY rsr DESC, gene_a, gene_b) AS place FROM agg_a WHERE gene_a <> gene_b) WHERE place <= 20")
def _(t):
    return top_pairs(t.agg_a, 20).withColumn("rsr", rnd("rsr", 8))


# ---------------------------------------------------------------- N

@query("n1_rename", 'SELECT o_orderkey AS "ID", o_orderpriority AS "Cell_type", o_custkey FROM orders')
def _(t):
    rows = t.raw("orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    return p.rename_if_present(rows, {"o_orderkey": "ID", "o_orderpriority": "Cell_type", "celltype": "Cell_type"})


cte("count_info", """
SELECT dataset_id, cell_id, umi_counts, gene_counts, log10(gene_counts) / nullif(log10(umi_counts), 0) AS rna_novelty, mt / umi_counts AS mt_ratio
FROM (SELECT dataset_id, cell_id, sum(value) AS umi_counts, count(*) FILTER (value > 0) AS gene_counts, sum(CASE WHEN gene % 10 = 0 THEN value ELSE 0 END) AS mt FROM expr_a GROUP BY ALL)""")


def info(t, cells=None):
    mt = t.raw("supplier").filter("s_suppkey % 10 = 0").select(F.col("s_suppkey").cast("int").alias("gene"))
    return p.count_info(t.expr_a, mt, cells)


@query("n2_count_info", """
SELECT dataset_id, cell_id, coalesce(umi_counts, 0)::DOUBLE AS umi_counts, coalesce(gene_counts, 0) AS gene_counts, round(rna_novelty, 6) AS rna_novelty, round(mt_ratio, 6) AS mt_ratio
FROM (SELECT DISTINCT dataset_id, cell_id FROM meta_a) LEFT JOIN count_info USING (dataset_id, cell_id)""")
def _(t):
    return info(t, t.meta_a).withColumns({"rna_novelty": rnd("rna_novelty", 6), "mt_ratio": rnd("mt_ratio", 6)})


@query("n3_mitochondrial", "SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE CAST(s_suppkey AS VARCHAR) END AS gene FROM supplier WHERE s_suppkey % 10 IN (0, 5)")
def _(t):
    key = F.col("s_suppkey")
    genes = t.raw("supplier").select(F.when(key % 2 == 0, F.col("s_name")).otherwise(key.cast("string")).alias("gene"))
    mt = t.raw("supplier").filter("s_suppkey % 10 IN (0, 5)").select(key.cast("string").alias("gene_stable_id"), F.col("s_name").alias("gene_name"))
    return p.mitochondrial(genes, mt)


@query("n4_quality_cells", """
SELECT cell_id, assay FROM (SELECT c.*, CASE WHEN dataset_id % 2 = 0 THEN '10x 3'' v2' ELSE 'Smart-seq2' END AS assay FROM count_info c)
WHERE umi_counts >= 50 AND gene_counts >= 2 AND rna_novelty > CASE WHEN assay = 'Smart-seq2' THEN 0.2 ELSE 0.3 END AND (mt_ratio IS NULL OR mt_ratio < 0.2)""")
def _(t):
    assay = F.when(F.col("dataset_id") % 2 == 0, "10x 3' v2").otherwise("Smart-seq2")
    cells = p.quality_cells(info(t).withColumn("assay", assay), 50, 2, 0.3, 0.2, 0.2)
    return cells.select("cell_id", "assay")


@query("n4_quality_report", """
SELECT dataset_id, count(*) AS n_cells, count(*) FILTER (dataset_id <> 3 AND umi_counts >= 50 AND gene_counts >= 2 AND rna_novelty > 0.3 AND (mt_ratio IS NULL OR mt_ratio < 0.2)) AS n_kept,
 count(*) FILTER (dataset_id <> 3 AND umi_counts >= 50 AND gene_counts >= 2 AND rna_novelty > 0.3 AND (mt_ratio IS NULL OR mt_ratio < 0.2)) > 0 AS passes FROM count_info GROUP BY ALL""")
def _(t):
    # dataset 3 has no cell with enough counts
    cells = info(t).withColumns({"assay": F.lit("10x"), "umi_counts": F.when(F.col("dataset_id") != 3, F.col("umi_counts"))})
    return p.quality_report(cells, p.quality_cells(cells, 50, 2, 0.3, 0.2, 0.2))


@query("n5_ids_to_symbols", "SELECT cell_id, s_name AS gene, value FROM expr_a JOIN supplier ON gene = s_suppkey WHERE s_suppkey % 13 <> 0")
def _(t):
    key = F.col("s_suppkey")
    ref = t.raw("supplier").select(F.concat(F.lit("ENS"), key.cast("string")).alias("gene_id"), F.when(key % 13 == 0, "").otherwise(F.col("s_name")).alias("symbol"))
    expr = t.expr_a.withColumn("gene", F.concat(F.lit("ENS"), F.col("gene").cast("string")))
    return p.ids_to_symbols(expr, ref).select("cell_id", "gene", "value")


@query("n6_coding_only", """
SELECT cell_id, 'SYM' || s_nationkey AS gene, value FROM expr_a JOIN (SELECT s_nationkey, min(s_suppkey) AS first FROM supplier WHERE s_acctbal > 0 GROUP BY ALL) ON gene = first""")
def _(t):
    coding = t.raw("supplier").filter("s_acctbal > 0").select(
        F.col("s_suppkey").cast("int").alias("gene_id"), F.concat(F.lit("SYM"), F.col("s_nationkey").cast("string")).alias("symbol"), F.col("s_suppkey").alias("ordinal")
    )
    return p.coding_only(t.expr_a, coding).select("cell_id", "gene", "value")


cte("cell_total", "SELECT dataset_id, cell_id, sum(value) AS total FROM expr_a GROUP BY ALL")


def modes(t, **by):
    """Normalisation mode per dataset; ``default`` for the rest."""
    key = F.col("r_regionkey")
    mode = F.lit(by["default"])
    for k, v in by.items():
        if k != "default":
            mode = F.when(key == int(k[1:]), v).otherwise(mode)
    return t.raw("region").select(key.alias("dataset_id"), mode.alias("norm_mode"))


@query("n7_cpm", "SELECT e.dataset_id, e.cell_id, gene, round(value / total * 1e6, 4) AS value FROM expr_a e JOIN cell_total USING (dataset_id, cell_id)")
def _(t):
    return p.normalise(t.expr_a).select("dataset_id", "cell_id", "gene", rnd("value", 4).alias("value"))


@query("n8_lognorm", "SELECT e.dataset_id, e.cell_id, gene, round(ln(1 + value / total * 1e4), 6) AS value FROM expr_a e JOIN cell_total USING (dataset_id, cell_id)")
def _(t):
    return p.normalise(t.expr_a, modes(t, default="log")).select("dataset_id", "cell_id", "gene", rnd("value", 6).alias("value"))


@query("n9_reverse_log", "SELECT dataset_id, cell_id, gene, round(exp(ln(1 + value)) - 1, 4) AS value FROM expr_a")
def _(t):
    logged = t.expr_a.withColumn("value", F.log1p("value"))
    return p.normalise(logged, modes(t, default="expm1")).select("dataset_id", "cell_id", "gene", rnd("value", 4).alias("value"))


@query("n10_mode_per_dataset", """
SELECT e.dataset_id, e.cell_id, gene, round(CASE WHEN e.dataset_id = 0 THEN value WHEN e.dataset_id = 1 THEN ln(1 + value / total * 1e4) ELSE value / total * 1e6 END, 4) AS value
FROM expr_a e JOIN cell_total USING (dataset_id, cell_id)""")
def _(t):
    out = p.normalise(t.expr_a, modes(t, default="cpm", d0="none", d1="log"))
    return out.select("dataset_id", "cell_id", "gene", rnd("value", 4).alias("value"))


@query("n11_given_counts", """
SELECT c.dataset_id, c.cell_id, u AS umi_counts, gene_counts, round(log10(gene_counts) / nullif(log10(u), 0), 6) AS rna_novelty
FROM (SELECT *, CASE WHEN cell_id % 2 = 0 THEN 777.0::DOUBLE ELSE umi_counts END AS u FROM count_info) c""")
def _(t):
    given = info(t).select("dataset_id", "cell_id", F.when(F.col("cell_id") % 2 == 0, 777.0).alias("umi_counts"), F.lit(None).cast("long").alias("gene_counts"))
    out = p.prefer_given_counts(given, info(t))
    return out.withColumn("rna_novelty", rnd("rna_novelty", 6)).select("dataset_id", "cell_id", "umi_counts", "gene_counts", "rna_novelty")


@query("n12_label_rules", r"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p_brand, '#([0-9])([0-9]*)$', '-\2\1 '), 'a', 'A'), 'n', 'N', 'g'), '([A-Z])([a-z]+)', '\2\1')) AS brand FROM part""")
def _(t):
    rows = t.raw("part").select("p_partkey", F.col("p_brand").alias("brand"))
    rules = [("#([0-9])([0-9]*)$", "-$2$1 ", False), ("a", "A", False), ("n", "N", True), ("([A-Z])([a-z]+)", "$2$1", False)]
    return p.apply_rules(rows, "brand", rules, trim=True)


cte("part_sets", "SELECT p_partkey, CASE WHEN p_size <= 20 THEN 'a' WHEN p_size <= 40 THEN 'b' ELSE 'c' END AS dataset_id, p_brand AS brand FROM part")


@query("n12_rules_per_dataset", r"""
SELECT p_partkey, dataset_id, trim(CASE dataset_id WHEN 'a' THEN regexp_replace(regexp_replace(brand, '#([0-9])([0-9]*)$', '-\2\1 '), 'n', 'N', 'g')
 WHEN 'b' THEN regexp_replace(regexp_replace(brand, '([a-z])', '[\1]'), '#', '_') ELSE brand END) AS brand
FROM part_sets WHERE NOT (dataset_id = 'b' AND regexp_matches(brand, '[25]$'))""")
def _(t):
    size = F.col("p_size")
    rows = t.raw("part").select("p_partkey", F.when(size <= 20, "a").when(size <= 40, "b").otherwise("c").alias("dataset_id"), F.col("p_brand").alias("brand"))
    rules = [
        ("b", 3, "drop", "[25]$", None, None), ("b", 1, "replace", "([a-z])", "[$1]", False), ("b", 2, "replace", "#", "_", False),
        ("a", 1, "replace", "#([0-9])([0-9]*)$", "-$2$1 ", False), ("a", 2, "replace", "n", "N", True),
    ]
    table = t.spark.createDataFrame(rules, "dataset_id string, ord int, action string, pattern string, replacement string, every boolean")
    return p.apply_rule_table(rows, "brand", table)


@query("n13_recode", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Neuron' WHEN '2-HIGH' THEN 'Astrocyte' ELSE o_orderpriority END AS cell_type FROM orders")
def _(t):
    rows = t.raw("orders").select("o_orderkey", F.col("o_orderpriority").alias("cell_type"))
    return p.recode(rows, "cell_type", {"1-URGENT": "Neuron", "2-HIGH": "Astrocyte"})


@query("n14_drop_ambiguous", "SELECT o_orderkey, substr(o_orderpriority, 3) AS cell_type FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'")
def _(t):
    rows = t.raw("orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Unknown").otherwise(F.substring("o_orderpriority", 3, 100)).alias("cell_type"))
    return p.drop_ambiguous(rows)


@query("n15_barcodes", "SELECT c_custkey, 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS barcode, 'S' || (c_custkey % 3) AS sample FROM customer")
def _(t):
    raw = F.concat(F.lit("S"), (F.col("c_custkey") % 3).cast("string"), F.lit("_"), F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit(".1"))
    rows = p.label_from_id(t.raw("customer").select("c_custkey", raw.alias("barcode")), "barcode", "_", 1, "sample")
    return p.clean_barcode(rows, "barcode", "S[0-9]_")


@query("n16_drop_listed", "SELECT dataset_id, cell_id, cell_type FROM meta_a WHERE cell_id NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)")
def _(t):
    listed = t.raw("orders").filter("o_custkey % 10 = 0").select(F.col("o_orderkey").alias("cell_id"))
    return p.drop_listed(t.meta_a, listed, "cell_id").select("dataset_id", "cell_id", "cell_type")


LI = ["l_orderkey", "l_suppkey", "l_linenumber", "l_quantity"]


@query("n17_drop_all_duplicated", "SELECT l_orderkey, l_suppkey, l_linenumber, l_quantity FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_suppkey) = 1")
def _(t):
    return p.drop_all_duplicated(t.raw("lineitem").select(*LI), ["l_orderkey", "l_suppkey"])


@query("n18_keep_first", "SELECT l_orderkey, l_suppkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_quantity) = 1")
def _(t):
    return p.keep_first(t.raw("lineitem").select(*LI), ["l_orderkey", "l_suppkey"], "l_linenumber")


@query("n19_common_cells", "SELECT m.dataset_id, m.cell_id FROM meta_a m SEMI JOIN expr_a USING (dataset_id, cell_id)")
def _(t):
    return p.common_cells(t.expr_a, t.meta_a)[1].select("dataset_id", "cell_id")


@query("n19_common_genes", "SELECT DISTINCT l_returnflag AS part, p_partkey % 997 AS gene FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 997 IN (SELECT p_partkey % 997 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey % 997 HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem))")
def _(t):
    parts = t.raw("lineitem").select(F.col("l_returnflag").alias("part"), (F.col("l_partkey") % 997).alias("gene")).distinct()
    return p.common_genes(parts).select("part", "gene")


cte("batch_rows", "SELECT l_returnflag AS batch, l_orderkey AS cell_id, l_suppkey AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY ALL")


cte("batch_ra", """
SELECT cell_id, gene, value FROM batch_rows WHERE batch = 'R' AND gene IN (SELECT gene FROM batch_rows WHERE batch = 'A')
UNION ALL SELECT cell_id, gene, value FROM batch_rows WHERE batch = 'A' AND gene IN (SELECT gene FROM batch_rows WHERE batch = 'R') AND cell_id NOT IN (SELECT cell_id FROM batch_rows WHERE batch = 'R')""")


@query("n20_union_batches", """
SELECT cell_id, gene, value FROM batch_ra WHERE gene IN (SELECT gene FROM batch_rows WHERE batch = 'N')
UNION ALL SELECT cell_id, gene, value FROM batch_rows WHERE batch = 'N' AND gene IN (SELECT gene FROM batch_ra) AND cell_id NOT IN (SELECT cell_id FROM batch_ra)""")
def _(t):
    rows = t.raw("lineitem").groupBy("l_returnflag", F.col("l_orderkey").alias("cell_id"), F.col("l_suppkey").alias("gene")).agg(F.sum("l_quantity").alias("value"))
    one = lambda b: rows.filter(F.col("l_returnflag") == b).drop("l_returnflag")
    return p.union_batches(p.union_batches(one("R"), one("A")), one("N"))


cte("dup_cells", "SELECT o_custkey AS barcode, l_orderkey AS cell_id, p_size AS gene, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL")
cte("dup_ranks", """
SELECT barcode, cell_id, gene, rank() OVER w + (count(*) OVER (PARTITION BY barcode, cell_id, value) - 1) / 2.0::DOUBLE AS rk
FROM (SELECT c.barcode, c.cell_id, g.gene, coalesce(d.value, 0) AS value FROM (SELECT DISTINCT barcode, cell_id FROM dup_cells) c CROSS JOIN genes_b g
 LEFT JOIN dup_cells d ON d.barcode = c.barcode AND d.cell_id = c.cell_id AND d.gene = g.gene) WINDOW w AS (PARTITION BY barcode, cell_id ORDER BY value)""")


def barcoded(t):
    return (
        t.raw("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        .join(t.raw("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.raw("part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("o_custkey").alias("barcode"), F.col("l_orderkey").alias("cell_id"), F.col("p_size").alias("gene"))
        .agg(F.sum("l_quantity").alias("value"))
    )


@query("n21_identical_cells", """
SELECT barcode, CAST(sum(c) AS BIGINT) AS n_cells FROM (SELECT barcode, profile, count(*) AS c FROM (
 SELECT barcode, cell_id, string_agg(gene || ':' || rk, ',' ORDER BY gene) AS profile FROM dup_ranks GROUP BY ALL) GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL""")
def _(t):
    return p.identical_cells(barcoded(t), "barcode", t.genes_b.n)


@query("n21_near_duplicates", """
SELECT barcode, cell_a, cell_b, round((n * sxy - sa * sb) / nullif(sqrt(n * saa - sa * sa) * sqrt(n * sbb - sb * sb), 0), 5) AS r FROM (
 SELECT a.barcode, a.cell_id AS cell_a, b.cell_id AS cell_b, count(*)::DOUBLE AS n, sum(a.rk) AS sa, sum(b.rk) AS sb, sum(a.rk * a.rk) AS saa, sum(b.rk * b.rk) AS sbb, sum(a.rk * b.rk) AS sxy
 FROM dup_ranks a JOIN dup_ranks b ON a.barcode = b.barcode AND a.gene = b.gene AND a.cell_id < b.cell_id GROUP BY ALL)""")
def _(t):
    return p.near_duplicates(barcoded(t), "barcode", t.genes_b.n).select("barcode", "cell_a", "cell_b", rnd("r", 5).alias("r"))


@query("n22_strip_version", "SELECT p_partkey, 'ENSG' || p_partkey AS gene_id FROM part")
def _(t):
    key = F.col("p_partkey")
    rows = t.raw("part").select("p_partkey", F.concat(F.lit("ENSG"), key.cast("string"), F.lit("."), (key % 15).cast("string")).alias("gene_id"))
    return p.strip_version(rows, "gene_id")


@query("n23_layer_fallback", "SELECT dataset_id, cell_id, gene, CASE WHEN dataset_id = 2 THEN value * 2 ELSE value END AS value FROM expr_a")
def _(t):
    counts = t.expr_a.withColumn("value", F.when(F.col("dataset_id") == 2, 0.0).otherwise(F.col("value"))).withColumn("layer", F.lit("counts"))
    data = t.expr_a.withColumn("value", F.col("value") * 2).withColumn("layer", F.lit("data"))
    return p.choose_layer(counts.unionByName(data)).select("dataset_id", "cell_id", "gene", "value")
