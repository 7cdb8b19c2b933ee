"""The engine's input tables, derived from the given star-schema tables.

A: few datasets (regions), many genes (suppliers), cells are orders, cell types are priorities.
B: many datasets (nations), 50 genes (part sizes), cell types are order statuses.
F: a dense matrix, vectors as cells and positions as genes.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import correlate, crossgroup, enrich, integrate, measure, rankings, recovery, saturation, similarity
from ..session import fit_shuffles, prepare
from ..schemas import GeneSpan, gene_span
from ..sources.stage import content_key, input_bytes, materialize, stage_path
from .oracle import cte

MIN_CELL_B = 15
SEED = 7
DRAWS = 1000
N_ITER = 100
N_DRAWS = 1000
MIN_TARGETS = 3
N_SETS_ITER = 10_000
TIER_K = 20
K = 10  # profiles of fixture B have 50 genes


class Tables:
    """Given tables and derived inputs of one data folder; heavy ones are stage tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = fit_shuffles(prepare(spark), input_bytes(spark, sf_dir)), sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def content(self) -> str:
        """Names the input files and the parameters that stage tables are made with."""
        return content_key(
            self.spark, [self.sf_dir], min_cell=MIN_CELL_B, seed=SEED, draws=(DRAWS, N_ITER, N_DRAWS, N_SETS_ITER), k=(K, TIER_K), min_targets=MIN_TARGETS
        )

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return materialize(self.spark, self.path(name), build)

    def path(self, name: str) -> str:
        return stage_path(self.spark, self.content, name)

    # ---- joined base
    @cached_property
    def order_region(self) -> DataFrame:
        orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
        cust = self.raw("customer").select("c_custkey", "c_nationkey")
        nation = self.raw("nation").select("n_nationkey", "n_regionkey")
        return orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).join(
            nation, F.col("c_nationkey") == F.col("n_nationkey")
        )

    # ---- fixture A
    @cached_property
    def expr_a(self) -> DataFrame:
        li = self.raw("lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
        return (
            li.join(self.order_region, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(
                F.col("n_regionkey").alias("dataset_id"),
                F.col("o_orderpriority").alias("cell_type"),
                F.col("l_orderkey").alias("cell_id"),
                F.col("l_suppkey").cast("int").alias("gene"),
            )
            .agg(F.sum("l_quantity").alias("value"))
        )

    @cached_property
    def meta_a(self) -> DataFrame:
        return self.order_region.select(
            F.col("n_regionkey").alias("dataset_id"),
            F.col("o_orderkey").alias("cell_id"),
            F.col("o_orderpriority").alias("cell_type"),
        )

    @cached_property
    def genes_a(self) -> GeneSpan:
        return gene_span(self.raw("supplier").select(F.col("s_suppkey").cast("int").alias("gene")))

    # ---- fixture B
    @cached_property
    def expr_b(self) -> DataFrame:
        def build():
            li = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
            part = self.raw("part").select("p_partkey", "p_size")
            return (
                li.join(part, F.col("l_partkey") == F.col("p_partkey"))
                .join(self.order_region, F.col("l_orderkey") == F.col("o_orderkey"))
                .groupBy(
                    F.col("c_nationkey").alias("dataset_id"),
                    F.col("o_orderstatus").alias("cell_type"),
                    F.col("l_orderkey").alias("cell_id"),
                    F.col("p_size").alias("gene"),
                )
                .agg(F.sum("l_quantity").alias("value"))
            )

        return self.stage("expr_b", build)

    @cached_property
    def meta_b(self) -> DataFrame:
        return self.order_region.select(
            F.col("c_nationkey").alias("dataset_id"),
            F.col("o_orderkey").alias("cell_id"),
            F.col("o_orderstatus").alias("cell_type"),
        )

    @cached_property
    def genes_b(self) -> GeneSpan:
        return gene_span(self.raw("part").select(F.col("p_size").alias("gene")))

    @cached_property
    def species(self) -> DataFrame:
        """dataset_id -> Human for the nations of regions 0 and 1, else Mouse."""
        return self.raw("nation").select(
            F.col("n_nationkey").alias("dataset_id"),
            F.when(F.col("n_regionkey") <= 1, "Human").otherwise("Mouse").alias("species"),
        )

    @cached_property
    def agg_a(self) -> DataFrame:
        return self.stage("agg_a", lambda: correlate.rank_sum_rank(self.expr_a, self.meta_a, self.genes_a))

    @cached_property
    def pairs_b(self) -> DataFrame:
        return self.stage(
            "pairs_b", lambda: correlate.pair_correlation(self.expr_b, self.meta_b, self.genes_b, MIN_CELL_B)
        )

    @cached_property
    def info_b(self) -> DataFrame:
        """Dataset metadata: species, platform, cells, types, measured genes."""
        key = F.col("n_nationkey")
        platform = self.raw("nation").select(
            key.alias("dataset_id"),
            F.col("n_name").alias("label"),
            F.when(key % 3 == 0, F.concat(F.lit("10x 3' v"), (key % 2 + 1).cast("string")))
            .otherwise(F.concat(F.lit("Smart-seq"), (key % 3).cast("string")))
            .alias("platform"),
        )
        return measure.genes_per_dataset(
            self.msr_b, self.species.join(self.types_b, "dataset_id").join(platform, "dataset_id")
        )

    @cached_property
    def agg_b(self) -> DataFrame:
        return self.stage(
            "agg_b", lambda: correlate.rank_sum_rank(self.expr_b, self.meta_b, self.genes_b, MIN_CELL_B, self.pairs_b)
        )

    @cached_property
    def types_b(self) -> DataFrame:
        return measure.type_counts(self.meta_b)

    @cached_property
    def msr_b(self) -> DataFrame:
        return measure.measured(self.agg_b, self.types_b)

    @cached_property
    def comsr_b(self) -> DataFrame:
        """Co-measured datasets per (species, gene pair), both directions."""
        return self.stage("comsr_b", lambda: measure.comeasured(measure.comeasured_pairs(self.expr_b, self.meta_b, self.genes_b, self.species, MIN_CELL_B)))

    @cached_property
    def gene_ref(self) -> DataFrame:
        """(species, gene, symbol): GN12 for human, Gn12 for mouse."""
        g = self.raw("part").select(F.col("p_size").alias("gene")).distinct()
        text = F.col("gene").cast("string")
        return g.select(F.lit("Human").alias("species"), "gene", F.concat(F.lit("GN"), text).alias("symbol")).unionByName(
            g.select(F.lit("Mouse").alias("species"), "gene", F.concat(F.lit("Gn"), text).alias("symbol"))
        )

    @cached_property
    def tfs(self) -> DataFrame:
        """(tf, family): every fifth gene is a regulator."""
        g = self.raw("part").select(F.col("p_size").alias("tf")).distinct()
        return g.filter("tf % 5 = 0").withColumn("family", (F.col("tf") % 3).cast("int"))

    @cached_property
    def ortho(self) -> DataFrame:
        """(gene_hg, gene_mm, symbol_hg, symbol_mm, id): genes that are no multiple of seven."""
        g = self.raw("part").select(F.col("p_size").alias("gene_hg")).distinct().filter("gene_hg % 7 <> 0")
        text = F.col("gene_hg").cast("string")
        hg, mm = F.concat(F.lit("GN"), text), F.concat(F.lit("Gn"), text)
        return g.select(
            "gene_hg",
            F.col("gene_hg").alias("gene_mm"),
            hg.alias("symbol_hg"),
            mm.alias("symbol_mm"),
            F.concat_ws("_", hg, mm).alias("id"),
        )

    @cached_property
    def profile(self) -> DataFrame:
        """(species, tf, dataset_id, gene, score) of the datasets that measure the regulator."""

        def build():
            full = correlate.mirrored(self.agg_b, "rsr")
            return measure.profiles(full, self.tfs.select("tf"), self.msr_b, self.species)

        return self.stage("profile", build)

    @cached_property
    def tf_genes(self) -> DataFrame:
        return self.tfs.select(F.col("tf").alias("gene"))

    @cached_property
    def full_b(self) -> DataFrame:
        """(dataset_id, gene, partner, rsr): both directions of the aggregate."""
        return correlate.mirrored(self.agg_b, "rsr")

    @cached_property
    def imputed(self) -> DataFrame:
        return self.stage("imputed", lambda: rankings.impute_to_median(self.profile, self.msr_b))

    @cached_property
    def rank_tf(self) -> DataFrame:
        return self.stage(
            "rank_tf", lambda: rankings.consensus_ranks(self.profile, self.msr_b, self.comsr_b, K)
        )

    @cached_property
    def rank_ortho(self) -> DataFrame:
        return rankings.join_ortholog_ranks(self.rank_tf, self.ortho)

    @cached_property
    def sim_tf(self) -> DataFrame:
        return self.stage("sim_tf", lambda: similarity.regulator_similarity(self.profile, K))

    @cached_property
    def null_sim(self) -> DataFrame:
        def build():
            null = similarity.null_profiles(self.full_b, self.msr_b, self.tf_genes, self.species, DRAWS, SEED)
            return similarity.null_similarity(null, K)

        return self.stage("null_sim", build)

    @cached_property
    def summ_tf(self) -> DataFrame:
        n_exp = self.profile.groupBy("species", "tf").agg(F.count_distinct("dataset_id").alias("n_exp"))
        return similarity.similarity_summary(self.sim_tf, ["species", "tf"], n_exp)

    @cached_property
    def summ_null(self) -> DataFrame:
        return similarity.similarity_summary(self.null_sim, ["species", "iter"])

    @cached_property
    def n_exp(self) -> DataFrame:
        return self.profile.groupBy("species", "tf").agg(F.count_distinct("dataset_id").alias("n_exp"))

    @cached_property
    def step_summ(self) -> DataFrame:
        def build():
            return saturation.step_summary(saturation.step_overlaps(self.imputed, K, N_ITER, SEED))

        return self.stage("step_summ", build)

    @cached_property
    def rank_ortho_s(self) -> DataFrame:
        return self.stage("rank_ortho", lambda: self.rank_ortho)

    @cached_property
    def ortho_tfs(self) -> DataFrame:
        return self.rank_ortho_s.select("tf_id").distinct()

    def overlaps(self, reverse: bool) -> DataFrame:
        """Top (or bottom) overlaps of all regulators; the quantiles read them three times."""
        return self.stage("overlaps_bottom" if reverse else "overlaps_top", lambda: crossgroup.overlap_table(self.rank_ortho_s, K, reverse))

    def quantiles(self, reverse: bool) -> DataFrame:
        return crossgroup.overlap_quantiles(self.overlaps(reverse), self.ortho_tfs)

    @cached_property
    def quant_top(self) -> DataFrame:
        return self.quantiles(False)

    @cached_property
    def wide_sim(self) -> DataFrame:
        def build():
            cor = crossgroup.side_correlation(self.rank_ortho_s)
            return crossgroup.wide_similarity(cor, self.quant_top, self.quantiles(True))

        return self.stage("wide_sim", build)

    # ---- curated records, labels, binding
    @cached_property
    def records_1(self) -> DataFrame:
        p = F.col("p_partkey")
        test = (
            F.when(p % 5 == 0, "ChIP-seq").when(p % 5 == 1, "Reporter assay (Luciferase)").when(p % 5 == 2, "siRNA Perturbation, then binding")
            .when(p % 5 == 3, "Chromatin binding assay")
        )
        return self.raw("part").select(
            p.alias("record_id"),
            F.concat(F.lit("GN"), (p % 50 + 1).cast("string")).alias("tf"),
            F.concat(F.lit("GN"), F.col("p_size").cast("string")).alias("target"),
            F.when(p % 2 == 0, "human").otherwise("mouse").alias("species_name"),
            test.alias("experiment"),
            F.when(p % 7 == 0, F.lit(None)).when(p % 7 == 1, "Survey;Other").otherwise(F.col("p_type")).alias("source_list"),
        )

    @cached_property
    def records_2(self) -> DataFrame:
        p = F.col("p_partkey")
        return self.raw("part").select(
            p.alias("record_id"),
            F.concat(F.lit("GN"), (p % 50 + 1).cast("string")).alias("tf"),
            F.col("p_name").alias("cell_type"),
            (p + 10_000_000).cast("string").alias("pubmed"),
        )

    @cached_property
    def records_3(self) -> DataFrame:
        p = F.col("p_partkey")
        lead = F.when(p % 2 == 0, "GN").otherwise("Gn")
        return self.raw("part").select(
            p.alias("record_id"),
            F.concat(lead, (p % 47 + 1).cast("string")).alias("tf"),
            F.concat(lead, F.col("p_size").cast("string")).alias("target"),
            F.col("p_name").alias("cell_type"),
        )

    @cached_property
    def tf_names(self) -> DataFrame:
        return self.gene_ref.filter("gene % 5 <> 4").select(F.upper("symbol").alias("symbol")).distinct()

    @cached_property
    def curated_sym(self) -> DataFrame:
        p = F.col("p_partkey")
        lead = F.when(p % 2 == 0, "GN").otherwise("Gn")
        return (
            self.raw("part")
            .select(
                F.concat(lead, (p % 50 + 1).cast("string")).alias("tf_symbol"),
                F.concat(lead, F.col("p_size").cast("string")).alias("target_symbol"),
            )
            .distinct()
        )

    @cached_property
    def labels(self) -> DataFrame:
        return self.stage("labels", lambda: recovery.curated_labels(self.curated_sym, self.gene_ref, self.ortho))

    @cached_property
    def universe(self) -> DataFrame:
        present = self.rank_tf.select("species", "gene").distinct()
        return recovery.eligible_universe(self.curated_sym, "target_symbol", present, self.gene_ref, self.ortho)

    @cached_property
    def doc_scores(self) -> DataFrame:
        lab = self.raw("labels").select("doc_id", "quality")
        return self.raw("documents").join(lab, "doc_id").select(
            "lang", "doc_id", F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("label")
        )

    @cached_property
    def bind_all(self) -> DataFrame:
        """Binding by species: the mouse matrix differs and lacks regulators that are multiples of three."""
        cols = ["species", "tf", "gene", "bind_score"]
        hg = self.bind.withColumn("species", F.lit("Human")).select(*cols)
        tf = (F.lit(1) + (F.col("p_partkey") * 7) % 50).cast("int")
        mm = (
            self.raw("part")
            .groupBy(tf.alias("tf"), F.col("p_size").alias("gene"))
            .agg(rnd(F.avg("p_retailprice"), 2).alias("bind_score"))
            .filter("tf % 3 <> 0")
        )
        return hg.unionByName(mm.withColumn("species", F.lit("Mouse")).select(*cols))

    @cached_property
    def rank_all(self) -> DataFrame:
        return self.stage("rank_all", lambda: integrate.join_binding(self.rank_tf, self.bind_all))

    def scores(self, source: str) -> DataFrame:
        """(species, tf, gene, score) of one evidence source, larger is better."""
        value = {
            "coexpr": F.col("avg_aggr_coexpr"),
            "reverse": -F.col("avg_aggr_coexpr"),
            "bind": F.col("bind_score"),
            "integrated": -F.col("rank_integrated").cast("double"),
        }[source]
        table = self.rank_tf if source in ("coexpr", "reverse") else self.rank_all
        return table.select("species", "tf", "gene", value.alias("score"))

    def null_auc(self, source: str) -> DataFrame:
        return self.stage(
            f"null_{source}",
            lambda: recovery.null_auc(self.scores(source), self.labels, self.universe, N_DRAWS, SEED),
        )

    def recovery(self, source: str) -> DataFrame:
        def build():
            return recovery.compare_to_null(recovery.observed_auc(self.scores(source), self.labels), self.null_auc(source))

        return self.stage(f"recovery_{source}", build)

    @cached_property
    def wide_auc(self) -> DataFrame:
        first, *others = [(s, self.recovery(s)) for s in ("coexpr", "bind", "integrated", "reverse")]
        return self.stage("wide_auc", lambda: recovery.join_sources(first, *others, min_targets=MIN_TARGETS))

    @cached_property
    def evidence(self) -> DataFrame:
        return self.stage("evidence", lambda: integrate.ortholog_evidence(self.rank_all, self.ortho))

    @cached_property
    def eligibility(self) -> DataFrame:
        return integrate.eligibility(self.rank_all, self.ortho)

    @cached_property
    def tiers(self) -> DataFrame:
        return self.stage("tiers", lambda: integrate.tiers(self.rank_all, self.evidence, self.ortho, TIER_K))

    @cached_property
    def enriched(self) -> DataFrame:
        def build():
            sets = self.raw("part").select(F.col("p_brand").alias("set_id"), F.col("p_size").alias("gene")).distinct()
            return enrich.enrichment(self.rank_tf, sets, "rank_aggr_coexpr", N_SETS_ITER, SEED)

        return self.stage("enriched", build)

    def term_counts(self, cutoff: float) -> DataFrame:
        tested = self.rank_tf.select("species", "tf").distinct()
        return enrich.terms_per_tf(enrich.significant(self.enriched, cutoff), tested)

    @cached_property
    def curated(self) -> DataFrame:
        """Distinct (tf, target) ordinals, self pairs included."""
        return (
            self.raw("part")
            .select((F.lit(1) + F.col("p_partkey") % 50).cast("int").alias("tf"), F.col("p_size").alias("target"))
            .distinct()
        )

    @cached_property
    def bind(self) -> DataFrame:
        """(tf, gene, bind_score): absent pairs are not measured."""
        return (
            self.raw("part")
            .groupBy((F.lit(1) + F.col("p_partkey") % 50).cast("int").alias("tf"), F.col("p_size").alias("gene"))
            .agg(rnd(F.avg("p_retailprice"), 2).alias("bind_score"))
        )

    # ---- fixture F
    @cached_property
    def expr_f(self) -> DataFrame:
        e = self.raw("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("gene", "x"))
        return e.select(
            F.lit(0).alias("dataset_id"),
            F.col("label").alias("cell_type"),
            F.col("vec_id").alias("cell_id"),
            "gene",
            F.floor(F.col("x").cast("double") * 1000 + 0.5).cast("double").alias("value"),
        )

    @cached_property
    def meta_f(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.lit(0).alias("dataset_id"), F.col("vec_id").alias("cell_id"), F.col("label").alias("cell_type")
        )

    @cached_property
    def genes_f(self) -> GeneSpan:
        return gene_span(self.expr_f.select("gene").distinct())


def f10(x: str) -> str:
    return f"(floor(({x}) * 1e10 + 0.5) / 1e10)"


cte("order_region", """
SELECT o_orderkey, o_orderpriority, o_orderstatus, c_nationkey, n_regionkey
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
""")
cte("expr_a", """
SELECT n_regionkey AS dataset_id, o_orderpriority AS cell_type, l_orderkey AS cell_id,
       CAST(l_suppkey AS INTEGER) AS gene, sum(l_quantity) AS value
FROM lineitem JOIN order_region ON l_orderkey = o_orderkey GROUP BY ALL
""")
cte("meta_a", "SELECT n_regionkey AS dataset_id, o_orderkey AS cell_id, o_orderpriority AS cell_type FROM order_region")
cte("expr_b", """
SELECT c_nationkey AS dataset_id, o_orderstatus AS cell_type, l_orderkey AS cell_id, p_size AS gene,
       sum(l_quantity) AS value
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN order_region ON l_orderkey = o_orderkey GROUP BY ALL
""")
cte("meta_b", "SELECT c_nationkey AS dataset_id, o_orderkey AS cell_id, o_orderstatus AS cell_type FROM order_region")
cte("expr_f", """
SELECT 0 AS dataset_id, label AS cell_type, vec_id AS cell_id, CAST(i - 1 AS INTEGER) AS gene,
       floor(CAST(embedding[i] AS DOUBLE) * 1000 + 0.5) AS value
FROM embeddings, (SELECT unnest(range(1, 65)) AS i)
""")
cte("meta_f", "SELECT 0 AS dataset_id, vec_id AS cell_id, label AS cell_type FROM embeddings")
cte("species", "SELECT n_nationkey AS dataset_id, CASE WHEN n_regionkey <= 1 THEN 'Human' ELSE 'Mouse' END AS species FROM nation")
cte("genes_a", "SELECT DISTINCT CAST(s_suppkey AS INTEGER) AS gene FROM supplier")
cte("genes_b", "SELECT DISTINCT p_size AS gene FROM part")


def correlation_ctes(tag: str, min_cell: int) -> None:
    """Pair correlations of one fixture, by plain self-joins."""
    cte(f"size_{tag}", f"SELECT dataset_id, cell_type, count(*) AS n FROM meta_{tag} GROUP BY ALL")
    cte(f"mom_{tag}", f"""
SELECT dataset_id, cell_type, gene, count(*) FILTER (value > 0) AS nz, sum(value) AS sx, sum(value * value) AS sxx
FROM expr_{tag} GROUP BY ALL""")
    cte(f"elig_{tag}", f"SELECT * FROM mom_{tag} WHERE nz >= {min_cell}")
    cte(f"sxy_{tag}", f"""
SELECT a.dataset_id, a.cell_type, a.gene AS gene_a, b.gene AS gene_b, sum(a.value * b.value) AS sxy
FROM expr_{tag} a JOIN expr_{tag} b USING (dataset_id, cell_type, cell_id) WHERE a.gene >= b.gene GROUP BY ALL""")
    cte(f"pair_cor_{tag}", f"""
SELECT dataset_id, cell_type, gene_a, gene_b,
       CASE WHEN gene_a = gene_b THEN 1.0::DOUBLE ELSE {f10('(n * sxy - sa * sb) / (sqrt(n * saa - sa * sa) * sqrt(n * sbb - sb * sb))')} END AS r
FROM (SELECT a.dataset_id, a.cell_type, a.gene AS gene_a, b.gene AS gene_b, n::DOUBLE AS n,
             a.sx AS sa, b.sx AS sb, a.sxx AS saa, b.sxx AS sbb, coalesce(p.sxy, 0) AS sxy
      FROM elig_{tag} a JOIN elig_{tag} b USING (dataset_id, cell_type) JOIN size_{tag} USING (dataset_id, cell_type)
      LEFT JOIN sxy_{tag} p ON p.dataset_id = a.dataset_id AND p.cell_type = a.cell_type
           AND p.gene_a = a.gene AND p.gene_b = b.gene
      WHERE a.gene >= b.gene)
WHERE n * saa - sa * sa > 0 AND n * sbb - sb * sb > 0""")


def aggregate_ctes(tag: str, base: str, genes: str) -> None:
    """The aggregate of pair_cor_<tag>; sizes and eligible genes are those of ``base``."""
    cte(f"full_cor_{tag}", f"""
SELECT dataset_id, cell_type, a.gene AS gene_a, b.gene AS gene_b, r,
       EXISTS (SELECT 1 FROM elig_{base} e WHERE e.dataset_id = s.dataset_id AND e.cell_type = s.cell_type) AS used
FROM size_{base} s CROSS JOIN {genes} a JOIN {genes} b ON a.gene >= b.gene
LEFT JOIN pair_cor_{tag} p USING (dataset_id, cell_type)
""".replace("LEFT JOIN pair_cor_" + tag + " p USING (dataset_id, cell_type)",
            f"LEFT JOIN pair_cor_{tag} p ON p.dataset_id = s.dataset_id AND p.cell_type = s.cell_type AND p.gene_a = a.gene AND p.gene_b = b.gene")
        .replace("SELECT dataset_id, cell_type, a.gene AS gene_a", "SELECT s.dataset_id, s.cell_type, a.gene AS gene_a"))
    cte(f"ranked_cor_{tag}", f"""
SELECT *, CASE WHEN used THEN rank() OVER (PARTITION BY dataset_id, cell_type
       ORDER BY CASE WHEN gene_a = gene_b THEN 1 ELSE coalesce(r, 0) END DESC) END AS pair_rank
FROM full_cor_{tag}""")
    cte(f"agg_{tag}", f"""
SELECT dataset_id, gene_a, gene_b,
       rank() OVER (PARTITION BY dataset_id ORDER BY s DESC) / (count(*) OVER (PARTITION BY dataset_id))::DOUBLE AS rsr,
       n_na
FROM (SELECT dataset_id, gene_a, gene_b, coalesce(sum(pair_rank), 0) AS s,
             CAST(count(*) FILTER (r IS NULL) AS INTEGER) AS n_na
      FROM ranked_cor_{tag} GROUP BY ALL)""")


correlation_ctes("a", correlate.MIN_CELL)
correlation_ctes("b", MIN_CELL_B)
aggregate_ctes("a", "a", "genes_a")
aggregate_ctes("b", "b", "genes_b")
cte("full_b", """
SELECT dataset_id, gene_a AS gene, gene_b AS partner, rsr, n_na FROM agg_b
UNION ALL SELECT dataset_id, gene_b, gene_a, rsr, n_na FROM agg_b WHERE gene_a <> gene_b""")
cte("types_b", "SELECT dataset_id, count(DISTINCT cell_type) AS n_celltypes, count(*) AS n_cells FROM meta_b GROUP BY ALL")
cte("msr_b", """
SELECT a.dataset_id, a.gene_a AS gene, n_na <> n_celltypes AS measured
FROM agg_b a JOIN types_b USING (dataset_id) WHERE gene_a = gene_b""")
cte("comsr_b", """
SELECT species, gene, partner, CAST(sum(CASE WHEN n_na < n_celltypes THEN 1 ELSE 0 END) AS BIGINT) AS n_comeasured
FROM full_b JOIN types_b USING (dataset_id) JOIN species USING (dataset_id) GROUP BY ALL""")
cte("tfs", "SELECT DISTINCT p_size AS tf, CAST(p_size % 3 AS INTEGER) AS family FROM part WHERE p_size % 5 = 0")
cte("ortho", """
SELECT DISTINCT p_size AS gene_hg, p_size AS gene_mm, 'GN' || p_size AS symbol_hg, 'Gn' || p_size AS symbol_mm,
       'GN' || p_size || '_Gn' || p_size AS id FROM part WHERE p_size % 7 <> 0""")
cte("gene_ref", """
SELECT DISTINCT 'Human' AS species, p_size AS gene, 'GN' || p_size AS symbol FROM part
UNION ALL SELECT DISTINCT 'Mouse', p_size, 'Gn' || p_size FROM part""")
cte("profile", """
SELECT species, t.tf, f.dataset_id, f.gene, f.rsr AS score
FROM full_b f JOIN tfs t ON f.partner = t.tf JOIN species s ON s.dataset_id = f.dataset_id
JOIN msr_b m ON m.dataset_id = f.dataset_id AND m.gene = t.tf AND m.measured""")
cte("curated", "SELECT DISTINCT CAST(1 + p_partkey % 50 AS INTEGER) AS tf, p_size AS target FROM part")
cte("bind", """
SELECT CAST(1 + p_partkey % 50 AS INTEGER) AS tf, p_size AS gene, round(avg(p_retailprice), 2) AS bind_score
FROM part GROUP BY ALL""")
