"""Gene-gene correlation per cell type and its rank aggregation per dataset.

The expensive step is X'X over cells. A join of the count table with itself would emit one row per
pair of genes in every cell; here tasks multiply blocks of genes for bounded chunks of cells
(``tiles``). Cell types of any size are split by chunk, gene lists of any size by tile, and the only
pairs ever materialised are the result rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tiles
from ..functions.exprs import fix10, rnd
from ..functions.ranks import grouped_rank
from ..functions.stats import large_group_median
from ..schemas import GeneSpan
from ..sources.stage import written
from .tiles import CHUNK_CELLS, GENE_BLOCK, TILE_ROWS

MIN_CELL = 20
GROUP = ("dataset_id", "cell_type")
#: Tasks per block of genes that make the rows of all pairs.
SPINE_TASKS = 8


# ---------------------------------------------------------------- per gene and cell type

def type_sizes(meta: DataFrame, keys: tuple[str, ...] = GROUP) -> DataFrame:
    """Cells per (dataset, cell type), cells without any count included."""
    return meta.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"))


def gene_moments(expr: DataFrame) -> DataFrame:
    return tiles.gene_moments(expr, GROUP)


def eligible_genes(expr: DataFrame, min_cell: int = MIN_CELL) -> DataFrame:
    """Genes with enough positive cells in a cell type; all others are NA there."""
    return gene_moments(expr).filter(F.col("nz") >= min_cell).select(*GROUP, F.col("gene").cast(expr.schema["gene"].dataType), "nz")


def subset_and_filter(expr: DataFrame, cell_type: str, min_cell: int = MIN_CELL) -> DataFrame:
    """Counts of one cell type, genes below the minimum removed."""
    one = expr.filter(F.col("cell_type") == cell_type)
    return one.join(eligible_genes(one, min_cell).drop("nz"), [*GROUP, "gene"], "left_semi")


# ---------------------------------------------------------------- all pairs

def pair_correlation(
    expr: DataFrame,
    meta: DataFrame,
    genes: GeneSpan,
    min_cell: int = MIN_CELL,
    gene_block: int = GENE_BLOCK,
    chunk_cells: int = CHUNK_CELLS,
    raw_products: bool = False,
    keys: tuple[str, ...] = GROUP,
    queries_from: int = 0,
) -> DataFrame:
    """Pearson of every defined pair ``gene_a >= gene_b`` per group, here (dataset, cell type).

    ``queries_from`` is a block number: ordinals from that block on are query columns, and only their
    pairs with the other columns are computed.

    Undefined pairs (a gene below ``min_cell`` or without variance) have no row. Zeros count: the
    number of cells comes from ``meta``. r is fixed to 10 decimals, so that ranks are repeatable.
    """
    return tiles.product_rows(expr, meta, genes, keys, min_cell, raw_products, gene_block, chunk_cells, queries_from)


# ---------------------------------------------------------------- other correlation methods

def rank_values(expr: DataFrame, meta: DataFrame) -> DataFrame:
    """Replace counts by their average rank over the cells, shifted so that zero cells stay zero.

    The zeros of a gene are one tie block known by its size; Pearson ignores the shift, so the
    table stays sparse. ``positive`` keeps the information needed for the minimum-cell rule.
    """
    keys = [*GROUP, "gene"]
    nonzero = expr.filter(F.col("value") != 0)
    ranked = grouped_rank(nonzero, keys, "value", "_rk", descending=False, method="avg")
    counts = nonzero.groupBy(*keys).agg(
        F.count_if(F.col("value") < 0).alias("_neg"), F.count(F.lit(1)).alias("_nonzero")
    )
    zeros = F.col("n_cells") - F.col("_nonzero")
    # a positive value comes after all zero cells, a negative one before them
    shifted = F.col("_rk") + F.when(F.col("value") > 0, zeros).otherwise(0) - (F.col("_neg") + (zeros + 1) / 2.0)
    return (
        ranked.join(counts, keys)
        .join(type_sizes(meta), list(GROUP))
        .select(*GROUP, "cell_id", "gene", shifted.alias("value"))
    )


def spearman_correlation(
    expr: DataFrame, meta: DataFrame, genes: GeneSpan, min_cell: int = MIN_CELL
) -> DataFrame:
    """Spearman of every pair: Pearson of :func:`rank_values`, genes below the minimum left out."""
    return pair_correlation(_eligible_ranks(expr, meta, min_cell), meta, genes, min_cell=0)


def _eligible_ranks(expr: DataFrame, meta: DataFrame, min_cell: int) -> DataFrame:
    return rank_values(expr.join(eligible_genes(expr, min_cell).drop("nz"), [*GROUP, "gene"], "left_semi"), meta)


def midweights(expr: DataFrame, meta: DataFrame, min_cell: int = MIN_CELL) -> DataFrame:
    """Biweight terms per value, plus the term ``x0`` of a zero cell, for eligible genes.

    Terms are (x - median)(1 - u^2)^2 for |u| < 1 with u = (x - median) / (9 MAD), scaled to unit
    length; a gene with MAD zero uses x - mean. Median and MAD include the zero cells: these are
    weighted counts of the distinct values, so the zero block is one row however large it is.
    """
    keys = [*GROUP, "gene"]
    kept = expr.join(eligible_genes(expr, min_cell).drop("nz"), keys, "left_semi")
    sizes = type_sizes(meta)
    counts = kept.filter(F.col("value") != 0).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("c"))
    zero = (
        counts.groupBy(*keys)
        .agg(F.sum("c").alias("_nonzero"))
        .join(sizes, list(GROUP))
        .select(*keys, F.lit(0.0).alias("value"), (F.col("n_cells") - F.col("_nonzero")).alias("c"))
        .filter(F.col("c") > 0)
    )
    # distinct values with counts: small against the cells, and read by five branches below
    dist = written(counts.unionByName(zero), "values")
    mean = dist.groupBy(*keys).agg((F.sum(F.col("value") * F.col("c")) / F.sum("c")).alias("_mean"))
    dev = dist.join(large_group_median(dist, keys, "value", "_med", "c").join(mean, keys), keys)
    dev = written(dev.withColumn("_dev", F.abs(F.col("value") - F.col("_med"))), "deviations")
    mad = large_group_median(dev, keys, "_dev", "_mad", "c")
    x = F.col("value")
    u = F.try_divide(x - F.col("_med"), 9.0 * F.col("_mad"))
    w = F.when(F.abs(u) < 1, (1 - u * u) * (1 - u * u)).otherwise(0.0)
    term = F.when(F.col("_mad") > 0, (x - F.col("_med")) * w).otherwise(x - F.col("_mean"))
    terms = dev.join(mad, keys).select(*keys, "value", "c", term.alias("_t"))
    length = terms.groupBy(*keys).agg(
        F.sqrt(F.sum(F.col("_t") * F.col("_t") * F.col("c"))).alias("_len"),
        F.sum(F.when(x == 0, F.col("_t"))).alias("_t0"),
    )
    scaled = terms.join(length.filter(F.col("_len") > 0), keys).select(
        *keys,
        "value",
        (F.col("_t") / F.col("_len")).alias("x"),
        (F.coalesce(F.col("_t0"), F.lit(0.0)) / F.col("_len")).alias("x0"),
    )
    return kept.filter(F.col("value") != 0).join(scaled, [*keys, "value"]).select(*GROUP, "cell_id", "gene", "x", "x0")


def bicor_correlation(
    expr: DataFrame, meta: DataFrame, genes: GeneSpan, min_cell: int = MIN_CELL
) -> DataFrame:
    """Biweight midcorrelation of every pair.

    With x = x' + x0, where x' is zero in zero cells, the sum of x*y over all cells follows from
    the sparse products, the sparse sums and the number of cells.
    """
    terms = midweights(expr, meta, min_cell)
    sparse = terms.select(*GROUP, "cell_id", "gene", (F.col("x") - F.col("x0")).alias("value"))
    prod = pair_correlation(sparse, meta, genes, min_cell=0, raw_products=True)
    side = terms.groupBy(*GROUP, "gene").agg(F.sum(F.col("x") - F.col("x0")).alias("s"), F.max("x0").alias("x0"))
    a = side.select(*GROUP, F.col("gene").alias("gene_a"), F.col("s").alias("sa"), F.col("x0").alias("a0"))
    b = side.select(*GROUP, F.col("gene").alias("gene_b"), F.col("s").alias("sb"), F.col("x0").alias("b0"))
    r = (
        F.col("r")
        + F.col("b0") * F.col("sa")
        + F.col("a0") * F.col("sb")
        + F.col("n_cells") * F.col("a0") * F.col("b0")
    )
    return (
        prod.join(a, [*GROUP, "gene_a"])
        .join(b, [*GROUP, "gene_b"])
        .join(type_sizes(meta), list(GROUP))
        .select(*GROUP, "gene_a", "gene_b", F.when(F.col("gene_a") == F.col("gene_b"), 1.0).otherwise(fix10(r)).alias("r"))
    )


METHODS = {"pearson": pair_correlation, "spearman": spearman_correlation, "bicor": bicor_correlation}


# ---------------------------------------------------------------- rank aggregation

def pair_spine(groups: DataFrame, genes: GeneSpan, gene_block: int = GENE_BLOCK) -> DataFrame:
    """Every pair ``gene_a >= gene_b`` of every group: some genes of a block and another block are dealt to tasks and become pairs there.

    A task holds all pairs that a row of its input makes before it hands them on, so such a row has ``TILE_ROWS`` genes of one side.
    """
    last = genes.first + genes.n - 1
    lo, hi = genes.first // gene_block, last // gene_block
    begin, end = lambda t: F.greatest(F.col(t) * gene_block, F.lit(genes.first)), lambda t: F.least((F.col(t) + 1) * gene_block - 1, F.lit(last))
    rows = groups.withColumn("_a", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).withColumn("_i", F.explode(F.sequence(begin("_a"), end("_a"), F.lit(TILE_ROWS))))
    rows = rows.withColumn("_b", F.explode(F.sequence(F.lit(lo), F.col("_a"))))
    # a number of its own: adaptive execution sees a few bytes a row and would put all into one task
    rows = rows.repartition(SPINE_TASKS * (hi - lo + 1), *groups.columns, "_i", "_b")
    rows = rows.withColumn("gene_a", F.explode(F.sequence("_i", F.least(F.col("_i") + (TILE_ROWS - 1), end("_a")))))
    return rows.withColumn("gene_b", F.explode(F.sequence(begin("_b"), F.least(end("_b"), F.col("gene_a"))))).drop("_a", "_b", "_i")


def type_status(moments: DataFrame, meta: DataFrame, min_cell: int = MIN_CELL) -> DataFrame:
    """Every (dataset, cell type) with its size; ``used`` is false where every gene is NA."""
    used = moments.filter(F.col("nz") >= min_cell).select(*GROUP).distinct().withColumn("used", F.lit(True))
    return (
        type_sizes(meta)
        .join(used, list(GROUP), "left")
        .withColumn("used", F.coalesce(F.col("used"), F.lit(False)))
    )


def correlation_tiles(
    expr: DataFrame, meta: DataFrame, genes: GeneSpan, min_cell: int = MIN_CELL, method: str = "pearson", gene_block: int = GENE_BLOCK,
    moments: DataFrame | None = None,
) -> DataFrame:
    """The correlations of ``method`` as packed tiles per (dataset, cell type)."""
    if method == "pearson":
        return tiles.product_tiles(expr, meta, genes, GROUP, min_cell, gene_block=gene_block, defined=tiles.defined_genes(expr, meta, GROUP, min_cell, moments))
    if method == "spearman":
        return tiles.product_tiles(_eligible_ranks(expr, meta, min_cell), meta, genes, GROUP, 0, gene_block=gene_block)
    return tiles.packed(METHODS[method](expr, meta, genes, min_cell), GROUP, genes, gene_block)


def rank_sum_rank(
    expr: DataFrame,
    meta: DataFrame,
    genes: GeneSpan,
    min_cell: int = MIN_CELL,
    pairs: DataFrame | None = None,
    method: str = "pearson",
    standardize: bool = True,
    gene_block: int = GENE_BLOCK,
) -> DataFrame:
    """Rank-sum-rank aggregate per dataset: all pairs, ``rsr`` in (0, 1] with 1 best, ``n_na``.

    ``method`` is pearson, spearman or bicor; ``pairs`` takes a correlation table made before. Without ``standardize`` the
    ranks are not divided by the number of pairs, so that the best is the number of pairs.

    In a cell type the G diagonal pairs count as 1 and undefined pairs as 0, and all are ranked
    jointly (1 = largest r, ties take the smallest rank). Tiles of correlations become tiles of rank sums per dataset, and
    these are ranked again; undefined pairs are never entries, they share one base rank per type.
    """
    # a row per gene and cell type, read by several branches
    moments = written(gene_moments(expr), "moments")
    if pairs is None:
        made = correlation_tiles(expr, meta, genes, min_cell, method, gene_block, moments)
    else:
        made = tiles.packed(pairs, GROUP, genes, gene_block)
    # read four times below, so it is written once
    made = written(made, "tiles")
    status = type_status(moments, meta, min_cell)
    counts = made.groupBy(*GROUP).agg(F.sum("n_defined").alias("_defined"), F.sum("n_above").alias("_above"))
    base = status.filter("used").join(counts, list(GROUP), "left").select(
        *GROUP,
        (F.coalesce(F.col("_above"), F.lit(0)) + 1 + genes.n).alias("base"),
        (F.lit(genes.n_pairs - genes.n) - F.coalesce(F.col("_defined"), F.lit(0))).alias("zeros"),
    )
    data = (
        status.groupBy("dataset_id")
        .agg(F.count(F.lit(1)).alias("n_types"), F.count_if("used").alias("n_used"))
        .join(base.groupBy("dataset_id").agg(F.sum("base").alias("s0")), "dataset_id", "left")
        .withColumn("s0", F.coalesce(F.col("s0"), F.lit(0)))
    )
    sums = written(tiles.summed_tiles(made.join(base, list(GROUP)), data.drop("n_types"), genes, gene_block), "rank-sums")
    ranked = tiles.ranked_pairs(sums, gene_block, genes).join(data.select("dataset_id", "n_types"), "dataset_id")
    rsr = F.col("rank") / F.lit(float(genes.n_pairs)) if standardize else F.col("rank").cast("double")
    return ranked.select("dataset_id", "gene_a", "gene_b", rsr.alias("rsr"), (F.col("n_types") - F.col("c")).cast("int").alias("n_na"))


def mirrored(agg: DataFrame, *values: str) -> DataFrame:
    """Both directions of a lower-triangle table as (gene, partner)."""
    down = agg.select("dataset_id", F.col("gene_a").alias("gene"), F.col("gene_b").alias("partner"), *values)
    up = agg.filter(F.col("gene_a") != F.col("gene_b")).select(
        "dataset_id", F.col("gene_b").alias("gene"), F.col("gene_a").alias("partner"), *values
    )
    return down.unionByName(up)


def fill_triangle(pairs: DataFrame, genes: GeneSpan) -> DataFrame:
    """Imputed matrix view: all pairs of a cell type, undefined 0, diagonal 1."""
    groups = pairs.select(*GROUP).distinct()
    full = pair_spine(groups, genes).join(pairs, [*GROUP, "gene_a", "gene_b"], "left")
    return full.select(
        *GROUP,
        "gene_a",
        "gene_b",
        F.when(F.col("gene_a") == F.col("gene_b"), 1.0).otherwise(F.coalesce(F.col("r"), F.lit(0.0))).alias("r"),
    )


def mean_pair_score(agg: DataFrame, n_datasets: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean aggregate of every unordered pair over datasets, within the columns ``by``."""
    off = agg.filter(F.col("gene_a") != F.col("gene_b"))
    total = F.sum("rsr")
    mean = total / F.lit(float(n_datasets)) if n_datasets else F.avg("rsr")
    return off.groupBy(*by, "gene_a", "gene_b").agg(mean.alias("avg_rsr"))


def head_and_tail(means: DataFrame, n: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """The n best and n worst pairs, within the columns ``by``; each end keeps n rows a task before it is shuffled."""
    value, last = fix10("avg_rsr"), [F.col("gene_a"), F.col("gene_b")]
    sides = []
    for side, order in (("top", value.desc()), ("bottom", value.asc())):
        if by:
            place = F.row_number().over(Window.partitionBy(*by).orderBy(order, *last))
            kept = means.withColumn("_i", place).filter(F.col("_i") <= n).drop("_i")
        else:
            kept = means.orderBy(order, *last).limit(n)
        sides.append(kept.withColumn("side", F.lit(side)))
    return sides[0].unionByName(sides[1])


# ---------------------------------------------------------------- one pair of genes

def pair_cells(expr: DataFrame, meta: DataFrame, gene1: int, gene2: int) -> DataFrame:
    """Values of two genes in every cell, zero where there is no count."""
    v = F.col("value")
    both = (
        expr.filter(F.col("gene").isin(gene1, gene2))
        .groupBy("dataset_id", "cell_type", "cell_id")
        .agg(F.sum(F.when(F.col("gene") == gene1, v)).alias("x"), F.sum(F.when(F.col("gene") == gene2, v)).alias("y"))
    )
    zero = F.lit(0.0)
    return (
        meta.select("dataset_id", "cell_type", "cell_id")
        .join(both, ["dataset_id", "cell_type", "cell_id"], "left")
        .withColumns({"x": F.coalesce("x", zero), "y": F.coalesce("y", zero)})
    )


def celltype_correlation(
    expr: DataFrame, meta: DataFrame, gene1: int, gene2: int, min_cell: int = MIN_CELL, method: str = "pearson"
) -> DataFrame:
    """Correlation of one pair per (dataset, cell type), undefined types dropped, 5 decimals.

    Only cells with a count of either gene are read into the aggregate; the other cells enter
    through the cell number alone.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, one of {sorted(METHODS)}")
    if method == "bicor":
        return _pair_bicor(expr, meta, gene1, gene2, min_cell)
    if method == "spearman":
        both = expr.filter(F.col("gene").isin(gene1, gene2))
        both = both.join(eligible_genes(both, min_cell).drop("nz"), [*GROUP, "gene"], "left_semi")
        return celltype_correlation(rank_values(both, meta), meta, gene1, gene2, min_cell=0)
    v = F.col("value")
    cells = (
        expr.filter(F.col("gene").isin(gene1, gene2))
        .groupBy("dataset_id", "cell_type", "cell_id")
        .agg(
            F.coalesce(F.sum(F.when(F.col("gene") == gene1, v)), F.lit(0.0)).alias("x"),
            F.coalesce(F.sum(F.when(F.col("gene") == gene2, v)), F.lit(0.0)).alias("y"),
        )
    )
    x, y = F.col("x"), F.col("y")
    m = cells.groupBy(*GROUP).agg(
        F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"),
        F.sum(x * y).alias("sxy"), F.count_if(x > 0).alias("nx"), F.count_if(y > 0).alias("ny"),
    )
    n = F.col("n_cells").cast("double")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    r = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.sqrt(vx) * F.sqrt(vy))
    least = 1e-13 * n  # the same bound as for all pairs: below it the variance is rounding
    ok = (F.col("nx") >= min_cell) & (F.col("ny") >= min_cell) & (vx > least * F.col("sxx")) & (vy > least * F.col("syy"))
    return m.join(type_sizes(meta), list(GROUP)).filter(ok).select(*GROUP, rnd(r, 5).alias("r"))


def _pair_bicor(expr: DataFrame, meta: DataFrame, gene1: int, gene2: int, min_cell: int) -> DataFrame:
    """Biweight midcorrelation of one pair per (dataset, cell type); zero cells enter through their common term."""
    terms = midweights(expr.filter(F.col("gene").isin(gene1, gene2)), meta, min_cell)
    own, d = lambda g, c: F.when(F.col("gene") == g, c), F.col("x") - F.col("x0")
    cells = terms.groupBy(*GROUP, "cell_id").agg(*[F.sum(own(g, d)).alias(n) for g, n in ((gene1, "a"), (gene2, "b"))])
    sums = cells.groupBy(*GROUP).agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.sum(F.coalesce(F.col("a") * F.col("b"), F.lit(0.0))).alias("sab"))
    zero = terms.groupBy(*GROUP).agg(*[F.max(own(g, F.col("x0"))).alias(n) for g, n in ((gene1, "a0"), (gene2, "b0"))])
    r = F.col("sab") + F.col("b0") * F.col("sa") + F.col("a0") * F.col("sb") + F.col("n_cells") * F.col("a0") * F.col("b0")
    both = sums.join(zero.filter("a0 IS NOT NULL AND b0 IS NOT NULL"), list(GROUP)).join(type_sizes(meta), list(GROUP))
    return both.select(*GROUP, rnd(fix10(r), 5).alias("r"))


def normalise_pair(species: str, gene1: str, gene2: str) -> tuple[str, str, str]:
    """Species to title case, symbols to the casing of that species."""
    name = species.strip().capitalize()
    if name not in ("Human", "Mouse"):
        raise ValueError(f"unknown species {species!r}")
    fix = str.upper if name == "Human" else str.capitalize
    return name, fix(gene1.strip()), fix(gene2.strip())


def pair_correlation_by_symbol(
    expr: DataFrame, meta: DataFrame, gene_ref: DataFrame, species: str, gene1: str, gene2: str, min_cell: int = MIN_CELL
) -> DataFrame:
    """Point query by species and two symbols; the symbols are looked up in ``gene_ref``."""
    name, s1, s2 = normalise_pair(species, gene1, gene2)
    found = {r["symbol"]: r["gene"] for r in gene_ref.filter((F.col("species") == name) & F.col("symbol").isin(s1, s2)).select("symbol", "gene").collect()}
    if s1 not in found or s2 not in found:
        raise ValueError(f"unknown gene among {s1}, {s2} for {name}")
    return celltype_correlation(
        expr.filter(F.col("species") == name), meta.filter(F.col("species") == name), found[s1], found[s2], min_cell
    )


def dataset_means(cors: DataFrame) -> DataFrame:
    """Mean correlation of a pair per dataset, best first."""
    return cors.groupBy("dataset_id").agg(F.avg("r").alias("mean_r"), F.count(F.lit(1)).alias("n_types"))


def long_to_pairs(table: DataFrame, symmetric: bool, value: str) -> DataFrame:
    """Long view of a mirrored (gene, partner) table; unique unordered pairs if symmetric."""
    keep = table.filter(F.col("gene") > F.col("partner")) if symmetric else table
    return keep.select("dataset_id", F.col("gene").alias("row"), F.col("partner").alias("col"), value)
