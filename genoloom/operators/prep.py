"""Cleaning and normalisation of sparse counts: QC, gene mapping, label rules, scaling."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import pearson
from ..functions.ranks import avg_rank

CELL = ["dataset_id", "cell_id"]

# Cell types that carry no identity.
AMBIGUOUS = "(?i)^(|-|unknown|undetermined|doublet|low umi|other|na)$"


def rename_if_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename the columns that exist, leave the rest."""
    return df.withColumnsRenamed(names)


# ---------------------------------------------------------------- counts and quality

def mitochondrial(genes: DataFrame, mt: DataFrame) -> DataFrame:
    """Genes listed by symbol or by stable id, mitochondrial."""
    by_symbol = genes.join(mt.select(F.col("gene_name").alias("gene")), "gene", "left_semi")
    by_id = genes.join(mt.select(F.col("gene_stable_id").alias("gene")), "gene", "left_semi")
    return by_symbol.unionByName(by_id).distinct()


def count_info(expr: DataFrame, mt_genes: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Per cell: total, expressed genes, novelty (log ratio) and mitochondrial share.

    With ``cells``, every listed cell has a row; one without any count has totals of 0 and no ratios.

    All genes count, before any gene filter. The share is NULL when the dataset has no
    mitochondrial gene.
    """
    v = F.col("value")
    rows = expr
    if mt_genes is not None:
        rows = expr.join(mt_genes.select("gene", F.lit(True).alias("_mt")), "gene", "left")
    mt = F.coalesce(F.col("_mt"), F.lit(False)) if mt_genes is not None else F.lit(False)
    out = rows.groupBy(*CELL).agg(
        F.sum(v).alias("umi_counts"), F.count_if(v > 0).alias("gene_counts"), F.sum(F.when(mt, v).otherwise(0.0)).alias("_mt_sum"), F.max(mt).alias("_any")
    )
    has_mt = out.groupBy("dataset_id").agg(F.max("_any").alias("_has"))
    log = lambda c: F.log10(F.when(F.col(c) > 0, F.col(c).cast("double")))
    if cells is not None:
        none = {"umi_counts": F.coalesce("umi_counts", F.lit(0.0)), "gene_counts": F.coalesce("gene_counts", F.lit(0).cast("long"))}
        out = cells.select(*CELL).distinct().join(out, CELL, "left").withColumns(none)
        has_mt = cells.select("dataset_id").distinct().join(has_mt, "dataset_id", "left")
    return out.join(has_mt, "dataset_id").select(
        *CELL, "umi_counts", "gene_counts", F.try_divide(log("gene_counts"), log("umi_counts")).alias("rna_novelty"),
        F.when(F.col("_has"), F.try_divide(F.col("_mt_sum"), F.col("umi_counts"))).alias("mt_ratio"),
    )


def prefer_given_counts(meta: DataFrame, info: DataFrame) -> DataFrame:
    """Counts supplied by the metadata win; only the novelty is computed from them."""
    rows = meta.join(info.select(*CELL, F.col("umi_counts").alias("_u"), F.col("gene_counts").alias("_g")), CELL, "left")
    umi, genes = F.coalesce("umi_counts", "_u"), F.coalesce("gene_counts", "_g")
    log = lambda c: F.log10(F.when(c > 0, c.cast("double")))
    return rows.withColumns({"umi_counts": umi, "gene_counts": genes}).withColumn(
        "rna_novelty", F.try_divide(log(F.col("gene_counts")), log(F.col("umi_counts")))
    ).drop("_u", "_g")


def quality_cells(
    meta: DataFrame, min_counts: float = 500, min_genes: float = 250, min_novelty: float = 0.8,
    min_novelty_full_length: float = 0.5, max_mt_ratio: float = 0.2,
) -> DataFrame:
    """Cells that pass the limits; full-length assays have a lower novelty limit, NULL novelty fails."""
    limit = F.when(F.lower("assay").contains("smart-seq"), min_novelty_full_length).otherwise(min_novelty)
    return meta.filter(
        (F.col("umi_counts") >= min_counts) & (F.col("gene_counts") >= min_genes) & (F.col("rna_novelty") > limit)
        & (F.col("mt_ratio").isNull() | (F.col("mt_ratio") < max_mt_ratio))
    )


def quality_report(meta: DataFrame, kept: DataFrame, fail: bool = False) -> DataFrame:
    """(dataset_id, n_cells, n_kept, passes): a dataset of which no cell is left does not pass; with ``fail`` the job stops there."""
    left = kept.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_kept"))
    out = meta.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_cells")).join(left, "dataset_id", "left")
    out = out.withColumn("n_kept", F.coalesce("n_kept", F.lit(0).cast("long"))).withColumn("passes", F.col("n_kept") > 0)
    if fail:
        fault = F.raise_error(F.concat(F.lit("no cell is left in dataset "), F.col("dataset_id").cast("string"))).cast("boolean")
        out = out.filter(F.when(F.col("passes"), True).otherwise(fault))
    return out


def ids_to_symbols(expr: DataFrame, gene_ref: DataFrame) -> DataFrame:
    """Map gene ids to symbols; ids without a symbol drop out."""
    ref = gene_ref.filter(F.col("symbol") != "").select(F.col("gene_id").alias("gene"), "symbol")
    return expr.join(ref, "gene").drop("gene").withColumnRenamed("symbol", "gene")


def coding_only(expr: DataFrame, coding: DataFrame) -> DataFrame:
    """Counts of the coding genes; the first id of a symbol counts, missing genes are absent zeros."""
    first = coding.groupBy("symbol").agg(F.min_by("gene_id", "ordinal").alias("gene"))
    return expr.join(first, "gene").drop("gene").withColumnRenamed("symbol", "gene")


# ---------------------------------------------------------------- normalisation

def normalise(expr: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """Value by the dataset's mode: cpm (default), log, expm1 or none, in one pass.

    Totals are over the remaining genes, so run it after the gene filter. The total comes from an
    aggregate that combines before the shuffle.
    """
    total = expr.groupBy(*CELL).agg(F.sum("value").alias("_t"))
    rows = expr.join(total, CELL)
    mode: Column = F.lit("cpm")
    if modes is not None:
        rows = rows.join(modes.select("dataset_id", "norm_mode"), "dataset_id", "left")
        mode = F.coalesce("norm_mode", F.lit("cpm"))
    share = F.try_divide(F.col("value"), F.col("_t"))
    out = (
        F.when(mode == "none", F.col("value"))
        .when(mode == "expm1", F.expm1(F.when(mode == "expm1", F.col("value"))))
        .when(mode == "log", F.log1p(share * 1e4))
        .otherwise(share * 1e6)
    )
    return rows.withColumn("value", out).drop("_t", "norm_mode")


def choose_layer(layers: DataFrame) -> DataFrame:
    """Counts layer, or the data layer where a dataset's counts are missing or all zero."""
    v = F.abs("value")
    has = layers.groupBy("dataset_id").agg((F.sum(F.when(F.col("layer") == "counts", v).otherwise(0.0)) > 0).alias("_has"))
    keep = F.when(F.col("_has"), "counts").otherwise("data")
    return layers.join(has, "dataset_id").filter(F.col("layer") == keep).drop("_has", "layer")


# ---------------------------------------------------------------- labels and ids

def _two_groups_on(text: str, mark: str) -> str:
    """Group references (``$1`` of a replacement, ``\\1`` of a pattern) two higher; other escapes stay."""
    found = r"\\.|\$([0-9])" if mark == "$" else r"\\([1-9])|\\."
    return re.sub(found, lambda m: f"{mark}{int(m[1]) + 2}" if m[1] else m[0], text)


def apply_rules(df: DataFrame, column: str, rules: list[tuple[str, str, bool]], trim: bool = False) -> DataFrame:
    """Ordered (pattern, replacement, every match) rules; otherwise the first match only.

    A replacement may refer to groups of its pattern ($1, $2). ``trim`` takes blanks off both ends at last.
    """
    out = F.col(column)
    for pattern, replacement, every in rules:
        if every:
            out = F.regexp_replace(out, pattern, replacement)
        else:
            # the text before the first match and the match are groups of their own; those of the rule follow
            whole = f"^((?s:.*?))({_two_groups_on(pattern, chr(92))})"
            out = F.regexp_replace(out, whole, "$1" + _two_groups_on(replacement, "$"))
    return df.withColumn(column, F.trim(out) if trim else out)


RULES = "dataset_id, ord, action, pattern, replacement, every"


def _packed_rules(rules: DataFrame) -> DataFrame:
    """(dataset_id, _rules): the rules of a dataset in order, those for the first match only with their groups two higher."""

    def raised(text: str, token: str, mark: str) -> Column:
        parts = F.regexp_extract_all(F.col(text), F.lit(token), F.lit(0))
        digit = lambda x: F.substring(x, 2, 1)
        is_group = lambda x: (F.length(x) == 2) & x.startswith(mark) & digit(x).rlike("[0-9]" if mark == "$" else "[1-9]")
        return F.array_join(F.transform(parts, lambda x: F.when(is_group(x), F.concat(F.lit(mark), (digit(x).try_cast("int") + 2).cast("string"))).otherwise(x)), "")

    # the text before the first match and the match are groups of their own; those of the rule follow
    first = F.concat(F.lit("^((?s:.*?))("), raised("pattern", r"\\.|[^\\]+", "\\"), F.lit(")"))
    after = F.concat(F.lit("$1"), raised("replacement", r"\\.|\$[0-9]|[^\\$]+|.", "$"))
    every = F.coalesce("every", F.lit(False))
    rule = F.struct(
        "ord", "action", F.when(every | (F.col("action") == "drop"), F.col("pattern")).otherwise(first).alias("pattern"),
        F.when(every, F.col("replacement")).otherwise(after).alias("replacement"),
    )
    return rules.groupBy("dataset_id").agg(F.array_sort(F.collect_list(rule)).alias("_rules"))


def apply_rule_table(df: DataFrame, column: str, rules: DataFrame, trim: bool = True) -> DataFrame:
    """Each dataset's own ordered rules (``RULES``) over its labels, all datasets in one pass.

    ``replace`` rules put ``replacement`` (groups $1, $2) for the first match, or for ``every`` one;
    ``drop`` rules remove the rows whose label so far matches; NULL labels go with any ``drop`` rule.
    A dataset without rules keeps its labels. Both ends are trimmed at last.
    """
    both = df.join(_packed_rules(rules), "dataset_id", "left")

    def step(text: Column, rule: Column) -> Column:
        dropped = F.when(F.rlike(text, rule["pattern"]), F.lit(None).cast("string")).otherwise(text)
        return F.when(rule["action"] == "drop", dropped).otherwise(F.regexp_replace(text, rule["pattern"], rule["replacement"]))

    drops = F.exists("_rules", lambda r: r["action"] == "drop")
    out = F.when(F.col("_rules").isNull(), F.col(column)).otherwise(F.aggregate("_rules", F.col(column), step))
    kept = both.withColumn(column, F.trim(out) if trim else out).filter(F.col(column).isNotNull() | ~F.coalesce(drops, F.lit(False)))
    return kept.select(*df.columns)


def recode(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    out = F.col(column)
    for old, new in names.items():
        out = F.when(F.col(column) == old, new).otherwise(out)
    return df.withColumn(column, out)


def drop_ambiguous(df: DataFrame, column: str = "cell_type", pattern: str = AMBIGUOUS) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.trim(column).rlike(pattern))


def clean_barcode(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Dots to dashes, a prefix and a numeric suffix removed."""
    c = F.regexp_replace(F.col(column), r"\.", "-")
    return df.withColumn(column, F.regexp_replace(F.regexp_replace(c, f"^{prefix}", ""), r"-[0-9]+$", ""))


def label_from_id(df: DataFrame, column: str, separator: str, part: int, out: str) -> DataFrame:
    """A label that is part of the cell id."""
    return df.withColumn(out, F.element_at(F.split(F.col(column), separator), part))


def strip_version(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.regexp_replace(column, r"\.[0-9]+$", ""))


# ---------------------------------------------------------------- duplicates and alignment

def drop_listed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    return df.join(listed.select(key), key, "left_anti")


def drop_all_duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once are removed entirely."""
    single = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select(*keys)
    return df.join(single, keys, "left_semi")


def keep_first(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The first row of each key in source order: an aggregate, so a hot key combines early.

    Rows with the same ordinal are told apart by their other columns, so a rerun picks the same.
    """
    others = [ordinal, *[c for c in df.columns if c not in (*keys, ordinal)]]
    first = df.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_r"))
    return first.select(*keys, "_r.*").select(*df.columns)


def common_cells(expr: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells that both tables have."""
    e = expr.join(meta.select(*CELL), CELL, "left_semi")
    return e, meta.join(expr.select(*CELL).distinct(), CELL, "left_semi")


def common_genes(parts: DataFrame, part: str = "part") -> DataFrame:
    """Rows of the genes that occur in every part."""
    pairs = parts.select("gene", part).distinct()
    n_parts = parts.select(part).distinct().agg(F.count(F.lit(1)).alias("_k"))
    seen = pairs.groupBy("gene").agg(F.count(F.lit(1)).alias("_n"))
    everywhere = seen.join(F.broadcast(n_parts), F.col("_n") == F.col("_k")).select("gene")  # one row
    return parts.join(everywhere, "gene", "left_semi")


def union_batches(batch1: DataFrame, batch2: DataFrame) -> DataFrame:
    """Cells of both batches come from the first, the rest from the second; common genes only."""
    g1, g2 = batch1.select("gene").distinct(), batch2.select("gene").distinct()
    b1, b2 = batch1.join(g2, "gene", "left_semi"), batch2.join(g1, "gene", "left_semi")
    return b1.unionByName(b2.join(batch1.select("cell_id").distinct(), "cell_id", "left_anti"))


def _zero_shifted_ranks(expr: DataFrame, cell: list[str], n_genes: int) -> DataFrame:
    """Average rank among all genes of a cell minus that of its zero block: zeros stay zero."""
    zeros = F.lit(float(n_genes)) - F.count(F.lit(1)).over(W.partitionBy(*cell))
    shift = avg_rank(cell, "value") + zeros - (zeros + 1) / 2.0
    return expr.filter(F.col("value") > 0).select(*cell, "gene", shift.alias("x"))


def identical_cells(expr: DataFrame, barcode: str, n_genes: int) -> DataFrame:
    """Barcodes with cells whose Spearman correlation is exactly 1, without forming pairs.

    That is the case when two cells rank all genes alike, so cells are grouped by a fingerprint of
    their ranks (two hashes and two sums over the expressed genes). Any number of cells may share
    a barcode.
    """
    ranked = _zero_shifted_ranks(expr, [barcode, "cell_id"], n_genes)
    marks = ranked.groupBy(barcode, "cell_id").agg(
        F.bit_xor(F.xxhash64("gene", "x")).alias("h1"), F.bit_xor(F.xxhash64("x", "gene", F.lit(7))).alias("h2"),
        F.count(F.lit(1)).alias("nz"), F.sum("x").alias("sx"),
    )
    same = marks.groupBy(barcode, "h1", "h2", "nz", "sx").agg(F.count(F.lit(1)).alias("n_cells"))
    return same.filter("n_cells > 1").groupBy(barcode).agg(F.sum("n_cells").alias("n_cells"))


def near_duplicates(expr: DataFrame, barcode: str, n_genes: int) -> DataFrame:
    """Spearman between cells that share a barcode, zeros included.

    The pairs are the result, so this is for barcodes shared by few cells (:func:`identical_cells`
    answers the yes-or-no question for any number). Ranks are shifted so that a zero has rank zero;
    only genes expressed in both cells of a pair meet in the join, the rest follows from the sums.
    """
    cell = [barcode, "cell_id"]
    shared = expr.select(*cell).distinct().groupBy(barcode).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    rows = expr.filter(F.col("value") > 0).join(shared.select(barcode), barcode, "left_semi")
    ranked = _zero_shifted_ranks(rows, cell, n_genes)
    sums = ranked.groupBy(*cell).agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    a = ranked.select(barcode, "gene", F.col("cell_id").alias("cell_a"), F.col("x").alias("xa"))
    b = ranked.select(barcode, "gene", F.col("cell_id").alias("cell_b"), F.col("x").alias("xb"))
    prod = a.join(b, [barcode, "gene"]).filter("cell_a < cell_b").groupBy(barcode, "cell_a", "cell_b").agg(
        F.sum(F.col("xa") * F.col("xb")).alias("sxy")
    )
    sa = sums.select(barcode, F.col("cell_id").alias("cell_a"), F.col("sx").alias("sa"), F.col("sxx").alias("saa"))
    sb = sums.select(barcode, F.col("cell_id").alias("cell_b"), F.col("sx").alias("sb"), F.col("sxx").alias("sbb"))
    pairs = sa.join(sb, barcode).filter("cell_a < cell_b").join(prod, [barcode, "cell_a", "cell_b"], "left")
    pairs = pairs.withColumn("sxy", F.coalesce("sxy", F.lit(0.0))).withColumn("n", F.lit(float(n_genes)))
    r = pearson("n", "sa", "sb", "saa", "sbb", "sxy")
    return pairs.select(barcode, "cell_a", "cell_b", r.alias("r")).withColumn("identical", F.abs(F.col("r") - 1) < 1e-9)
