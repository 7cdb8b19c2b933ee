"""Which genes and gene pairs are measured in which dataset, and summaries of it."""
from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import six_numbers
from ..schemas import GeneSpan
from ..sources.stage import written
from .tiles import GENE_BLOCK, ROW_TASKS, TILE_ROWS, blocks, defined_genes, fields


def cell_counts(meta: DataFrame) -> DataFrame:
    return meta.groupBy("dataset_id", "cell_type").agg(F.count(F.lit(1)).alias("n_cells"))


def type_counts(meta: DataFrame) -> DataFrame:
    """Cell types and cells per dataset; counting by type first avoids a distinct over cells."""
    return cell_counts(meta).groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_celltypes"), F.sum("n_cells").alias("n_cells")
    )


def measured(agg: DataFrame, types: DataFrame) -> DataFrame:
    """A gene is measured unless its diagonal is NA in every cell type."""
    diag = agg.filter(F.col("gene_a") == F.col("gene_b"))
    return diag.join(types, "dataset_id").select(
        "dataset_id", F.col("gene_a").alias("gene"), (F.col("n_na") != F.col("n_celltypes")).alias("measured")
    )


def type_bitmaps(expr: DataFrame, meta: DataFrame, min_cell: int) -> DataFrame:
    """(dataset_id, gene, word, bits): in which cell types of a dataset a gene is defined, 64 types a word."""
    types = cell_counts(meta).select("dataset_id", "cell_type", (F.row_number().over(W.partitionBy("dataset_id").orderBy("cell_type")) - 1).alias("_t"))
    ok = defined_genes(expr, meta, ("dataset_id", "cell_type"), min_cell).join(types, ["dataset_id", "cell_type"])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("_t", F.lit(64)))
    return ok.groupBy("dataset_id", "gene", F.floor(F.col("_t") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))


def _bitmap_tiles(bitmaps: DataFrame, block: int) -> DataFrame:
    """(dataset_id, ta, tb, a, b): the bitmaps of two blocks of genes, as lists of (gene, word, bits)."""
    packed = bitmaps.groupBy("dataset_id", F.floor(F.col("gene") / block).cast("int").alias("b")).agg(F.collect_list(F.struct("gene", "word", "bits")).alias("m"))
    left = packed.select("dataset_id", F.col("b").alias("ta"), F.col("m").alias("a"))
    return left.join(packed.select("dataset_id", F.col("b").alias("tb"), F.col("m").alias("b")), "dataset_id").filter("ta >= tb")


def _words(entries: list, tile: int, block: int, n_words: int) -> np.ndarray:
    """words x genes of a block"""
    out = np.zeros((n_words, block), np.uint64)
    if len(entries):
        gene, word, bits = (np.array([e[k] for e in entries], np.int64) for k in ("gene", "word", "bits"))
        out[word, gene - tile * block] = bits.view(np.uint64)
    return out


def _bitmap_pairs(expr: DataFrame, meta: DataFrame, genes: GeneSpan, min_cell: int, groups: DataFrame, count, name: str, gene_block: int) -> DataFrame:
    """(group, gene_a, gene_b, name) for all pairs of all groups: ``count(common words)`` summed over the datasets of a group (group, dataset_id).

    A pair is defined in a cell type where both of its genes are, so the AND of two bitmaps says
    where. Bitmaps of a block of genes meet those of another in one task, dataset after dataset.
    """
    block, n_blocks = blocks(genes, gene_block)
    first = genes.first // block
    (group,) = [c for c in groups.columns if c != "dataset_id"] or ["dataset_id"]
    keyed = groups if group != "dataset_id" else groups.select("dataset_id")
    met = _bitmap_tiles(type_bitmaps(expr, meta, min_cell), block).join(keyed, "dataset_id").select(group, "ta", "tb", "a", "b")
    spine = keyed.select(group).distinct().withColumn("ta", F.explode(F.sequence(F.lit(first), F.lit(n_blocks - 1))))
    spine = spine.withColumn("tb", F.explode(F.sequence(F.lit(first), F.col("ta"))))

    def add(key: tuple[Any, ...], parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, ta, tb = key
        total = np.zeros((block, block), np.int64)
        for part in parts:
            for a, b in zip(part["a"], part["b"]):
                if a is not None:
                    n_words = 1 + max(e["word"] for some in (a, b) for e in some)
                    x, y = _words(a, ta, block, n_words), _words(b, tb, block, n_words)
                    total += count(x[w][:, None] & y[w][None, :] for w in range(n_words))
        rows, columns = (np.arange(max(genes.first - t * block, 0), min(genes.first + genes.n - t * block, block)) for t in (ta, tb))
        for some in np.array_split(rows, max(1, len(rows) // 64)):
            i, j = (x.ravel() for x in np.meshgrid(some, columns, indexing="ij"))
            if ta == tb:
                i, j = i[i >= j], j[i >= j]
            yield pd.DataFrame({group: key[0], "gene_a": i + ta * block, "gene_b": j + tb * block, name: total[i, j]})

    rows = spine.join(met, [group, "ta", "tb"], "left").repartition(ROW_TASKS * n_blocks, group, "ta", "tb")
    return rows.groupBy(group, "ta", "tb").applyInPandas(add, f"{fields(keyed, (group,))}, gene_a int, gene_b int, {name} long")


def comeasured_pairs(expr: DataFrame, meta: DataFrame, genes: GeneSpan, species: DataFrame, min_cell: int, gene_block: int = GENE_BLOCK) -> DataFrame:
    """Datasets per (species, unordered pair) in which at least one cell type defines the pair, without any aggregate."""

    def some(words: Iterator[np.ndarray]) -> np.ndarray:
        out = next(words) != 0
        for w in words:
            out |= w != 0
        return out

    return _bitmap_pairs(expr, meta, genes, min_cell, species.select("species", "dataset_id"), some, "n_comeasured", gene_block)


def defined_types(expr: DataFrame, meta: DataFrame, genes: GeneSpan, min_cell: int, gene_block: int = GENE_BLOCK) -> DataFrame:
    """(dataset_id, gene_a, gene_b, n_types): number of cell types that define a pair; the others are its NA count.

    Bitmaps of a block of genes are arrays, one per 64 cell types with an entry per gene. A tile of
    two blocks becomes pairs in its task by native column functions.
    """
    block, n_blocks = blocks(genes, gene_block)
    first, last = genes.first, genes.first + genes.n - 1
    most = cell_counts(meta).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    words = range(max(1, -(-(most or 0) // 64)))
    own = type_bitmaps(expr, meta, min_cell).groupBy("dataset_id", "gene").agg(*[F.bit_or(F.when(F.col("word") == w, F.col("bits"))).alias(f"w{w}") for w in words])
    spine = meta.select("dataset_id").distinct().withColumn("b", F.explode(F.sequence(F.lit(first // block), F.lit(n_blocks - 1))))
    spine = spine.withColumn("gene", F.explode(F.sequence(F.greatest(F.col("b") * block, F.lit(first)), F.least((F.col("b") + 1) * block - 1, F.lit(last)))))
    filled = spine.join(own, ["dataset_id", "gene"], "left").select("dataset_id", "b", F.struct("gene", *[F.coalesce(f"w{w}", F.lit(0).cast("long")).alias(f"w{w}") for w in words]).alias("x"))
    # a word per gene and 64 cell types, read by both sides of the next join
    packed = written(filled.groupBy("dataset_id", "b").agg(F.array_sort(F.collect_list("x")).alias("x")), "bitmaps")
    # a few genes and a block are dealt as four numbers; the bitmaps, a word per gene and 64 cell types, go to every executor
    begin, end = F.greatest(F.col("ta") * block, F.lit(first)), F.least((F.col("ta") + 1) * block - 1, F.lit(last))
    tiles = meta.select("dataset_id").distinct().withColumn("ta", F.explode(F.sequence(F.lit(first // block), F.lit(n_blocks - 1))))
    tiles = tiles.withColumn("at", F.explode(F.sequence(F.lit(0), end - begin, F.lit(TILE_ROWS)))).withColumn("tb", F.explode(F.sequence(F.lit(first // block), F.col("ta"))))
    # a number of its own: adaptive execution sees a few bytes a row and would put all pairs into a few tasks
    tiles = tiles.repartition(ROW_TASKS * n_blocks, "dataset_id", "ta", "tb", "at")

    def side(tile: str, name: str) -> tuple[DataFrame, Column]:
        own = packed.select(F.col("dataset_id").alias("_d"), F.col("b").alias("_b"), *[F.col(f"x.w{w}").alias(f"{name}{w}") for w in words])
        return F.broadcast(own), F.col("dataset_id").eqNullSafe(F.col("_d")) & (F.col(tile) == F.col("_b"))

    gene = lambda t, i: F.greatest(F.col(t) * block, F.lit(first)) + F.col(i)
    one = tiles.join(*side("ta", "x")).select("*", F.posexplode(F.slice("x0", F.col("at") + 1, TILE_ROWS)).alias("i", "a")).withColumn("i", F.col("at") + F.col("i"))
    one = one.select("dataset_id", "tb", gene("ta", "i").cast("int").alias("gene_a"), "a", *[F.get(f"x{w}", F.col("i")).alias(f"a{w}") for w in words[1:]])
    both = one.join(*side("tb", "y")).select("dataset_id", "tb", "gene_a", "a", *[f"a{w}" for w in words[1:]], *[f"y{w}" for w in words[1:]], F.posexplode("y0").alias("j", "b"))
    gene_b = gene("tb", "j")
    n_types = sum((F.bit_count(F.col(f"a{w}").bitwiseAND(F.get(f"y{w}", F.col("j")))) for w in words[1:]), F.bit_count(F.col("a").bitwiseAND(F.col("b"))))
    return both.filter(F.col("gene_a") >= gene_b).select("dataset_id", "gene_a", gene_b.cast("int").alias("gene_b"), n_types.cast("long").alias("n_types"))


def comeasured(tri: DataFrame) -> DataFrame:
    """Both directions of :func:`comeasured_pairs`."""
    down = tri.select("species", F.col("gene_a").alias("gene"), F.col("gene_b").alias("partner"), "n_comeasured")
    up = tri.filter("gene_a <> gene_b").select(
        "species", F.col("gene_b").alias("gene"), F.col("gene_a").alias("partner"), "n_comeasured"
    )
    return down.unionByName(up)


def genes_per_dataset(msr: DataFrame, info: DataFrame) -> DataFrame:
    n = msr.groupBy("dataset_id").agg(F.count_if("measured").alias("n_genes"))
    return info.join(n, "dataset_id", "left")


def gene_summary(msr: DataFrame, species: DataFrame, tfs: DataFrame) -> DataFrame:
    """Datasets that measure a gene: count and proportion, with the regulator flag."""
    flag = tfs.select(F.col("tf").alias("gene"), F.lit(True).alias("is_tf"))
    return (
        msr.join(species, "dataset_id")
        .groupBy("species", "gene")
        .agg(F.count_if("measured").alias("n_msr"), F.avg(F.col("measured").cast("double")).alias("prop_msr"))
        .join(flag, "gene", "left")
        .withColumn("is_tf", F.coalesce("is_tf", F.lit(False)))
    )


def measurement_classes(summary: DataFrame) -> DataFrame:
    """Genes never, rarely (<= 0.1), mostly (>= 0.9) and always measured, per species."""
    p = F.col("prop_msr")
    return summary.groupBy("species").agg(
        F.count_if(p == 0).alias("never"),
        F.count_if(p <= 0.1).alias("rarely"),
        F.count_if(p >= 0.9).alias("mostly"),
        F.count_if(p == 1).alias("always"),
    )


def always_measured_orthologs(summary: DataFrame, ortho: DataFrame) -> DataFrame:
    always = summary.filter("prop_msr = 1")
    hg = always.filter("species = 'Human'").select(F.col("gene").alias("gene_hg"))
    mm = always.filter("species = 'Mouse'").select(F.col("gene").alias("gene_mm"))
    return ortho.join(hg, "gene_hg", "left_semi").join(mm, "gene_mm", "left_semi")


def median_by_tf_status(summary: DataFrame) -> DataFrame:
    return summary.groupBy("species", "is_tf").agg(F.percentile("n_msr", F.lit(0.5)).alias("median_msr"))


def species_summaries(info: DataFrame, columns: list[str]) -> DataFrame:
    """Six numbers of each metadata column per species."""
    long = info.unpivot(["species"], [F.col(c).cast("double").alias(c) for c in columns], "stat", "value")
    return long.groupBy("species", "stat").agg(*six_numbers("value"))


def measured_subset(profile: DataFrame, msr: DataFrame) -> DataFrame:
    """Rows of the datasets in which the regulator itself is measured."""
    keep = msr.filter("measured").select("dataset_id", F.col("gene").alias("tf"))
    return profile.join(keep, ["dataset_id", "tf"], "left_semi")


def profiles(full: DataFrame, tfs: DataFrame, msr: DataFrame, species: DataFrame) -> DataFrame:
    """(species, tf, dataset_id, gene, score): one column of every dataset per regulator."""
    rows = full.join(tfs.select(F.col("tf").alias("partner")), "partner", "left_semi").select(
        F.col("partner").alias("tf"), "dataset_id", "gene", F.col("rsr").alias("score")
    )
    return measured_subset(rows, msr).join(species, "dataset_id").select("species", "tf", "dataset_id", "gene", "score")


def dataset_tally(info: DataFrame, by: list[str]) -> DataFrame:
    return info.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
