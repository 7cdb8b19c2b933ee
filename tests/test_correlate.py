import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoloom.operators import correlate as c
from genoloom.schemas import GeneSpan, gene_span, index_genes


def tables(spark, cells):
    """cells: {(dataset, type, cell): {gene: value}}"""
    meta = spark.createDataFrame([(d, i, t) for d, t, i in cells], "dataset_id int, cell_id long, cell_type string")
    rows = [(d, t, i, g, float(v)) for (d, t, i), genes in cells.items() for g, v in genes.items() if v]
    expr = spark.createDataFrame(rows, "dataset_id int, cell_type string, cell_id long, gene int, value double")
    return expr, meta


def random_cells(n_genes, n_cells, types=("t1", "t2"), datasets=(0, 1), seed=1):
    rng = random.Random(seed)
    return {
        (d, t, i + 1000 * k + 100000 * d): {g: rng.choice([0, 0, 1, 2, 5]) for g in range(n_genes)}
        for d in datasets for k, t in enumerate(types) for i in range(n_cells)
    }


def as_dict(df, *value):
    return {(r["dataset_id"], r["cell_type"], r["gene_a"], r["gene_b"]): r["r"] for r in df.collect()}


def brute_pearson(cells, n_genes, min_cell, rank=False):
    groups = {}
    for (d, t, _), genes in cells.items():
        groups.setdefault((d, t), []).append([genes.get(g, 0) for g in range(n_genes)])
    out = {}
    for (d, t), rows in groups.items():
        x = np.array(rows, float)
        ok = (x > 0).sum(0) >= min_cell
        if rank:
            x = np.column_stack([[(col < v).sum() + ((col == v).sum() + 1) / 2 for v in col] for col in x.T])
        ok &= x.var(0) > 0
        for a in np.flatnonzero(ok):
            for b in np.flatnonzero(ok):
                if a >= b:
                    out[(d, t, int(a), int(b))] = np.corrcoef(x[:, a], x[:, b])[0, 1]
    return out


@pytest.mark.parametrize("block, chunk", [(1024, 4096), (3, 7), (4, 4096)])
def test_pearson_equals_brute_force_for_any_tiling(spark, block, chunk):
    cells = random_cells(10, 40)
    expr, meta = tables(spark, cells)
    got = as_dict(c.pair_correlation(expr, meta, GeneSpan(0, 10), 20, gene_block=block, chunk_cells=chunk))
    want = brute_pearson(cells, 10, 20)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_string_cell_ids(spark):
    cells = random_cells(6, 30, datasets=(0,))
    expr, meta = tables(spark, cells)
    name = F.concat(F.lit("cell"), F.col("cell_id").cast("string"))
    one = as_dict(c.pair_correlation(expr, meta, GeneSpan(0, 6), 5))
    two = as_dict(c.pair_correlation(expr.withColumn("cell_id", name), meta.withColumn("cell_id", name), GeneSpan(0, 6), 5))
    assert one == two


def test_spearman_equals_brute_force(spark):
    cells = random_cells(8, 35, seed=5)
    expr, meta = tables(spark, cells)
    got = as_dict(c.spearman_correlation(expr, meta, GeneSpan(0, 8), 15))
    want = brute_pearson(cells, 8, 15, rank=True)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def brute_rsr(cells, n_genes, min_cell):
    cor = brute_pearson(cells, n_genes, min_cell)
    pairs = [(a, b) for a in range(n_genes) for b in range(a + 1)]
    sums, na = {}, {}
    groups = {(d, t) for d, t, _ in cells}
    for d, t in groups:
        used = any(
            sum(genes.get(g, 0) > 0 for (d2, t2, _), genes in cells.items() if (d2, t2) == (d, t)) >= min_cell for g in range(n_genes)
        )
        vals = {p: cor.get((d, t, *p)) for p in pairs}
        for p in pairs:
            na[(d, *p)] = na.get((d, *p), 0) + (vals[p] is None)
        if not used:
            continue
        full = {p: 1.0 if p[0] == p[1] else round(v, 10) if v is not None else 0.0 for p, v in vals.items()}
        for p in pairs:
            sums[(d, *p)] = sums.get((d, *p), 0) + 1 + sum(v > full[p] for v in full.values())
    out = {}
    for d in {d for d, _ in groups}:
        own = {p: sums.get((d, *p), 0) for p in pairs}
        for p in pairs:
            out[(d, *p)] = ((1 + sum(v > own[p] for v in own.values())) / len(pairs), na[(d, *p)])
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_rsr_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(c.tiles.joint_ranks, "__defaults__", (64,))  # ranges of about 64 values
    cells = random_cells(7, 25, seed=9)
    for k in cells:
        if k[1] == "t2":
            cells[k][3] = 0  # never measured in one type
        cells[k][6] = 1  # constant and non-zero: no variance
    cells[(0, "lonely", 999999)] = {g: 3 for g in range(7)}  # a one-cell type is skipped
    expr, meta = tables(spark, cells)
    got = {(r["dataset_id"], r["gene_a"], r["gene_b"]): (r["rsr"], r["n_na"]) for r in c.rank_sum_rank(expr, meta, GeneSpan(0, 7), 8, gene_block=block).collect()}
    want = brute_rsr(cells, 7, 8)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-12, k
    assert all(0 < v[0] <= 1 for v in got.values())
    plain = c.rank_sum_rank(expr, meta, GeneSpan(0, 7), 8, standardize=False, gene_block=block).collect()
    assert all(r["rsr"] == round(want[r["dataset_id"], r["gene_a"], r["gene_b"]][0] * 28) for r in plain)


def test_planted_group_ranks_first(spark):
    rng = random.Random(4)
    cells = {}
    for t in ("t1", "t2", "t3"):
        for i in range(60):
            level = rng.choice([1, 2, 6])
            cells[(0, t, hash((t, i)) % 10**9)] = {g: (level + rng.choice([0, 1]) if g < 4 else rng.choice([0, 1, 3])) for g in range(12)}
    expr, meta = tables(spark, cells)
    agg = c.rank_sum_rank(expr, meta, GeneSpan(0, 12), 10)
    best = agg.filter("gene_a <> gene_b").orderBy(F.col("rsr").desc()).limit(6).collect()
    assert {(r["gene_a"], r["gene_b"]) for r in best} == {(a, b) for a in range(4) for b in range(a)}


def test_order_of_cells_does_not_matter(spark):
    cells = random_cells(6, 30, datasets=(0,))
    expr, meta = tables(spark, cells)
    a = c.rank_sum_rank(expr, meta, GeneSpan(0, 6), 5).orderBy("gene_a", "gene_b").collect()
    b = c.rank_sum_rank(expr.repartition(7).orderBy(F.rand(1)), meta, GeneSpan(0, 6), 5).orderBy("gene_a", "gene_b").collect()
    assert a == b


def test_pair_spine_is_complete(spark):
    groups = spark.createDataFrame([(5,), (7,), (9,)], "dataset_id int")
    rows = c.pair_spine(groups, GeneSpan(3, 40))
    assert rows.count() == rows.distinct().count() == 3 * 820
    assert rows.filter("gene_a < gene_b OR gene_b < 3 OR gene_a > 42").count() == 0


def test_gene_span_refuses_holes(spark):
    with pytest.raises(ValueError):
        gene_span(spark.createDataFrame([(1,), (3,)], "gene int"))
    named = index_genes(spark.createDataFrame([("b",), ("a",), ("b",)], "symbol string"))
    assert gene_span(named) == GeneSpan(1, 2)


def test_normalise_pair():
    assert c.normalise_pair(" mouse", "PAX6", "sox2 ") == ("Mouse", "Pax6", "Sox2")
    assert c.normalise_pair("HUMAN", "pax6", "Sox2") == ("Human", "PAX6", "SOX2")
    with pytest.raises(ValueError):
        c.normalise_pair("rat", "a", "b")
