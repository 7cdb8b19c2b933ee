"""Mechanisms that bound what a task, a shuffle or a stage holds, against brute force."""
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from genoloom.functions import sampling
from genoloom.functions.ranks import tie_adjusted_k, top_set
from genoloom.operators import correlate, measure, prep, saturation, similarity, tiles
from genoloom.schemas import GeneSpan
from genoloom.sources import readers, stage
from test_correlate import as_dict, brute_pearson, random_cells, tables


def test_no_task_reads_all_chunks_of_a_hot_cell_type(spark, monkeypatch, tmp_path):
    """One type with nearly all cells in about 64 chunks: 8 lanes of 8 partial tiles, and one sum of 8 lanes."""
    cells = random_cells(5, 640, types=("hot",), datasets=(0,)) | random_cells(5, 30, types=("cold",), datasets=(0,), seed=2)
    expr, meta = tables(spark, cells)
    plain, log = tiles._added, str(tmp_path)

    def counted(parts, block):
        parts = [p for p in parts]
        with open(f"{log}/{random.random()}", "w") as f:
            f.write(str(sum(p["idx"].notna().sum() for p in parts)))
        return plain(iter(parts), block)

    monkeypatch.setattr(tiles, "_added", counted)
    got = as_dict(correlate.pair_correlation(expr, meta, GeneSpan(0, 5), 20, gene_block=3, chunk_cells=10))
    want = brute_pearson(cells, 5, 20)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    read = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert max(read) <= 8 and sum(n == 8 for n in read) >= 8


@pytest.mark.parametrize("block", [1024, 4])
def test_bitmaps_tell_where_pairs_are_defined(spark, block):
    rng = random.Random(6)
    types = [f"t{i}" for i in range(70)]  # more types than bits in a word
    cells = {(d, t, 1000 * i + d): {g: rng.choice([0, 0, 1, 4]) for g in range(9)} for d in range(3) for i, t in enumerate(types) for i in (i, i + 100, i + 200, i + 300)}
    expr, meta = tables(spark, cells)
    cor = brute_pearson(cells, 9, 2)
    pairs = [(a, b) for a in range(9) for b in range(a + 1)]
    n = {(d, *p): sum((d, t, *p) in cor for t in types) for d in range(3) for p in pairs}
    got = {tuple(r)[:3]: r["n_types"] for r in measure.defined_types(expr, meta, GeneSpan(0, 9), 2, block).collect()}
    assert got == n and 0 < max(n.values()) < 70
    species = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y")], "dataset_id int, species string")
    got = {tuple(r)[:3]: r["n_comeasured"] for r in measure.comeasured_pairs(expr, meta, GeneSpan(0, 9), species, 2, block).collect()}
    assert got == {(s, *p): sum(n[(d, *p)] > 0 for d in own) for s, own in (("x", (0, 1)), ("y", (2,))) for p in pairs}


def test_queries_of_more_datasets_than_a_block(spark):
    rng = np.random.default_rng(3)
    rows = [(d, p, g, float(rng.normal())) for d in range(9) for p in range(4) for g in range(6)]
    full = spark.createDataFrame(rows, "dataset_id int, partner int, gene int, rsr double")
    table = pd.DataFrame(rows, columns=["d", "p", "g", "v"]).set_index(["d", "p", "g"])["v"].unstack().rank(axis=1)
    want = {(q, s, p): np.corrcoef(table.loc[(q, 2)], table.loc[(s, p)])[0, 1] for q in range(9) for s in range(9) if s != q for p in range(4)}
    for query in (None, 5):
        got = {(r["query"], r["subject"], r["partner"]): r["scor"] for r in similarity.query_correlation(full, 2, GeneSpan(0, 4), gene_block=3, query=query).collect()}
        own = {k: v for k, v in want.items() if query in (None, k[0])}
        assert got.keys() == own.keys() and all(abs(got[k] - own[k]) < 1e-9 for k in own)


def test_permutations_are_complete_and_even(spark):
    sizes = [1, 2, 3, 7, 12, 50, 101]
    df = spark.createDataFrame([(n, i) for n in sizes for i in range(300)], "n long, i int").withColumn("keys", sampling.permutation_keys(4, "n", "i"))
    df = df.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = df.select("n", "i", "place", sampling.permuted(F.col("place"), F.col("n"), F.col("keys")).alias("x")).toPandas()
    for n in sizes:
        own = rows[rows.n == n].sort_values(["i", "place"])["x"].to_numpy().reshape(300, n)
        assert (np.sort(own, 1) == np.arange(n)).all()
        if n == 12:  # every item comes first about equally often
            seen = np.bincount(own[:, 0], minlength=12)
            assert ((seen - 25) ** 2 / 25).sum() < 35


def test_draws_below_n_are_even(spark):
    got = spark.range(6000).select(sampling.below(F.lit(6).cast("long"), 1, "id").alias("x")).groupBy("x").count().toPandas()
    assert set(got["x"]) == set(range(6)) and (((got["count"] - 1000) ** 2) / 1000).sum() < 25


def test_saturation_shuffles_the_profiles_once(spark):
    rng = random.Random(1)
    rows = [("Human", tf, d, g, rng.choice([None, rng.random(), 0.5])) for tf in (1, 2) for d in range(6) for g in range(12)]
    rows += [("Human", 3, d, g, 0.1 * g) for d in range(2) for g in range(12)]
    imputed = spark.createDataFrame(rows, "species string, tf int, dataset_id int, gene int, score double")
    few, many = (saturation.step_overlaps(imputed, 3, n, 5) for n in (2, 100))
    for df in (few, many):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange") == 1 and "Window" not in text
    got = many.collect()
    assert {(r["tf"], r["step"], r["iter"]) for r in got} == {(tf, s, i) for tf in (1, 2) for s in range(2, 6) for i in range(1, 101)}
    one = {tuple(r) for r in saturation.step_overlaps(imputed, 3, 100, 5, {4}).collect()}
    assert one == {tuple(r) for r in got if r["step"] == 4} and len(one) == 200
    full = {(r["species"], r["tf"]): set(r["global_top"]) for r in saturation.average_top(imputed, 3).collect()}
    sample = spark.createDataFrame([("Human", 1, d) for d in (0, 1, 2, 3, 4, 5)], "species string, tf int, dataset_id int")
    assert saturation.sample_overlap(imputed, sample, 3).first()["topk"] == len(full["Human", 1])


def test_short_groups_are_an_error_unless_allowed(spark):
    df = spark.createDataFrame([("a", g, float(g)) for g in range(5)] + [("b", g, float(g)) for g in range(2)], "k string, gene int, v double")
    for make in (lambda **o: tie_adjusted_k(df, ["k"], "v", 3, **o), lambda **o: top_set(df, ["k"], "v", "gene", 3, **o), lambda **o: top_set(df, ["k"], "v", "gene", 3, check_k=False, **o)):
        with pytest.raises(Exception, match="fewer than 3 values in the group b"):
            make().collect()
        assert make(short="own").count() > 0
    assert {r["k"]: r["k_eff"] for r in tie_adjusted_k(df, ["k"], "v", 3, short="own").collect()} == {"a": 3, "b": 2}


def test_options_of_column_comparisons(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, (3, 12)).astype(float)
    df = spark.createDataFrame([(1, c, g, float(x[c, g])) for c in range(3) for g in range(12)], "k int, c int, gene int, score double")
    for method, y in (("pearson", x), ("spearman", np.array([pd.Series(v).rank() for v in x]))):
        got = {(r["col_a"], r["col_b"]): r["scor"] for r in similarity.column_correlations(df, ["k"], "c", method).collect()}
        assert got.keys() == {(0, 1), (0, 2), (1, 2)} and all(abs(got[i, j] - np.corrcoef(y[i], y[j])[0, 1]) < 1e-9 for i, j in got)
        one = similarity.matched_correlation(df.filter("c = 0").withColumn("c", F.lit(1)), df.filter("c = 1"), "c", method).first()
        assert abs(one["scor"] - np.corrcoef(y[0], y[1])[0, 1]) < 1e-9 and one["n"] == 12
    low = {(r["col_a"], r["col_b"]): r["overlap"] for r in similarity.column_overlaps(df, ["k"], "c", 4, descending=False, check_k=False).collect()}
    bottom = [set(sorted(range(12), key=lambda g: (v[g], g))[:4]) for v in x]
    assert low == {(i, j): len(bottom[i] & bottom[j]) for i, j in low} and len(low) == 3
    own = [r for r in similarity.column_aucs(df, ["k"], "c", 4).collect() if r["col_i"] == r["col_j"]]
    assert len(own) == 3 and all(r["auroc"] == r["auprc"] == 1 for r in own)
    with pytest.raises(Exception, match="without a score"):
        similarity.column_correlations(df.filter("c > 0 OR gene > 0"), ["k"], "c").collect()


def test_dense_matrix_of_many_columns_and_files(spark, tmp_path):
    n = 25_000
    (tmp_path / "a.tsv").write_text("V1\t" + "\t".join(f"a{i}" for i in range(n)) + "\nG1\t" + "\t".join(str(i % 3) for i in range(n)) + "\n")
    (tmp_path / "b.tsv").write_text('"V1"\t"b.1"\t"a7"\t"b.2"\n"G1"\t0\t2\tNA\n"G2"\t3.5\t\t-1\n')
    got = {(r["gene"], r["cell_id"], r["value"]) for r in readers.read_dense(spark, str(tmp_path)).collect()}
    want = {("G1", f"a{i}", float(i % 3)) for i in range(n) if i % 3} | {("G1", "a7", 2.0), ("G2", "b.1", 3.5), ("G2", "b.2", -1.0)}
    assert got == want


def test_line_numbers_do_not_depend_on_how_splits_are_packed(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"part-{f}.txt").write_text("".join(f"{f} {i}\n" for i in range(500)))
    old, seen = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for size in ("300", "1000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = readers.numbered_lines(spark, str(tmp_path)).collect()
            seen.append(sorted((r["line_no"], r["file_line_no"], r["line"]) for r in rows))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert seen[0] == seen[1] == seen[2] == sorted((1 + 500 * f + i, i + 1, f"{f} {i}") for f in range(3) for i in range(500))
    plan = readers.numbered_lines(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" not in plan


def test_stage_keys_follow_content(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("one")
    key = lambda **p: stage.content_key(spark, [str(tmp_path / "in")], **p)
    first = key(k=10)
    assert first == key(k=10) != key(k=11)
    (tmp_path / "in" / "x.txt").write_text("one more")
    assert key(k=10) != first
    made = [stage.materialize(spark, stage.stage_path(spark, key(k=k), "step"), lambda k=k: spark.range(k)).count() for k in (3, 4, 3)]
    assert made == [3, 4, 3]


def test_two_datasets_with_their_own_rules_in_one_pass(spark):
    rows = [("x", "T-cell 12 "), ("x", "doublet"), ("x", None), ("y", "T-cell 12 "), ("y", "l.l"), ("z", None), ("z", " as is ")]
    df = spark.createDataFrame(rows, "dataset_id string, t string")
    rules = spark.createDataFrame([
        ("x", 2, "drop", "^doublet$", None, None), ("x", 1, "replace", r"(\w+)-cell", "$1", False), ("y", 1, "replace", r"(l)\1", "[$0$1]", False),
        ("y", 2, "replace", r"\.|\d", r"\$", True), ("y", 3, "replace", "e|l", "", False),
    ], f"dataset_id string, ord int, action string, pattern string, replacement string, every boolean")
    got = sorted((r["dataset_id"], r["t"] or "") for r in prep.apply_rule_table(df, "t", rules).collect())
    assert got == [("x", "T 12"), ("y", ".l".replace(".", "$")), ("y", "T-c[lll] $$"), ("z", ""), ("z", "as is")]


def test_a_dataset_without_cells_is_reported_or_stops_the_job(spark):
    meta = spark.createDataFrame([(1, 1, 900, 400), (1, 2, 10, 5), (2, 3, 10, 5)], "dataset_id int, cell_id int, umi_counts long, gene_counts long")
    meta = meta.withColumns({"rna_novelty": F.lit(0.9), "assay": F.lit("10x"), "mt_ratio": F.lit(None).cast("double")})
    good = prep.quality_cells(meta)
    got = {tuple(r) for r in prep.quality_report(meta, good).collect()}
    assert got == {(1, 2, 1, True), (2, 1, 0, False)}
    with pytest.raises(Exception, match="no cell is left in dataset 2"):
        prep.quality_report(meta, good, fail=True).collect()
    assert prep.quality_report(meta.filter("dataset_id = 1"), good, fail=True).count() == 1


def test_whole_overlap_matrix_and_diagonals(spark):
    from genoloom.operators import crossgroup

    rows = [(t, g, float(g if t == 1 else -g), float(-g)) for t in (1, 2) for g in range(6)]
    ranks = spark.createDataFrame(rows, "tf_id int, id int, avg_aggr_coexpr_hg double, avg_aggr_coexpr_mm double")
    got = {(r["tf_hg"], r["tf_mm"]): r["overlap"] for r in crossgroup.overlap_matrix(ranks, 2).collect()}
    assert got == {(1, 1): 0, (1, 2): 0, (2, 1): 2, (2, 2): 2}
    found = similarity.with_diagonal(spark.createDataFrame([(1, 2, 5), (2, 1, 3)], "query int, subject int, rank long")).collect()
    assert {tuple(r) for r in found} == {(1, 2, 5), (2, 1, 3), (1, 1, 1), (2, 2, 1)}


def test_a_tile_without_pairs_takes_part_in_the_ranking(spark):
    """One defined gene gives a tile with a diagonal and no pair."""
    expr = spark.createDataFrame([(1, "t", c, 2, float(c % 3 + 1)) for c in range(30)], "dataset_id int, cell_type string, cell_id long, gene int, value double")
    meta = expr.select("dataset_id", "cell_id", "cell_type").distinct()
    got = {(r["gene_a"], r["gene_b"]): (r["rsr"], r["n_na"]) for r in correlate.rank_sum_rank(expr, meta, GeneSpan(1, 3), min_cell=5).collect()}
    pairs = [(a, b) for a in (1, 2, 3) for b in range(1, a + 1)]
    assert got == {(a, b): (4 / 6 if a == b else 1 / 6, 0 if a == b == 2 else 1) for a, b in pairs}


def test_shuffles_follow_the_size_of_the_input(spark):
    """More input, more partitions, merged to 16 MB: a task reads no more from larger tables."""
    from genoloom.session import TASK_BYTES, fit_shuffles

    size, first = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    old = {c: spark.conf.get(c, None) for c in (size, first)}
    try:
        spark.conf.set(size, "64MB")
        spark.conf.unset(first)
        fit_shuffles(spark, 1 << 20)
        assert spark.conf.get(first, None) is None and int(spark.conf.get(size)) == TASK_BYTES
        fit_shuffles(spark, 6 << 30)
        assert int(spark.conf.get(first)) == 3072
        fit_shuffles(spark, 1 << 30)
        spark.conf.set(size, "4MB")
        assert int(fit_shuffles(spark, 1 << 30).conf.get(first)) == 3072 and spark.conf.get(size) == "4MB"
    finally:
        for c, v in old.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def test_arrays_as_bytes_are_small_and_exact(spark):
    """Correlations of 10 decimals, ranks and places take a part of their 8 bytes; anything else comes back bit by bit."""
    rng = np.random.default_rng(4)
    r = np.floor(rng.normal(0, 0.05, 100_000) * 1e10 + 0.5) / 1e10
    ranks = np.sort(rng.choice(10_000_000, 100_000, replace=False))
    odd = [np.zeros(0), np.zeros(0, np.int32), np.array([-0.0, 0.5, np.nan, np.inf, -1e300]), np.array([-(2**63), 2**63 - 1, 0]), rng.normal(size=99)]
    for a in [r, np.sort(r), ranks, np.arange(100_000, dtype=np.int32), *odd]:
        for ascending in (False, True):
            back = tiles.spread(tiles.squeezed(a, ascending))
            assert back.tobytes() == a.astype(np.float64 if a.dtype == np.float64 else np.int64).tobytes()
    sizes = [len(tiles.squeezed(a, up)) / 100_000 for a, up in ((r, False), (np.sort(r), True), (ranks, True), (np.arange(100_000), True))]
    assert all(n < most for n, most in zip(sizes, (4.5, 3, 1.5, 0.01), strict=True))


def test_tiles_and_ranks_take_few_bytes_a_pair(spark):
    """Plain arrays take 12 bytes a pair for the tile and 16 for values and ranks."""
    rng = np.random.default_rng(8)
    n_genes, cells = 400, 300
    value = rng.poisson(1.0, (cells, n_genes))
    rows = pd.DataFrame([(1, "t", c, g, float(value[c, g])) for c in range(cells) for g in range(n_genes) if value[c, g]], columns=["dataset_id", "cell_type", "cell_id", "gene", "value"])
    expr = spark.createDataFrame(rows).withColumns({"dataset_id": F.col("dataset_id").cast("int"), "gene": F.col("gene").cast("int")})
    meta = expr.select("dataset_id", "cell_id", "cell_type").distinct()
    made = tiles.product_tiles(expr, meta, GeneSpan(0, n_genes), ("dataset_id", "cell_type"), 20).cache()
    n = made.agg(F.sum("n_defined")).first()[0]
    size = made.agg(F.sum(F.length("idx") + F.length("val"))).first()[0]
    ranked = tiles.joint_ranks(made, ("dataset_id", "cell_type")).agg(F.sum(F.length("ranks"))).first()[0]
    made.unpersist()
    assert n > 70_000 and size < 5 * n and ranked < 2 * n


def test_blocks_of_the_pair_spine_are_dealt_to_many_tasks(spark):
    groups = spark.createDataFrame([(d,) for d in range(5)], "dataset_id int")
    made = correlate.pair_spine(groups, GeneSpan(3, 600), gene_block=64).withColumn("task", F.spark_partition_id())
    n, tasks, distinct = made.agg(F.count("*"), F.count_distinct("task"), F.count_distinct("dataset_id", "gene_a", "gene_b")).first()
    assert n == distinct == 5 * 600 * 601 // 2 and tasks > 16


def test_counts_without_a_gene_change_no_pair(spark):
    cells = random_cells(5, 60, types=("t",), datasets=(0,))
    expr, meta = tables(spark, cells)
    nameless = expr.limit(9).withColumn("gene", F.lit(None).cast("int"))
    got, want = (as_dict(correlate.pair_correlation(e, meta, GeneSpan(0, 5), 20, gene_block=3)) for e in (expr.unionByName(nameless), expr))
    assert got == want and len(got) == 15


def test_cells_of_few_genes_list_their_pairs(spark):
    """A chunk of 900 cells with three of 300 genes each, blocks of 32: the pairs of the cells are sent at once, not 55 products of blocks."""
    rng = np.random.default_rng(4)
    rows = pd.DataFrame([(c, float(g), float(rng.integers(1, 5))) for c in range(900) for g in [*rng.choice(300, 3, False), *([7] if c % 9 == 0 else [])]], columns=["cell_id", "gene", "value"])
    nameless = pd.DataFrame({"cell_id": [1], "gene": [np.nan], "value": [3.0]})
    made = list(tiles._chunk_products(32, 10, ("k",), 0, 4096)(("x", 0, 0), iter([rows, nameless])))
    x = np.zeros((900, 300))
    np.add.at(x, (rows["cell_id"], rows["gene"].astype(int)), rows["value"])
    got = np.zeros((300, 300))
    for t in made[0].itertuples():
        idx = tiles.spread(t.idx)
        got[t.ta * 32 + idx // 32, t.tb * 32 + idx % 32] = tiles.spread(t.val)
    assert len(made) == 1 and len(made[0]) > 50 and (got == np.tril(x.T @ x, -1)).all()


def test_sparse_cells_give_the_same_correlations_in_many_tasks(spark):
    rng = random.Random(9)
    cells = {(0, "t", c): {g: rng.choice([0, 1, 3]) if g in own else 0 for g in range(120)} for c in range(700) for own in [set(rng.sample(range(120), 4))]}
    expr, meta = tables(spark, cells)
    made = correlate.pair_correlation(expr, meta, GeneSpan(0, 120), 3, gene_block=16, chunk_cells=50)
    got, want = as_dict(made), brute_pearson(cells, 120, 3)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 8


def test_pairs_of_bitmaps_are_made_in_many_tasks(spark):
    cells = random_cells(40, 60, types=("s", "t"), datasets=(0, 1))
    expr, meta = tables(spark, cells)
    made = measure.defined_types(expr, meta, GeneSpan(0, 40), 2, 8)
    n, tasks = made.withColumn("task", F.spark_partition_id()).agg(F.count("*"), F.count_distinct("task")).first()
    assert n == 2 * 40 * 41 // 2 and tasks > 8
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan


def test_pairs_of_genes_are_dealt_evenly(spark):
    """All pairs that a row makes are in memory at once: a gene used to meet all before it, and its whole block was one task's."""
    groups, genes = spark.range(1).withColumnRenamed("id", "dataset_id"), GeneSpan(1, 2000)
    rows = correlate.pair_spine(groups, genes, 512)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == genes.n_pairs and max(sizes) < 0.15 * genes.n_pairs
    assert rows.filter("gene_b > gene_a OR gene_b < 1 OR gene_a > 2000").count() == 0 and rows.distinct().count() == genes.n_pairs


def test_defined_types_shuffles_no_pairs(spark, capsys):
    rows = [(d, t, c, g, float(1 + (c * g) % 5)) for d in (1, 2) for t in ("a", "b") for c in range(6) for g in range(1, 71) if t == "a" or g % 3]
    expr = spark.createDataFrame(rows, "dataset_id int, cell_type string, cell_id int, gene int, value double")
    meta = expr.select("dataset_id", "cell_id", "cell_type").distinct()
    out = measure.defined_types(expr, meta, GeneSpan(1, 70), 2, gene_block=40)
    out.explain()
    assert not [line for line in capsys.readouterr().out.splitlines() if "Exchange" in line and ("gene_a" in line or "x0" in line)]
    defined = {(d, t, g) for d, t, g in tiles.defined_genes(expr, meta, ("dataset_id", "cell_type"), 2).select("dataset_id", "cell_type", "gene").collect()}
    want = {(d, a, b): sum((d, t, a) in defined and (d, t, b) in defined for t in "ab") for d in (1, 2) for a in range(1, 71) for b in range(1, a + 1)}
    assert {(r.dataset_id, r.gene_a, r.gene_b): r.n_types for r in out.collect()} == want
