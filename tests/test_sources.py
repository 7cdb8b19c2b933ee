import pytest
from pyspark.sql import types as T

from genoloom.sources import readers, stage


def test_banner_and_header_are_skipped(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("Table S1. Curated pairs\ntf\tn\nAA\t1\nBB\t2\n")
    schema = T.StructType([T.StructField("tf", T.StringType()), T.StructField("n", T.IntegerType())])
    assert [tuple(r) for r in readers.read_after_banner(spark, str(tmp_path / "t.tsv"), schema).collect()] == [("AA", 1), ("BB", 2)]


def test_positional_scan(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("585\tNM_1\tchr1\t+\t10\t20\n586\tNM_2\tchr2\t-\t30\t40\n")
    out = readers.read_positional(spark, str(tmp_path / "t.tsv"), {3: "chromosome", 5: "start", 2: "refseq_id"}).collect()
    assert [tuple(r) for r in out] == [("chr1", "10", "NM_1"), ("chr2", "30", "NM_2")]


def test_dense_both_ways(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("V1\tc.1\tc.2\nG1\t0\t2\nG2\t3\t0\n")
    out = {tuple(r) for r in readers.read_dense(spark, str(tmp_path / "m.tsv")).collect()}
    assert out == {("G1", "c.2", 2.0), ("G2", "c.1", 3.0)}
    (tmp_path / "t.tsv").write_text("V1\tG1\tG2\nc1\t0\t3\nc2\t2\t0\n")
    out = {tuple(r) for r in readers.read_dense(spark, str(tmp_path / "t.tsv"), cells_as_rows=True).collect()}
    assert out == {("G1", "c2", 2.0), ("G2", "c1", 3.0)}


def test_matrix_market_with_an_entry_like_the_size_line(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% made by hand\n2 3 3\n1 1 5\n2 3 3\n1 2 7\n")
    (tmp_path / "f.tsv").write_text("GA\tx\nGB\ty\n")
    (tmp_path / "b.tsv").write_text("c1\nc2\nc3\n")
    out = readers.read_matrix_market(spark, *(str(tmp_path / n) for n in ("m.mtx", "f.tsv", "b.tsv")))
    assert {tuple(r) for r in out.collect()} == {("GA", "c1", 5.0), ("GB", "c3", 3.0), ("GA", "c2", 7.0)}


def test_line_numbers_over_many_files_and_splits(spark, tmp_path):
    want, n = {}, 0
    for f in range(5):
        lines = []
        for _ in range(200 + 37 * f):
            n += 1
            lines.append(f"line {n}")
            want[f"line {n}"] = n
        (tmp_path / f"part-{f}.txt").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = {r["line"]: r["line_no"] for r in readers.numbered_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want


def test_materialize_runs_once_unless_forced(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = stage.stage_path(spark, "test_materialize", "once")
    assert stage.materialize(spark, path, build).count() == 3
    assert stage.materialize(spark, path, build).count() == 3 and len(calls) == 1
    assert stage.materialize(spark, path, build, force=True).count() == 3 and len(calls) == 2


def test_shared_folder_comes_from_the_session(spark):
    assert stage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_parts_of_equal_size_are_reported(spark):
    rows = [("a", 1), ("a", 2), ("b", 3), ("b", 4), ("c", 5)]
    out = {r["part"]: r["distinct_size"] for r in readers.parts_share_size(spark.createDataFrame(rows, "part string, cell_id int")).collect()}
    assert out == {"a": False, "b": False, "c": True}
