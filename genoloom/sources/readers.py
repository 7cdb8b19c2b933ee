"""Readers of the text layouts count matrices and reference tables come in."""
from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Tab file with a header; the schema is given, never inferred."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def read_positional(spark: SparkSession, path: str, columns: dict[int, str]) -> DataFrame:
    """Headerless tab file; picks columns by 1-based position, in the order given."""
    raw = spark.read.csv(path, sep="\t", header=False)
    return raw.select(*[F.col(f"_c{i - 1}").alias(name) for i, name in columns.items()])


def read_after_banner(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tab file with one banner line above the header, in every part file.

    The banner is skipped as if it were the header; the true header is the row that repeats the
    column names.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    rows = spark.read.csv(path, sep="\t", header=True, enforceSchema=True, schema=text)
    first = schema.fields[0].name
    rows = rows.filter(~F.col(first).eqNullSafe(first))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the 0-based place of each line in its split; the lines of a split come one after the other."""
    split, seen = None, 0
    for batch in batches:
        files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        place = []
        for at in zip(files, blocks):
            if at != split:
                split, seen = at, 0
            place.append(seen)
            seen += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], ["_f", "_b", "line", "_i"])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, line_no, file_line_no): lines with their 1-based numbers across the files of a path, in file name order, and in their file.

    The pass that reads a line counts its place within its split (file, block start). The lines in
    earlier splits are prefix sums over the counts per split, which depend on the splits alone and not
    on how a scan deals them to tasks.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.col("value").alias("line"))
    lines = lines.mapInArrow(_placed, "_f string, _b long, line string, _i long")
    splits = lines.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = lambda w: F.sum("_n").over(w) - F.col("_n")
    splits = splits.select("_f", "_b", before(W.orderBy("_f", "_b")).alias("_all"), before(W.partitionBy("_f").orderBy("_b")).alias("_own"))
    return lines.join(splits, ["_f", "_b"]).select(
        F.col("_f").alias("file"), "line", (F.col("_all") + F.col("_i") + 1).alias("line_no"), (F.col("_own") + F.col("_i") + 1).alias("file_line_no")
    )


def read_dense(spark: SparkSession, path: str, key: str = "gene", cells_as_rows: bool = False, sep: str = "\t") -> DataFrame:
    """Dense matrix text to non-zero triples; the first column is the gene (or the cell).

    A line is split once, its non-zero fields are exploded with their positions and meet the header of
    their own file by position. A matrix may have any number of columns, and the files of a path
    different ones. Fields that are no number count as missing.
    """
    lines = numbered_lines(spark, path)
    plain = lambda c: F.btrim(c, F.lit('"'))
    fields = F.split("line", re.escape(sep), -1)
    header = lines.filter("file_line_no = 1").select("file", F.posexplode(F.slice(fields, 2, F.size(fields))).alias("at", "_name"))
    rows = lines.filter("file_line_no > 1").select("file", fields.alias("f"))
    found = F.transform(F.slice("f", 2, F.size("f")), lambda x, i: F.struct(i.alias("at"), plain(x).try_cast("double").alias("value")))
    cells = rows.select("file", plain(F.col("f")[0]).alias("_row"), F.explode(F.filter(found, lambda x: x["value"] != 0)).alias("c"))
    named = cells.select("file", "_row", "c.at", "c.value").join(header.withColumn("_name", plain(F.col("_name"))), ["file", "at"])
    row, column = ("cell_id", key) if cells_as_rows else (key, "cell_id")
    return named.select(F.col("_row").alias(row), F.col("_name").alias(column), "value").select(key, "cell_id", "value")


def read_matrix_market(spark: SparkSession, path: str, features: str, barcodes: str, transposed: bool = False) -> DataFrame:
    """Triplet matrix with a feature list and a barcode list joined by position."""
    lines = numbered_lines(spark, path).filter(~F.col("line").startswith("%"))
    size_line = lines.agg(F.min("line_no")).first()[0]  # one number: the first line that is no comment
    parts = F.split(F.col("line"), r"\s+")
    entries = lines.filter(F.col("line_no") > size_line).select(
        parts[0].cast("long").alias("i"), parts[1].cast("long").alias("j"), parts[2].cast("double").alias("value")
    )
    g, c = ("j", "i") if transposed else ("i", "j")
    names = numbered_lines(spark, features).select(F.col("line_no").alias(g), F.split("line", "\t")[0].alias("gene"))
    cells = numbered_lines(spark, barcodes).select(F.col("line_no").alias(c), F.split("line", "\t")[0].alias("cell_id"))
    return entries.join(names, g).join(cells, c).select("gene", "cell_id", "value")


def read_parts(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str, pattern: str) -> DataFrame:
    """Several files of one dataset stacked; ``part`` is the first group of ``pattern`` in the path."""
    rows = spark.read.csv(paths, sep="\t", header=True, schema=schema)
    return rows.withColumn("part", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def read_aggregates(
    spark: SparkSession, path: str, ids: Sequence[int | str] | None = None, genes: Sequence[int] | None = None, value: str = "rsr"
) -> DataFrame:
    """Aggregate table of some datasets and some columns (partition pruning and pushdown)."""
    rows = spark.read.parquet(path)
    if ids is not None:
        rows = rows.filter(F.col("dataset_id").isin(list(ids)))
    if genes is not None:
        rows = rows.filter(F.col("gene_b").isin(list(genes)))
    return rows.select("dataset_id", "gene_a", "gene_b", value)


def read_datasets(spark: SparkSession, path: str, ids: Sequence[int | str]) -> DataFrame:
    """Normalised counts of the named datasets only."""
    return spark.read.parquet(path).filter(F.col("dataset_id").isin(list(ids)))


def pick_datasets(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """A batch job over an (id, species) list is a semi-join, not a loop."""
    return df.join(wanted, wanted.columns, "left_semi")


def merge_parts(*parts: DataFrame) -> DataFrame:
    """Stack the per-sample objects of a dataset."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def parts_share_size(parts: DataFrame, part: str = "part") -> DataFrame:
    """Cells per part; ``distinct_sizes`` says that no two parts have the same number."""
    n = parts.select(part, "cell_id").distinct().groupBy(part).agg(F.count(F.lit(1)).alias("n_cells"))
    same = n.groupBy("n_cells").agg(F.count(F.lit(1)).alias("_k"))
    return n.join(same, "n_cells").select(part, "n_cells", (F.col("_k") == 1).alias("distinct_size"))


def attach_clusters(cells: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cells of a tissue with their cluster description, a tissue-wide cell type and a unique id."""
    ct = clusters.select(
        "tissue", "cluster", F.regexp_replace(F.concat_ws("_", "tissue", "cell_type"), " ", "_").alias("cell_type"), "cell_type_group"
    )
    out = cells.withColumn("cluster", F.concat(F.lit("c-"), F.col("cluster").cast("string"))).join(ct, ["tissue", "cluster"], "left")
    return out.withColumn("id", F.concat(F.col("cell_id").cast("string"), F.lit("_"), F.coalesce("cell_type", F.lit("NA"))))


def write_tsv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Tab-separated export with a header in every part file."""
    df.write.mode("overwrite").partitionBy(*partition_by).csv(path, sep="\t", header=True)
