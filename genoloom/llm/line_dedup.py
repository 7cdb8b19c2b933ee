"""Line-level deduplication across documents, in DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, unused

#: Stripped from both ends of a line before it is compared.
BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text",
    n_lines: str = "n_lines", n_dropped: str = "n_dropped",
) -> DataFrame:
    """``docs`` with the text cleared of lines that many documents share; adds two counts per row.

    A line's key is the line stripped and lower-cased (A-Z). Keys of at least ``min_chars`` code
    points in at least ``min_docs`` documents lose every line except those of the largest id that
    holds the key. The other lines stay in their order, byte for byte.

    Cases: a null or empty text is one empty line and becomes ''. A null id is one document, smaller
    than all others. Rows that repeat an id are one document: they count once and are cut alike. All
    lines of the largest id stay, repeats inside it included. Other columns pass through; a column
    with the name of one of the two counts is replaced. An empty table gives an empty table.

    The text is shuffled once, with the positions to drop; before that only 128-bit hashes travel.
    Distinct (key, document) rows are formed before documents are counted, so a line that sits in a
    third of all documents is spread by document; the join with the shared keys has no grouping
    above it in its stage, so a hot key can be split.
    """
    own, mark, gone = unused(docs, "_ld_id"), unused(docs, "_ld_text"), unused(docs, "_ld_gone")
    text, doc = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    lines = docs.select(doc.alias("doc"), F.xxhash64(text).alias("mark"), F.posexplode(lines_of(text)).alias("at", "line"))
    trimmed = F.btrim("line", F.lit(BLANKS))
    lines = lines.filter(F.char_length(trimmed) >= min_chars).withColumn("key", line_key(F.col("line")))
    lines = lines.select("doc", "mark", "at", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("line"), "key").alias("k2"))
    shared = (
        lines.groupBy("k1", "k2", "doc").agg(F.lit(1).alias("one"))
        .groupBy("k1", "k2").agg(F.count("one").alias("n_docs"), F.max("doc").alias("last"))
        .filter(F.col("n_docs") >= min_docs).select("k1", "k2", "last")
    )
    drops = (
        lines.join(shared, ["k1", "k2"]).filter(~F.col("doc").eqNullSafe(F.col("last")))
        .groupBy("doc", "mark").agg(F.collect_set("at").alias(gone)).withColumnsRenamed({"doc": own, "mark": mark})
    )
    joined = docs.join(drops, F.col(f"`{id_col}`").eqNullSafe(F.col(own)) & (F.xxhash64(text) == F.col(mark)), "left")
    parts, drop = lines_of(text), F.coalesce(F.col(gone), F.array().cast("array<int>"))
    keep = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), drop)
    kept = F.when(F.col(gone).isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.transform(keep, lambda i: F.get(parts, i)), "\n"))
    counts = joined.withColumns({n_lines: F.size(parts).cast("long"), n_dropped: F.size(drop).cast("long")})
    return counts.withColumn(text_col, kept).drop(own, mark, gone)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, s.last IS NOT NULL AND s.last <> k.doc_id AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
