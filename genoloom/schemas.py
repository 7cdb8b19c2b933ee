"""Column contracts of the long tables. Genes are integer ordinals 'first .. first + G - 1'."""
from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXPR = ("dataset_id", "cell_type", "cell_id", "gene", "value")
CELL_META = ("dataset_id", "cell_id", "cell_type")
AGG = ("dataset_id", "gene_a", "gene_b", "rsr", "n_na")
PROFILE = ("species", "tf", "dataset_id", "gene", "score")

REFSEQ = T.StructType(
    [
        T.StructField("chromosome", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("strand", T.StringType()),
        T.StructField("refseq_id", T.StringType()),
        T.StructField("symbol", T.StringType()),
    ]
)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; present {df.columns}")
    return df


@dataclass(frozen=True)
class GeneSpan:
    """The gene dimension: ordinals ``first .. first + n - 1``, one row and column each."""

    first: int
    n: int

    @property
    def n_pairs(self) -> int:
        return self.n * (self.n + 1) // 2


def gene_span(genes: DataFrame) -> GeneSpan:
    """Read the span off the gene table (one aggregate row) and check that it has no holes."""
    lo, hi, n = genes.agg(F.min("gene"), F.max("gene"), F.count_distinct("gene")).first()
    if n == 0 or hi - lo + 1 != n:
        raise ValueError("gene ordinals must be contiguous; build them with index_genes()")
    return GeneSpan(int(lo), int(n))


def index_genes(gene_ref: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Give every distinct symbol an ordinal in symbol order. The gene list is a reference table."""
    return gene_ref.select(symbol).distinct().select(
        symbol, F.row_number().over(W.partitionBy(F.lit(1)).orderBy(symbol)).alias("gene")
    )
