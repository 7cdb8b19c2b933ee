"""What several operators of this package share."""
from __future__ import annotations

import ctypes
import gc
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have; Spark compares names without case."""
    have, name = {c.lower() for c in df.columns}, base
    while name.lower() in have:
        name += "_"
    return name


def learned_from(doc_id: Column, modulus: int) -> Column:
    """True for documents a model may learn from: crc32 of the id as text, modulo, is not 2. Null ids are held in."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)) != 2, F.lit(True))


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z only. Where every character is one byte, lower() does just that and is faster."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, low))


def give_back() -> None:
    """Returns the memory that this process no longer uses; drivers and workers live on after a step that took much."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
        if trim:
            trim(0)
