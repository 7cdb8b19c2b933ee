"""Connected components of a link table by alternating star steps; nothing meets on the driver."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import written


def _towards_smallest(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Each node points its (larger) neighbours at the smallest node it knows."""
    if larger_only:
        seen = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    told = seen.join(least, "u")
    if larger_only:
        told = told.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        told = told.select(F.col("v").alias("u"), F.col("low").alias("v")).union(least.select("u", F.col("low").alias("v")))
    return told.filter("u <> v").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); root is the smallest node of the component.

    u and v may be of any type that can be ordered. Links may repeat and may join a node to itself;
    an isolated node has no row. Every round is written to the shared folder, which cuts the lineage
    and outlives executors. A hub is met by map-side minima and by joins that can be split.
    """
    edges, before = written(links.select("u", "v").filter("u <> v").distinct(), "links"), None
    for _ in range(max_rounds):
        edges = written(_towards_smallest(_towards_smallest(edges, True), False), "links")
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        before = now
    raise RuntimeError(f"no end after {max_rounds} rounds")
