"""Ranks, tie-adjusted top-k sets and the distributed rank.

Plain ranking windows are used where a group is bounded by the gene universe (one profile).
Groups that hold gene *pairs* or *cells* can outgrow one task; ``grouped_rank`` ranks those.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .exprs import col

Keys = Sequence[str]
#: Distinct values one task ranks at a time, and sampled values per such range.
RANGE_ROWS = 1 << 16
SAMPLES = 64


def _ordered(keys: Keys, value: str | Column, descending: bool, *then: Column):
    v = col(value)
    first = v.desc_nulls_last() if descending else v.asc_nulls_last()
    return W.partitionBy(*keys).orderBy(first, *then)


def min_rank(keys: Keys, value: str | Column, descending: bool = True) -> Column:
    """1 + number of strictly better values; NULL stays NULL."""
    return F.when(col(value).isNotNull(), F.rank().over(_ordered(keys, value, descending)).cast("long"))


def max_rank(keys: Keys, value: str | Column, descending: bool = True) -> Column:
    """Last position of the tie block; NULLs share the last block."""
    w = _ordered(keys, value, descending).rangeBetween(W.unboundedPreceding, W.currentRow)
    return F.count(F.lit(1)).over(w)


def avg_rank(keys: Keys, value: str | Column, descending: bool = False) -> Column:
    """Mean position of the tie block; both parts share one window sort."""
    w = _ordered(keys, value, descending)
    last = F.count(F.lit(1)).over(w.rangeBetween(W.unboundedPreceding, W.currentRow))
    return F.when(col(value).isNotNull(), (F.rank().over(w) + last) / F.lit(2.0))


def random_rank(keys: Keys, value: str | Column, seed: int, item: str | Column, descending: bool = True) -> Column:
    """Ties broken by a seeded hash of the item, so that a rerun gives the same ranks."""
    tie = F.md5(F.concat_ws("|", F.lit(str(seed)), col(item).cast("string")))
    return F.when(
        col(value).isNotNull(), F.row_number().over(_ordered(keys, value, descending, tie, col(item))).cast("long")
    )


def _long_enough(held: Column, k: int, keys: Keys, short: str) -> Column:
    """True; for a group of fewer than k values the job fails, unless ``short`` is "own"."""
    if short == "own":
        return F.lit(True)
    if short != "error":
        raise ValueError(f"short is 'error' or 'own', not {short!r}")
    name = F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in keys])
    fault = F.raise_error(F.concat(F.lit(f"fewer than {k} values in the group "), name)).cast("boolean")
    return F.when(held >= k, True).otherwise(fault)


def tie_adjusted_k(df: DataFrame, keys: Keys, value: str, k: int, descending: bool = True, short: str = "error") -> DataFrame:
    """Per group, the largest k' <= k that does not stop inside a tie block that began before k.

    NULL values are dropped first. A group with fewer than k values is an error; with ``short="own"``
    its own length takes the place of k.
    """
    w = _ordered(keys, value, descending)
    found = (
        df.filter(F.col(value).isNotNull())
        .select(*keys, value)
        .withColumn("_rn", F.row_number().over(w))
        .withColumn("_rk", F.rank().over(w))
        .filter(F.col("_rn") <= k)
        .groupBy(*keys)
        .agg(F.max("_rk").alias("_rk"), F.count(F.lit(1)).alias("_n"))
    )
    return found.filter(_long_enough(F.col("_n"), k, keys, short)).select(
        *keys, F.when(F.col("_rk") < F.col("_n"), F.col("_rk") - 1).otherwise(F.col("_n")).cast("long").alias("k_eff")
    )


def top_set(
    df: DataFrame, keys: Keys, value: str, gene: str, k: int, descending: bool = True, check_k: bool = True, short: str = "error"
) -> DataFrame:
    """Rows of the top (or bottom) k of each group, ties at the end removed, never fewer than one.

    ``row_number <= k`` comes first, so Spark keeps k rows per group before it shuffles. A group with
    fewer than k values is an error; with ``short="own"`` its own length takes the place of k.
    """
    w = _ordered(keys, value, descending, F.col(gene).asc())
    rank_w = _ordered(keys, value, descending)
    all_rows = W.partitionBy(*keys)
    top = (
        df.filter(F.col(value).isNotNull())
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= k)
    )
    if not check_k and short == "own":
        return top.drop("_rn")
    top = top.withColumn("_n", F.count(F.lit(1)).over(all_rows)).filter(_long_enough(F.col("_n"), k, keys, short))
    if not check_k:
        return top.drop("_rn", "_n")
    top = (
        top.withColumn("_rk", F.rank().over(rank_w))
        .withColumn("_last", F.max("_rk").over(all_rows))
        .withColumn("_k", F.when(F.col("_last") < F.col("_n"), F.col("_last") - 1).otherwise(F.col("_n")))
    )
    return top.filter(F.col("_rn") <= F.greatest(F.col("_k"), F.lit(1))).drop("_rn", "_rk", "_last", "_n", "_k")


def range_splits(dist: DataFrame, keys: Keys, value: str, range_rows: int, *carried: str) -> DataFrame:
    """(keys, _splits): sorted values that cut a group's distinct values into ranges of about ``range_rows``.

    A value is in the sample if its hash is a multiple of ``range_rows / 64``, so about 64 sampled
    values fall into each range whatever the distribution; every 64th is a split. The sample depends
    on the values alone: it is the same wherever and however often it is drawn. Groups with fewer
    than 64 sampled values have no row; they are one range. ``carried`` columns are read, which keeps
    the plan below the same as in other branches, so that its shuffle runs once.
    """
    rate = max(range_rows // SAMPLES, 1)
    held = F.lit(True)
    for c in carried:
        held = held & F.col(c).isNotNull()
    # one condition over grouped and counted columns, which cannot be moved below the grouping
    sampled = dist.filter(F.when(held, F.pmod(F.xxhash64(value), F.lit(rate)) == 0))
    ordered = sampled.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_s"))
    return ordered.filter(F.size("_s") >= SAMPLES).select(*keys, F.filter("_s", lambda x, i: i % SAMPLES == SAMPLES - 1).alias("_splits"))


def range_of(value: str, splits: str = "_splits") -> Column:
    """Number of splits up to and including the value, by bisection; 0 without splits."""
    array, size = F.col(splits), F.size(splits)
    steps = F.reverse(F.sequence(F.lit(0), F.floor(F.log2(size.cast("double"))).cast("int")))

    def halve(at: Column, step: Column) -> Column:
        to = at + F.call_function("shiftleft", F.lit(1), step)
        return F.when((to <= size) & (F.get(array, to - 1) <= F.col(value)), to).otherwise(at)

    return F.when(size > 0, F.aggregate(steps, F.lit(0), halve)).otherwise(F.lit(0))


def value_positions(
    df: DataFrame,
    keys: Keys,
    value: str,
    descending: bool = True,
    range_rows: int = RANGE_ROWS,
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """Distinct values of each group with ``n_before`` (rows that come earlier) and ``n_equal``.

    Equal values collapse to one counted row first (partial aggregation removes hot tie blocks),
    the distinct values of a group are cut into ranges of about ``range_rows`` by sampled split
    points, each range is counted by itself, and the rows of the better ranges are added. No group
    is ever in one task, and an extreme value does not crowd the others into one range.

    ``sums`` names further quantities to accumulate the same way, as <name>_before, <name>_equal;
    a name ``n`` replaces the row count, which makes the rows weighted.
    """
    keys = list(keys)
    sums = {"n": F.lit(1).cast("long"), **(sums or {})}
    names = list(sums)
    dist = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[F.sum(c).alias(f"{n}_equal") for n, c in sums.items()])
    splits = range_splits(dist, keys, value, range_rows, *[f"{n}_equal" for n in names])
    binned = dist.join(splits, keys, "left") if keys else dist.join(splits, how="left")
    number = range_of(value)
    binned = binned.withColumn("_range", -number if descending else number).drop("_splits")
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = W.partitionBy(*keys, "_range").orderBy(order)
    ranges = binned.groupBy(*keys, "_range").agg(*[F.sum(f"{n}_equal").alias(n) for n in names])
    earlier = W.partitionBy(*keys).orderBy("_range")
    ranges = ranges.select(*keys, "_range", *[(F.sum(n).over(earlier) - F.col(n)).alias(f"_off_{n}") for n in names])
    own = {f"_in_{n}": F.sum(f"{n}_equal").over(inside) - F.col(f"{n}_equal") for n in names}
    return (
        binned.withColumns(own)
        .join(ranges, [*keys, "_range"])
        .select(
            *keys, value, *[c for n in names for c in ((F.col(f"_off_{n}") + F.col(f"_in_{n}")).alias(f"{n}_before"), F.col(f"{n}_equal"))]
        )
    )


def grouped_rank(
    df: DataFrame, keys: Keys, value: str, out: str, descending: bool = True, range_rows: int = RANGE_ROWS, method: str = "min"
) -> DataFrame:
    """Exact rank in groups too large for one task, by :func:`value_positions`.

    The rank comes back by an equi-join on the value, which adaptive skew handling may split.
    """
    if method not in ("min", "avg"):
        raise ValueError(method)
    keys = list(keys)
    # -0.0 and 0.0 are one value for ranking
    df = df.withColumn(value, F.when(F.col(value) == 0, F.lit(0)).otherwise(F.col(value)).cast(df.schema[value].dataType))
    first = F.col("n_before") + 1
    rank = first.cast("long") if method == "min" else first + (F.col("n_equal") - 1) / F.lit(2.0)
    ranks = value_positions(df, keys, value, descending, range_rows).select(*keys, value, rank.alias(out))
    return df.join(ranks, [*keys, value], "left")
