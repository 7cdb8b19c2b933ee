"""Statistics as aggregates and windows: summaries, rank tests, rank correlation, trends."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .exprs import col, pearson_agg
from .ranks import avg_rank, grouped_rank, value_positions

# Coefficients of the Abramowitz and Stegun 7.1.26 approximation of erf.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def six_numbers(value: str | Column) -> list[Column]:
    """Min, Q1, Median, Mean, Q3, Max; quantiles are exact with linear interpolation."""
    v = col(value).cast("double")
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [
        F.min(v).alias("min"),
        q[0].alias("q1"),
        q[1].alias("median"),
        F.avg(v).alias("mean"),
        q[2].alias("q3"),
        F.max(v).alias("max"),
    ]


def _quantile_of_positions(q: float, value: str) -> Column:
    """Aggregate over :func:`value_positions` rows that also carry the group's row number ``_n``."""
    at = (F.col("_n") - 1) * F.lit(q)
    start, stop = F.col("n_before"), F.col("n_before") + F.col("n_equal")
    pick = lambda i: F.max(F.when((i >= start) & (i < stop), F.col(value)))
    lo, hi = pick(F.floor(at)), pick(F.ceil(at))
    return lo + (hi - lo) * F.max(at - F.floor(at))


def large_group_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The six numbers where a group has more distinct values than one task should hold.

    Same exact quantiles as :func:`six_numbers`, picked from the distributed value positions.
    """
    keys = list(keys)
    pos = value_positions(df, keys, value, descending=False)
    basic = df.groupBy(*keys).agg(
        F.count(value).alias("_n"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max")
    )
    return pos.join(basic, keys).groupBy(*keys, "min", "mean", "max").agg(
        *[_quantile_of_positions(q, value).alias(name) for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    )


def large_group_median(df: DataFrame, keys: Sequence[str], value: str, out: str, weight: str | None = None) -> DataFrame:
    """Exact median of groups of any size; ``weight`` is a whole number of rows a row stands for."""
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull())
    count = F.col(weight) if weight else F.lit(1).cast("long")
    pos = value_positions(rows, keys, value, False, sums={"n": count})
    total = rows.groupBy(*keys).agg(F.sum(count).alias("_n"))
    return pos.join(total, keys).groupBy(*keys).agg(_quantile_of_positions(0.5, value).alias(out))


def normal_upper_tail(z: str | Column) -> Column:
    """P(Z > z) by the erf approximation above (absolute error below 1.5e-7)."""
    z = col(z)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    poly = F.lit(ERF_A[4])
    for a in reversed(ERF_A[:4]):
        poly = poly * t + F.lit(a)
    tail = F.lit(0.5) * poly * t * F.exp(-x * x)
    return F.when(z >= 0, tail).when(z < 0, F.lit(1.0) - tail)


def rank_sum_test(df: DataFrame, keys: Sequence[str], value: str, in_first: str) -> DataFrame:
    """Wilcoxon rank-sum of the rows where ``in_first`` is true against the others, per group.

    Normal approximation with tie correction and continuity 0.5. Mid-ranks come from the
    distributed value positions, so a group may hold any number of rows.
    """
    keys = list(keys)
    first = F.when(F.col(in_first), 1).otherwise(0).cast("long")
    pos = value_positions(df, keys, value, descending=False, sums={"first": first})
    c = F.col("n_equal").cast("double")
    agg = pos.groupBy(*keys).agg(
        F.sum("first_equal").cast("double").alias("n1"),
        F.sum(c).alias("n"),
        F.sum(F.col("first_equal") * (F.col("n_before") + (c + 1) / F.lit(2.0))).alias("r1"),
        F.sum(c * c * c - c).alias("ties"),
    )
    n1, n = F.col("n1"), F.col("n")
    n2 = n - n1
    u = F.col("r1") - n1 * (n1 + 1) / 2
    d = u - n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    shift = F.signum(d) * 0.5
    z2 = F.try_divide(d - shift, sigma)
    z1 = F.try_divide(d - 0.5, sigma)
    # least() skips NULL, but one tie block over all rows has no p-value
    p2 = F.when(z2.isNotNull(), F.least(F.lit(1.0), 2 * normal_upper_tail(F.abs(z2))))
    return agg.select(
        *keys,
        n1.cast("long").alias("n_first"),
        n2.cast("long").alias("n_second"),
        u.alias("u"),
        p2.alias("p_two_sided"),
        normal_upper_tail(z1).alias("p_greater"),
    )


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, large: bool = False) -> DataFrame:
    """Spearman per group over the rows where both values are present.

    A group is a profile (at most the gene list); ``large`` ranks groups of any size.
    """
    keys = list(keys)
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    if large:
        ranked = grouped_rank(rows, keys, x, "_rx", False, method="avg")
        ranked = grouped_rank(ranked, keys, y, "_ry", False, method="avg")
    else:
        ranked = rows.select(*keys, avg_rank(keys, x).alias("_rx"), avg_rank(keys, y).alias("_ry"))
    return ranked.groupBy(*keys).agg(pearson_agg("_rx", "_ry").alias("spearman"), F.count(F.lit(1)).alias("n"))


def spearman_matrix(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """Spearman of every pair of numeric columns, pairwise complete."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(a).alias("column_a"),
                F.lit(b).alias("column_b"),
                F.col(a).cast("double").alias("x"),
                F.col(b).cast("double").alias("y"),
            )
            for i, a in enumerate(columns)
            for b in columns[i + 1 :]
        ]
    )
    long = df.select(row_id, F.explode(pairs).alias("p")).select("p.*")
    return spearman(long, ["column_a", "column_b"], "x", "y")


def correlation_test(x: str | Column, y: str | Column) -> list[Column]:
    """r, number of complete rows and the t statistic of a Pearson correlation."""
    r = pearson_agg(x, y)
    n = F.count(F.when(col(x).isNotNull() & col(y).isNotNull(), 1))
    return [r.alias("r"), n.alias("n"), (r * F.sqrt(F.try_divide((n - 2).cast("double"), 1 - r * r))).alias("t")]


def two_by_two(a: Column, b: Column) -> list[Column]:
    """Counts of a 2x2 table of two flags and its sample odds ratio (NULL on a zero cell below)."""
    n11, n10 = F.count_if(a & b), F.count_if(a & ~b)
    n01, n00 = F.count_if(~a & b), F.count_if(~a & ~b)
    return [
        n11.alias("n11"),
        n10.alias("n10"),
        n01.alias("n01"),
        n00.alias("n00"),
        F.try_divide((n11 * n00).cast("double"), (n10 * n01).cast("double")).alias("odds_ratio"),
    ]


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int, log10: bool = False) -> DataFrame:
    """Counts in ``bins`` equal bins between the smallest and the largest value of a group."""
    keys = list(keys)
    v = F.log10(col(value) + 1) if log10 else col(value).cast("double")
    vals = df.filter(F.col(value).isNotNull()).select(*keys, v.alias("_v"))
    span = vals.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    b = F.least(F.lit(bins), F.floor(F.coalesce(F.try_divide((F.col("_v") - F.col("_lo")) * bins, width), F.lit(0.0))) + 1)
    return vals.join(span, keys).withColumn("bin", b.cast("int")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def linear_trend(x: str | Column, y: str | Column) -> list[Column]:
    """Slope and intercept of the least-squares line; NULL where x does not vary."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    n, sx, sy = F.count(x).cast("double"), F.sum(x), F.sum(y)
    den = n * F.sum(x * x) - sx * sx
    slope = F.try_divide(n * F.sum(x * y) - sx * sy, den)
    return [slope.alias("slope"), ((sy - slope * sx) / n).alias("intercept")]
