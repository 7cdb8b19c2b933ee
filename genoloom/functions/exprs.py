"""Small column expressions shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fix10(c: str | Column) -> Column:
    """Fix a double to 10 decimals, so that summation order cannot break or make ties."""
    return F.floor(col(c) * F.lit(1e10) + F.lit(0.5)) / F.lit(1e10)


def rnd(c: str | Column, digits: int) -> Column:
    """Round half up by plain double arithmetic, so that any engine gives the same result."""
    scale = float(10**digits)
    return F.floor(col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def share(cond: Column) -> Column:
    """Share of rows that meet a condition; rows where it is NULL are left out."""
    return F.avg(cond.cast("double"))


def count_true(cond: Column) -> Column:
    return F.coalesce(F.sum(cond.cast("long")), F.lit(0).cast("long"))


def title(c: str | Column) -> Column:
    """First letter upper case, the rest lower case."""
    c = col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1_000_000)))


def pearson(n, sx, sy, sxx, syy, sxy) -> Column:
    """Pearson from moments; NULL where a variance is zero (``corr`` would raise under ANSI)."""
    n, sx, sy, sxx, syy, sxy = map(col, (n, sx, sy, sxx, syy, sxy))
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 0) & (vy > 0), F.try_divide(n * sxy - sx * sy, F.sqrt(vx) * F.sqrt(vy)))


def pearson_agg(x: str | Column, y: str | Column) -> Column:
    """Aggregate form of :func:`pearson` over rows where both values are present."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return pearson(
        F.count(x).cast("double"), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y)
    )
