"""Seeded draws: orders by a hash, random places, and permutations that are evaluated place by place."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_key(seed: int, *parts: str | Column) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def with_draws(df: DataFrame, n_iter: int, name: str = "iter") -> DataFrame:
    """Every row once per draw."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(n_iter))))


def shuffled_position(keys: Sequence[str], item: str, seed: int, *salt: str) -> Column:
    """Position of the item in a seeded shuffle of its group."""
    w = W.partitionBy(*keys).orderBy(hash_key(seed, *salt, item), F.col(item))
    return F.row_number().over(w).cast("long")


def below(n: str | Column, seed: int, *parts: str | Column) -> Column:
    """A number in 0 .. n - 1 from the hash of seed and parts (60 bits, so its bias is below n / 2^60)."""
    n = F.col(n) if isinstance(n, str) else n
    return F.pmod(F.conv(F.substring(hash_key(seed, *parts), 1, 15), 16, 10).cast("long"), n)


#: Rounds of the network, and the prime its round functions count by.
ROUNDS, ORDER = 6, 2**31 - 1


def permutation_keys(seed: int, *parts: str | Column) -> Column:
    """Two 28-bit numbers per round from hashes of seed and parts: the key of one permutation."""
    digits = lambda i, at: F.conv(F.substring(hash_key(seed, *parts, F.lit(i)), at, 7), 16, 10).cast("long")
    return F.array(*[F.struct(F.lit(i).alias("i"), digits(i, 1).alias("a"), digits(i, 8).alias("b")) for i in range(ROUNDS)])


def permuted(place: Column, n: Column, keys: Column) -> Column:
    """The number (0 .. n - 1) at a place (0 .. n - 1) of the permutation with these keys.

    A Feistel network over pairs (l, r) with l below a = ceil(sqrt(n)) and r below b = ceil(n / a): in
    turn one half is moved by a function of the other, which permutes all a * b pairs. A pair outside
    0 .. n - 1 is permuted again until it is inside; there are fewer than a such pairs, so fewer than
    a repeats. Nothing is sorted: the first m places of a shuffle of n items cost m evaluations.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def moved(x: Column, key: Column) -> Column:
        t = (x + key["a"]) % ORDER
        return ((t * t) % ORDER * key["b"] + key["a"]) % ORDER

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).alias("r"))

        def turn(h: Column, key: Column) -> Column:
            even = F.struct(((h["l"] + moved(h["r"], key)) % a).alias("l"), h["r"].alias("r"))
            odd = F.struct(h["l"].alias("l"), ((h["r"] + moved(h["l"], key)) % b).alias("r"))
            return F.when(key["i"] % 2 == 0, even).otherwise(odd)

        return F.aggregate(keys, start, turn, lambda h: h["l"] * b + h["r"])

    extra = F.when(a * b > n, F.sequence(F.lit(1).cast("long"), a * b - n)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(extra, once(place), lambda x, _: F.when(x < n, x).otherwise(once(x)))


def permuted_sql(source: str, place: str, n: str, seed: int, parts: str, longest: int) -> str:
    """``permuted`` as SQL: all columns of ``source`` and the number ``x``; for n up to ``longest``."""
    a = f"CAST(ceil(sqrt({n}::DOUBLE)) AS BIGINT)"
    keys = ", ".join(f"('0x' || substr(md5(concat_ws('|', '{seed}', {parts}, {i})), {at}, 7))::BIGINT AS {c}{i}_" for i in range(ROUNDS) for c, at in (("ka", 1), ("kb", 8)))
    sql = f"SELECT *, {a} AS a_, CAST(ceil({n} / {a}::DOUBLE) AS BIGINT) AS b_, CAST({place} AS BIGINT) AS x, {keys} FROM ({source})"
    spare = max(math.ceil(math.sqrt(m)) * math.ceil(m / math.ceil(math.sqrt(m))) - m for m in range(1, longest + 1))
    for walk in range(spare + 1):
        sql = f"SELECT *, x // b_ AS l_, x % b_ AS r_ FROM ({sql})"
        for i in range(ROUNDS):
            own, other, size = ("l_", "r_", "a_") if i % 2 == 0 else ("r_", "l_", "b_")
            t = f"(({other} + ka{i}_) % {ORDER})"
            sql = f"SELECT * REPLACE (({own} + (({t} * {t}) % {ORDER} * kb{i}_ + ka{i}_) % {ORDER}) % {size} AS {own}) FROM ({sql})"
        done = "false" if walk == 0 else f"x < {n}"
        sql = f"SELECT * EXCLUDE (l_, r_) REPLACE (CASE WHEN {done} THEN x ELSE l_ * b_ + r_ END AS x) FROM ({sql})"
    spent = ", ".join(["a_", "b_", *[f"{c}{i}_" for i in range(ROUNDS) for c in ("ka", "kb")]])
    return f"SELECT * EXCLUDE ({spent}) FROM ({sql})"
