"""Randomness that depends only on a seed and a row's key.

The same rows are drawn on any number of partitions, after a retry, and in any
engine that has MD5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mark(seed: int | str, *keys: Column) -> Column:
    """The hash text rows are ordered by."""
    return F.md5(F.concat_ws("~", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def draw(limit: Column, seed: int | str, *keys: Column) -> Column:
    """A whole number from 0 to ``limit - 1``."""
    number = F.conv(F.substring(mark(seed, *keys), 1, 15), 16, 10).cast("bigint")
    return F.pmod(number, limit.cast("bigint"))


def draw_distinct(k: Column, n: Column, seed: int | str, *keys: Column) -> Column:
    """``k`` different positions below ``n``, each set equally likely (Floyd's method).

    ``k`` is small (ten examples at most), so the membership test is a short scan.
    """
    none = F.array().cast("array<bigint>")

    def step(chosen: Column, j: Column) -> Column:
        t = draw(j + 1, seed, *keys, j)
        return F.concat(chosen, F.array(F.when(F.array_contains(chosen, t), j).otherwise(t)))

    return F.when(k > 0, F.aggregate(F.sequence((n - k).cast("bigint"), (n - 1).cast("bigint")), none, step)).otherwise(none)
