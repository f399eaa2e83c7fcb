"""Seeded shuffle, sample and holdout: T5-T7, J6."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.functions.draws import mark
from taskweave.operators.positions import with_position

_SMALL = 10_000  # rows few enough to be ordered by one task
_PREFIX = 3  # hex digits looked at per pass: at most 4096 counts reach the driver


def _columns(keys: Sequence[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def first_by_mark(df: DataFrame, keys: Sequence[str], n: int, seed: int | str) -> Column:
    """A test for "among the ``n`` rows with the smallest hash marks", exact, without sorting the rows.

    Counting marks by their leading digits shows in which digits the n-th row lies;
    the same is repeated inside those digits until few rows are left, which are then ordered.
    Each pass is a count over the key columns. The test itself needs no shuffle.
    """
    marks = df.select(*keys, mark(seed, *_columns(keys)).alias("_mark"))
    prefix, before = "", 0
    if n <= 0:
        return F.lit(False)
    while True:
        inside = marks.where(F.col("_mark").startswith(prefix))
        width = len(prefix) + _PREFIX
        counts = inside.groupBy(F.left("_mark", F.lit(width)).alias("p")).agg(F.count("*").alias("n")).collect()
        chosen = None
        for p, size in sorted((r["p"], r["n"]) for r in counts):
            if before + size >= n:
                chosen = (p, size)
                break
            before += size
        if chosen is None:
            return F.lit(True)  # fewer rows than asked for
        prefix, size = chosen
        if size <= _SMALL or len(prefix) >= 30:
            break
    last = (
        marks.where(F.col("_mark").startswith(prefix)).orderBy("_mark", *keys).limit(n - before).orderBy(
            F.desc("_mark"), *[F.desc(k) for k in keys]
        ).first()
    )
    here = mark(seed, *_columns(keys))
    tie = F.struct(here.alias("m"), *_columns(keys)) <= F.struct(
        F.lit(last["_mark"]).alias("m"), *[F.lit(last[k]).alias(k) for k in keys]
    )
    return (here < last["_mark"]) | ((here == last["_mark"]) & tie)


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int | str = 42) -> DataFrame:
    """``n`` rows, or all when there are fewer."""
    return df.where(first_by_mark(df, keys, n, seed))


def holdout(df: DataFrame, keys: Sequence[str], share: float = 0.15, seed: int | str = 2023) -> DataFrame:
    """Add ``split``: ``ceil(share * n)`` random rows are ``val``, the others ``train``."""
    n = df.select(*keys).count()
    if n <= 1:
        raise ValueError("a holdout needs more than one row")
    is_val = first_by_mark(df, keys, math.ceil(share * n), seed)
    return df.withColumn("split", F.when(is_val, "val").otherwise("train"))


def shuffle(df: DataFrame, keys: Sequence[str], seed: int | str = 2023, name: str = "pos") -> DataFrame:
    """Random order as a position column: the place of each row's hash mark, ties by the keys.

    Marks are even whatever the data, and positions come from range partitions, so no task sees more than its range.
    """
    marked = df.withColumn("_mark", mark(seed, *_columns(keys)))
    return with_position(marked, ["_mark", *keys], name=name).select(*df.columns, name)
