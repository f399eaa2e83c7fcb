"""Contiguous train/val/test splits with caps: W1."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.operators.positions import before_key, keys_at, with_position


def check_proportions(train: float, val: float) -> None:
    if train + val >= 1:
        raise ValueError(f"train {train} + val {val} must stay below 1, the rest is the test split")


def split_sizes(n: int, train: float, val: float, caps: Mapping[str, int] | None) -> tuple[int, int, int]:
    """Sizes of the three splits; the test size is taken before any cap applies."""
    caps = caps or {}
    sizes = {"train": int(train * n), "val": int(val * n)}
    sizes["test"] = n - sizes["train"] - sizes["val"]
    return tuple(min(size, caps.get(name, size)) for name, size in sizes.items())


def _unsplit(df: DataFrame) -> DataFrame:
    """Of a table that already has splits only the training part is split anew, so that no test row is trained on."""
    return df.where(F.col("split") == "train").drop("split") if "split" in df.columns else df


def _ends(sizes: Sequence[int]) -> tuple[int, int, int]:
    return sizes[0], sizes[0] + sizes[1], sum(sizes)


def _named(before_train_end: Column, before_val_end: Column) -> Column:
    return F.when(before_train_end, "train").when(before_val_end, "val").otherwise("test")


def split_table(
    df: DataFrame,
    keys: Sequence[str],
    train: float = 0.8,
    val: float = 0.1,
    caps: Mapping[str, int] | None = None,
) -> DataFrame:
    """Split one table, ordered by its unique ``keys``; rows beyond the caps are left out.

    Only the key columns are sorted, to find the three border keys. The rows
    themselves are then cut by comparison with those keys: no shuffle of wide
    rows, and Parquet skips the row groups beyond the caps.
    """
    check_proportions(train, val)
    df = _unsplit(df)
    n = df.select(*keys).count()
    ends = _ends(split_sizes(n, train, val, caps))
    borders = keys_at(df, keys, [e for e in ends if e < n])

    def before(end: int) -> Column:
        return F.lit(True) if end >= n else before_key(keys, borders[end])

    return df.where(before(ends[2])).withColumn("split", _named(before(ends[0]), before(ends[1])))


def split_by_position(df: DataFrame, n: int, train: float, val: float, caps=None, pos: str = "pos") -> DataFrame:
    """The same for a table that already carries dense positions 0..n-1: pure predicates."""
    check_proportions(train, val)
    a, b, c = _ends(split_sizes(n, train, val, caps))
    return df.where(F.col(pos) < c).withColumn("split", _named(F.col(pos) < a, F.col(pos) < b))


def split_tasks(
    df: DataFrame,
    keys: Sequence[str],
    train: float = 0.8,
    val: float = 0.1,
    caps: Mapping[str, int] | None = None,
    task: str = "task_id",
) -> DataFrame:
    """Split every task's table on its own; a task may be of any size.

    Only the keys are put in order, to find the three border keys of each task. One row of borders per task
    is joined to the rows, which are cut by comparison.
    """
    check_proportions(train, val)
    df = _unsplit(df)
    if df.where(F.col(task).isNull()).select(task).head(1):
        raise ValueError(f"rows without {task} belong to no task and cannot be split")
    caps = caps or {}
    limit = lambda size, name: F.least(size, F.lit(caps[name])) if name in caps else size
    counts = df.groupBy(task).agg(F.count("*").alias("_n"))
    raw_train = F.floor(F.lit(train) * F.col("_n")).cast("bigint")
    raw_val = F.floor(F.lit(val) * F.col("_n")).cast("bigint")
    a = limit(raw_train, "train")
    b = a + limit(raw_val, "val")
    c = b + limit(F.col("_n") - raw_train - raw_val, "test")
    ends = counts.select(task, a.alias("_a"), b.alias("_b"), c.alias("_c"))
    placed = with_position(df.select(task, *keys), list(keys), name="_pos", group=[task]).join(ends, task)
    here = F.struct(*keys)
    borders = placed.where(F.col("_pos").isin(F.col("_a"), F.col("_b"), F.col("_c"))).groupBy(task).agg(
        *[F.max(F.when(F.col("_pos") == F.col(end), here)).alias(f"{end}_key") for end in ("_a", "_b", "_c")]
    )

    def before(end: str) -> Column:
        return F.col(f"{end}_key").isNull() | (here < F.col(f"{end}_key"))  # no border: the task ends first

    return (
        df.join(borders, task, "left").where(before("_c")).withColumn("split", _named(before("_a"), before("_b"))).select(*df.columns, "split")
    )
