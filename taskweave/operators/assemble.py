"""Take ranked sources until enough rows are gathered: T10."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskweave.operators.positions import with_position


def sources_for_target(sizes: DataFrame, target: int, max_sources: int = 3, source: str = "source") -> DataFrame:
    """Sources in rank order until ``target`` rows are reached: (source, rank, already).

    ``sizes`` has one row per source (source, rank, n_rows). At most ``max_sources`` are looked at, so
    the running total is over that many rows.
    """
    first = sizes.orderBy("rank", source).limit(max_sources)
    before = Window.orderBy("rank", source).rowsBetween(Window.unboundedPreceding, -1)
    running = F.coalesce(F.sum("n_rows").over(before), F.lit(0).cast("bigint"))
    return first.withColumn("already", running).where(F.col("already") < target)


def assemble(
    rows: DataFrame,
    ranked: DataFrame,
    keys: list[str],
    target: int,
    max_sources: int = 3,
    source: str = "source",
) -> DataFrame:
    """Rows of the best sources, in source order, cut at exactly ``target`` rows.

    ``ranked`` is (source, rank). Every source but the last is taken whole; only the last one is
    numbered, so that it can be cut.
    """
    sizes = rows.groupBy(source).agg(F.count("*").alias("n_rows")).join(ranked, source)
    chosen = sources_for_target(sizes, target, max_sources, source)
    picked = rows.join(chosen.select(source, "already", "n_rows"), source)
    whole = picked.where(F.col("already") + F.col("n_rows") <= target)
    partial = picked.where(F.col("already") + F.col("n_rows") > target)
    cut = with_position(partial, keys, name="_pos").where(F.col("_pos") + F.col("already") < target)
    return whole.select(*rows.columns).unionByName(cut.select(*rows.columns))
