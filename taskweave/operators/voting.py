"""Votes: one output per input, one name per item: A1, A2, T8, J5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.contracts import INPUT, OUTPUT


def vote_counts(pairs: DataFrame, seen: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(input, output, n, first_seen): all that voting needs, and mergeable between rounds."""
    seen = F.lit(None).cast("bigint") if seen is None else seen
    return pairs.groupBy(*by, INPUT, OUTPUT).agg(F.count("*").alias("n"), F.min(seen).alias("first_seen"))


def merge_counts(old: DataFrame, new: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Add a round's counts to the state, instead of counting everything again."""
    return (
        old.unionByName(new).groupBy(*by, INPUT, OUTPUT).agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"))
    )


def winners(counts: DataFrame, by: tuple[str, ...] = (), tie_break: str = "first_seen") -> DataFrame:
    """Per input the most frequent output, then the shortest, then the first seen.

    ``first_seen`` of the result is where the input first appeared. Both aggregates
    combine on the map side, so an input with very many rows is not a hot spot.
    For tables without positions, ``tie_break="lexicographic"`` ends on the output itself.
    """
    ties = {"first_seen": [F.col("first_seen"), F.col(OUTPUT)], "lexicographic": [F.col(OUTPUT)]}
    if tie_break not in ties:
        raise ValueError(f"tie_break must be one of {sorted(ties)}")
    order = F.struct(-F.col("n"), F.length(OUTPUT), *ties[tie_break])
    return counts.groupBy(*by, INPUT).agg(
        F.min_by(OUTPUT, order).alias(OUTPUT), F.min("first_seen").alias("first_seen")
    )


def multi_vote(pairs: DataFrame, seen: Column | None = None, limit: int | None = None) -> DataFrame:
    """Vote over a whole table; with ``limit``, the inputs that appeared first."""
    tie_break = "lexicographic" if seen is None else "first_seen"
    out = winners(vote_counts(pairs, seen), tie_break=tie_break)
    return out if limit is None else out.orderBy("first_seen", INPUT).limit(limit)


def known_votes(votes: DataFrame, candidates: DataFrame, item: str = "item", name: str = "name") -> DataFrame:
    """Votes for a name that is not among the item's candidates become NULL, which can win like any other."""
    known = candidates.select(item, name).distinct().withColumn("_known", F.lit(True))
    return votes.join(known, [item, name], "left").withColumn(name, F.when(F.col("_known"), F.col(name))).drop("_known")


def plurality(
    votes: DataFrame, candidates: DataFrame | None = None, item: str = "item", name: str = "name", vote: str = "vote"
) -> DataFrame:
    """The most voted name per item; ties go to the name voted for first.

    With ``candidates`` (item, name), other names count as NULL. Votes are counted before they meet the candidates, so an
    item with very many votes brings one row per name to that join.
    """
    tally = votes.groupBy(item, name).agg(F.count("*").alias("n"), F.min(vote).alias("first"))
    if candidates is not None:
        known = known_votes(tally, candidates, item, name)
        tally = known.groupBy(item, name).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return tally.groupBy(item).agg(
        F.max_by(name, F.struct(F.col("n"), -F.col("first"))).alias("winner"), F.max("n").alias("votes")
    )
