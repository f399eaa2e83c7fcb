"""Positions, heads, voting, sampling: exact against brute force, and the same on any partitioning."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from taskweave.operators import positions
from taskweave.operators.assemble import assemble
from taskweave.operators.positions import head_per_group, keys_at, with_position
from taskweave.operators.sampling import first_by_mark, holdout, sample_rows, shuffle
from taskweave.operators.voting import known_votes, merge_counts, multi_vote, plurality, vote_counts, winners


@pytest.fixture
def skewed(spark):
    """One group holds most rows."""
    rnd = random.Random(7)
    data = [(0 if rnd.random() < 0.8 else rnd.randrange(5), k) for k in rnd.sample(range(10000), 2000)]
    return data, spark.createDataFrame(data, "g int, k int")


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_with_position(skewed, parts):
    data, df = skewed
    got = {(r["g"], r["k"]): r["pos"] for r in with_position(df.repartition(parts), ["k"]).collect()}
    assert got == {row: i for i, row in enumerate(sorted(data, key=lambda r: r[1]))}
    grouped = {(r["g"], r["k"]): r["pos"] for r in with_position(df.repartition(parts), ["k"], group=["g"]).collect()}
    expected = {}
    for g in {g for g, _ in data}:
        expected |= {row: i for i, row in enumerate(sorted(r for r in data if r[0] == g))}
    assert grouped == expected


def test_positions_of_an_empty_table(spark):
    assert with_position(spark.range(0), ["id"]).count() == 0


def test_keys_at(skewed):
    data, df = skewed
    ordered = sorted(data)
    assert keys_at(df, ["g", "k"], [0, 1234, 1999, 5000]) == {i: ordered[i] for i in (0, 1234, 1999)}


def test_keys_at_in_many_small_passes(spark, monkeypatch):
    monkeypatch.setattr(positions, "_SMALL", 20)
    monkeypatch.setattr(positions, "_CUTS", 5)
    rnd = random.Random(3)
    data = [(rnd.choice([None, "a", "b", "é"]), k, rnd.choice([k / 7, float("nan")])) for k in rnd.sample(range(-900, 900), 400)]
    df = spark.createDataFrame(data, "g string, k int, x double").coalesce(2).cache()
    ordered = sorted(((g, k) for g, k, _ in data), key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    ranks = [0, 1, 250, 399, 400, -1]
    assert keys_at(df, ["g", "k"], ranks) == {r: ordered[r] for r in ranks if 0 <= r < 400}
    doubles = sorted(x for _, _, x in data if x == x)
    got = keys_at(df, ["x"], [17, 399])
    assert got[17] == (doubles[17],) and got[399][0] != got[399][0]
    repeated = spark.createDataFrame([(i % 3,) for i in range(300)], "k int").coalesce(2)
    assert keys_at(repeated, ["k"], [0, 150, 299]) == {0: (0,), 150: (1,), 299: (2,)}
    assert keys_at(df.limit(0), ["k"], [0]) == {}


@pytest.mark.parametrize("bundles", [64, 3])
def test_head_per_group_with_and_without_bundles(skewed, monkeypatch, bundles):
    data, df = skewed
    monkeypatch.setattr(positions, "_BUNDLES", bundles)
    got = {tuple(r) for r in head_per_group(df.repartition(16), ["g"], [F.desc("k")], 40, rank="r").collect()}
    expected = set()
    for g in {g for g, _ in data}:
        expected |= {(g, k, i + 1) for i, (_, k) in enumerate(sorted((r for r in data if r[0] == g), key=lambda r: -r[1])[:40])}
    assert got == expected
    top = [r["k"] for r in head_per_group(df, [], [F.asc("k")], 40).collect()]
    assert sorted(top) == sorted(k for _, k in data)[:40]


def md5(seed, key):
    return hashlib.md5(f"{seed}~{key}".encode()).hexdigest()


def test_samples_are_the_smallest_marks(spark, monkeypatch):
    from taskweave.operators import sampling

    monkeypatch.setattr(sampling, "_SMALL", 3)  # several passes over longer and longer prefixes
    df = spark.range(3000).repartition(7)
    ordered = sorted(range(3000), key=lambda k: (md5(42, k), k))
    for n in (0, 1, 100, 2999, 3000, 4000):
        assert {r["id"] for r in df.where(first_by_mark(df, ["id"], n, 42)).collect()} == set(ordered[:n])
    assert sample_rows(df, ["id"], 10).count() == 10


def test_holdout_and_shuffle(spark):
    df = spark.range(1001)
    got = {r["id"]: r["split"] for r in holdout(df, ["id"], 0.15, 2023).collect()}
    ordered = sorted(range(1001), key=lambda k: (md5(2023, k), k))
    assert {k for k, s in got.items() if s == "val"} == set(ordered[: math.ceil(0.15 * 1001)])
    with pytest.raises(ValueError):
        holdout(spark.range(1), ["id"])
    assert {r["id"]: r["pos"] for r in shuffle(df, ["id"], 2023).collect()} == {k: i for i, k in enumerate(ordered)}
    assert shuffle(df.repartition(9), ["id"], 2023).orderBy("pos").first()["id"] == ordered[0]


VOTES = [("apple", o) for o in "AAGAD"] + [("banana", o) for o in "CBB"] + [("orange", o) for o in "OF"]


def test_multi_vote_takes_count_then_length_then_first(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(VOTES)] + [(90, "long", "bbb"), (91, "long", "aa")]
    df = spark.createDataFrame(rows, "pos bigint, input_col string, output_col string").repartition(6)
    got = [(r["input_col"], r["output_col"]) for r in multi_vote(df, F.col("pos")).orderBy("first_seen").collect()]
    assert got == [("apple", "A"), ("banana", "B"), ("orange", "O"), ("long", "aa")]
    assert [r["input_col"] for r in multi_vote(df, F.col("pos"), limit=2).collect()] == ["apple", "banana"]
    lexicographic = {r["input_col"]: r["output_col"] for r in multi_vote(df).collect()}
    assert lexicographic["orange"] == "F"
    assert multi_vote(df.limit(0), F.col("pos")).count() == 0


def test_votes_merge_round_by_round(spark):
    rounds = [
        [("1", "a"), ("1", "b"), ("1", "a"), ("1", "c"), ("2", "a"), ("2", "b")], [("3", "a"), ("3", "a"), ("3", "b")],
        [("1", "b"), ("1", "b"), ("1", "b")], [("4", "c"), ("4", "c"), ("5", "a")],
    ]
    states = [[("1", "a"), ("2", "a")], [("1", "a"), ("2", "a"), ("3", "a")], [("1", "b"), ("2", "a"), ("3", "a")],
              [("1", "b"), ("2", "a"), ("3", "a"), ("4", "c"), ("5", "a")]]
    state, seen = None, 0
    for votes, expected in zip(rounds, states):
        rows = [(seen + i, *v) for i, v in enumerate(votes)]
        seen += len(votes)
        counts = vote_counts(spark.createDataFrame(rows, "pos bigint, input_col string, output_col string"), F.col("pos"))
        state = counts if state is None else merge_counts(state, counts)
        assert [(r[0], r[1]) for r in winners(state).orderBy("first_seen").collect()] == expected


def test_plurality_counts_unknown_names_as_none(spark):
    votes = [(0, i, n) for i, n in enumerate(["x", "ghost", "ghoul", "x"])] + [(1, i, n) for i, n in enumerate(["y", "x", "x", "y"])] + [(2, 0, "ghost"), (2, 1, "spook"), (2, 2, "x")]
    rows = spark.createDataFrame(votes, "item int, vote int, name string")
    candidates = spark.createDataFrame([(0, "x"), (1, "x"), (1, "y"), (2, "x"), (2, "x")], "item int, name string")
    for chosen in (plurality(rows, candidates), plurality(known_votes(rows, candidates))):
        assert {r["item"]: (r["winner"], r["votes"]) for r in chosen.collect()} == {0: ("x", 2), 1: ("y", 2), 2: (None, 2)}


def test_assemble_takes_sources_in_rank_order_up_to_the_target(spark):
    rows = spark.range(100).select(F.when(F.col("id") < 30, "a").when(F.col("id") < 50, "b").otherwise("c").alias("source"), "id")
    ranked = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "source string, rank int")
    got = lambda **k: sorted(r["id"] for r in assemble(rows, ranked, ["id"], **k).collect())
    assert got(target=35) == [*range(15), *range(30, 50)]
    assert got(target=20) == [*range(30, 50)]
    assert got(target=1000, max_sources=2) == [*range(50)]
    assert len(got(target=1000)) == 100
