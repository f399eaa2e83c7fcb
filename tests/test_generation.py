"""Rounds of generation: what they keep, how tasks end, and that late rounds are no heavier than early ones."""

import json
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from taskweave.plans import generation
from taskweave.plans.generation import GenerationSettings, generate, generate_with_status
from taskweave.queries.stubs import md5

SCHEMA = "task_id int, instruction string, examples string, num_examples bigint, max_calls bigint"


def settings(**k):
    return GenerationSettings(requests_per_minute=None, wait_seconds=0.0, **k)


def voting_client():
    """Inputs repeat over rounds and their outputs disagree."""

    def ask(prompt, n, temperature, max_tokens):
        hashes = [md5(f"{prompt}~{i}") for i in range(n)]
        return [json.dumps({"input": f"case {int(h[:3], 16) % 25}", "output": h[4] * (1 + int(h[5], 16) % 2)}) for h in hashes]

    return ask


def by_votes(rows):
    """The pairs of (input, output) answers in order of appearance, each input with its best output."""
    counts, first, places = defaultdict(Counter), {}, {}
    for at, (source, target) in enumerate(rows):
        counts[source][target] += 1
        first.setdefault((source, target), at)
        places.setdefault(source, len(places))
    best = {s: min(c, key=lambda t: (-c[t], len(t), first[s, t], t)) for s, c in counts.items()}
    return {(place, s, best[s]) for s, place in places.items()}


def test_winners_by_delta_are_the_votes_over_everything(spark, monkeypatch):
    answered = []

    def logged(prompts, factory, calls):
        answers = complete(prompts, factory, calls)
        rows = answers.join(prompts.select("prompt_id", "task_id", "number"), "prompt_id").collect()
        for r in sorted(rows, key=lambda r: (r.task_id, r.number, r.choice)):
            pair = json.loads(r.content)
            answered.append((r.task_id, pair["input"], pair["output"]))
        return answers

    complete = generation.complete
    monkeypatch.setattr(generation, "complete", logged)
    tasks = spark.createDataFrame([(t, f"task {t}", "N/A", 60, 8) for t in range(3)], SCHEMA)
    pairs, status = generate_with_status(tasks, voting_client, settings(max_batch_size=2, responses_per_request=4))
    got = defaultdict(set)
    for r in pairs.collect():
        got[r.task_id].add((r.pos, r.input_col, r.output_col))
    want = {t: by_votes([(s, o) for u, s, o in answered if u == t]) for t in range(3)}
    assert dict(got) == want
    assert {(r.task_id, r.calls, r.have, r.state) for r in status.collect()} == {(t, 8, len(want[t]), generation.SPENT) for t in range(3)}


def test_the_plan_does_not_grow_with_the_rounds(spark, monkeypatch):
    sizes = defaultdict(list)

    def measured(df, label, **options):
        sizes[label].append(len(df._jdf.queryExecution().optimizedPlan().toString()))
        return stage(df, label, **options)

    stage = generation.stage
    monkeypatch.setattr(generation, "stage", measured)
    tasks = spark.createDataFrame([(0, "do", "N/A", 500, 12)], SCHEMA)
    assert generate(tasks, voting_client, settings(max_batch_size=1, responses_per_request=3)).count() <= 25
    for label in ("prompts", "status"):
        rounds = sizes[label][2:12]
        assert max(rounds) <= 1.02 * min(rounds)


def test_tasks_end_alone_and_say_how(spark):
    def client():
        def ask(prompt, n, temperature, max_tokens):
            if "dumb" in prompt:
                return ["no pair"] * n
            if "stuck" in prompt:
                return [json.dumps({"input": "same", "output": "x"})] * n
            return [json.dumps({"input": md5(f"{prompt}{temperature}{i}"), "output": "y"}) for i in range(n)]

        return ask

    rows = [(0, "fine", "N/A", 12, None), (1, "w " * 5000, "N/A", 5, None), (2, "dumb", "N/A", 5, None), (3, "stuck", "N/A", 5, None),
            (4, "short", "N/A", 40, 2), (5, "none wanted", "N/A", 0, None), (6, "no calls", "N/A", 5, 0)]
    tasks = spark.createDataFrame(rows, SCHEMA)
    plan = settings(max_batch_size=3, responses_per_request=2, max_idle_rounds=3)
    pairs, status = generate_with_status(tasks, client, plan)
    ends = {r.task_id: (r.have, r.state) for r in status.collect()}
    assert ends == {
        0: (12, "done"), 1: (0, "instruction too long"), 2: (0, "no new pairs"), 3: (1, "no new pairs"),
        4: (4, "no calls left"), 5: (0, "done"), 6: (0, "no calls left"),
    }
    assert {r["task_id"]: r["count"] for r in pairs.groupBy("task_id").count().collect()} == {0: 12, 3: 1, 4: 4}
    with pytest.raises(RuntimeError, match=r"1 \(instruction too long\), 2 \(no new pairs\), 3 \(no new pairs\)"):
        generate(tasks, client, plan, strict=True)
    assert generate_with_status(tasks.where("task_id = 0"), client, settings(max_rounds=1, max_batch_size=1))[1].first().state == "out of rounds"


def test_no_tasks(spark):
    pairs, status = generate_with_status(spark.createDataFrame([], SCHEMA), voting_client, settings())
    assert pairs.columns == ["task_id", "pos", "input_col", "output_col"] and pairs.count() == 0 == status.count()


def test_latest_line_of_a_position_is_sampled(spark):
    pool = spark.createDataFrame([(0, 0, "old", 0), (0, 0, "new", 3), (0, 1, "only", 1)], "task_id int, pos bigint, line string, part int")
    asked = spark.range(50).select(F.lit(0).alias("task_id"), F.col("id").alias("prompt_id"), F.lit(2).cast("bigint").alias("have"))
    lines = {line for r in generation.with_sampled_lines(asked, pool, 1, version="part").collect() for line in r.lines}
    assert lines == {"new", "only"}
