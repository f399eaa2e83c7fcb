import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from taskweave.contracts import TaskSpec, require_columns
from taskweave.functions import prompts as P
from taskweave.functions.text import token_count
from taskweave.operators.completion import FILTERED, CallSettings, PromptRefused, complete, complete_until_parsed
from taskweave.plans.dataset_retrieval import retrieve_dataset
from taskweave.plans.generation import GenerationSettings, generate, generate_splits, with_sampled_lines
from taskweave.plans.rerank import rerank
from taskweave.plans.transform import judge_answers, transform_table, within_failure_budget
from taskweave.plans.understanding import expand_queries, parse_prompts, select_columns

FREE = CallSettings(responses=1, requests_per_minute=None, wait_seconds=0.0)


def prompts(spark, n, text="p"):
    return spark.range(n).select(F.col("id").alias("prompt_id"), F.concat(F.lit(text), F.col("id").cast("string")).alias("prompt"))


def log_client(folder, answer):
    """A client that writes one file per call."""

    def factory():
        def ask(prompt, n, temperature, max_tokens):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                json.dump([prompt, n, temperature, max_tokens], f)
            return answer(prompt, n)

        return ask

    return factory


def calls(folder):
    return [json.load(open(os.path.join(folder, f))) for f in os.listdir(folder)]


def test_complete_calls_once_and_isolates_failures(spark, tmp_path):
    def answer(prompt, n):
        if prompt == "p1":
            raise PromptRefused("policy")
        if prompt == "p2":
            raise TimeoutError("slow")
        return [f"{prompt}#{i}" for i in range(n)]

    out = complete(prompts(spark, 5), log_client(tmp_path, answer), CallSettings(responses=2, requests_per_minute=None, wait_seconds=0.0, max_tokens=1000))
    rows = {(r["prompt_id"], r["choice"], r["content"], r["error"]) for r in out.collect()}
    assert rows == {(p, i, f"p{p}#{i}", None) for p in (0, 3, 4) for i in (0, 1)} | {(1, 0, FILTERED, "policy"), (2, 0, "", "TimeoutError: slow")}
    assert out.count() == 8
    made = calls(tmp_path)
    assert sorted(c[0] for c in made) == ["p0", "p1", "p2", "p2", "p2", "p3", "p4"]  # reading twice calls nothing again
    assert {tuple(c[1:]) for c in made} == {(2, 1.0, 1000 - 1 - 300)}


def test_complete_continues_a_written_table(spark, tmp_path):
    (tmp_path / "log").mkdir()
    factory = log_client(tmp_path / "log", lambda p, n: ["ok"])
    path = str(tmp_path / "answers")
    assert complete(prompts(spark, 3), factory, FREE, path).count() == 3
    assert complete(prompts(spark, 5), factory, FREE, path).count() == 5
    assert sorted(c[0] for c in calls(tmp_path / "log")) == ["p0", "p1", "p2", "p3", "p4"]


def test_batches_share_the_budget_of_their_longest_prompt(spark, tmp_path):
    rows = [(0, "a", 0, 0.1), (1, "a b c", 0, 0.2), (2, "a b", 1, 0.3)]
    df = spark.createDataFrame(rows, "prompt_id int, prompt string, batch_id int, temperature double")
    complete(df, log_client(tmp_path, lambda p, n: ["x"]), CallSettings(responses=1, requests_per_minute=None, max_tokens=None))
    assert {(p, t, m) for p, _, t, m in calls(tmp_path)} == {("a", 0.1, 9), ("a b c", 0.2, 9), ("a b", 0.3, 6)}


def test_retry_rounds(spark, tmp_path):
    marker = str(tmp_path)

    def factory():
        def ask(prompt, n, temperature, max_tokens):
            seen = os.path.join(marker, prompt)
            if prompt == "p1" and not os.path.exists(seen):
                open(seen, "w").close()
                return [""]
            return [""] if prompt == "p2" else [prompt.upper()]

        return ask

    parse = lambda c: F.when(c != "", c)
    got = complete_until_parsed(prompts(spark, 3), factory, parse, tries=3, settings=FREE).collect()
    assert {(r["prompt_id"], r["parsed"]) for r in got} == {(0, "P0"), (1, "P1"), (2, None)}
    with pytest.raises(RuntimeError):
        complete_until_parsed(prompts(spark, 3), factory, parse, tries=1, settings=FREE, strict=True)
    with pytest.raises(ValueError):
        complete_until_parsed(prompts(spark, 3), factory, parse, tries=0)


def test_sampled_lines_are_distinct_and_even(spark):
    pool = spark.range(30).select(F.lit(0).alias("task_id"), F.col("id").alias("pos"), F.col("id").cast("string").alias("line"))
    asked = spark.range(2000).select(F.lit(0).alias("task_id"), F.col("id").alias("prompt_id"), F.lit(30).cast("bigint").alias("have"))
    rows = [r["lines"] for r in with_sampled_lines(asked, pool, 1).collect()]
    assert len(rows) == 2000 and all(1 <= len(r) <= 10 and len(set(r)) == len(r) for r in rows)
    counts = [sum(str(i) in r for r in rows) for i in range(30)]
    assert 0.7 < min(counts) / max(counts)  # each example is about as likely as any other
    empty = with_sampled_lines(asked.limit(3).withColumn("have", F.lit(0).cast("bigint")), pool.limit(0), 1)
    assert [r["lines"] for r in empty.collect()] == [[], [], []]


def test_generation_prompt_takes_what_fits(spark):
    lines = [f'input="{i}"\noutput="{i}"\n' for i in range(5)]
    rows = [(0, "do", "N/A", lines), (1, "do", "N/A", []), (2, "w " * 5000, "N/A", lines)]
    df = spark.createDataFrame(rows, "prompt_id int, instruction string, examples string, lines array<string>")
    full = {r["prompt_id"]: r for r in P.with_generation_prompt(df, 3500, 1).collect()}
    assert full[0]["n_used"] == 5 and full[0]["fits"] and all(line in full[0]["prompt"] for line in lines)
    assert full[1]["n_used"] == 0 and "N/A\n\nNew example" in full[1]["prompt"]
    assert not full[2]["fits"] and full[2]["n_used"] == 0
    for cutoff in range(60, 400, 20):
        got = P.with_generation_prompt(df.where("prompt_id = 0"), cutoff, 1).select("*", token_count(F.col("prompt")).alias("n")).first()
        assert got["n"] < cutoff if got["fits"] else got["n_used"] == 0
    shown = {n: sum(t in r["prompt"] for t in P.SOLVED_TASKS) for n in range(5)
             for r in P.with_generation_prompt(df.where("prompt_id = 0").withColumn("lines", F.slice("lines", 1, n)), 3500, 1).collect()}
    assert shown == {0: 2, 1: 4, 2: 3, 3: 2, 4: 4}


def settings(**k):
    return GenerationSettings(requests_per_minute=None, wait_seconds=0.0, **k)


def test_generation_without_voting_stops_at_the_call_limit(spark, tmp_path):
    tasks = spark.createDataFrame([(0, "do", "N/A", 29, 3)], "task_id int, instruction string, examples string, num_examples bigint, max_calls bigint")
    same = lambda p, n: [json.dumps({"input": "x", "output": "y"})] * n
    out = generate(tasks, log_client(tmp_path, same), settings(multi_vote=False)).collect()
    assert len(out) == 15 and {(r["input_col"], r["output_col"]) for r in out} == {("x", "y")} and len(calls(tmp_path)) == 3
    assert sorted(r["pos"] for r in out) == list(range(15))


def test_generation_votes_warms_up_and_serves_many_tasks(spark, tmp_path):
    def answer(prompt, n):
        case = str(len(os.listdir(tmp_path)))
        return [json.dumps({"input": case, "output": "long"}), json.dumps({"input": case, "output": "b"}), json.dumps({"input": case, "output": "b"}), "broken", ""][:n]

    tasks = spark.createDataFrame([(t, f"task {t}", "N/A", 2 + t) for t in range(3)], "task_id int, instruction string, examples string, num_examples bigint")
    out = generate(tasks, log_client(tmp_path, answer), settings(max_batch_size=2, responses_per_request=5)).collect()
    by_task = {t: [r for r in out if r["task_id"] == t] for t in range(3)}
    assert {t: len(rows) for t, rows in by_task.items()} == {0: 2, 1: 3, 2: 4}
    assert {r["output_col"] for r in out} == {"b"}
    temperatures = {round(c[2], 3) for c in calls(tmp_path)}
    assert 0.5 in temperatures and max(temperatures) > 0.5 and max(temperatures) <= 1.7


def test_splits_share_the_call_budget(spark, tmp_path):
    fresh = lambda p, n: [json.dumps({"input": uuid.uuid4().hex, "output": "y"}) for _ in range(n)]
    out = generate_splits(spark, TaskSpec("do"), {"train": 20, "val": 20, "test": 5}, log_client(tmp_path, fresh), settings(), max_calls=6)
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 20, "val": 10} and len(calls(tmp_path)) == 6


def test_transform_judgement_and_failure_budget(spark):
    contents = [
        '{"input": "a", "output": "1"}', "no json", '{"input": "", "output": "2"}', '{"input": "b", "output": ""}', '{"input": "seen", "output": "3"}',
        '{"input": null, "output": "4"}', '{"input": "c", "output": "5"}', '{"input": "only"}',
    ]
    answers = spark.createDataFrame([(i, 0, c) for i, c in enumerate(contents)], "prompt_id int, choice int, content string")
    judged = judge_answers(answers, "12 seen 34")
    assert {r["prompt_id"]: r["failed"] for r in judged.collect()} == {0: False, 2: True, 3: False, 4: True, 5: True, 6: False}
    kept = lambda n: sorted(r["prompt_id"] for r in within_failure_budget(judged, n).collect())
    assert kept(0) == [0] and kept(1) == [0, 3] and kept(2) == [0, 3] and kept(3) == [0, 3, 6]


def test_transform_table(spark, tmp_path):
    def answer(prompt, n):
        return ['Done {"input": "in %s", "output": "out"}' % prompt.split("'x': ")[-1].split("}")[0]] if prompt.endswith("JSON:") else ["understood"]

    table = spark.range(250).select(F.col("id").alias("pos"), F.col("id").alias("x"))
    out = transform_table(table, TaskSpec("do", "N/A"), log_client(tmp_path, answer), 120, 3, calls=FREE)
    assert {(r["pos"], r["input_col"]) for r in out.collect()} == {(i, f"in {i}") for i in range(120)}
    made = [c[0] for c in calls(tmp_path)]
    assert len(made) == 122  # one explanation, one plan, one call per row within the limit
    plan = next(p for p in made if p.endswith("Plan:"))
    assert all(f"{{'x': {i}}}" in plan for i in range(5)) and "{'x': 5}" not in plan


def test_understanding_jobs(spark):
    def factory():
        def ask(prompt, n, temperature, max_tokens):
            if "Its parts as JSON" in prompt:
                return ['{"Instruction": "i\nj", "Demonstrations": "N/A"}'] if "good" in prompt else ["{"]
            if prompt.endswith("Card:\n"):
                return ["a model"]
            kind = prompt.rsplit("Data set: ", 1)[1].split("\n")[0]
            return [json.dumps({"input": ["q", "c"] if kind != "unknown" else ["zz"], "output": ["a"] if kind != "two" else ["a", "q"]}) if kind != "missing" else '{"output": ["a"]}']

        return ask

    texts = spark.createDataFrame([(0, "good"), (1, "bad")], "prompt_id int, text string")
    assert {tuple(r) for r in parse_prompts(texts, factory, 2, FREE).collect()} == {(0, "i\nj", "N/A"), (1, None, None)}
    assert tuple(expand_queries(texts.select(F.col("prompt_id").alias("query_id"), "text"), factory, calls=FREE).first()) == (0, "a model")
    tables = spark.createDataFrame([(i, "do", n, "d", ["q", "c", "a"], "{}") for i, n in enumerate(("right", "missing", "unknown", "two"))],
                                   "prompt_id int, instruction string, name string, description string, columns array<string>, sample_row string")
    got = {r["prompt_id"]: (r["inputs"], r["output"], r["problem"]) for r in select_columns(tables, factory, 2, FREE).collect()}
    assert got == {0: (["q", "c"], "a", None), 1: (None, None, "wrong number of columns"), 2: (None, None, "unknown columns: zz"), 3: (None, None, "wrong number of columns")}


def catalog(spark):
    config = lambda ds, c: (c, "{}", ["text", "lang"], {"text": "text", "lang": "lang"}, f"{ds} texts", ds)
    rows = [(ds, f"about {ds}", 5, ["t"], gated, {c: config(ds, c) for c in cs}) for ds, gated, cs in (("one", False, ["only"]), ("many", False, ["a", "b", "c"]), ("shut", True, ["x"]))]
    return spark.createDataFrame(
        rows, "name string, description string, downloads bigint, tags array<string>, is_gated boolean, configs map<string, struct<config_name:string,"
        "sample_row:string,columns:array<string>,columns_mapping:map<string,string>,dataset_description:string,dataset_name:string>>",
    )


def choosing(dataset, config):
    def factory():
        def ask(prompt, n, temperature, max_tokens):
            if prompt.endswith("best data set is:"):
                left = dataset if f"**{dataset}**" in prompt else "one" if "**one**" in prompt else "ghost"
                return [f"**{left}**"] * n
            if prompt.endswith("best part is:"):
                return [f"**{config}**" if f"**{config}**" in prompt else "**b**"] * n
            if prompt.endswith("Chosen columns:"):
                return ['{"input": ["text"], "output": ["lang"]}']
            if prompt.endswith("Example as JSON:"):
                return [json.dumps({"input": prompt.rsplit("'text': '", 1)[1].split("'")[0], "output": "o"})]
            return ["fine"]

        return ask

    return factory


def test_rerank(spark):
    tasks = spark.createDataFrame([(0, "i", "e")], "task_id int, instruction string, examples string")
    rows = catalog(spark)
    candidates = rows.select(F.lit(0).alias("task_id"), F.ascii("name").alias("pos"), "name", "description", "tags")
    configs = rows.select(F.col("name").alias("dataset"), F.explode("configs").alias("config", "c")).select("dataset", "config", "c.columns", "c.sample_row")
    pick = lambda d, c: tuple(rerank(tasks, candidates, configs, choosing(d, c), 3, FREE).first())[1:]
    assert pick("many", "a") == ("many", "a") and pick("one", "zzz") == ("one", "only")
    no_ghost = candidates.where("name <> 'one'")
    assert tuple(rerank(tasks, no_ghost, configs, choosing("ghost", "a"), 3, FREE).first())[1:] == (None, None)


def loader(spark):
    def load(dataset, config):
        split = F.when(F.col("id") < 8, "train").otherwise("test")
        return spark.range(12).select(F.concat_ws(" ", F.lit(dataset), F.lit(config), "id").alias("text"), F.lit("en").alias("lang"), split.alias("split"), F.col("id").alias("row_key"))

    return load


def retrieved(spark, dataset, config, **options):
    from taskweave.operators.inference import hashed_embedding

    rows = catalog(spark)
    return retrieve_dataset(
        TaskSpec("about texts"), rows.select("name", "description"), rows, hashed_embedding, choosing(dataset, config), loader(spark),
        votes=FREE, single=FREE, row_calls=FREE, **options,
    )


def test_dataset_retrieval(spark):
    got = retrieved(spark, "many", "a", max_rows=5).collect()
    assert {(r["split"], r["source"]) for r in got} == {("train", "many_a"), ("test", "many_a")}
    assert sum(r["split"] == "train" for r in got) == 5 and sum(r["split"] == "test" for r in got) == 4
    assert all(r["input_col"].startswith("text: many a ") and r["output_col"] == "en" for r in got)


def test_dataset_retrieval_with_transform_gathers_from_several(spark):
    got = retrieved(spark, "many", "a", transform=True, target_rows=20, max_datasets=3).collect()
    counts = {}
    for r in got:
        counts[r["source"]] = counts.get(r["source"], 0) + 1
        assert r["input_col"].startswith(r["source"].replace("_", " ")) and r["output_col"] == "o"
    assert counts == {"many_a": 8, "many_b": 8, "many_c": 4} or (sum(counts.values()) == 20 and len(counts) == 3)


def test_contracts(spark):
    with pytest.raises(ValueError):
        TaskSpec("")
    with pytest.raises(ValueError):
        require_columns(spark.range(1), "x")


def test_dataset_retrieval_without_a_choice_is_an_empty_table(spark):
    for options in ({}, {"transform": True}, {"transform": True, "strict": True}):
        got = retrieved_by(spark, nobody, **options)
        assert got.columns == ["split", "source", "input_col", "output_col"] and got.count() == 0


def nobody():
    return lambda prompt, n, temperature, max_tokens: ["**no such set**"] * n


def broken():
    def ask(prompt, n, temperature, max_tokens):
        raise ValueError("provider is down")

    return ask


def retrieved_by(spark, client, **options):
    from taskweave.operators.inference import hashed_embedding

    rows = catalog(spark)
    calls = dict(votes=FREE, single=FREE, row_calls=FREE)
    return retrieve_dataset(
        TaskSpec("about texts"), rows.select("name", "description"), rows, hashed_embedding, client, loader(spark), **{**calls, **options}
    )


def test_dataset_retrieval_says_when_no_vote_is_answered(spark):
    with pytest.raises(RuntimeError, match="no vote was answered: ValueError: provider is down"):
        retrieved_by(spark, broken)
    with pytest.raises(RuntimeError, match="no room"):
        retrieved_by(spark, nobody, votes=CallSettings(responses=1, requests_per_minute=None, wait_seconds=0.0, max_tokens=20))
