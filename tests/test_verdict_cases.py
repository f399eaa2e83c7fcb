"""Budgets, resumed calls, NULLs and duplicates."""

import os

import pytest
from pyspark.sql import functions as F

from taskweave.contracts import TaskSpec
from taskweave.operators.completion import NO_ROOM, CallSettings, PromptRefused, complete, complete_until_parsed
from taskweave.operators.inference import hashed_embedding
from taskweave.operators.metrics import containment_accuracy, exact_match, greedy_match, pair_with_references
from taskweave.operators.positions import with_position
from taskweave.operators.shapes import unique_names
from taskweave.operators.splits import split_table, split_tasks
from taskweave.plans.transform import FIRST_ROWS, transform_table
from taskweave.staging import stage, staging_scope

FREE = CallSettings(responses=1, requests_per_minute=None, wait_seconds=0.0, tries=1)


def telling():
    return lambda prompt, n, temperature, max_tokens: [str(max_tokens)] * n


def test_staged_tables_go_with_their_scope(spark):
    kept = stage(spark.range(3), "kept")
    with staging_scope(spark):
        inner = stage(spark.range(5), "inner")
        files = inner.inputFiles()
        assert inner.count() == 5 and all(os.path.exists(f.removeprefix("file://")) for f in files)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
    assert kept.count() == 3


def test_every_prompt_has_its_own_budget(spark):
    rows = spark.createDataFrame([(0, "short"), (1, "word " * 3000), (2, "word " * 5000)], "prompt_id int, prompt string")
    got = {r.prompt_id: (r.content, r.error) for r in complete(rows, telling, FREE).collect()}
    assert got == {0: ("3699", None), 1: ("700", None), 2: ("", NO_ROOM)}
    parsed = complete_until_parsed(rows.where("prompt_id < 2"), telling, lambda c: c, settings=FREE)
    assert {r.prompt_id: r.parsed for r in parsed.collect()} == {0: "3699", 1: "700"}
    batch = complete(rows.where("prompt_id < 2").withColumn("batch_id", F.lit(1)), telling, FREE)
    assert {r.content for r in batch.collect()} == {"700"}


def test_resume_asks_failed_and_changed_prompts_again(spark, tmp_path):
    path, calls = str(tmp_path / "answers"), tmp_path / "calls"
    calls.mkdir()

    def client(mood):
        def make():
            def ask(prompt, n, temperature, max_tokens):
                with open(calls / mood, "a") as f:
                    f.write(prompt + "\n")
                if prompt == "refuse":
                    raise PromptRefused("no")
                if prompt == "fail" and mood == "first":
                    raise ValueError("down")
                return [f"{mood} {prompt}"]

            return ask

        return make

    def table(*rows):
        return spark.createDataFrame(list(rows), "prompt_id int, prompt string")

    first = complete(table((0, "good"), (1, "fail"), (2, "refuse"), (3, "old"), (4, "gone")), client("first"), FREE, path, chunk=2)
    assert {(r.prompt_id, r.content) for r in first.collect()} >= {(0, "first good"), (1, ""), (3, "first old")}
    again = complete(table((0, "good"), (1, "fail"), (2, "refuse"), (3, "new")), client("second"), FREE, path)
    assert {(r.prompt_id, r.content) for r in again.collect()} == {
        (0, "first good"), (1, "second fail"), (2, "Invalid Request: Prompt was filtered"), (3, "second new"),
    }
    assert sorted((calls / "second").read_text().split()) == ["fail", "new"]


def test_missing_predictions_are_no_hits(spark):
    rows = spark.createDataFrame(
        [(0, "a", "a", "x"), (1, None, "b", "x"), (2, "c", None, None)], "row_id int, prediction string, reference string, model_input string"
    )
    assert exact_match(rows).first().value == pytest.approx(1 / 3)
    assert containment_accuracy(rows).first().value == pytest.approx(1 / 3)


def test_pairs_without_tokens_on_one_side_score_zero(spark):
    tokens = spark.createDataFrame(
        [(0, 0, 0, [1.0, 0.0]), (0, 1, 0, [1.0, 0.0]), (1, 1, 0, [1.0, 0.0]), (2, 0, 0, [0.0, 0.0]), (2, 1, 0, [1.0, 0.0])],
        "pair_id int, side int, token long, embedding array<double>",
    )
    assert {r.pair_id: r.f1 for r in greedy_match(tokens).collect()} == {0: 1.0, 1: 0.0, 2: 0.0}


def test_repeated_and_missing_keys_do_not_pair(spark):
    one = spark.createDataFrame([(0, "p"), (1, "q")], "row_id int, prediction string")
    refs = one.withColumnRenamed("prediction", "reference")
    assert pair_with_references(one, refs).count() == 2
    for bad in (one.union(one.limit(1)), one.limit(1), one.union(spark.createDataFrame([(None, "z")], one.schema))):
        with pytest.raises(ValueError):
            pair_with_references(bad, refs)


def test_rows_without_a_group_keep_their_places(spark):
    rows = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), ("a", 5)], "g string, k int")
    got = {(r.g, r.k, r.pos) for r in with_position(rows, ["k"], group=["g"]).collect()}
    assert got == {(None, 1, 0), (None, 3, 1), ("a", 2, 0), ("a", 5, 1)}
    with pytest.raises(ValueError):
        split_tasks(rows, ["k"], task="g")


def test_test_rows_are_never_trained_on(spark):
    rows = spark.createDataFrame([(i, "test" if i % 2 else "train") for i in range(40)], "k int, split string")
    out = split_table(rows, ["k"], 0.5, 0.2).collect()
    assert len(out) == 20 and all(r.k % 2 == 0 for r in out)


def test_null_text_has_a_zero_vector(spark):
    rows = spark.createDataFrame([(None,), ("",), ("a b",)], "text string")
    got = [r.e for r in rows.select(hashed_embedding(F.col("text"), 4).alias("e")).collect()]
    assert got[0] == got[1] == [0.0] * 4 and sum(x * x for x in got[2]) == pytest.approx(1)


def test_new_names_never_meet(spark):
    assert unique_names(["a_b_1", "a.b", "a_b"]) == {"a_b_1": "a_b_1", "a.b": "a_b", "a_b": "a_b_2"}
    assert unique_names(["x.y", "x_y", "x_y_2", "z"]) == {"x.y": "x_y", "x_y": "x_y_1", "x_y_2": "x_y_2", "z": "z"}


def test_rows_after_the_failure_budget_are_not_asked(spark, tmp_path):
    log = tmp_path / "calls"

    def bad():
        def ask(prompt, n, temperature, max_tokens):
            with open(log, "a") as f:
                f.write("x")
            return ['{"input": "", "output": ""}']

        return ask

    rows = spark.range(2000).select(F.col("id").alias("pos"), F.concat(F.lit("row "), F.col("id")).alias("text"))
    calls = CallSettings(responses=1, temperature=0.0, requests_per_minute=None, wait_seconds=0.0)
    assert transform_table(rows, TaskSpec("do", "shown"), bad, 2000, 10, calls=calls).count() == 0
    assert len(log.read_text()) == 2 + FIRST_ROWS
