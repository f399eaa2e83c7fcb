"""The whole chain with stub models: prompt, pairs, splits, text, tokens, predictions, scores."""

import json

from pyspark.sql import functions as F

from taskweave.contracts import INPUT, OUTPUT, TaskSpec
from taskweave.operators.completion import CallSettings
from taskweave.operators.inference import predict
from taskweave.operators.metrics import evaluate, pair_with_references
from taskweave.operators.pairs import concatenate
from taskweave.operators.positions import with_position
from taskweave.operators.retrieval import config_rows
from taskweave.operators.splits import split_tasks
from taskweave.operators.textualize import process_tasks
from taskweave.operators.tokenize import tokenize_rows
from taskweave.plans.generation import GenerationSettings, generate_splits
from taskweave.plans.understanding import parse_prompts
from taskweave.sources.tables import read_splits, write_splits

FREE = CallSettings(responses=1, requests_per_minute=None, wait_seconds=0.0)


def client():
    def ask(prompt, n, temperature, max_tokens):
        if "Its parts as JSON" in prompt:
            return ['{"Instruction": "Shout the text.", "Demonstrations": "a -> A"}']
        seed = abs(hash(prompt)) % 1000
        return [json.dumps({"input": f"text {seed + i}", "output": f"TEXT {seed + i}"}) for i in range(n)]

    return ask


def shouting():
    """Finds the example in a model input and shouts it; the model repeats its input."""
    return lambda texts: [t + t.split("Example:\n")[1].split("\nLabel:")[0].upper() for t in texts]


def test_chain(spark, tmp_path):
    prompts = spark.createDataFrame([(0, "please shout")], "prompt_id int, text string")
    parsed = parse_prompts(prompts, client, calls=FREE).first()
    spec = TaskSpec(parsed["instruction"], parsed["examples"])
    made = generate_splits(spark, spec, {"train": 10}, client, GenerationSettings(requests_per_minute=None, wait_seconds=0.0), max_calls=5)
    generated = made.select(F.lit(1).alias("task_id"), "pos", INPUT, OUTPUT)
    retrieved = spark.range(40).select(
        F.lit(0).alias("task_id"), F.col("id").alias("pos"), F.format_string("row %d", "id").alias(INPUT), F.format_string("ROW %d", "id").alias(OUTPUT)
    )
    split = split_tasks(concatenate([retrieved, generated]), ["pos"], 0.5, 0.25, {"train": 15})
    rows = process_tasks(split, spec.instruction, has_encoder=False, eos_token="<end>")
    write_splits(rows, str(tmp_path / "splits"))

    tokens = tokenize_rows(read_splits(spark, str(tmp_path / "splits"), "train"), has_encoder=False)
    widths = {tuple(len(r[c]) for c in ("input_ids", "attention_mask", "labels")) for r in tokens.collect()}
    assert len(widths) == 1 and len(set(widths.pop())) == 1

    test = with_position(read_splits(spark, str(tmp_path / "splits"), "test"), ["task_id", "pos"], name="row_id")
    said = predict(test, shouting).select("row_id", F.col("prediction.prediction").alias("prediction"))
    pairs = pair_with_references(said, test.select("row_id", "task_id", "model_input", F.col("model_output").alias("reference")))
    scores = {(r["task_id"], r["metric"]): r["value"] for r in evaluate(pairs, model_input="model_input", by=["task_id"]).collect()}
    assert scores[0, "exact_match"] == 1.0 and round(scores[0, "chr_f++"], 6) == 100.0
    assert {m for t, m in scores if t == 1} == {"exact_match", "chr_f++"}
    assert evaluate(pairs, ["exact_match"]).first()["value"] == 0.0  # the echo counts when it is not detached


def test_config_rows(spark):
    chosen = spark.createDataFrame([(0, "d", "a")], "task_id int, dataset string, config string")
    configs = spark.createDataFrame([("d", "a", "{}"), ("d", "b", "{}")], "dataset string, config string, sample_row string")
    assert [r["config"] for r in config_rows(chosen, configs).collect()] == ["a"]
