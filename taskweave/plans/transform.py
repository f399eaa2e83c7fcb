"""Rewrite the rows of a table into pairs with a model: explain, plan, one prompt per row, check (M6, F8-F10)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskweave.contracts import INPUT, OUTPUT, TaskSpec
from taskweave.functions import prompts as P
from taskweave.functions.parsing import last_object
from taskweave.functions.text import py_str, token_count
from taskweave.operators.completion import CallSettings, ClientFactory, answer_prompt, complete
from taskweave.operators.positions import batch_number
from taskweave.operators.tokenize import completion_budget
from taskweave.staging import stage

BATCH = 100
FIRST_ROWS = 4 * BATCH  # rows asked before the failures are counted for the first time; then twice as many each time
ROW_CALLS = CallSettings(responses=1, temperature=0.0, requests_per_minute=15)


def row_text(df: DataFrame, columns: list[str]) -> Column:
    """A row the way Python shows a dict."""
    row = F.struct(*columns)
    return py_str(row, df.select(row.alias("r")).schema["r"].dataType)


def ask_once(spark: SparkSession, prompt: Column, factory: ClientFactory, tries: int, settings: CallSettings) -> str:
    """One prompt, one text: asked from the driver, since there is nothing to spread."""
    row = spark.range(1).select(prompt.alias("prompt")).select("prompt", token_count(F.col("prompt")).alias("n"))
    text = row.select("prompt", completion_budget(F.col("n"), settings.max_tokens, settings.token_buffer).alias("budget")).first()
    answer = answer_prompt(factory(), text["prompt"], settings.temperature, text["budget"], replace(settings, responses=1, tries=tries))[0]
    if not answer[1] or answer[2]:
        raise RuntimeError(f"no answer within {tries} calls: {answer[2]}")
    return answer[1]


def judge_answers(answers: DataFrame, examples: str, pos: str = "prompt_id") -> DataFrame:
    """(pos, input_col, output_col, failed). Answers without a usable object are left out and are no failures.

    A missing side, or an input that the task's own examples contain (the empty input always is), is a failure.
    """
    fields = last_object(F.col("content"), ["input", "output"])
    parsed = answers.where(F.col("choice") == 0).select(F.col(pos), fields.alias("f")).where(F.col("f").isNotNull())
    source, target = F.col("f")["input"], F.col("f")["output"]
    failed = source.isNull() | target.isNull() | F.contains(F.lit(examples), source)
    return parsed.select(pos, source.alias(INPUT), target.alias(OUTPUT), failed.alias("failed"))


def within_failure_budget(judged: DataFrame, max_failed: int, pos: str = "prompt_id") -> DataFrame:
    """Good pairs before the failure that exceeds the budget.

    Only the positions of the first ``max_failed + 1`` failures are looked up; the cut is then a plain filter.
    """
    firsts = judged.where("failed").select(pos).orderBy(pos).limit(max_failed + 1)
    edge = firsts.agg(F.struct(F.max(pos).alias("at"), F.count("*").alias("n")).alias("e")).scalar()
    good = judged.where(~F.col("failed")).where((edge["n"] <= max_failed) | (F.col(pos) < edge["at"]))
    return good.select(pos, INPUT, OUTPUT)


def transform_table(
    table: DataFrame,
    spec: TaskSpec,
    factory: ClientFactory,
    n_rows: int,
    max_failed: int,
    pos: str = "pos",
    tries: int = 10,
    calls: CallSettings = ROW_CALLS,
) -> DataFrame:
    """(pos, input_col, output_col) from the first ``n_rows`` rows of a table with dense positions.

    The limit comes before the model calls, and only the row text is carried to them. Rows are asked in order of position in
    growing parts, and none after the part whose failures exceed the budget.
    """
    spark = table.sparkSession
    columns = [c for c in table.columns if c != pos]
    shown = row_text(table, columns)
    single = replace(calls, temperature=0.01)
    task = ask_once(spark, P.explanation_prompt(F.lit(spec.instruction), F.lit(spec.examples)), factory, tries, single)
    head = table.where(F.col(pos) < P.PLAN_ROWS).select(pos, shown.alias("row")).orderBy(pos).collect()
    rows = F.array(*[F.lit(r["row"]) for r in head]) if head else F.array().cast("array<string>")
    plan = ask_once(spark, P.plan_prompt(F.lit(task), F.lit(spec.examples), rows), factory, tries, single)
    prompt = P.transform_prompt(F.lit(task), F.lit(spec.examples), F.lit(plan), shown)
    judged, failed, start, size = None, 0, 0, FIRST_ROWS
    while start < n_rows and failed <= max_failed:
        rows = table.where((F.col(pos) >= start) & (F.col(pos) < min(start + size, n_rows)))
        prompts = rows.select(F.col(pos).alias("prompt_id"), prompt.alias("prompt"), batch_number(pos, BATCH).alias("batch_id"))
        part = stage(judge_answers(complete(prompts, factory, calls), spec.examples), "judged")
        judged = part if judged is None else judged.unionByName(part)
        failed += part.where("failed").count()
        start, size = start + size, size * 2
        if part.isEmpty() and rows.isEmpty():
            break
    if judged is None:
        judged = judge_answers(complete(table.limit(0).select(F.col(pos).alias("prompt_id"), prompt.alias("prompt")), factory, calls), spec.examples)
    return within_failure_budget(judged, max_failed).withColumnRenamed("prompt_id", pos)
