"""Turn (input, output) pairs into model text: P1-P7."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.contracts import INPUT, MODEL_INPUT, MODEL_OUTPUT, OUTPUT, SPLITS, require_columns
from taskweave.functions.text import py_str


def wrap_input(instruction: str, text: Column, task_id: Column | int = 0) -> Column:
    """The text a model sees for one input; works the same on a stream."""
    task = (F.lit(task_id) if isinstance(task_id, int) else task_id).cast("string")
    return F.concat(F.lit("<task "), task, F.lit(f">{instruction}\nExample:\n"), text, F.lit("\nLabel:\n"))


def drop_empty_pairs(df: DataFrame) -> DataFrame:
    """Keep rows whose two sides both show some text. NULL shows as ``None``, so it stays."""
    require_columns(df, INPUT, OUTPUT)
    shown = [py_str(F.col(c), df.schema[c].dataType) for c in (INPUT, OUTPUT)]
    return df.where((F.length(shown[0]) > 0) & (F.length(shown[1]) > 0))


def textualize(
    df: DataFrame, instruction: str, has_encoder: bool, eos_token: str | None = None, split: str = "split"
) -> DataFrame:
    """Replace the pair columns by ``model_input`` and ``model_output``.

    ``df`` has ``input_col``, ``output_col``, a split column and optionally ``task_id``.
    For a decoder-only model, training rows carry the answer and the end mark in the input.
    """
    require_columns(df, INPUT, OUTPUT, split)
    if not has_encoder and eos_token is None:
        raise ValueError("a decoder-only model needs an eos_token")
    task = F.col("task_id") if "task_id" in df.columns else 0
    source = py_str(F.col(INPUT), df.schema[INPUT].dataType)
    target = py_str(F.col(OUTPUT), df.schema[OUTPUT].dataType)
    prompt = wrap_input(instruction, source, task)
    if has_encoder:
        model_input, model_output = prompt, target
    else:
        training = F.col(split) == "train"
        ended = F.concat(target, F.lit(eos_token))
        model_output = F.when(training, ended).otherwise(target)
        model_input = F.when(training, F.concat(prompt, ended)).otherwise(prompt)
    named = F.when(
        F.col(split).isin(*SPLITS), F.col(split)
    ).otherwise(F.raise_error(F.concat(F.lit("split must be train, val or test, not "), F.coalesce(F.col(split), F.lit("NULL")))))
    return (
        df.withColumns({MODEL_INPUT: model_input, MODEL_OUTPUT: model_output, split: named}).drop(INPUT, OUTPUT)
    )


def process_tasks(
    pairs: DataFrame, instruction: str, has_encoder: bool, eos_token: str | None = None
) -> DataFrame:
    """The whole step for pairs that already carry a split: filter, then write the text."""
    return textualize(drop_empty_pairs(pairs), instruction, has_encoder, eos_token)
