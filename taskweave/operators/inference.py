"""Run a user's model over a text column: M3, M4."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskweave.contracts import require_columns
from taskweave.functions.draws import draw
from taskweave.functions.text import tokens

Predict = Callable[[list[str]], list[str]]
Encode = Callable[[list[str]], np.ndarray]

def _in_batches(load: Callable[[], Callable], size: int, shape: Callable):
    """An Arrow UDF body that loads the model once per worker and feeds it ``size`` texts at a time."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in series:
            out: list = []
            for at in range(0, len(texts), size):
                out += shape(model(list(texts.iloc[at : at + size])))
            yield pd.Series(out, dtype=object)

    return run


def predict(df: DataFrame, load: Callable[[], Predict], input_column: str = "model_input", batch_size: int = 10) -> DataFrame:
    """Add ``prediction`` STRUCT<prediction, aux>; the auxiliary map carries the input text."""
    require_columns(df, input_column)

    def body(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _in_batches(load, batch_size, list)(series)

    said = F.pandas_udf(body, "string")(F.col(input_column))
    return df.withColumn(
        "prediction",
        F.struct(said.alias("prediction"), F.create_map(F.lit("input_text"), F.col(input_column)).alias("aux")),
    )


def encode(df: DataFrame, load: Callable[[], Encode], text_column: str = "text", batch_size: int = 8) -> DataFrame:
    """Add ``embedding`` from a user's encoder; the encoder cuts texts to its own token limit."""
    require_columns(df, text_column)

    def body(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _in_batches(load, batch_size, lambda m: [row.tolist() for row in np.asarray(m)])(series)

    return df.withColumn("embedding", F.pandas_udf(body, "array<double>")(F.col(text_column)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _unit_counts(slots: pd.Series, size: pd.Series) -> pd.Series:
    """One count over row and slot for the whole batch; a row without slots gives zeros."""
    n, width = len(slots), int(size.iloc[0]) if len(size) else 1
    lengths = np.array([0 if v is None else len(v) for v in slots])
    flat = np.concatenate([np.empty(0, np.int64), *(np.asarray(v, np.int64) for v in slots if v is not None)])
    counts = np.bincount(np.repeat(np.arange(n), lengths) * width + flat, minlength=n * width).reshape(n, width).astype(np.float64)
    norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return pd.Series(list(counts / np.where(norm == 0, 1, norm)), dtype=object)


def hashed_embedding(text: Column, size: int = 64, max_tokens: int | None = None) -> Column:
    """Stand-in encoder: counts of hashed tokens of the whole text, scaled to length one; a NULL text gives zeros."""
    used = tokens(F.lower(F.coalesce(text, F.lit(""))))
    if max_tokens is not None:
        used = F.slice(used, 1, max_tokens)
    slots = F.transform(used, lambda t: draw(F.lit(size), "slot", t).cast("int"))
    return _unit_counts(slots, F.lit(size))
