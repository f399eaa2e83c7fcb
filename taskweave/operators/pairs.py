"""Make, check, format and combine (input, output) pairs: P8-P10, P24, U1-U4, A7, A11."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.contracts import INPUT, OUTPUT, require_columns
from taskweave.functions.text import py_str, strip
from taskweave.operators.positions import head_per_group


def canonicalize(
    df: DataFrame,
    input_columns: Sequence[str],
    output_column: str,
    order: Sequence[str],
    max_rows: int | None = None,
    split: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``name: value`` lines of the chosen columns, in the chosen order, against one output column.

    With ``max_rows``, the first that many rows of each split in the order of ``order``. The cut comes
    first, on the raw columns, so no text is built for rows that are dropped.
    """
    require_columns(df, *input_columns, output_column, *([split] if split else []))
    if max_rows is not None:
        df = head_per_group(df, [split] if split else [], [F.col(c) for c in order], max_rows)
    lines = [F.concat(F.lit(f"{c}: "), py_str(F.col(c), df.schema[c].dataType)) for c in input_columns]
    body = strip(F.concat_ws("\n", *lines))
    kept = [c for c in ([split] if split else []) + list(keep)]
    return df.select(*kept, body.alias(INPUT), F.col(output_column).alias(OUTPUT))


def pairs_from_samples(df: DataFrame, inputs: str, outputs: str) -> DataFrame:
    """Pairs from two parallel columns; a pair with a missing side is dropped."""
    return df.where(F.col(inputs).isNotNull() & F.col(outputs).isNotNull()).withColumnsRenamed(
        {inputs: INPUT, outputs: OUTPUT}
    )


def as_training_text(input_col: Column, output_col: Column) -> Column:
    """Both sides stripped, one space between. A NULL side gives NULL."""
    return F.concat(strip(input_col), F.lit(" "), strip(output_col))


def format_pairs(df: DataFrame) -> DataFrame:
    require_columns(df, INPUT, OUTPUT)
    return df.withColumn("text", as_training_text(F.col(INPUT), F.col(OUTPUT))).drop(INPUT, OUTPUT)


def concatenate(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables with the same columns."""
    if not tables:
        raise ValueError("nothing to concatenate")
    return reduce(lambda a, b: a.unionByName(b), tables)


_COMBINED = {"text": ("text",), "input_output": (INPUT, OUTPUT)}


def combine(tables: Sequence[DataFrame], kind: str = "input_output", keep: Sequence[str] = ()) -> DataFrame:
    """Union of the ``text`` column, or of the two pair columns."""
    if kind not in _COMBINED:
        raise ValueError(f"kind must be one of {sorted(_COMBINED)}, not {kind!r}")
    columns = [*keep, *_COMBINED[kind]]
    return concatenate([require_columns(t, *columns).select(*columns) for t in tables])


def selection_problem(inputs: Column, outputs: Column, columns: Column) -> Column:
    """Why a proposed column selection is unusable, or NULL when it is fine."""
    unknown = F.array_except(F.array_union(inputs, outputs), columns)
    missing = inputs.isNull() | outputs.isNull() | (F.size(inputs) < 1) | (F.size(outputs) != 1)
    return F.when(missing, F.lit("wrong number of columns")).when(
        F.size(unknown) > 0, F.concat(F.lit("unknown columns: "), F.array_join(F.array_sort(unknown), ", "))
    )


def contributions(df: DataFrame, source: str = "source") -> DataFrame:
    """Rows taken per source."""
    return df.groupBy(source).agg(F.count("*").alias("n_rows"))
