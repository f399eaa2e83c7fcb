"""Work on a table's schema: flatten, rename, prune, preview: P11-P15."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskweave.functions.text import json_of_ascii, json_text, let


def _leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    found = []
    for field in schema.fields:
        here = (*path, field.name)
        if isinstance(field.dataType, T.StructType):
            found += _leaves(field.dataType, here)
        else:
            found.append((here, field.dataType))
    return found


def _at(path: Sequence[str]) -> Column:
    column = F.col(f"`{path[0]}`")
    for name in path[1:]:
        column = column.getField(name)
    return column


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Every struct field becomes a column named by its path."""
    return df.select(*[_at(path).alias(separator.join(path)) for path, _ in _leaves(df.schema)])


def unique_names(columns: Sequence[str]) -> dict[str, str]:
    """New name per column: dots become underscores; of columns that then agree, later ones get the first free ``_1``, ``_2``...

    A name that some column has by itself is never given to another.
    """
    groups: dict[str, list[str]] = {}
    for column in columns:
        groups.setdefault(column.replace(".", "_"), []).append(column)
    taken = set(groups)
    names: dict[str, str] = {}
    for plain, (first, *others) in groups.items():
        names[first] = plain
        numbered = (f"{plain}_{i}" for i in count(1))
        for column in others:
            names[column] = next(name for name in numbered if name not in taken)
            taken.add(names[column])
    return {column: names[column] for column in columns}


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Apply a stored column mapping; names it does not list stay."""
    return df.select(*[F.col(f"`{c}`").alias(mapping.get(c, c)) for c in df.columns])


def flatten_with_unique_names(df: DataFrame) -> DataFrame:
    flat = flatten(df)
    return rename(flat, unique_names(flat.columns))


def prune(df: DataFrame, inputs: Sequence[str], output: str) -> DataFrame:
    """Only the selected columns; reaches the Parquet scan."""
    return df.select(*dict.fromkeys([*inputs, output]))


def row_preview(df: DataFrame, columns: Sequence[str] | None = None, max_length: int = 50) -> Column:
    """One row as JSON text whose values are JSON texts of limited length.

    A value up to ``max_length - 3`` is shown whole; a longer one is cut to ``max_length`` and gets dots.
    """
    def limited(value: Column) -> Column:
        cut = F.concat(F.left(value, F.lit(max_length)), F.lit("..."))
        return F.when(F.length(value) <= max_length - 3, value).otherwise(cut)

    def shown(name: str) -> Column:
        value, dtype = F.col(f"`{name}`"), df.schema[name].dataType
        if isinstance(dtype, T.StringType):
            # JSON text is never shorter than what it spells, so the rest of a longer text cannot be seen
            value = F.left(value, F.lit(max_length + 1))
        return let(json_text(value, dtype), limited)

    names = list(columns or df.columns)
    # a shown value is JSON text already, hence plain ASCII
    pairs = [F.concat(F.lit(json.dumps(n) + ": "), json_of_ascii(shown(n))) for n in names]
    return F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))
