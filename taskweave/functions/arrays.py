"""Fixed-width token arrays: pad runs, padding, masks, labels: F16-F20."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100  # fixed value: the label a loss function skips


def leading_run(ids: Column, pad: Column | int) -> Column:
    """How many pad ids the array starts with."""
    pad = F.lit(pad) if isinstance(pad, int) else pad
    other = F.array_position(F.transform(ids, lambda x: x != pad), True)
    return F.when(other == 0, F.size(ids)).otherwise(other - 1).cast("int")


def trailing_run(ids: Column, pad: Column | int) -> Column:
    return leading_run(F.reverse(ids), pad)


def _fill(value: int, n: Column) -> Column:
    return F.array_repeat(F.lit(value), F.greatest(n, F.lit(0)).cast("int"))


def truncate(ids: Column, max_length: int | None) -> Column:
    return ids if max_length is None else F.slice(ids, 1, max_length)


def pad_to(ids: Column, width: Column | int, pad: int, left: bool) -> Column:
    width = F.lit(width) if isinstance(width, int) else width
    padding = _fill(pad, width - F.size(ids))
    return F.concat(padding, ids) if left else F.concat(ids, padding)


def mask_for(ids: Column, width: Column | int, left: bool) -> Column:
    """1 for tokens, 0 for padding."""
    return pad_to(F.transform(ids, lambda _: F.lit(1)), width, 0, left)


def tail_labels(padded: Column, n_output: Column) -> Column:
    """Ignore everything but the last ``n_output`` positions, which repeat the ids."""
    size = F.size(padded)
    kept = F.least(n_output, size)
    return F.concat(_fill(IGNORE, size - kept), F.slice(padded, size - kept + 1, kept))


def output_labels(ids: Column, width: Column | int, pad: int) -> Column:
    """The output ids filled up to ``width``, where the pad run at the end is ignored, be it padding or ids of its own."""
    width = F.lit(width) if isinstance(width, int) else width
    kept = F.size(ids) - trailing_run(ids, pad)
    return F.concat(F.slice(ids, F.lit(1), kept), _fill(IGNORE, width - kept))
