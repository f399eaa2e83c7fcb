"""Token ids, batches and budgets: F4, F15, F17-F20, A9, A10, W4."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskweave.contracts import MODEL_INPUT, MODEL_OUTPUT, require_columns
from taskweave.functions import arrays
from taskweave.functions.draws import draw
from taskweave.functions.text import tokens
from taskweave.staging import stage

Tokenizer = Callable[[Column], Column]


def hashed_ids(vocabulary: int = 32_000, reserved: int = 3) -> Tokenizer:
    """Stand-in tokenizer: words and marks to ids by hash; ids below ``reserved`` stay free for pad and marks."""

    def ids(text: Column) -> Column:
        number = lambda t: (draw(F.lit(vocabulary - reserved), "token", t) + reserved).cast("int")
        return F.transform(tokens(text), number)

    return ids


def tokenizer_from(load: Callable[[], Callable[[str], list[int]]]) -> Tokenizer:
    """A user's own tokenizer. ``load`` runs once per Python worker and returns text -> ids."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            yield texts.map(lambda t: None if t is None else encode(t))

    return ids


def tokenize_rows(
    df: DataFrame,
    has_encoder: bool,
    tokenizer: Tokenizer | None = None,
    max_length: int | None = None,
    pad: int = 0,
) -> DataFrame:
    """Replace the model texts by ``input_ids``, ``attention_mask`` and ``labels`` of one width.

    Inputs are padded to the longest row of the whole table, on the left for decoder-only models.
    The two widths come from one small aggregate that enters the plan as a scalar.
    """
    rows = _token_rows(df, tokenizer, max_length)
    widths = rows.agg(
        F.struct(F.max(F.size("_in")).alias("i"), F.max(F.size("_out")).alias("o")).alias("w")
    ).scalar()
    return _padded(rows, has_encoder, pad, widths["i"], widths["o"]).drop("_in", "_out")


def _token_rows(df: DataFrame, tokenizer: Tokenizer | None, max_length: int | None) -> DataFrame:
    """The ids as ``_in`` and ``_out`` in place of the texts; written, as widths and rows both read them."""
    require_columns(df, MODEL_INPUT, MODEL_OUTPUT)
    tokenizer = tokenizer or hashed_ids()
    cut = lambda name: arrays.truncate(tokenizer(F.col(name)), max_length)
    return stage(df.withColumns({"_in": cut(MODEL_INPUT), "_out": cut(MODEL_OUTPUT)}).drop(MODEL_INPUT, MODEL_OUTPUT), "token-ids")


def _padded(rows: DataFrame, has_encoder: bool, pad: int, in_width: Column, out_width: Column) -> DataFrame:
    left = not has_encoder
    ids = arrays.pad_to(F.col("_in"), in_width, pad, left)
    mask = arrays.mask_for(F.col("_in"), in_width, left)
    padded = rows.withColumns({"input_ids": ids, "attention_mask": mask})
    if has_encoder:
        labels = arrays.output_labels(F.col("_out"), out_width, pad)
    else:
        labels = arrays.tail_labels(F.col("input_ids"), F.size("_out"))
    return padded.withColumn("labels", labels)


#: lengths up to which rows share a bucket, two to an octave, so that at most a third of a row is padding
BORDERS = tuple(sorted({k << i for i in range(1, 20) for k in (2, 3)} | {1, 2, 3}))


def tokenize_bucketed(
    df: DataFrame, has_encoder: bool, tokenizer: Tokenizer | None = None, max_length: int | None = None, pad: int = 0,
    borders: Sequence[int] = BORDERS,
) -> DataFrame:
    """Like ``tokenize_rows`` with a width for each ``bucket`` of input lengths, so that one long text does not pad the whole table.

    A bucket ends at a border; rows beyond the last one share a bucket. Its widths are those of its longest rows, from a
    histogram with one row per bucket that is combined on the map side and joined back.
    """
    if list(borders) != sorted(set(borders)):
        raise ValueError("borders must ascend")
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in borders]), lambda b: b < F.size("_in")))
    rows = _token_rows(df, tokenizer, max_length).withColumn("bucket", bucket)
    widths = stage(length_histogram(rows), "widths")
    padded = _padded(rows.join(widths.select("bucket", "_in_width", "_out_width"), "bucket"), has_encoder, pad, F.col("_in_width"), F.col("_out_width"))
    return padded.drop("_in", "_out", "_in_width", "_out_width")


def length_histogram(rows: DataFrame) -> DataFrame:
    """(bucket, n, _in_width, _out_width) of rows with ids."""
    sizes = rows.select("bucket", F.size("_in").alias("i"), F.size("_out").alias("o"))
    return sizes.groupBy("bucket").agg(F.count("*").alias("n"), F.max("i").alias("_in_width"), F.max("o").alias("_out_width"))


def padding_share(tokenized: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n_rows, width, padding): the share of the input ids that is padding."""
    seen = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    sizes = tokenized.select(*by, F.size("input_ids").alias("w"), seen.alias("t"))
    return sizes.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.max("w").alias("width"), (1 - F.sum("t") / F.sum("w")).alias("padding")
    )


def tokenize_causal(df: DataFrame, tokenizer: Tokenizer | None = None, width: int = 512, pad: int = 0) -> DataFrame:
    """``text`` at a fixed width, padded on the left; labels repeat the ids."""
    require_columns(df, "text")
    rows = df.withColumn("_in", arrays.truncate((tokenizer or hashed_ids())(F.col("text")), width)).drop("text")
    return (
        rows.withColumns(
            {
                "input_ids": arrays.pad_to(F.col("_in"), width, pad, left=True),
                "attention_mask": arrays.mask_for(F.col("_in"), width, left=True),
            }
        )
        .withColumn("labels", F.col("input_ids"))
        .drop("_in")
    )


def longest_texts(df: DataFrame, columns: list[str], counter: Callable[[Column], Column], limit: int, key: str) -> DataFrame:
    """Per column the longest text by characters, its tokens, and whether the limit cuts it.

    Only lengths and keys are compared; the texts of the winners are fetched afterwards.
    """
    def longest(name: str) -> DataFrame:
        best = df.select(key, F.length(name).alias("n_chars")).agg(
            F.max_by(key, F.struct(F.col("n_chars"), -F.col(key))).alias("k")
        ).scalar()
        n = counter(F.col(name))
        return df.where(F.col(key) == best).select(
            F.lit(name).alias("column"), F.col(key), F.length(name).cast("bigint").alias("n_chars"),
            n.cast("bigint").alias("n_tokens"), (n > limit).alias("truncated"),
        )

    out = longest(columns[0])
    for name in columns[1:]:
        out = out.unionByName(longest(name))
    return out


def completion_budget(n_tokens: Column, max_tokens: int | None, buffer: int = 300) -> Column:
    """Tokens left for the answer: what the model takes, less the prompt and a buffer; without a limit, 3 x the prompt."""
    if max_tokens is None:
        return 3 * n_tokens
    return F.lit(max_tokens) - n_tokens - F.lit(buffer)


def batch_budgets(prompts: DataFrame, max_tokens: int | None, buffer: int = 300, batch: str = "batch_id") -> DataFrame:
    """The longest prompt of a batch sets the budget of the whole batch."""
    return prompts.groupBy(batch).agg(F.max("n_tokens").alias("n_tokens"), F.count("*").alias("n_prompts")).withColumn(
        "budget", completion_budget(F.col("n_tokens"), max_tokens, buffer)
    )
