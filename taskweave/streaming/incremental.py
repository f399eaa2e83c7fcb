"""The row operators on a stream, and votes kept up to date batch by batch: R1, R2."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from taskweave.contracts import INPUT, OUTPUT
from taskweave.functions.parsing import strict_pair
from taskweave.operators.textualize import drop_empty_pairs, textualize
from taskweave.operators.voting import vote_counts, winners


def textualize_stream(pairs: DataFrame, instruction: str, has_encoder: bool, eos_token: str | None = None) -> DataFrame:
    """Filter and text are row expressions, so the batch operators run on a stream unchanged."""
    return textualize(drop_empty_pairs(pairs), instruction, has_encoder, eos_token)


def parse_stream(answers: DataFrame, keep: tuple[str, ...] = ("seen",)) -> DataFrame:
    """(keep..., input_col, output_col) from a stream with a ``content`` column."""
    parsed = answers.withColumn("_pair", strict_pair(F.col("content"))).where(F.col("_pair").isNotNull())
    return parsed.select(*keep, F.col("_pair.input").alias(INPUT), F.col("_pair.output").alias(OUTPUT))


def vote_stream(pairs: DataFrame, path: str, seen: Column) -> DataStreamWriter:
    """Write each micro-batch's own vote counts under its batch number.

    A replayed batch overwrites its own folder, so counts are exact after a failure; a batch never
    rewrites what older batches wrote.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        vote_counts(batch, seen).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return pairs.writeStream.outputMode("append").foreachBatch(save)


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """All batches' counts, merged."""
    saved = spark.read.parquet(path)
    return saved.groupBy(INPUT, OUTPUT).agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"))


def current_winners(spark: SparkSession, path: str) -> DataFrame:
    return winners(current_counts(spark, path))


def compact_counts(spark: SparkSession, path: str, target: str) -> None:
    """Write the merged counts as one table, for a stream that starts over on a new path."""
    current_counts(spark, path).write.mode("overwrite").parquet(f"{target}/batch=-1")


# --- totals in the state store ---------------------------------------------------

FOLD_EVERY = 16


def vote_totals_stream(pairs: DataFrame, path: str, seen: Column, fold_every: int = FOLD_EVERY) -> DataStreamWriter:
    """Keep the total of each (input, output) in the stream's state, and under ``path`` a table of the totals.

    The state is in the checkpoint, so a stream that starts again goes on counting where it stopped. A micro-batch writes
    the new totals of the pairs it touched, under its number; one that is replayed writes the same totals again. Every
    ``fold_every`` batches what has been written is folded into one part, so there are never more parts than that and a
    reader's work does not grow with the number of batches. Counting combines on the map side, so an input with very many answers is no hot spot.
    """
    if fold_every < 1:
        raise ValueError("fold_every must be at least 1")
    totals = vote_counts(pairs, seen)

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/upto={batch_id}")
        parts = _parts(spark, path)
        older = [n for n in parts if n < batch_id]
        if len(older) >= fold_every:
            # this batch's own part comes to hold everything; a replay finds the older parts or what covers them
            _newest(spark, path, parts).write.mode("overwrite").parquet(f"{path}/folding")
            _replace(spark, f"{path}/folding", f"{path}/upto={batch_id}", [f"{path}/upto={n}" for n in older])

    return totals.writeStream.outputMode("update").foreachBatch(save)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _parts(spark: SparkSession, path: str) -> list[int]:
    fs, place = _file_system(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(int(n.removeprefix("upto=")) for n in names if n.startswith("upto="))


def _replace(spark: SparkSession, new: str, old: str, gone: list[str]) -> None:
    """Put the folder ``new`` in the place of ``old``, then drop the folders that it covers.

    If this stops half way the batch is replayed: it writes its own totals, finds older parts left over, and folds again.
    Between the two steps of a swap a reader may see the older parts alone.
    """
    fs, source = _file_system(spark, new)
    target = _file_system(spark, old)[1]
    fs.delete(target, True)
    fs.rename(source, target)
    for path in gone:
        fs.delete(_file_system(spark, path)[1], True)


def _newest(spark: SparkSession, path: str, parts: list[int]) -> DataFrame:
    rows = [spark.read.parquet(f"{path}/upto={n}").withColumn("_part", F.lit(n)) for n in parts]
    every = reduce(DataFrame.unionByName, rows)
    last = every.groupBy(INPUT, OUTPUT).agg(F.max_by(F.struct("n", "first_seen"), "_part").alias("t"))
    return last.select(INPUT, OUTPUT, "t.*")


def current_totals(spark: SparkSession, path: str) -> DataFrame:
    """(input, output, n, first_seen) as of the last batch."""
    parts = _parts(spark, path)
    if not parts:
        return spark.createDataFrame([], f"{INPUT} string, {OUTPUT} string, n bigint, first_seen bigint")
    return _newest(spark, path, parts)
