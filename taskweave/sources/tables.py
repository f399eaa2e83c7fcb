"""Task tables, split tables, vector tables, texts to encode, metric files: S5-S8, S10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskweave.contracts import require_columns
from taskweave.sources.catalogs import read_json_rows

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read_table(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose files give fewer partitions than there are cores, evenly over the cores; any other scan unchanged.

    For work that is heavy per row on tables of a few files. A large table has more splits than cores, and is
    never shuffled by this. Meant for a plain scan: counting its partitions runs nothing.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per split, so that a reader of one split opens only its files."""
    require_columns(df, "split").write.mode(mode).partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table if split is None else table.where(F.col("split") == split)


def write_vectors(df: DataFrame, path: str) -> None:
    require_columns(df, "id", "embedding").select("id", "embedding").write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("id", "embedding")


def texts_to_encode(spark: SparkSession, file: str | None = None, table: DataFrame | None = None) -> DataFrame:
    """(text_id, text) from a JSON or JSON-lines file or from a table; exactly one of the two."""
    if (file is None) == (table is None):
        raise ValueError("give either a file or a table, and not both")
    if table is not None:
        return require_columns(table, "text_id", "text").select("text_id", "text")
    return read_json_rows(spark, file, "text_id bigint, text string")


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    metrics.select("metric", "value").coalesce(1).write.mode("overwrite").json(path)


def write_metrics_text(metrics: DataFrame, path: str) -> None:
    """``name: value`` lines."""
    line = F.concat(F.col("metric"), F.lit(": "), F.col("value").cast("string"))
    metrics.select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)
