"""Catalogue files in and out: S1-S4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskweave.contracts import DATASET_ENTRY, MODEL_ENTRY, RERANK_ENTRY


def _entries(spark: SparkSession, path: str, entry: T.StructType) -> DataFrame:
    """A JSON object with one key per entry as rows (key, value).

    The format is one object per file, so one task reads each file; the rows are spread right away.
    Catalogues that grow should be stored as Parquet with ``save_catalog``.
    """
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", T.MapType(T.StringType(), entry))
    return text.select(F.explode(parsed)).repartition("key")


def read_datasets(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, score), sorted by name."""
    rows = _entries(spark, path, DATASET_ENTRY)
    return rows.select(F.col("key").alias("name"), "value.description", F.lit(0.0).alias("score")).orderBy("name")


def read_rerank_datasets(spark: SparkSession, path: str) -> DataFrame:
    """One row per dataset: name, description, downloads, tags, is_gated, configs."""
    return _entries(spark, path, RERANK_ENTRY).select(
        F.col("key").alias("name"), "value.description", "value.downloads", "value.tags", "value.is_gated", "value.configs"
    )


def configs_of(datasets: DataFrame) -> DataFrame:
    """One row per (dataset, config)."""
    return datasets.select(F.col("name").alias("dataset"), F.explode("configs").alias("config", "c")).select(
        "dataset", "config", "c.sample_row", "c.columns", "c.columns_mapping", "c.dataset_description"
    )


def read_models(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON file per model; hidden and empty files give no row. Missing downloads count as 0."""
    rows = spark.read.schema(MODEL_ENTRY).option("multiLine", True).option("recursiveFileLookup", True).json(folder)
    return rows.where(F.col("pretrained_model_name").isNotNull()).select(
        F.col("pretrained_model_name").alias("name"), "description", "size_bytes",
        F.coalesce("downloads", F.lit(0).cast("bigint")).alias("downloads"),
    )


def read_json_rows(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON array is one value over the whole file; of JSON lines each line is a value, and files can be split."""
    first = spark.read.text(path).where("trim(value) <> ''").head(1)
    is_array = any(r["value"].lstrip().startswith("[") for r in first)
    return spark.read.schema(schema).option("multiLine", is_array).json(path)


def read_raw_catalog(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON array of entries, or one entry per line."""
    return read_json_rows(spark, path, schema)


def write_catalog_json(catalog: DataFrame, path: str) -> None:
    """One entry per line."""
    catalog.write.mode("overwrite").json(path)


def save_catalog(catalog: DataFrame, path: str) -> None:
    catalog.write.mode("overwrite").parquet(path)
