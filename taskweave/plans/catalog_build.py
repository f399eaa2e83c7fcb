"""Build the nested dataset catalogue from tables: validity, eligible configs, names, previews (M14)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskweave.operators.catalog import nested_entries, takes_schema, valid_datasets
from taskweave.operators.shapes import flatten, row_preview, unique_names


def config_entry(table: DataFrame, dataset: str, config: str, description: str, splits: list[str]) -> DataFrame | None:
    """One row (dataset, config, sample_row, columns, columns_mapping, dataset_description), or None when not eligible.

    Reads the first row only.
    """
    if "train" not in splits or not takes_schema(table.schema):
        return None
    flat = flatten(table)
    mapping = unique_names(flat.columns)
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return flat.limit(1).select(
        F.lit(dataset).alias("dataset"), F.lit(config).alias("config"), row_preview(flat, max_length=50).alias("sample_row"),
        F.array(*[F.lit(n) for n in mapping.values()]).alias("columns"), F.create_map(*pairs).alias("columns_mapping"),
        F.lit(description).alias("dataset_description"),
    )


def build_catalog(
    spark: SparkSession, datasets: DataFrame, tables: Mapping[tuple[str, str], tuple[DataFrame, list[str]]]
) -> DataFrame:
    """Nested catalogue rows for the valid datasets of (dataset, description, downloads, tags, is_gated, disabled, preview, viewer).

    ``tables``: (dataset, config) -> (train table, split names).
    """
    rows = [config_entry(t, ds, cfg, "", splits) for (ds, cfg), (t, splits) in tables.items()]
    rows = [r for r in rows if r is not None]
    valid = valid_datasets(datasets).drop("disabled", "preview", "viewer")
    schema = (
        "dataset string, config string, sample_row string, columns array<string>, columns_mapping map<string,string>, dataset_description string"
    )
    configs = spark.createDataFrame([], schema)
    for row in rows:
        configs = configs.unionByName(row)
    described = configs.drop("dataset_description").join(
        valid.select("dataset", F.col("description").alias("dataset_description")), "dataset"
    )
    return nested_entries(valid, described)
