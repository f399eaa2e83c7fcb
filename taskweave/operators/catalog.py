"""Curate, filter and build dataset and model catalogues: P16-P20, A8, W2, S11, M14."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskweave.functions.text import words

# Column types a catalogue does not take (images and points in time).
REJECTED_TYPES = (T.BinaryType, T.TimestampType, T.TimestampNTZType, T.DateType)
BLOCKED_ORGANIZATIONS = ("huggingtweets",)


def _same_text(c: Column) -> Column:
    """A short key for equality of long texts."""
    return F.struct(F.unhex(F.sha2(c, 256)), F.length(c))


def curation_reasons(
    catalog: DataFrame,
    min_downloads: int = 10,
    min_words: int = 4,
    description: str = "description",
    downloads: str = "downloads",
    pos: str = "pos",
) -> DataFrame:
    """Add ``reason``: why an entry is dropped, first reason wins, NULL when it is kept.

    Among usable entries with the same description the first by ``pos`` stays. The first positions
    come from an aggregate that combines on the map side, so a description shared by very many
    entries is not a hot spot; they are matched back by the unique ``pos``.
    """
    text = F.col(description)
    early = (
        F.when(text.isNull() | (text == ""), "no_description")
        .when(F.size(words(text)) < min_words, "short_description")
        .when(F.coalesce(F.col(downloads), F.lit(0)) < min_downloads, "few_downloads")
    )
    judged = catalog.withColumn("reason", early)
    firsts = (
        judged.where(F.col("reason").isNull())
        .groupBy(_same_text(text).alias("_text"))
        .agg(F.min(pos).alias(pos))
        .select(pos, F.lit(True).alias("_first"))
    )
    return (
        judged.join(firsts, pos, "left")
        .withColumn("reason", F.when(F.col("reason").isNull() & F.col("_first").isNull(), "duplicate").otherwise(F.col("reason")))
        .drop("_first")
    )


def curate(catalog: DataFrame, **options) -> DataFrame:
    return curation_reasons(catalog, **options).where(F.col("reason").isNull()).drop("reason")


def reason_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def accessible(names: DataFrame, catalog: DataFrame, allow_gated: bool = False, include_open: bool = False) -> DataFrame:
    """Catalogue entries for the given names whose gate flag equals ``allow_gated``.

    ``allow_gated=True`` keeps gated entries only, unless ``include_open``.
    """
    gate = F.lit(True) if allow_gated and include_open else F.col("is_gated") == F.lit(allow_gated)
    return catalog.where(gate).join(names.select("name"), "name", "left_semi")


def valid_datasets(catalog: DataFrame) -> DataFrame:
    """Not disabled, with both the preview and the viewer available."""
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    return catalog.where(~flag("disabled") & flag("preview") & flag("viewer"))


def eligible_configs(
    configs: DataFrame, columns: DataFrame, rejected: Sequence[str] = ("binary", "timestamp", "timestamp_ntz", "date")
) -> DataFrame:
    """Configs with a ``train`` split, a sample row, and no column of a rejected type.

    ``configs``: (dataset, config, splits ARRAY, sample_row); ``columns``: (dataset, config, name, type).
    """
    bad = columns.where(F.col("type").isin(*rejected)).select("dataset", "config").distinct()
    usable = configs.where(F.array_contains("splits", "train") & F.col("sample_row").isNotNull())
    return usable.join(bad, ["dataset", "config"], "left_anti")


def takes_schema(schema: T.StructType) -> bool:
    """Whether a table's own schema is free of rejected types, at any depth."""
    def ok(dtype: T.DataType) -> bool:
        if isinstance(dtype, T.StructType):
            return all(ok(f.dataType) for f in dtype.fields)
        return not isinstance(dtype, REJECTED_TYPES)

    return ok(schema)


def eligible_models(models: DataFrame, blocked: Sequence[str] = BLOCKED_ORGANIZATIONS) -> DataFrame:
    """Size known and above zero, described, and not from a blocked organization."""
    return models.withColumn("size_bytes", F.expr("try_cast(size_bytes AS BIGINT)")).where(
        (F.col("size_bytes") > 0)
        & F.col("description").isNotNull()
        & ~F.split_part("name", F.lit("/"), F.lit(1)).isin(*blocked)
    )


def sorted_map(key: Column, value: Column) -> Column:
    """An aggregate that builds a map with its keys in order; one entry per row of the group."""
    def order(a: Column, b: Column) -> Column:
        return F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)

    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("key"), value.alias("value"))), order))


def nested_entries(datasets: DataFrame, configs: DataFrame) -> DataFrame:
    """One catalogue row per dataset with its configs as a map.

    ``configs`` columns: dataset, config, sample_row, columns ARRAY, columns_mapping MAP, dataset_description.
    A dataset has as many map entries as configs, the shape the catalogue file itself has.
    """
    entry = F.struct(
        F.col("config").alias("config_name"), "sample_row", "columns", "columns_mapping", "dataset_description",
        F.col("dataset").alias("dataset_name"),
    )
    maps = configs.groupBy("dataset").agg(sorted_map(F.col("config"), entry).alias("configs"))
    return datasets.join(maps, "dataset", "left")


def size_in_mb(n_bytes: Column) -> Column:
    """Bytes as megabytes with two decimals, ``NA`` when unknown."""
    text = F.format_string("%.2f", n_bytes / F.lit(1024.0 * 1024.0))
    return F.when(n_bytes.isNull(), F.lit("NA")).otherwise(text)
