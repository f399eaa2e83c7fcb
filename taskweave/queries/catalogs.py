"""Catalogue work: curation, access, eligibility, nested entries, sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskweave.operators.catalog import (
    accessible, curate, curation_reasons, eligible_configs, eligible_models, nested_entries, reason_counts, size_in_mb, valid_datasets,
)
from taskweave.queries.registry import query, sql_words, spread_table, table

# every eleventh text is blanked and every fifth has no download count, so that each reason occurs
_CATALOG = f"""c AS (SELECT doc_id AS pos, CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END AS description,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars END AS downloads FROM documents),
e AS (SELECT *, CASE WHEN description IS NULL OR description = '' THEN 'no_description'
  WHEN len({sql_words('description')}) < 12 THEN 'short_description'
  WHEN coalesce(downloads, 0) < 300 THEN 'few_downloads' END AS early FROM c),
j AS (SELECT *, CASE WHEN early IS NOT NULL THEN early
  WHEN row_number() OVER (PARTITION BY early IS NULL, description ORDER BY pos) > 1 THEN 'duplicate' END AS reason FROM e)"""


def _catalog(spark, sf_dir):
    blank = F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("text"))
    return spread_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pos"), blank.alias("description"), F.when(F.col("doc_id") % 5 != 0, F.col("n_chars")).alias("downloads")
    )


@query(f"WITH {_CATALOG} SELECT pos, description, downloads FROM j WHERE reason IS NULL")
def curate_catalog(spark, sf_dir):
    return curate(_catalog(spark, sf_dir), min_downloads=300, min_words=12).select("pos", "description", "downloads")


@query(f"WITH {_CATALOG} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM j GROUP BY 1")
def curation_reason_counts(spark, sf_dir):
    return reason_counts(curation_reasons(_catalog(spark, sf_dir), min_downloads=300, min_words=12))


@query("""SELECT l.doc_id AS name, d.lang, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id
WHERE l.toxic = 0""")
def access_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), "lang", "n_chars")
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"), (F.col("toxic") == 1).alias("is_gated"))
    catalog = docs.join(marks, "name")
    return accessible(docs.select("name"), catalog).select("name", "lang", "n_chars")


@query("""SELECT doc_id AS dataset, lang FROM documents WHERE n_chars % 13 <> 0 AND lang <> 'es' AND n_chars % 2 = 0""")
def validity_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("dataset"), "lang", (F.col("n_chars") % 13 == 0).alias("disabled"),
        F.when(F.col("lang") != "es", True).alias("preview"), (F.col("n_chars") % 2 == 0).alias("viewer"),
    )
    return valid_datasets(docs).select("dataset", "lang")


def _configs(spark, sf_dir):
    """Sources as datasets, languages as configs; a config's splits and column types follow from its documents."""
    docs = table(spark, sf_dir, "documents")
    split = F.when(F.col("n_chars") % 4 == 0, "train").otherwise("test")
    configs = docs.groupBy(F.col("source").alias("dataset"), F.col("lang").alias("config")).agg(
        F.collect_set(split).alias("splits"),
        F.when(F.min("n_chars") < 150, F.min_by("doc_id", "doc_id").cast("string")).alias("sample_row"),
    )
    kind = F.when((F.col("n_chars") % 50 == 0), "binary").otherwise("string")
    columns = docs.select(F.col("source").alias("dataset"), F.col("lang").alias("config"), F.lit("text").alias("name"), kind.alias("type"))
    return configs, columns


_ELIGIBLE = """g AS (SELECT source, lang, bool_or(n_chars % 4 = 0) AS has_train, bool_or(n_chars % 50 = 0) AS has_binary,
  min(n_chars) AS least, min(doc_id)::VARCHAR AS sample_row FROM documents GROUP BY source, lang),
e AS (SELECT * FROM g WHERE has_train AND NOT has_binary AND least < 150)"""


@query(f"WITH {_ELIGIBLE} SELECT source AS dataset, lang AS config, sample_row FROM e", name="eligible_configs")
def eligible_config_rows(spark, sf_dir):
    return eligible_configs(*_configs(spark, sf_dir)).select("dataset", "config", "sample_row")


@query(f"""WITH {_ELIGIBLE} SELECT d.source AS dataset, d.n AS downloads, m.configs, m.sample_rows
FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) d
LEFT JOIN (SELECT source, string_agg(lang, ',' ORDER BY lang) AS configs, string_agg(sample_row, ',' ORDER BY lang) AS sample_rows FROM e GROUP BY source) m
ON d.source = m.source""")
def nested_catalog(spark, sf_dir):
    datasets = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("downloads"))
    configs = eligible_configs(*_configs(spark, sf_dir)).withColumns(
        {
            "columns": F.array(F.lit("text")),
            "columns_mapping": F.create_map(F.lit("text"), F.lit("text")),
            "dataset_description": F.col("dataset"),
        }
    )
    nested = nested_entries(datasets, configs)
    rows = F.transform(F.map_entries("configs"), lambda e: e["value"]["sample_row"])
    return nested.select(
        "dataset", "downloads", F.array_join(F.map_keys("configs"), ",").alias("configs"), F.array_join(rows, ",").alias("sample_rows")
    )


@query("""SELECT p_partkey, p_brand || '/' || p_name AS name, (CASE WHEN p_size % 9 = 0 THEN 0 ELSE p_size END) * 100000000::BIGINT AS size_bytes FROM part
WHERE p_size % 9 <> 0 AND p_type <> 'ECONOMY' AND p_brand <> 'Brand#13'""", name="eligible_models")
def eligible_model_rows(spark, sf_dir):
    size = F.when(F.col("p_size") % 9 == 0, F.lit("0")).otherwise((F.col("p_size") * F.lit(100_000_000).cast("bigint")).cast("string"))
    models = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws("/", "p_brand", "p_name").alias("name"),
        F.when(F.col("p_type") != "ECONOMY", F.col("p_type")).alias("description"), size.alias("size_bytes"),
    )
    return eligible_models(models, blocked=("Brand#13",)).select("p_partkey", "name", "size_bytes")


@query("""SELECT source, CASE WHEN b IS NULL THEN 'NA' ELSE printf('%.2f', b / 1048576.0::DOUBLE) END AS size_mb
FROM (SELECT source, CASE WHEN min(n_chars) < 20 THEN NULL ELSE sum(n_chars) END AS b FROM documents GROUP BY source)""")
def size_report(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.when(F.min("n_chars") >= 20, F.sum("n_chars")).alias("b"))
    return sizes.select("source", size_in_mb(F.col("b")).alias("size_mb"))
