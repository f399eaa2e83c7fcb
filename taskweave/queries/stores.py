"""Tables written in a source's form and read back through its reader: S1-S8, S10, T9, J7, P11, A11, R1."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from taskweave.contracts import INPUT, OUTPUT
from taskweave.operators.metrics import evaluate
from taskweave.operators.retrieval import config_rows
from taskweave.operators.shapes import prune
from taskweave.operators.splits import split_table
from taskweave.queries.pairs import _INSIDE, _SPLIT, CAPS
from taskweave.queries.registry import TURN_PAIRS, query, table, turn_pairs
from taskweave.sources import catalogs, tables
from taskweave.staging import shared_folder
from taskweave.streaming.incremental import textualize_stream


def _place(spark, label: str) -> str:
    return f"{shared_folder(spark)}/taskweave/{label}-{uuid.uuid4().hex}"


_ORDERS = f"""r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders),
s AS (SELECT o_orderkey, o_totalprice, {_SPLIT} AS split FROM r WHERE {_INSIDE})"""


def _split_orders(spark, sf_dir):
    return split_table(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 0.7, 0.1, CAPS)


@query(f"WITH {_ORDERS} SELECT * FROM s WHERE split = 'train'")
def split_store(spark, sf_dir):
    path = _place(spark, "splits")
    tables.write_splits(_split_orders(spark, sf_dir), path)
    return tables.read_splits(spark, path, "train")


@query(f"WITH {_ORDERS} SELECT split, count(*) AS n_rows FROM s GROUP BY split")
def split_counts(spark, sf_dir):
    return _split_orders(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n_rows"))


@query("SELECT vec_id AS id, len(embedding) AS size, round(embedding[1]::DOUBLE, 6) AS first, label FROM embeddings")
def vector_store(spark, sf_dir):
    path = _place(spark, "vectors")
    rows = table(spark, sf_dir, "embeddings")
    tables.write_vectors(rows.select(F.col("vec_id").alias("id"), "embedding"), path)
    back = tables.read_vectors(spark, path).join(rows.select(F.col("vec_id").alias("id"), "label"), "id")
    return back.select(
        "id", F.size("embedding").cast("long").alias("size"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), "label"
    )


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def task_table_formats(spark, sf_dir):
    """The table as CSV, as JSON and as ORC; each holds a third of the rows."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    parts = []
    for i, form in enumerate(("csv", "json", "orc")):
        path = _place(spark, form)
        rows.where(F.col("o_orderkey") % 3 == i).write.format(form).save(path)
        parts.append(tables.read_table(spark, path, form, schema=", ".join(f"{c} {t}" for c, t in rows.dtypes)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT doc_id AS text_id, text FROM documents")
def corpus_scan(spark, sf_dir):
    path = _place(spark, "texts")
    table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text").write.json(path)
    return tables.texts_to_encode(spark, file=path)


def _one_object(entries, path: str) -> None:
    """A catalogue file: one JSON object with a key per source, twenty whatever the table."""
    whole = entries.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "entry")))).alias("value"))
    whole.coalesce(1).write.text(path)


_SOURCES = "SELECT source AS name, count(*) || ' rows, up to ' || max(n_chars) AS description FROM documents GROUP BY source"


def _sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(
        F.concat(F.count("*").cast("string"), F.lit(" rows, up to "), F.max("n_chars").cast("string")).alias("description")
    )


@query(f"SELECT name, description, 0.0::DOUBLE AS score, row_number() OVER (ORDER BY name) - 1 AS place FROM ({_SOURCES})")
def dataset_catalog_scan(spark, sf_dir):
    path = _place(spark, "catalog")
    _one_object(_sources(spark, sf_dir).select("name", F.struct("name", "description", F.lit("{}").alias("evaluation_metadata")).alias("entry")), path)
    # the reader's order shows in the places that a single partition numbers
    rows = catalogs.read_datasets(spark, path).coalesce(1)
    return rows.withColumn("place", F.monotonically_increasing_id())


def _rerank_catalog(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    configs = docs.groupBy(F.col("source").alias("name"), "lang").agg(F.min("doc_id").cast("string").alias("sample_row"))
    config = F.struct(
        F.col("lang").alias("config_name"), "sample_row", F.array(F.lit("text"), F.lit("lang")).alias("columns"),
        F.create_map(F.lit("text"), F.lit("text")).alias("columns_mapping"), F.col("name").alias("dataset_description"),
        F.col("name").alias("dataset_name"),
    )
    nested = configs.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("lang", config.alias("c")))).alias("configs"))
    sizes = docs.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("downloads"))
    entry = F.struct(
        F.col("name").alias("dataset_name"), F.col("name").alias("description"), "downloads", "configs",
        F.array(F.lit("a"), F.lit("b")).alias("tags"), (F.col("downloads") % 2 == 0).alias("is_gated"),
    )
    path = _place(spark, "rerank")
    _one_object(nested.join(sizes, "name").select("name", entry.alias("entry")), path)
    return catalogs.read_rerank_datasets(spark, path)


@query("SELECT source AS name, count(*) AS downloads, count(*) % 2 = 0 AS is_gated, count(DISTINCT lang) AS n_configs, 'a,b' AS tags FROM documents GROUP BY source")
def rerank_catalog_scan(spark, sf_dir):
    return _rerank_catalog(spark, sf_dir).select(
        "name", "downloads", "is_gated", F.size("configs").cast("long").alias("n_configs"), F.array_join("tags", ",").alias("tags")
    )


@query("""SELECT d.source AS dataset, d.lang AS config, min(d.doc_id)::VARCHAR AS sample_row, 'text,lang' AS columns FROM documents d
WHERE d.lang = (SELECT min(lang) FROM documents e WHERE e.source = d.source) GROUP BY 1, 2""")
def config_lookup(spark, sf_dir):
    chosen = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("dataset")).agg(F.min("lang").alias("config"))
    rows = config_rows(chosen, catalogs.configs_of(_rerank_catalog(spark, sf_dir)))
    return rows.select("dataset", "config", "sample_row", F.array_join("columns", ",").alias("columns"))


@query("""SELECT n_name AS name, 'in region ' || n_regionkey AS description, (n_nationkey * 1000)::VARCHAR AS size_bytes, coalesce(c, 0)::BIGINT AS downloads
FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_acctbal < 0 GROUP BY 1) ON c_nationkey = n_nationkey""")
def model_catalog_scan(spark, sf_dir):
    """A file for each nation's model."""
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("downloads"))
    models = table(spark, sf_dir, "nation").join(poor, "n_nationkey", "left").select(
        F.col("n_name").alias("pretrained_model_name"), F.concat(F.lit("in region "), F.col("n_regionkey").cast("string")).alias("description"),
        (F.col("n_nationkey") * 1000).cast("string").alias("size_bytes"), "downloads", F.col("n_nationkey").alias("file"),
    )
    path = _place(spark, "models")
    models.repartition("file").write.partitionBy("file").json(path)
    return catalogs.read_models(spark, path)


@query("SELECT p_partkey, p_name, p_brand FROM part")
def raw_catalog_store(spark, sf_dir):
    path = _place(spark, "raw")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    catalogs.write_catalog_json(rows, path)
    return catalogs.read_raw_catalog(spark, path, rows.schema)


@query(f"""WITH {TURN_PAIRS} SELECT 'exact_match' AS metric,
  avg(CASE WHEN conv_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS value FROM turn_pairs WHERE output_col <> ''""")
def metric_store(spark, sf_dir):
    """Every third conversation is answered right."""
    pairs = turn_pairs(spark, sf_dir).where(F.col(OUTPUT) != "").select(
        F.col(OUTPUT).alias("reference"), F.when(F.col("conv_id") % 3 == 0, F.col(OUTPUT)).otherwise("").alias("prediction")
    )
    path = _place(spark, "metrics")
    tables.write_metrics_json(evaluate(pairs, ["exact_match"]), path)
    return spark.read.schema("metric string, value double").json(path)


@query("SELECT o_custkey, o_orderdate, o_orderstatus FROM orders")
def pruned_columns(spark, sf_dir):
    return prune(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderdate"], "o_orderstatus")


@query(f"""WITH {TURN_PAIRS} SELECT conv_id, turn, 'test' AS split,
  '<task 0>Answer.' || chr(10) || 'Example:' || chr(10) || input_col || chr(10) || 'Label:' || chr(10) AS model_input, output_col AS model_output
FROM turn_pairs WHERE input_col <> '' AND output_col <> ''""")
def streaming_textualize(spark, sf_dir):
    """The pairs as a stream of files."""
    folder = _place(spark, "pairs")
    pairs = turn_pairs(spark, sf_dir).withColumn("split", F.lit("test"))
    pairs.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(pairs.schema).parquet(f"{folder}/in")
    text = textualize_stream(stream.select("conv_id", "turn", "split", INPUT, OUTPUT), "Answer.", has_encoder=True)
    run = text.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")
