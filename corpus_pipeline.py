"""Documents to training sequences: quality rules, line dedup, near-duplicates, personal data, best-fit packing.

Each stage works on the whole table that the stage before it left, with the columns of ``documents`` (``doc_id, text,
lang, source, n_chars``; extra columns stay), and gives the same columns; the last one gives token pieces placed in
sequences. ``n_chars`` follows the text. An empty table stays empty through all stages; nulls, ties and repeated rows
have the results that the operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskweave.llm.linededup import drop_repeated_lines
from taskweave.llm.orderminhash import keep_one
from taskweave.llm.packing import pack_documents
from taskweave.llm.pii import redact_documents
from taskweave.llm.quality import clean_documents
from taskweave.shipping import ship_package
from taskweave.staging import stage


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail."""
    ship_package(spark)
    return _counted(clean_documents(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every line but the first of each group of near-equal lines goes, and so do documents that lose all they had."""
    ship_package(spark)
    left = drop_repeated_lines(docs)
    emptied = (F.col("__removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _counted(left.where(~F.coalesce(emptied, F.lit(False))).drop("__removed"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship_package(spark)
    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    ship_package(spark)
    return _counted(redact_documents(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024 tokens."""
    ship_package(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

# near-duplicate alignments, tokenizer ids and packing are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's documents are written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
