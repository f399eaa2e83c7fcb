"""Find models for tasks: search descriptions, weight by popularity, cut (M11)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.functions.text import tokens
from taskweave.operators.catalog import eligible_models
from taskweave.operators.completion import ClientFactory
from taskweave.operators.positions import head_per_group
from taskweave.operators.retrieval import bm25_top_k, dense_top_k, rescore, with_metadata
from taskweave.operators.sparse_index import SparseIndex
from taskweave.operators.vector_index import VectorIndex
from taskweave.plans.understanding import expand_queries

FIRST_STAGE_DEPTH, FINAL_DEPTH = 1000, 5


def lower_tokens(c: Column) -> Column:
    return tokens(F.lower(c))


def retrieve_models(
    queries: DataFrame,
    models: DataFrame,
    size_limit: int,
    encoder: Callable[[Column], Column] | None = None,
    expand_with: ClientFactory | None = None,
    first_depth: int = FIRST_STAGE_DEPTH,
    depth: int = FINAL_DEPTH,
    keep_oversize: bool = False,
    index: SparseIndex | VectorIndex | None = None,
) -> DataFrame:
    """(query_id, rank, name, score). Sparse search without an ``encoder``, dense search with one.

    ``queries``: (query_id, text); ``models``: (name, description, size_bytes, downloads). With ``expand_with``,
    each query is first replaced by an imagined description. ``index``: the stored descriptions, ids being names, so that
    they are not tokenized or encoded again; a sparse one without an ``encoder``, a vector index with one.
    """
    if index is not None and isinstance(index, VectorIndex) != (encoder is not None):
        raise ValueError("a vector index goes with an encoder, a sparse one without")
    models = eligible_models(models)
    if expand_with is not None:
        queries = expand_queries(queries, expand_with)
    texts = models.select(F.col("name").alias("id"), F.col("description").alias("text"))
    if encoder is None:
        found = bm25_top_k(queries, index or texts, first_depth, lower_tokens)
    else:
        found = dense_top_k(
            queries.select("query_id", encoder(F.col("text")).alias("embedding")),
            index or texts.select("id", encoder(F.col("text")).alias("embedding")),
            first_depth,
        )
    ranked = with_metadata(found.select("query_id", F.col("id").alias("name"), "score"), models)
    scored = rescore(ranked, size_limit, keep_oversize).withColumn("score", F.round("score", 6))
    best = head_per_group(scored, ["query_id"], [F.desc("score"), F.asc("name")], depth, rank="rank")
    return best.select("query_id", "rank", "name", "score")
