"""Search and rescoring: J1, J2, J4, J7, T1-T4."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.operators.positions import head_per_group
from taskweave.operators.sparse_index import SparseIndex, search_index, temporary_index
from taskweave.operators.vector_index import QUERY_BYTES, VectorIndex, scan, search_vectors

_BLOCK = 1024  # corpus vectors that meet a block of queries at once
WEIGHT_CELLS = 8_000_000  # scores of queries by documents held in a task of a sparse search, and
_TF_CELLS = 2_000_000  # tokens of its blocks of documents


def dense_top_k(queries: DataFrame, corpus: DataFrame | VectorIndex, k: int, broadcast_limit: int = QUERY_BYTES) -> DataFrame:
    """Exact inner-product search: (query_id, id, score, rank), best first, ties by id.

    ``queries``: (query_id, embedding); ``corpus``: (id, embedding), both with unique ids, or a stored index of it. Scores
    are rounded to six digits. Queries go in blocks of ``broadcast_limit`` bytes; without an index every vector meets every
    block, with one only the files that can hold a result are opened.
    """
    if isinstance(corpus, VectorIndex):
        return search_vectors(corpus, queries, k, broadcast_limit)
    return scan(queries, corpus, k, broadcast_limit, _BLOCK)


def bm25_top_k(
    queries: DataFrame,
    documents: DataFrame | SparseIndex,
    k: int,
    tokenize: Callable[[Column], Column],
    k1: float = 1.2,
    b: float = 0.75,
    weight_cells: int = WEIGHT_CELLS,
) -> DataFrame:
    """Sparse search: (query_id, id, score, rank). Only documents that share a term with the query appear.

    ``queries``: (query_id, text); ``documents``: (id, text), with unique ids. Every term of a text is looked at. ``k1``
    and ``b`` are the usual defaults. The documents are indexed first (``sparse_index``), for this search alone; for
    several searches, write the index once and give it instead. A task holds at most ``weight_cells`` scores.
    """
    index = documents if isinstance(documents, SparseIndex) else temporary_index(documents, tokenize, block_tokens=_TF_CELLS)
    return search_index(index, queries, k, tokenize, k1, b, scores=weight_cells)


def with_metadata(ranked: DataFrame, catalog: DataFrame, key: str = "name") -> DataFrame:
    """The ranked names with their catalogue columns. The ranked side is at most depth rows per query."""
    return ranked.join(catalog, key)


def popularity(score: Column, downloads: Column) -> Column:
    return score * F.log10(downloads.cast("double") + 2)


def rescore(ranked: DataFrame, size_limit: int, keep_oversize: bool = False) -> DataFrame:
    """Weight ``score`` by downloads. Models above the size limit are dropped, or kept at minus infinity."""
    fits = F.col("size_bytes") <= size_limit
    scaled = popularity(F.col("score"), F.coalesce(F.col("downloads"), F.lit(0)))
    if keep_oversize:
        return ranked.withColumn("score", F.when(fits, scaled).otherwise(F.lit(float("-inf"))))
    return ranked.where(fits).withColumn("score", scaled)


def final_top_k(ranked: DataFrame, k: int, group: list[str] | None = None, key: str = "name") -> DataFrame:
    """Second-stage cut by score."""
    order = [F.desc("score"), F.asc(key)]
    return head_per_group(ranked, group, order, k) if group else ranked.orderBy(*order).limit(k)


def config_rows(choices: DataFrame, configs: DataFrame) -> DataFrame:
    """The catalogue row of each chosen (dataset, config)."""
    return choices.join(configs, ["dataset", "config"])
