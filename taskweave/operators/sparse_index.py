"""A stored postings table for BM25, searched by blocks of documents that can still matter (T2).

Documents are tokenized once, when the index is written. An index is a folder with two tables:

* ``kind=postings``: (block, term, docs, tfs, max_tf, min_len), a row per term and block of documents; ``docs`` are places in
  the block. The rows lie in the order of (term, block), so a term's rows lie together, and a term in every document is as
  many rows as there are blocks.
* ``kind=blocks``: (block, ids, lengths).

The largest count and the shortest document of a row bound the weight any of its documents can have, whatever the
parameters and the collection's average. A search first adds those bounds up per query and block, which reads no postings.
It scores the blocks that promise most, takes the k-th best score as the bar, and scores the other blocks whose bound
reaches the bar. Blocks below it cannot hold a result and are skipped, so the rows are those of scoring everything.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskweave.contracts import require_columns
from taskweave.operators.positions import head_per_group
from taskweave.operators.ranking import candidates, cut
from taskweave.staging import shared_folder, stage

BLOCK = 2_048  # documents of a block
BLOCK_TOKENS = 2_000_000  # tokens after which a block is closed early
SCORES = 8_000_000  # scores of queries by documents that a task holds at once
_PART_BITS = 31
_SLACK = 2e-6  # scores are rounded to six digits, bounds are not


@dataclass(frozen=True)
class SparseIndex:
    postings: DataFrame
    blocks: DataFrame


def _schema(kind: str) -> str:
    return (
        f"kind string, block bigint, term string, docs array<int>, tfs array<int>, max_tf int, min_len int, ids array<{kind}>, lengths array<int>"
    )


def _block_rows(number: int, ids: pa.Array, lists: pa.Array) -> pa.RecordBatch:
    """The postings of a block in the order of terms, and a row for the block itself."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    code = place[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int64)
    cells, tf = np.unique(code * max(1, len(ids)) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    term, doc = np.divmod(cells, max(1, len(ids)))
    starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, np.int64)
    ends = pa.array(np.append(starts, len(term)).astype(np.int32))
    n = len(starts)
    largest = np.maximum.reduceat(tf, starts) if n else np.empty(0, np.int64)
    shortest = np.minimum.reduceat(lengths[doc], starts) if n else np.empty(0, np.int64)
    none = lambda kind, size=1: pa.nulls(size, kind)
    join = lambda a, b: pa.concat_arrays([a, b])
    ints = pa.list_(pa.int32())
    columns = {
        "kind": pa.array(["postings"] * n + ["blocks"]),
        "block": pa.array(np.full(n + 1, number, np.int64)),
        "term": join(coded.dictionary.take(pa.array(order)), none(pa.string())),
        "docs": join(pa.ListArray.from_arrays(ends, pa.array(doc.astype(np.int32))), none(ints)),
        "tfs": join(pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32))), none(ints)),
        "max_tf": join(pa.array(largest.astype(np.int32)), none(pa.int32())),
        "min_len": join(pa.array(shortest.astype(np.int32)), none(pa.int32())),
        "ids": join(none(pa.list_(ids.type), n), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)),
        "lengths": join(none(ints, n), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(lengths.astype(np.int32)))),
    }
    return pa.RecordBatch.from_pydict(columns)


def write_index(
    documents: DataFrame, path: str, tokenize: Callable[[Column], Column], block: int = BLOCK, block_tokens: int = BLOCK_TOKENS,
    sort: bool = True,
) -> SparseIndex:
    """Index (id, text) under ``path``. Ids are unique; every term of a text is indexed, a NULL text has none.

    Without ``sort`` the rows stay in the order of blocks, which saves a shuffle of an index that is searched once.
    """
    require_columns(documents, "id", "text")
    if block <= 0 or block_tokens <= 0:
        raise ValueError("a block holds a document and a token at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = None
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            done, start = np.cumsum(sizes), 0
            while start < batch.num_rows:
                before = done[start - 1] if start else 0
                stop = min(start + block, max(start + 1, int(np.searchsorted(done, before + block_tokens, side="right"))))
                if number is None:
                    number = batch.column(0)[0].as_py() << _PART_BITS
                yield _block_rows(number, batch.column(1).slice(start, stop - start), batch.column(2).slice(start, stop - start))
                number, start = number + 1, stop

    kind = documents.schema["id"].dataType.simpleString()
    # the partition's number keeps the numbers of blocks apart
    terms = documents.select(F.spark_partition_id().alias("part"), "id", tokenize(F.col("text")).alias("terms"))
    rows = terms.mapInArrow(run, _schema(kind))
    if sort:  # the range sort reads its input twice, so that is written first
        rows = stage(rows, "index-rows").repartitionByRange("kind", "term", "block").sortWithinPartitions("kind", "term", "block")
    rows.write.mode("overwrite").partitionBy("kind").parquet(path)
    return read_index(documents.sparkSession, path, kind)


def read_index(spark: SparkSession, path: str, id_kind: str | None = None) -> SparseIndex:
    if id_kind is None:
        id_kind = spark.read.parquet(path).schema["ids"].dataType.elementType.simpleString()
    table = spark.read.schema(_schema(id_kind)).parquet(path)
    postings = table.where(F.col("kind") == "postings").select("block", "term", "docs", "tfs", "max_tf", "min_len")
    return SparseIndex(postings, table.where(F.col("kind") == "blocks").select("block", "ids", "lengths"))


def temporary_index(documents: DataFrame, tokenize: Callable[[Column], Column], **sizes: int) -> SparseIndex:
    """An index for the searches of one job."""
    path = f"{shared_folder(documents.sparkSession)}/taskweave/index-{uuid.uuid4().hex}"
    return write_index(documents, path, tokenize, sort=False, **sizes)


def _weight(tf, length, average, k1: float, b: float):
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def search_index(
    index: SparseIndex, queries: DataFrame, k: int, tokenize: Callable[[Column], Column],
    k1: float = 1.2, b: float = 0.75, scores: int = SCORES,
) -> DataFrame:
    """(query_id, id, score, rank) for (query_id, text). Only documents that share a term with the query appear."""
    bounds, weights, average = query_bounds(index, queries, tokenize, k1, b)
    id_kind = index.blocks.schema["ids"].dataType.elementType.simpleString()
    result = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {id_kind}, score double"
    groups = max(1, -(-queries.count() * BLOCK // max(1, scores)))
    score = lambda wanted: _scored(index, wanted, weights, k, k1, b, average, groups, result)

    first = stage(score(most_promising(bounds, k)), "first-blocks")
    rest = score(reaching(bounds, first, k))
    best = ["query_id"], [F.desc("score"), F.asc("id")]
    return head_per_group(first.unionByName(rest), *best, k, rank="rank")


def query_bounds(
    index: SparseIndex, queries: DataFrame, tokenize: Callable[[Column], Column], k1: float, b: float
) -> tuple[DataFrame, DataFrame, float]:
    """(query_id, block, bound), (query_id, term, idf), and the average length; reads no postings."""
    sizes = index.blocks.select(F.size("ids").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
    told = sizes.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n, average = told["n"] or 0, (told["total"] or 0) / (told["n"] or 1) or 1.0
    # the outer form of explode: from the plain one the optimizer infers a filter that tokenizes every text again
    asked = queries.select("query_id", F.explode_outer(F.array_distinct(tokenize(F.col("text")))).alias("term")).where(F.col("term").isNotNull())
    vocabulary = asked.select("term").distinct()
    heads = stage(
        index.postings.select("block", "term", F.size("docs").alias("n"), "max_tf", "min_len").join(vocabulary, "term", "left_semi"), "index-heads"
    )
    df = heads.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = stage(asked.join(df, "term").select("query_id", "term", idf.alias("idf")), "query-weights")
    most = _weight(F.col("max_tf"), F.col("min_len"), F.lit(average), k1, b)
    bounds = heads.join(weights, "term").groupBy("query_id", "block").agg(F.sum(F.col("idf") * most).alias("bound"))
    return stage(bounds, "block-bounds"), weights, average


def most_promising(bounds: DataFrame, k: int) -> DataFrame:
    """The blocks scored first, enough of them to hold k documents where blocks are full."""
    n = 1 + -(-2 * k // BLOCK)
    return head_per_group(bounds, ["query_id"], [F.desc("bound"), F.asc("block")], n).select("query_id", "block")


def reaching(bounds: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """The other blocks that may hold one of the k best; ``first`` are the scores of the most promising ones."""
    ranked = head_per_group(first, ["query_id"], [F.desc("score"), F.asc("id")], k, rank="rank")
    bar = ranked.where(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
    left = bounds.join(most_promising(bounds, k), ["query_id", "block"], "left_anti")
    return left.join(bar, "query_id", "left").where(F.col("bar").isNull() | (F.col("bound") >= F.col("bar") - _SLACK)).select("query_id", "block")


def _scored(
    index: SparseIndex, wanted: DataFrame, weights: DataFrame, k: int, k1: float, b: float, average: float, groups: int, result: str
) -> DataFrame:
    """(query_id, id, score): up to k candidates of each wanted (query_id, block). A task holds one block and some of the queries."""
    group = F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("group")
    asked = wanted.join(weights, "query_id").groupBy("block", "term", group).agg(
        F.collect_list("query_id").alias("queries"), F.collect_list("idf").alias("idfs")
    )
    rows = asked.join(index.postings.select("block", "term", "docs", "tfs"), ["block", "term"])
    blocks = asked.select("block", "group").distinct().join(index.blocks, "block")
    parts = rows.unionByName(blocks, allowMissingColumns=True)
    columns = ["group", "block", "term", "queries", "idfs", "docs", "tfs", "ids", "lengths"]

    def score(table: pa.Table) -> pa.Table:
        whole = table.filter(pc.is_valid(table["ids"]))
        ids = whole["ids"].combine_chunks()[0].values.to_pandas().to_numpy()
        lengths = whole["lengths"].combine_chunks()[0].values.to_numpy()
        postings = table.filter(pc.is_valid(table["term"])).sort_by("term")
        coded = postings["queries"].combine_chunks().flatten().dictionary_encode()
        sums = np.zeros((len(coded.dictionary), len(ids)))
        at = 0
        codes = coded.indices.to_numpy()
        for idfs, docs, tfs in zip(postings["idfs"], postings["docs"], postings["tfs"]):
            idfs, docs, tfs = (v.values.to_numpy() for v in (idfs, docs, tfs))
            who = codes[at : at + len(idfs)]
            at += len(idfs)
            sums[np.ix_(who, docs)] += idfs[:, None] * _weight(tfs, lengths[docs], average, k1, b)[None, :]
        names = coded.dictionary.to_pandas().to_numpy()
        best = cut(candidates(sums, names, ids, k, sums > 0), k) if len(names) else pd.DataFrame({"query_id": [], "id": [], "score": []})
        return pa.Table.from_pandas(best, preserve_index=False)

    return parts.select(*columns).groupBy("group", "block").applyInArrow(score, result)
