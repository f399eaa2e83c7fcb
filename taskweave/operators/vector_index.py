"""Inner-product search over vectors, plain or through a stored index that leaves files unread (T1, J4, S6).

Vectors meet queries as two matrices: a pack of at most a few thousand vectors and a block of queries are one row each, a
join brings them together, and a task multiplies what it is given. Spark sends the query blocks to every task while
they are small and shuffles by block beyond that.

*Index.* A stored index holds the packs in a folder per cell. A cell is what lies nearest to one of at most ``CELLS``
pivots, which are drawn from the vectors; a cell's rows are sorted by their distance and cut into packs, each with its centre
and radius. For a query q and all x within r of c, q·x <= q·c + |q| r. A search first scores, for every query, the cells
that look best until they hold k vectors; the k-th best score is the query's bar. Then it opens the files of those
other cells whose bound reaches the bar of some query, and in them multiplies the packs whose own bound does. What is left
out cannot hold a result, so the rows are those of scoring everything.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskweave.contracts import require_columns
from taskweave.functions.draws import mark
from taskweave.operators.positions import head_per_group
from taskweave.operators.ranking import candidates, cut
from taskweave.staging import shared_folder, stage

CELLS = 1_024  # most cells, so that the pivots fit into every task
PACK = 1_024  # vectors of a pack
QUERY_BYTES = 8 << 20  # vectors of a block of queries
SCORES = 2_000_000  # scores a task holds at once
JOINED = 64 << 20  # bytes of packs and queries that a task of a search by cells brings together, about
_KEPT = 500_000  # candidates a task holds before it passes them on
_SLACK = 2e-6  # scores are rounded to six digits, bounds are not


@dataclass(frozen=True)
class VectorIndex:
    packs: DataFrame  # cell, ids, vectors, centre, radius
    cells: DataFrame  # cell, pivot, radius, n


def _pack_schema(id_kind: str) -> str:
    return f"ids array<{id_kind}>, vectors binary, centre binary, radius double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _pack(ids: pa.Array, matrix: np.ndarray) -> dict[str, pa.Array]:
    centre = matrix.mean(axis=0)
    radius = float(np.sqrt(((matrix - centre) ** 2).sum(axis=1).max()))
    return {
        "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        "vectors": pa.array([matrix.tobytes()], pa.binary()),
        "centre": pa.array([centre.tobytes()], pa.binary()),
        "radius": pa.array([radius * (1 + 1e-9)]),
    }


def _given(vectors: DataFrame, key: str) -> DataFrame:
    require_columns(vectors, key, "embedding")
    return vectors.select(key, F.col("embedding").cast("array<double>").alias("embedding"))


def _written(vectors: DataFrame, key: str) -> DataFrame:
    """The rows that have a vector. Written first: a filter on a vector that is still to be computed computes it twice."""
    return stage(_given(vectors, key), "vectors").where(F.col("embedding").isNotNull())


def packed(corpus: DataFrame, pack: int = PACK) -> DataFrame:
    """(id, embedding) as packs, where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(1)))
            for at in range(0, batch.num_rows, pack):
                rows = batch.slice(at, pack)
                yield pa.RecordBatch.from_pydict(_pack(rows.column(0), _matrix(rows.column(1))))

    return _given(corpus, "id").mapInArrow(run, _pack_schema(corpus.schema["id"].dataType.simpleString()))


# --- scoring ------------------------------------------------------------------


def _scored(rows: DataFrame, k: int, result: str) -> DataFrame:
    """(query_id, id, score) candidates from rows of a pack and a block of queries; ``bars`` are NULL where there are none.

    Rows of one block should follow each other, so that its packs leave the k best of them all and not those of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pd.DataFrame] = []
        held = 0
        for batch in batches:
            for row in range(batch.num_rows):
                ids, vectors, centre, radius, names, asked, bars = (column[row] for column in batch.columns)
                names = names.values.to_pandas().to_numpy()
                queries = np.frombuffer(asked.as_buffer(), np.float64).reshape(len(names), -1)
                if bars.is_valid:
                    bound = queries @ np.frombuffer(centre.as_buffer(), np.float64) + np.sqrt((queries**2).sum(axis=1)) * radius.as_py()
                    reach = bound >= bars.values.to_numpy() - _SLACK
                    queries, names = queries[reach], names[reach]
                if not len(names):
                    continue
                ids = ids.values.to_pandas().to_numpy()
                matrix = np.frombuffer(vectors.as_buffer(), np.float64).reshape(len(ids), -1)
                step = max(1, SCORES // max(1, len(ids)))
                for at in range(0, len(names), step):
                    asking = slice(at, at + step)
                    kept.append(cut(candidates(queries[asking] @ matrix.T, names[asking], ids, k), k))
                    held += len(kept[-1])
                if held > _KEPT:
                    kept = [cut(pd.concat(kept, ignore_index=True), k)]
                    held = len(kept[0])
                    if held > _KEPT // 2:
                        yield pa.RecordBatch.from_pandas(kept.pop(), preserve_index=False)
                        held = 0
        if kept:
            yield pa.RecordBatch.from_pandas(cut(pd.concat(kept, ignore_index=True), k), preserve_index=False)

    return rows.select("ids", "vectors", "centre", "radius", "names", "asked", "bars").mapInArrow(run, result)


def _query_blocks(queries: DataFrame, by: list[str], bars: bool) -> DataFrame:
    """Rows of (by, names, asked, bars) from (by, query_id, embedding[, bar])."""
    kind = queries.schema["query_id"].dataType.simpleString()
    bar = F.col("bar") if bars else F.lit(None).cast("double")
    lists = queries.groupBy(*by).agg(F.collect_list(F.struct("query_id", "embedding", bar.alias("bar"))).alias("l"))
    keys = ", ".join(f"{c} bigint" for c in by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                rows = batch.column(len(by))[row].values
                one = pa.array([0, len(rows)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(row, 1) for i in range(len(by))),
                        pa.ListArray.from_arrays(one, rows.field("query_id")),
                        pa.array([_matrix(rows.field("embedding")).tobytes()], pa.binary()),
                        pa.ListArray.from_arrays(one, rows.field("bar")) if bars else pa.nulls(1, pa.list_(pa.float64())),
                    ],
                    names=[*by, "names", "asked", "bars"],
                )

    typed = lists.select(*[F.col(c).cast("bigint") for c in by], "l")
    return typed.mapInArrow(run, f"{keys}, names array<{kind}>, asked binary, bars array<double>")


def _result(queries: DataFrame, id_kind: str) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {id_kind}, score double"


def _row_bytes(queries: DataFrame) -> int:
    first = queries.select(F.size("embedding").alias("n")).first()
    return 8 * first["n"] + 16 if first else 0


def _blocks(queries: DataFrame, query_bytes: int) -> int:
    n = queries.count()  # does not compute the vectors
    return max(1, -(-n * _row_bytes(queries) // query_bytes))


def best(found: DataFrame, k: int) -> DataFrame:
    return head_per_group(found, ["query_id"], [F.desc("score"), F.asc("id")], k, rank="rank")


def scan(queries: DataFrame, corpus: DataFrame, k: int, query_bytes: int = QUERY_BYTES, pack: int = PACK) -> DataFrame:
    """(query_id, id, score, rank) from every vector; each pack meets every block of queries."""
    queries = _written(queries, "query_id")
    n = _blocks(queries, query_bytes)
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n)))
    # written, so that their size is known when the join is planned
    asked = stage(_query_blocks(numbered, ["block"], bars=False), "query-blocks")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    rows = packed(corpus, pack).withColumn("block", every).join(asked, "block")
    return best(_scored(rows, k, _result(queries, corpus.schema["id"].dataType.simpleString())), k)


# --- the stored index -----------------------------------------------------------


def write_vector_index(corpus: DataFrame, path: str, cells: int | None = None, pack: int = PACK, seed: int | str = 2023) -> VectorIndex:
    """Index (id, embedding) under ``path``; ids are unique, vectors have one length, rows without a vector are left out."""
    spark = corpus.sparkSession
    given = _written(corpus, "id")
    n = given.count()
    cells = min(CELLS, cells or max(1, n // (4 * pack)))
    drawn = given.orderBy(mark(seed, F.col("id")), "id").limit(cells).collect()  # at most CELLS vectors
    pivots = np.array([r["embedding"] for r in drawn], np.float64) if drawn else np.empty((0, 0))
    kind = corpus.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = (pivots**2).sum(axis=1)
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                rows = batch.slice(at, PACK)
                matrix = _matrix(rows.column(1))
                cell = (lengths[None, :] - 2 * (matrix @ pivots.T)).argmin(axis=1)
                far = np.sqrt(((matrix - pivots[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int64)), pa.array(far), *rows.columns], names=["cell", "far", "id", "embedding"]
                )

    def pack_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                for at in range(lo, hi, pack):
                    rows = batch.slice(at, min(pack, hi - at))
                    columns = _pack(rows.column(2), _matrix(rows.column(3)))
                    yield pa.RecordBatch.from_pydict(
                        {"cell": rows.column(0).slice(0, 1), **columns, "far": pa.array([pc.max(rows.column(1)).as_py()]), "n": pa.array([rows.num_rows])}
                    )

    # a cell of any size is spread over as many tasks as its rows need
    assigned = stage(given.mapInArrow(assign, f"cell bigint, far double, id {kind}, embedding array<double>"), "cells")
    dealt = assigned.repartitionByRange("cell", "far", "id").sortWithinPartitions("cell", "far", "id")
    packs = dealt.mapInArrow(pack_up, f"cell bigint, {_pack_schema(kind)}, far double, n bigint")
    packs.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/packs")
    written = spark.read.schema(f"cell bigint, {_pack_schema(kind)}, far double, n bigint").parquet(f"{path}/packs")
    pivot_rows = spark.createDataFrame([(i, p.tolist(), kind) for i, p in enumerate(pivots)], "cell bigint, pivot array<double>, id_kind string")
    sizes = written.groupBy("cell").agg(F.max("far").alias("radius"), F.sum("n").alias("n"))
    pivot_rows.join(sizes, "cell").write.mode("overwrite").parquet(f"{path}/cells")
    return read_vector_index(spark, path)


def read_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    cells = spark.read.schema("cell bigint, pivot array<double>, id_kind string, radius double, n bigint").parquet(f"{path}/cells")
    known = cells.select("id_kind").first()
    if known is None:
        return VectorIndex(spark.createDataFrame([], f"cell bigint, {_pack_schema('string')}"), cells)
    packs = spark.read.schema(f"{_pack_schema(known['id_kind'])}, cell bigint").parquet(f"{path}/packs")
    return VectorIndex(packs, cells)


def temporary_vector_index(corpus: DataFrame, **sizes: int) -> VectorIndex:
    """An index for the searches of one job."""
    path = f"{shared_folder(corpus.sparkSession)}/taskweave/vector-index-{uuid.uuid4().hex}"
    return write_vector_index(corpus, path, **sizes)


def search_vectors(index: VectorIndex, queries: DataFrame, k: int, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, id, score, rank): the rows that ``scan`` gives, from the files that can hold them."""
    first, rest = search_parts(index, queries, k, query_bytes)
    return best(first.unionByName(rest), k)


def search_parts(index: VectorIndex, queries: DataFrame, k: int, query_bytes: int = QUERY_BYTES) -> tuple[DataFrame, DataFrame]:
    """The candidates of the cells that look best, and those of the other cells that reach the bar."""
    queries = _written(queries, "query_id")
    bounds = stage(_bounds(index, queries), "cell-bounds")
    so_far = Window.partitionBy("query_id").orderBy(F.desc("likely"), "cell").rowsBetween(Window.unboundedPreceding, -1)
    near = F.coalesce(F.sum("n").over(so_far), F.lit(0)) < k
    bounds = stage(bounds.withColumn("near", near), "near-cells")
    result = _result(queries, index.packs.schema["ids"].dataType.elementType.simpleString())
    first = stage(_open(index, bounds.where("near"), queries, k, query_bytes, result, bars=False), "near-candidates")
    bar = best(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
    # a query without a bar has fewer than k vectors in its near cells only where there are no other cells
    far = bounds.where(~F.col("near")).join(bar, "query_id").where(F.col("bound") >= F.col("bar") - _SLACK)
    return first, _open(index, stage(far, "far-cells"), queries, k, query_bytes, result, bars=True)


def _bounds(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """(query_id, cell, likely, bound, n) of every query and cell."""
    rows = index.cells.orderBy("cell").collect()  # at most CELLS rows
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, cell bigint, likely double, bound double, n bigint"
    if not rows:
        return queries.sparkSession.createDataFrame([], schema)
    pivots = np.array([r["pivot"] for r in rows], np.float64)
    cell, radius, n = (np.array([r[c] for r in rows]) for c in ("cell", "radius", "n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                matrix = _matrix(rows.column(1))
                likely = matrix @ pivots.T
                bound = likely + np.sqrt((matrix**2).sum(axis=1))[:, None] * (radius[None, :] * (1 + 1e-9))
                every = lambda values: pa.array(np.tile(values, len(matrix)))
                names = rows.column(0).take(pa.array(np.repeat(np.arange(len(matrix)), len(cell))))
                yield pa.RecordBatch.from_arrays(
                    [names, every(cell), pa.array(likely.ravel()), pa.array(bound.ravel()), every(n)],
                    names=["query_id", "cell", "likely", "bound", "n"],
                )

    return queries.mapInArrow(run, schema)


def _open(index: VectorIndex, wanted: DataFrame, queries: DataFrame, k: int, query_bytes: int, result: str, bars: bool) -> DataFrame:
    """Candidates from the packs of the wanted (query_id, cell[, bar])."""
    sizes = wanted.groupBy("cell").agg(F.count("*").alias("asked"), F.max("n").alias("n")).collect()  # at most CELLS rows
    each = _row_bytes(queries)
    blocks = [max(1, -(-r["asked"] * each // query_bytes)) for r in sizes]
    spark = queries.sparkSession
    # a local relation: its size is known to the optimizer, so it is sent, not shuffled
    dealt = spark.createDataFrame(
        pa.table({"cell": pa.array([r["cell"] for r in sizes], pa.int64()), "n_blocks": pa.array(blocks, pa.int64())})
    )
    numbered = wanted.join(queries, "query_id").join(dealt, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("n_blocks")))
    asked = stage(_query_blocks(numbered, ["cell", "block"], bars), "cell-queries")
    # folders of other cells are not listed, let alone read
    packs = index.packs.where(F.col("cell").isin([r["cell"] for r in sizes])).join(dealt, "cell")
    # a pack goes to every block that asks for its cell, and not all blocks of a cell to one task
    packs = packs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1))).drop("n_blocks")
    moved = sum((b * r["n"] + r["asked"]) * each for b, r in zip(blocks, sizes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-moved // JOINED))
    met = packs.repartition(parts, "cell", "block").join(asked.repartition(parts, "cell", "block"), ["cell", "block"])
    return _scored(met, k, result)
