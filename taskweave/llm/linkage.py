"""Connected groups from candidate buckets, without writing out all pairs of a bucket.

Members of a bucket are first held against its leader, the smallest id. Where that and other buckets leave a bucket in
more than one piece, the members outside its largest piece meet the members of other pieces inside tasks, in tiles of a
bounded number of rows, and only links come out. The groups are those that all pairs of all buckets would give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskweave.staging import stage

#: pairs (a, b), texts (id, text) -> those pairs that are links
Verify = Callable[[DataFrame, DataFrame], DataFrame]
#: texts -> is the pair of the i-th and the j-th a link?
Compare = Callable[[list[str]], Callable[[int, int], bool]]
#: texts -> which pairs (i, j), given as two arrays, may be links? Those left out cannot be
Sieve = Callable[[pa.Array], Callable[[np.ndarray, np.ndarray], np.ndarray]]
TILE = 400
_PAIRS = 500_000  # pairs that are sieved at once


def _star(edges: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(smallest id, id) for each id of a task's edges: what they connect, with one edge for each id."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in edges:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    ids = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(map(root, ids), pa.int64()), pa.array(ids, pa.int64())], names=["a", "b"])


def components(edges: DataFrame, edges_of_a_task: int = 2_000_000) -> DataFrame:
    """``id, component`` (smallest id that can be reached) for every id of ``edges`` (a, b).

    Each task first connects the edges it holds, and passes on one edge for each id. If that took more than one task, large-star
    and small-star steps alternate until nothing changes; each turn is written, so the lineage stays short. Smallest
    neighbours come from an aggregation, so an id with very many edges is summed on the map side.
    """
    given = stage(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "edges")
    tasks = max(1, -(-given.count() // edges_of_a_task))
    stars = stage(given.coalesce(tasks).mapInArrow(_star, "a long, b long"), "edges")
    if tasks == 1:
        return stars.select(F.col("b").alias("id"), F.col("a").alias("component"))
    ids = stars.select(F.col("b").alias("id")).distinct()
    pairs, known = stage(_ordered(stars), "edges"), None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        larger = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = stage(_ordered(larger), "edges")
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("low"))
        small = large.join(low, large["b"] == low["u"]).select("a", "u", "low")
        joined = small.select("a", F.col("low").alias("b")).union(small.select(F.col("u").alias("a"), F.col("low").alias("b")))
        pairs = stage(_ordered(joined), "edges")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == known:
            break
        known = now
    found = pairs.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("low"))
    return ids.join(found, "id", "left").select("id", F.coalesce("low", "id").alias("component"))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Each undirected pair once, as a < b."""
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked_groups(
    members: DataFrame, texts_of: Callable[[DataFrame], DataFrame], verify: Verify, compare: Compare, tile: int = TILE
) -> DataFrame:
    """``id, component`` of the ids that have links, from ``members`` (bucket, id).

    ``texts_of`` gives (id, text) for a table of ids.
    """
    return linked_groups_and_texts(members, texts_of, verify, compare, tile)[0]


def linked_groups_and_texts(
    members: DataFrame, texts_of: Callable[[DataFrame], DataFrame], verify: Verify, compare: Compare, tile: int = TILE,
    sieve: Sieve | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The groups, and the written texts of all ids that were compared."""
    sizes = members.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last")
    shared = stage(members.join(sizes.select("bucket", "leader"), "bucket").distinct(), "buckets")
    texts = stage(texts_of(shared.select("id").distinct()), "texts", compression="zstd")
    pairs = shared.where("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = stage(verify(pairs, texts).select("a", "b"), "links")
    groups = components(links)

    placed = shared.join(groups, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    ends = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    torn = stage(placed.join(ends.select("bucket"), "bucket"), "torn")
    if torn.isEmpty():
        return groups, texts
    more = stage(_across(torn, texts, compare, tile, sieve), "links")
    return components(links.unionByName(more)), texts


def _across(torn: DataFrame, texts: DataFrame, compare: Compare, tile: int, sieve: Sieve | None = None) -> DataFrame:
    """Links (a, b) between the pieces of torn buckets: enough of them to join what links join.

    The members outside a bucket's largest piece meet all members of the bucket, tile by tile. A pair that shares several
    buckets is looked at in the first one, and pairs that a tile's links have already joined are passed over.
    """
    piece = torn.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    main = piece.groupBy("bucket").agg(
        F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("largest")
    )
    counted = main.select(
        "bucket",
        "main",
        F.ceil(F.col("all") / tile).alias("rows"),
        F.ceil((F.col("all") - F.col("largest")) / tile).alias("columns"),
    )
    own = torn.groupBy("id").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))
    zero = F.lit(0).cast("long")
    row, column = F.pmod(F.xxhash64("id"), F.col("rows")), F.pmod(F.xxhash64("id", F.lit(1)), F.col("columns"))
    as_row = F.transform(F.sequence(zero, F.col("columns") - 1), lambda c: F.struct(F.col("row").alias("r"), c.alias("c"), F.lit(False).alias("apart")))
    as_column = F.transform(F.sequence(zero, F.col("rows") - 1), lambda r: F.struct(r.alias("r"), F.col("column").alias("c"), F.lit(True).alias("apart")))
    none = F.slice(as_column, 1, 0)
    spread = (
        torn.join(counted, "bucket")
        .withColumns({"row": row, "column": column})
        .select(
            "bucket",
            "id",
            "component",
            (F.col("component") == F.col("main")).alias("central"),
            F.explode(F.concat(as_row, F.when(F.col("component") != F.col("main"), as_column).otherwise(none))).alias("p"),
        )
        .select("bucket", "id", "component", "central", "p.*")
    )

    columns = ["bucket", "r", "c", "id", "component", "central", "apart", "buckets", "text"]

    def look(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        here = rows[0][0]
        ids, component, central, apart, buckets, found = zip(*(r[3:] for r in rows))
        linked, joined = compare(list(found)), _Joined()
        across = [i for i, a in enumerate(apart) if not a]
        for x in (i for i, a in enumerate(apart) if a):
            own = set(buckets[x])
            for y in across:
                if not central[y] and ids[x] >= ids[y]:
                    continue
                one, other = joined.root(component[x]), joined.root(component[y])
                if one != other and min(own.intersection(buckets[y])) == here and linked(x, y):
                    joined.parent[one] = other
                    yield ids[x], ids[y]

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by tile; one tile is held at a time."""
        rows: list[tuple] = []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and row[:3] != rows[0][:3]:
                    found += look(rows)
                    rows = []
                rows.append(row)
            yield _pairs(found)
        if rows:
            yield _pairs(look(rows))

    def look_through_sieve(part: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        """The same for whole tiles at once: only pairs that the sieve lets through are looked at one by one."""
        bucket, ids, component = (part[c].to_numpy() for c in ("bucket", "id", "component"))
        central, apart = (part[c].to_numpy(zero_copy_only=False) for c in ("central", "apart"))
        tile_of = np.cumsum(_tile_starts(part))
        may_link, linked = sieve(part["text"]), compare(_Lazy(part["text"]))
        every, first = part["buckets"].values.to_numpy(), part["buckets"].offsets.to_numpy()

        def before(x: int) -> list[int]:
            own = every[first[x] : first[x + 1]]
            return own[: own.searchsorted(bucket[x])].tolist()

        xs, ys = np.flatnonzero(apart), np.flatnonzero(~apart)
        start, stop = (np.searchsorted(tile_of[ys], tile_of[xs], side) for side in ("left", "right"))
        ends = np.cumsum(stop - start)
        at, joined = 0, _Joined()
        while at < len(xs):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, "right")))
            n = (stop - start)[at:to]
            i = np.repeat(xs[at:to], n)
            j = ys[np.arange(int(n.sum())) + np.repeat(start[at:to] - (np.cumsum(n) - n), n)]
            open_ = (component[i] != component[j]) & (central[j] | (ids[i] < ids[j]))
            i, j = i[open_], j[open_]
            kept = may_link(i, j)
            for x, y in zip(i[kept].tolist(), j[kept].tolist()):
                tile_ = tile_of[x]
                one, other = joined.root((tile_, component[x])), joined.root((tile_, component[y]))
                if one != other and set(before(x)).isdisjoint(before(y)) and linked(x, y):
                    joined.parent[one] = other
                    yield int(ids[x]), int(ids[y])
            at = to

    def sieved_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.RecordBatch | None = None  # the last tile may go on in the next batch
        for batch in batches:
            if left is not None:
                batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
            if batch.num_rows:
                last = int(np.flatnonzero(_tile_starts(batch))[-1])
                yield _pairs(look_through_sieve(batch.slice(0, last)) if last else ())
                left = batch.slice(last)
        if left is not None:
            yield _pairs(look_through_sieve(left))

    held = spread.join(own, "id").join(texts.select("id", "text"), "id").select(*columns)
    dealt = held.repartition("bucket", "r", "c").sortWithinPartitions("bucket", "r", "c")
    return dealt.mapInArrow(sieved_tiles if sieve else tiles, "a long, b long")


class _Joined:
    """What the links of a tile have joined so far."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def root(self, x):
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x


class _Lazy:
    """A column as a list whose items are read when they are asked for."""

    def __init__(self, column: pa.Array):
        self._column = column

    def __getitem__(self, i: int) -> str:
        return self._column[i].as_py()


def _tile_starts(rows: pa.RecordBatch) -> np.ndarray:
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for name in ("bucket", "r", "c"):
        values = rows[name].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return new


def _pairs(found: Iterable[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if (found := list(found)) else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
