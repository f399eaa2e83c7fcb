"""List positions, order statistics and per-group heads without a global window.

Spark rows have no order. Where a result depends on "row number i", the order
is a key, and the position is worked out from range partitions:
sort by range, number the rows inside each partition, add the sizes of the
partitions before it. No task ever holds more than its own range, and only one
number per partition reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskweave.functions.text import let
from taskweave.staging import stage

_SMALL = 5_000  # keys that one task may put in order
_CUTS = 64  # keys that cut a range in a pass
_ROW_BITS = (1 << 33) - 1  # low bits of monotonically_increasing_id: row inside the partition
_BUNDLES = 64  # a bundle merges the heads of one in so many partitions, and one task the heads of so many bundles


def with_position(
    df: DataFrame, keys: Sequence[str], name: str = "pos", group: Sequence[str] = ()
) -> DataFrame:
    """Add the 0-based position of each row in the order of ``keys``.

    ``keys`` must be unique together (within a ``group``), else the order among equal
    keys is arbitrary. With ``group``, positions restart in every group; a group
    may span any number of range partitions, so a huge group is no special case.
    """
    order = [*group, *keys]
    numbered = stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))),
        "positions",
    )
    sizes = sorted((r["_part"], r["n"]) for r in numbered.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts = [0, *accumulate(n for _, n in sizes)][: len(sizes)]
    # a local relation of one row per partition: its size is known to the optimizer, so it is sent, not shuffled
    offsets = df.sparkSession.createDataFrame(
        pa.table({"_part": pa.array([p for p, _ in sizes], pa.int32()), "_start": pa.array(starts, pa.int64())})
    )
    out = numbered.join(offsets, "_part").withColumn(name, F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")
    if group:
        first = out.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.min(name).alias("_first"))
        same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group])  # rows without a group are one group
        out = out.join(first, same).withColumn(name, F.col(name) - F.col("_first"))
    return out.select(*df.columns, name)


def keys_at(df: DataFrame, keys: Sequence[str], ranks: Sequence[int]) -> dict[int, tuple]:
    """The key values found at the given positions: a handful of rows, without sorting the keys.

    Some keys drawn by hash cut the range that a rank lies in; counting the keys between them says in which piece it lies; the
    same is repeated inside that piece until it is small, and only then put in order. All ranks go through a pass
    together, and a pass is a scan of the key columns with one count per piece. Passes grow with the logarithm of the rows.
    """
    rows = df.select(F.struct(*keys).alias("k"))
    kind = rows.schema["k"].dataType
    literal = lambda key: F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, kind.fields)])
    n = rows.count()
    pending = sorted({r for r in ranks if 0 <= r < n})
    pieces = [(None, None, 0, n)] if pending else []  # keys above the first and below the second; rows before, rows inside
    found: dict[int, tuple] = {}
    while pieces:
        for low, high, before, size in pieces:
            if size <= _SMALL:
                wanted = [r for r in pending if before <= r < before + size]
                inside = rows.where(_between(F.col("k"), low, high, literal))
                ordered = inside.orderBy("k").limit(wanted[-1] - before + 1).collect()
                found.update({r: tuple(ordered[r - before]["k"]) for r in wanted})
        pieces = [p for p in pieces if p[3] > _SMALL]
        pending = [r for r in pending if r not in found]
        if not pieces:
            break
        large = reduce(or_, [_between(F.col("k"), low, high, literal) for low, high, *_ in pieces])
        drawn = rows.where(large).orderBy(F.xxhash64("k")).limit(_CUTS * len(pieces)).collect()  # each task passes on that many
        # old borders stay, so a piece never grows again; a drawn key lies inside one, so that one shrinks
        cuts = sorted({tuple(r["k"]) for r in drawn} | {b for p in pieces for b in p[:2] if b is not None}, key=_in_order)
        marks = F.array(*[literal(c) for c in cuts])
        # an even number is a piece between two cuts, an odd one is a cut itself
        piece = let(F.col("k"), lambda k: 2 * F.size(F.filter(marks, lambda m: m < k)) + F.exists(marks, lambda m: m == k).cast("int"))
        counted = {r["p"]: r["n"] for r in rows.select(piece.alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}
        pieces, before = [], 0
        for p in range(2 * len(cuts) + 1):
            size = counted.get(p, 0)
            here = [r for r in pending if before <= r < before + size]
            if here and p % 2:
                found.update({r: cuts[p // 2] for r in here})
            elif here:
                pieces.append((cuts[p // 2 - 1] if p else None, cuts[p // 2] if p // 2 < len(cuts) else None, before, size))
            before += size
        pending = [r for r in pending if r not in found]
    return found


def _in_order(key: tuple) -> tuple:
    """Python's order of key values as Spark has it: NULL first, NaN last."""
    return tuple((v is not None, v != v, None if v is None or v != v else v) for v in key)


def _between(key: Column, low: tuple | None, high: tuple | None, literal) -> Column:
    above = F.lit(True) if low is None else key > literal(low)
    return above if high is None else above & (key < literal(high))


def before_key(keys: Sequence[str], bound: tuple) -> Column:
    """``keys < bound`` in tuple order; a plain comparison for one key, so Parquet can skip by it."""
    if len(keys) == 1:
        return F.col(keys[0]) < F.lit(bound[0])
    test = F.lit(False)
    for key, value in reversed(list(zip(keys, bound))):
        test = (F.col(key) < F.lit(value)) | ((F.col(key) == F.lit(value)) & test)
    return test


def head_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str | None = None,
) -> DataFrame:
    """First ``n`` rows of each group in a total order.

    Every input partition cuts its own rows to ``n`` per group before the shuffle (WindowGroupLimit). The heads of every
    64th partition are merged in a bundle, then the bundles, so the last task of a group gets 64 heads of it, however
    many partitions there are.
    """
    column = rank or "_rank"
    bundle = F.spark_partition_id() % F.lit(_BUNDLES)
    local = Window.partitionBy(*group, "_bundle").orderBy(*order)
    df = df.withColumn("_bundle", bundle).withColumn("_local", F.row_number().over(local)).where(F.col("_local") <= n)
    df = df.drop("_local", "_bundle")
    if not group and rank is None:
        return df.orderBy(*order).limit(n)
    window = Window.partitionBy(*group).orderBy(*order)
    out = df.withColumn(column, F.row_number().over(window)).where(F.col(column) <= n)
    return out if rank else out.drop(column)


def batch_number(pos: Column | str, size: int) -> Column:
    """Consecutive chunks of ``size`` rows."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    return F.floor((F.col(pos) if isinstance(pos, str) else pos) / F.lit(size)).cast("bigint")
