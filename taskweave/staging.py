"""Tables written once to the cluster's shared folder.

Three things need a table that later stages re-read instead of recomputing:
model answers (a recomputed call may answer differently, and costs money),
positions (both passes must see the same row order), and the state of a loop.
A Parquet table survives the loss of executors, is pruned by column when read
back, and cuts the lineage of loops. Staged tables stay until the ``staging_scope`` around them
ends; a long session opens one around each job whose result it writes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_scopes: list[list[str]] = []
_local_folders: dict[str, str] = {}  # of local sessions without the setting


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was staged inside; results must be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, as the cluster names it."""
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="taskweave-")
    return _local_folders[app]


def stage(df: DataFrame, label: str, by: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` once and return the written table; ``options`` are those of the Parquet writer.

    With ``by``, a folder for each value of that column, so that a reader of one value opens only its files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/taskweave/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    writer = df.write.options(**options)
    (writer.partitionBy(by) if by else writer).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return table.select(*[f"`{c}`" for c in df.columns]) if by else table


class Grown:
    """A table that a loop adds to, part by part; it reads as one scan, however many parts there are."""

    def __init__(self, spark: SparkSession, label: str, schema: str):
        self._spark, self._schema, self._parts = spark, schema, 0
        self._path = f"{shared_folder(spark)}/taskweave/{label}-{uuid.uuid4().hex}"
        if _scopes:
            _scopes[-1].append(self._path)

    def add(self, df: DataFrame, part: int) -> None:
        """Write a part; one that a broken run left behind is written over."""
        df.write.mode("overwrite").parquet(f"{self._path}/part={part}")
        self._parts += 1

    def read(self) -> DataFrame:
        """All parts, with their number as ``part``."""
        schema = f"{self._schema}, part int"
        return self._spark.read.schema(schema).parquet(self._path) if self._parts else self._spark.createDataFrame([], schema)

    def part(self, part: int) -> DataFrame:
        return self.read().where(f"part = {part}").drop("part")
