"""Make the package importable in the Python workers of a session that did not get it with --py-files."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        target = os.path.join(tempfile.mkdtemp(prefix="taskweave-ship-"), "taskweave.zip")
        with zipfile.ZipFile(target, "w") as archive:
            for folder, _, files in os.walk(_PACKAGE):
                for name in files:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        archive.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE)))
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)
    return spark
