"""Making this package known to the Python workers of a session, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once per application; workers then need no path to it."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        to = os.path.join(tempfile.mkdtemp(prefix="skein-code-"), "skein.zip")
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in sorted(os.walk(root)):
                for name in sorted(files):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, os.path.dirname(root)))
        context.addPyFile(to)  # served by the driver
        _SHIPPED.add(context.applicationId)
    return spark
