"""This package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, so that tasks can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    zipped = os.path.join(tempfile.mkdtemp(prefix="lodestack-code-"), "lodestack.zip")
    with zipfile.ZipFile(zipped, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join(os.path.basename(top), os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(zipped)
    _shipped.add(app)
