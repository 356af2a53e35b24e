"""Send the package to workers that do not have it."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import tripsearch

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application once; workers import it from there."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = os.path.dirname(os.path.abspath(tripsearch.__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(root)))
    # Spark serves the file from the driver; it is not data and no task writes to this folder
    path = os.path.join(tempfile.mkdtemp(prefix="tripsearch-ship-"), "tripsearch_package.zip")
    with open(path, "wb") as out:
        out.write(packed.getvalue())
    context.addPyFile(path)
    _SENT.add(context.applicationId)
