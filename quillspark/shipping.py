"""Gives Python workers this package where they can't import it already."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package's modules to the session's Python files, once."""
    root = os.path.dirname(PACKAGE)
    context = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _SHIPPED:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="quillspark-code-"), "quillspark_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
