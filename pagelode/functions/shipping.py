"""Ships this package to the executors, which share no folder with the driver."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession | None = None) -> None:
    """Adds the package as a zip to the (active) session's Python files, once for each SparkContext."""
    context = (spark or SparkSession.active()).sparkContext
    if getattr(context, "_pagelode_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="pagelode-zip-"), "pagelode.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    context._pagelode_shipped = True
