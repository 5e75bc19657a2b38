"""Sends the package to executors that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds this package to the Python path of all workers of a session."""
    root = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "sketchloom.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for at, _, files in os.walk(root):
                for f in sorted(files):
                    if f.endswith(".py"):
                        z.write(os.path.join(at, f), os.path.relpath(os.path.join(at, f), os.path.dirname(root)))
        spark.sparkContext.addPyFile(path)  # Spark copies it at once
