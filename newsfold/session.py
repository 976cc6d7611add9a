"""What a session needs before queries run."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a Spark context, so that Python functions import it
    wherever the driver was started. (``spark-submit --py-files`` does the same.)"""
    sc = spark.sparkContext
    if getattr(sc, "_newsfold_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="newsfold-")
    shutil.copytree(root, os.path.join(folder, "code", root.name), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(folder, root.name), "zip", os.path.join(folder, "code")))
    sc._newsfold_shipped = True
