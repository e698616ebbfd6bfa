"""Sending the library to the executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add this package to the Python path of the session's executors, once an application."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        folder = Path(tempfile.mkdtemp(prefix="spark-joblode-code-"))
        top = Path(__file__).parent
        shutil.copytree(top, folder / "code" / top.name, ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(str(folder / top.name), "zip", folder / "code"))
        _sent.add(sc.applicationId)
