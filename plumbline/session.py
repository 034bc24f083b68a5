"""Makes this package importable for Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ensure_importable(spark: SparkSession) -> None:
    """Ships the package to the executors, unless they find it on the path they share with the driver."""
    root = Path(__file__).resolve().parent.parent
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or any(p and Path(p).resolve() == root for p in known):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='plumbline-')}/plumbline", "zip", root, "plumbline")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
