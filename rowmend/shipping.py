"""Makes the package importable in the Python workers of the executors."""

from __future__ import annotations

import shutil
import tempfile
import threading
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_one_at_a_time = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once per application."""
    context = spark.sparkContext
    with _one_at_a_time:
        if context.applicationId in _shipped:
            return
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(
            str(Path(tempfile.mkdtemp(prefix="rowmend-zip-")) / root.name), "zip", root.parent, root.name
        )
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
