"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to all executors, once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="ship-")  # executors fetch from it as they start
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = f"{folder}/{here.name}.zip"
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as bundle:
        for file in sorted(here.rglob("*.py")):
            bundle.write(file, file.relative_to(here.parent))
    context.addPyFile(name)
    _shipped.add(context.applicationId)
