"""Make this package importable by Python workers that have no copy of it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="corvane-")) / "corvane_sources.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((top / "corvane").rglob("*.py")):
            z.write(p, p.relative_to(top))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
