"""Sending this package to the executors, so that they need not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    top = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="veritide-ship-")) / f"{top.name}.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(to))
    _done.add(sc.applicationId)
