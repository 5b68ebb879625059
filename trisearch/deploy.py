"""Gives the executors this package."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process of one machine."""
    return re.match(r"local(\[|$)", spark.sparkContext.master) is not None


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to the executors' Python workers, once for an application."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    _sent.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="trisearch-")) / "trisearch.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(target))
