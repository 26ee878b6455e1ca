"""Making the package importable in Python workers, wherever the session's executors run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    home = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="docloom-"), "docloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(home.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, f"{home.name}/{p.relative_to(home)}")
    sc.addPyFile(path)
    _sent.add(sc.applicationId)
