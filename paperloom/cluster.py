"""Make the package importable in Python workers."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once per Spark context.

    Functions that run in Python workers refer to this package by name, and
    executors need not have it installed.
    """
    sc = spark.sparkContext
    if getattr(sc, "_paperloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, str(p.relative_to(root.parent)))
    path = Path(tempfile.mkdtemp(prefix="paperloom-")) / "paperloom.zip"
    path.write_bytes(buf.getvalue())
    sc.addPyFile(str(path))
    sc._paperloom_shipped = True
