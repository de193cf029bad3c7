"""What a Spark session needs before it runs queries of this library."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Gives the library to the executors' Python workers, once per application, as any
    Spark job ships its code."""
    context = spark.sparkContext
    if getattr(context, "_plumbline_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "plumbline.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, Path(package.name) / p.relative_to(package))
    context.addPyFile(str(archive))
    context._plumbline_shipped = True
