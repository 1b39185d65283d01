"""Send this package to the executors, whose Python may not have it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the session's Python files once; returns the session.

    Batches for Python are held to 4 MB unless the session says otherwise: rows
    may be long texts, and the default counts rows only.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "4m")
    context = spark.sparkContext
    if getattr(context, "_tideline_shipped", False):
        return spark
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="tideline-")) / "tideline.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    context._tideline_shipped = True
    return spark
