"""The package on the executors: Python steps refer to its modules by name."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession | None = None) -> None:
    """Make this package importable on the executors, once for each Spark context."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or getattr(spark.sparkContext, "_slateledger_shipped", False):
        return
    top = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    folder = tempfile.mkdtemp()  # the driver's own: Spark serves the file to executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    to = Path(folder) / f"{top.name}_{uuid.uuid4().hex[:8]}.zip"
    to.write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(str(to))
    spark.sparkContext._slateledger_shipped = True
