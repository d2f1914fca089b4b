"""What a session needs before its Python workers can run this package."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application; the driver serves the file."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = Path(__file__).resolve().parent
    made, path = tempfile.mkstemp(suffix=".zip", prefix=f"{home.name}-")
    os.close(made)
    atexit.register(Path(path).unlink, missing_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, f"{home.name}/{p.relative_to(home)}")
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
