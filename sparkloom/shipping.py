"""Gets this package to the executors, whose Python workers import it by name."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_HERE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_sparkloom_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="ship-")) / "sparkloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(_HERE.rglob("*.py")):
            out.write(path, Path(_HERE.name) / path.relative_to(_HERE))
    sc.addPyFile(str(target))
    sc._sparkloom_shipped = True
