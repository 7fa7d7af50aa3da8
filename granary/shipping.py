"""The package as the executors get it: workers that run its functions need no copy of their own."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that they need no copy of their own."""
    context = spark.sparkContext
    if getattr(context, "_granary_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="granary-")) / "granary.zip"
    with zipfile.ZipFile(archive, "w") as held:
        for path in sorted(root.rglob("*.py")):
            held.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._granary_shipped = True
