"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ensure_importable(spark: SparkSession) -> None:
    """Send the package to executors that cannot see it: they inherit PYTHONPATH, and nothing else of ``sys.path``."""
    package = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _DONE or str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    to = Path(tempfile.mkdtemp(prefix="cartolex-")) / f"{package.name}.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(to))
    _DONE.add(app)
