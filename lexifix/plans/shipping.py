"""The package's own code for Python workers, which on a cluster don't see the driver's folders."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ensure_shipped(spark: SparkSession | None) -> None:
    """Add the package to the session's Python files, once for a SparkContext."""
    if spark is None or getattr(spark.sparkContext, "_lexifix_shipped", False) or not PACKAGE.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="lexifix-code-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(PACKAGE.rglob("*.py")):
            z.write(source, source.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(path))
    spark.sparkContext._lexifix_shipped = True
