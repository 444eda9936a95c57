"""The package on the executors: shipped with the session where they cannot import it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ensure(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once, unless its folder is on the workers' path already."""
    here = str(ROOT.parent)
    paths = [os.path.realpath(p) for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p]
    app = spark.sparkContext.applicationId
    if here in paths or app in _shipped:
        return
    _shipped.add(app)
    name = f"{tempfile.mkdtemp()}/{ROOT.name}.zip"
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(name)
