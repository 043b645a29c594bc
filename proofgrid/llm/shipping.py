"""Makes this package importable on executors that were started elsewhere."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import proofgrid

ROOT = Path(proofgrid.__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors once per application, unless their path has it already."""
    path = [Path(p or ".").resolve() for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    app = spark.sparkContext.applicationId
    if ROOT in path or app in _shipped or not ROOT.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="proofgrid-")) / "proofgrid-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((ROOT / "proofgrid").rglob("*.py")):
            out.write(file, file.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
