"""Sending this package to Python workers on other machines."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let all Python workers of the session import this package, wherever it lies for the driver.

    The package is zipped once per application; Spark serves the archive from the driver."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    folder = tempfile.mkdtemp(prefix="pathloom-package-")
    archive = os.path.join(folder, "pathloom.zip")
    Path(archive).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(archive)  # copied by the driver, which serves it
    _sent.add(app)
