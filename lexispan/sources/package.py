"""Hands the package to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds this package to the Python path of the application's workers, as an archive that the driver's file server serves; once an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="lexispan-")  # the driver's own: executors get it from the driver
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "lexispan.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(os.path.join(root, "lexispan")):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
