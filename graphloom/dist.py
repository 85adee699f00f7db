"""Makes this package importable in the Python workers of a session, whatever their working folder is."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources with the application, once; Spark's own file server hands them to executors."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    folder = tempfile.mkdtemp(prefix="graphloom-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "graphloom_sources.zip")
    with open(path, "wb") as f:
        f.write(packed.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
