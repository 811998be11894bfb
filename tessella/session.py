"""What a session needs before it runs the operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """Sends this package to the session's Python workers, once: they need not find it in a path of their own."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix=f"{package.name}-")  # the driver's own: executors fetch the archive from the driver
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        where = Path(folder, "src", package.name)
        shutil.copytree(package, where, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(str(Path(folder, f"{package.name}_package")), "zip", where.parent))
        _shipped.add(context.applicationId)
    return spark
