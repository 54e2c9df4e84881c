"""Sending the package to the executors, for sessions whose workers would not find it."""

from __future__ import annotations

import functools
import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds this package to the session's Python files, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_siteloom_shipped", False):
        return
    package = pathlib.Path(__file__).parent.parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="siteloom-")) / "siteloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))  # the driver serves it to every executor, also to those that join later
    sc._siteloom_shipped = True


def shipped(query):
    """A query that ships the package before it runs."""

    @functools.wraps(query)
    def run(spark, folder):
        ship(spark)
        return query(spark, folder)

    return run
