"""Sends this package to the executors, for drivers that did not start them with it on their path."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the session's files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="sievework-"), "sievework.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    context.addPyFile(path)
    _sent.add(context.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
