"""Shared pieces: batches and broadcasts of a bounded size, column names; scratch tables and components of the library."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..sources.scratch import shared_dir
from ..sources.scratch import stage as materialise
from ..sources.tables import exists as path_exists

__all__ = ["connected_components", "materialise", "path_exists", "shared_dir"]

#: Upper bound of anything this subpackage broadcasts by hand.
BROADCAST_BYTES = 64 << 20
#: Bytes after which a batch of rows for Python is closed: a task holds a few batches, in the JVM and in Python.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches to BATCH_BYTES, if it is greater."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices: Python values of a whole batch would take several times its memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(names: list[str], given: tuple[str, ...]) -> list[str]:
    """names, with `_in` behind those that given ones have, until they are free."""
    taken = {c.lower() for c in (*names, *given)}
    out = []
    for name in names:
        new = name
        if name.lower() in given:
            while new.lower() in taken:
                new += "_in"
            taken.add(new.lower())
        out.append(new)
    return out


def checked_broadcast(spark: SparkSession, value, n_bytes: int, what: str):
    if n_bytes > BROADCAST_BYTES:
        raise ValueError(f"{what} has {n_bytes} bytes; at most {BROADCAST_BYTES} are broadcast")
    return spark.sparkContext.broadcast(value)


def if_small(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES // 8) -> DataFrame:
    """df, a materialised table, marked for broadcast if its rows, counted, stay within the bound; else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df
