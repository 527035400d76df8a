"""Sessions and the review log over streams: an extension, the batch operators are the engine's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT, Params


def key_sessions(events: DataFrame, key: str, time: str, late: str = "1 hour", p: Params = DEFAULT) -> DataFrame:
    """key, session_start, session_end, n of gap sessions; rows later than the watermark are left out."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    grouped = rows.groupBy(F.session_window("__t", f"{p.moment_gap_minutes} minutes").alias("w"), F.col(key))
    found = grouped.agg(F.min("__t").alias("session_start"), F.max("__t").alias("session_end"), F.count("*").alias("n"))
    return found.drop("w")


def last_states(events: DataFrame) -> DataFrame:
    """path, status of a stream of review events (seq, path, arg), last write wins; use output mode complete or update."""
    return events.groupBy("path").agg(F.max_by("arg", "seq").alias("status"), F.max("seq").alias("seq"))
