"""Gap sessions: moments over all rows or by key, folder fallback, bursts by time and by sequence number."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..params import DEFAULT, Params
from .dedup import global_index


def minutes(n: int) -> Column:
    return F.make_dt_interval(mins=F.lit(n))


def sessions_by_key(rows: DataFrame, key: str, time: str, gap: Column, tie: str) -> DataFrame:
    """rows with session (from 1, by key), session_start, session_end: a new one iff the gap is exceeded."""
    order = Window.partitionBy(key).orderBy(time, tie)
    fresh = F.when(F.col(time) - F.lag(time).over(order) <= gap, 0).otherwise(1)
    numbered = rows.withColumn("session", F.sum(fresh).over(order).cast("int"))
    whole = Window.partitionBy(key, "session")
    return numbered.withColumns({"session_start": F.min(time).over(whole), "session_end": F.max(time).over(whole)})


def moments(rows: DataFrame, time: str, tie: str, p: Params = DEFAULT, bucket: str = "hour") -> DataFrame:
    """rows with a time: moment_id from 1 in time order, moment_label, moment_start, moment_end.

    Sessions of all rows in one order, without one task that sorts them all: rows are numbered within time buckets,
    and a table with one row for each bucket (bounded by the time that the rows span) carries the count of sessions
    and the last time over to the next bucket. The gap must not exceed a bucket's length many times for this to pay.
    """
    gap = minutes(p.moment_gap_minutes)
    timed = rows.where(F.col(time).isNotNull()).withColumn("__bucket", F.date_trunc(bucket, F.col(time).cast("timestamp")))
    inside = Window.partitionBy("__bucket").orderBy(time, tie)
    breaks = F.when(F.col(time) - F.lag(time).over(inside) > gap, 1).otherwise(0)
    local = timed.withColumn("__local", F.sum(breaks).over(inside))
    # one row for each bucket and local session; the first of a bucket may go on with the last one before
    pieces = local.groupBy("__bucket", "__local").agg(F.min(time).alias("__from"), F.max(time).alias("__to"))
    whole = Window.orderBy("__from")
    fresh = F.when(F.col("__from") - F.lag("__to").over(whole) <= gap, 0).otherwise(1)
    numbered = pieces.withColumn("moment_id", F.sum(fresh).over(whole).cast("int"))
    each = Window.partitionBy("moment_id")
    spans = numbered.select("__bucket", "__local", "moment_id", F.min("__from").over(each).alias("moment_start"), F.max("__to").over(each).alias("moment_end"))
    out = local.join(spans, ["__bucket", "__local"]).drop("__bucket", "__local")
    return out.withColumn("moment_label", paths.moment_label(F.col("moment_id")))


def fallback_moments(rows: DataFrame, path: str, tie: str, p: Params = DEFAULT) -> DataFrame:
    """rows with moment_label from the parent folder and moment_id from 10001 on in the order labels first appear."""
    labelled = rows.withColumn("moment_label", paths.folder_label(F.col(path), p.unknown))
    labels = labelled.groupBy("moment_label").agg(F.min(tie).alias("__first"))
    ids = global_index(labels, "__n", "__first").select("moment_label", (F.col("__n") + 1 + p.fallback_base).cast("int").alias("moment_id"))
    return labelled.join(ids, "moment_label")


def with_moments(records: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Records (ord, path, status, capture_time) with their moment columns: by time, or by folder where there is none.

    Rows that are not alive are `unknown` without an id, and so are those without a time if the fallback is off.
    """
    from ..functions.tiers import is_alive

    names = ["ord", "moment_id", "moment_label", "moment_start", "moment_end"]
    alive = records.where(is_alive(F.col("status")))
    found = moments(alive.select("ord", "capture_time"), "capture_time", "ord", p).select(*names)
    if p.folder_fallback:
        never = F.lit(None).cast("timestamp_ntz")
        rest = fallback_moments(alive.where("capture_time IS NULL").select("ord", "path"), "path", "ord", p)
        found = found.unionByName(rest.withColumns({"moment_start": never, "moment_end": never}).select(*names))
    others = records.drop(*names[1:])
    return others.join(found, "ord", "left").withColumn("moment_label", F.coalesce("moment_label", F.lit(p.unknown)))


def burst_groups(rows: DataFrame, p: Params = DEFAULT, moment: str = "moment_id", time: str = "capture_time", path: str = "path", tie: str = "ord") -> DataFrame:
    """rows of a moment with burst (its number in the moment, from 1), burst_pos and burst_size.

    A moment with any time is split where two neighbours in time are over the gap apart, times that are missing come
    last and never split; one without is split by the numbers in the file names.
    """
    rows = rows.where(F.col(moment).isNotNull())
    timed = F.max(F.col(time).isNotNull()).over(Window.partitionBy(moment))
    rows = rows.withColumn("__timed", timed).withColumn("__seq", F.when(~F.col("__timed"), paths.sequence_number(F.col(path))))
    order = Window.partitionBy(moment).orderBy(F.asc_nulls_last(F.col(time)), "__seq", tie)
    late = F.coalesce(F.col(time) - F.lag(time).over(order) > minutes(p.burst_gap_minutes), F.lit(False))
    last = F.lag("__seq").over(order)
    apart = last.isNotNull() & ((F.col("__seq") < 0) | (last < 0) | (F.col("__seq") - last > p.burst_sequence_gap))
    split = F.when(F.when(F.col("__timed"), late).otherwise(apart), 1).otherwise(0)
    out = rows.withColumn("burst", (F.sum(split).over(order) + 1).cast("int"))
    inside = Window.partitionBy(moment, "burst")
    first = inside.orderBy(F.asc_nulls_last(F.col(time)), "__seq", tie)
    return out.withColumn("burst_pos", F.row_number().over(first)).withColumn("burst_size", F.count("*").over(inside)).drop("__timed", "__seq")


def timed_bursts(rows: DataFrame, time: str, tie: str, p: Params = DEFAULT) -> DataFrame:
    """rows with a time: moment_id, and burst, burst_pos and burst_size as burst_groups() gives them in moments.

    A gap over the moments' is over the bursts' too, so bursts are sessions of all rows by their own gap, numbered from
    the moment's first on: no task sorts a whole moment, only a burst.
    """
    columns = ["moment_id", "moment_label", "moment_start", "moment_end"]
    short = moments(rows, time, tie, replace(p, moment_gap_minutes=p.burst_gap_minutes)).withColumn("__burst", F.col("moment_id")).drop(*columns)
    numbered = moments(short, time, tie, p)
    first = numbered.groupBy("moment_id").agg(F.min("__burst").alias("__first"))
    inside = Window.partitionBy("__burst")
    out = numbered.join(first, "moment_id").withColumn("burst", (F.col("__burst") - F.col("__first") + 1).cast("int"))
    return out.withColumns({"burst_pos": F.row_number().over(inside.orderBy(time, tie)), "burst_size": F.count("*").over(inside)}).drop("__burst", "__first")


def burst_keepers(rows: DataFrame, group: list[str], kind: str = "primary_shot_type", score: str = "blur_score", second: str = "max_smile_score", pos: str = "burst_pos", p: Params = DEFAULT) -> DataFrame:
    """rows with keep_order, kept and burst_pos_rank (kept ones from 1 by place, the others from burst_keep + 1).

    With rn the place by score, p the least rn of a kind other than rn 1's and n the group's size: rn 1 keeps its place,
    the rows from p on follow it, and those passed over come last.
    """
    by = Window.partitionBy(*group)
    best = by.orderBy(F.desc(F.coalesce(score, F.lit(0.0))), F.desc(F.coalesce(second, F.lit(0.0))), pos)
    rows = rows.withColumn("__rn", F.row_number().over(best))
    top = F.first(kind).over(by.orderBy("__rn"))
    rows = rows.withColumn("__other", F.when(~F.col(kind).eqNullSafe(top), F.col("__rn")))
    rows = rows.withColumns({"__p": F.min("__other").over(by), "__n": F.count("*").over(by)})
    rn, other = F.col("__rn"), F.col("__p")
    place = F.when(other.isNull() | (rn == 1), rn).when(rn >= other, rn - other + 2).otherwise((F.col("__n") - other + 2) + (rn - 1))
    rows = rows.withColumn("keep_order", place.cast("int")).withColumn("kept", F.col("keep_order") <= p.burst_keep)
    rank = F.row_number().over(Window.partitionBy(*group, "kept").orderBy(pos)) + F.when(F.col("kept"), 0).otherwise(p.burst_keep)
    return rows.withColumn("burst_pos_rank", rank.cast("int")).drop("__rn", "__other", "__p", "__n")


def apply_bursts(records: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Records with burst_group_id (from 1 by first row; singletons have none), burst_pos_rank and rejected_burst."""
    from ..functions.tiers import is_alive
    rows = burst_groups(records.where(is_alive(F.col("status"))), p).where("burst_size > 1")
    firsts = rows.groupBy("moment_id").agg(F.min("ord").alias("first"))
    ids = rows.select("moment_id", "burst").distinct().join(firsts, "moment_id")
    ids = global_index(ids, "number", "first", "burst").select("moment_id", "burst", (F.col("number") + 1).cast("int").alias("__group"))
    kept = burst_keepers(rows, ["moment_id", "burst"], p=p).join(ids, ["moment_id", "burst"]).select("ord", "__group", F.col("burst_pos_rank").alias("__rank"), F.col("kept").alias("__kept"))
    out = records.join(kept, "ord", "left")
    status = F.when(~F.col("__kept"), "rejected_burst").otherwise(F.col("status"))
    return out.withColumns({"burst_group_id": F.col("__group"), "burst_pos_rank": F.col("__rank"), "status": status}).drop("__group", "__rank", "__kept")
