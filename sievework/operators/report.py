"""Summaries: conditional counts, distributions, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..params import DEFAULT
from ..sources.scratch import stage

#: Buckets of one step towards a median, and distinct values that are sorted in one place.
BUCKETS, MIDDLE_ROWS = 4096, 50_000


def counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def conditional_counts(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    return rows.agg(*[F.count_if(t).alias(name) for name, t in tests.items()])


def statistics(rows: DataFrame, score: str) -> DataFrame:
    """n, low, high, mean, middle of a score; 0 without rows.

    The exact median from counts of distinct values in range partitions: no task holds more than its range.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    c = F.col(score)
    plain = rows.agg(F.count(c).alias("n"), zero(F.min(c)).alias("low"), zero(F.max(c)).alias("high"), zero(F.avg(c)).alias("mean"))
    return plain.crossJoin(F.broadcast(middle(rows, score)))  # one row each


def middle(rows: DataFrame, score: str) -> DataFrame:
    """middle: the median of a score, 0 without rows; one row."""
    # a bucket's rows are counted first, then the buckets that hold the two middle ones are looked into
    c = F.col(score).cast("double")
    values = stage(rows.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count("*").alias("k")), "values")
    ends = values.agg(F.min("v").alias("a"), F.max("v").alias("z"), F.sum("k").alias("n")).first()
    if not ends.n:
        return rows.sparkSession.createDataFrame([(0.0,)], "middle double")
    low, high, below = ends.a, ends.z, 0
    want = [(ends.n - 1) // 2, ends.n // 2]
    found = []
    for at in want:
        a, z, before = low, high, below
        while True:
            width = (z - a) / BUCKETS
            inside = values.where(F.col("v").between(a, z))
            if width <= 0 or inside.count() <= MIDDLE_ROWS:
                for row in inside.orderBy("v").collect():
                    before += row.k
                    if before > at:
                        found.append(row.v)
                        break
                break
            bucket = F.least(F.floor((F.col("v") - a) / width), F.lit(BUCKETS - 1)).alias("bucket")
            for row in inside.groupBy(bucket).agg(F.sum("k").alias("k"), F.min("v").alias("a"), F.max("v").alias("z")).orderBy("bucket").collect():
                if before + row.k > at:
                    a, z = row.a, row.z
                    break
                before += row.k
    return rows.sparkSession.createDataFrame([(sum(found) / 2,)], "middle double")


def shares(rows: DataFrame, by: str, limit: float = DEFAULT.diversity_percent) -> DataFrame:
    """by, n, percent of all rows, and whether that is over the limit."""
    counted = rows.groupBy(by).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row for each value
    return counted.withColumn("percent", F.col("n") * 100.0 / total).withColumn("dominant", F.col("percent") > limit)


def moment_summary(rows: DataFrame) -> DataFrame:
    """n_timed, n_moments and the whole rows per moment."""
    timed = F.count("capture_time")
    n = F.count_distinct("moment_id")
    return rows.agg(timed.alias("n_timed"), n.alias("n_moments"), F.floor(timed / F.greatest(n, F.lit(1))).alias("per_moment"))


def face_summary(rows: DataFrame, smile: float = DEFAULT.smile) -> DataFrame:
    faces = F.col("faces_detected")
    return rows.agg(
        F.coalesce(F.avg(F.when(faces > 0, faces)), F.lit(0.0)).alias("mean_faces"),
        F.count_if(F.col("max_smile_score") > smile).alias("n_smiling"),
        F.count_if(F.col("has_closed_eyes")).alias("n_closed_eyes"),
        F.count_if(faces.isNull()).alias("n_errors"),
    )


def tag_counts(rows: DataFrame, tags: str, names: list[str]) -> DataFrame:
    return rows.agg(*[F.count_if(F.array_contains(tags, n)).alias(f"n_{n}") for n in names])


def method_counts(rows: DataFrame) -> DataFrame:
    s = F.col("score_components")
    flags = {f"n_{f}": s[f] for f in ("candid_bonus", "closed_eyes_penalty", "soft_blur_penalty", "distraction_penalty")}
    return conditional_counts(rows, {"n_laion": F.col("laion_method") == "laion", "n_fallback": F.col("llava_fallback"), **flags})


def top(rows: DataFrame, score: str, tie: str, k: int = 10) -> DataFrame:
    return rows.orderBy(F.desc(score), tie).limit(k)


def scan_estimate(files: DataFrame, seconds_each: float = 0.87) -> DataFrame:
    """total, skipped, unique and the hours that the unique files take."""
    unique = F.count_if("keep")
    return files.agg(F.count("*").alias("total"), (F.count("*") - unique).alias("skipped"), unique.alias("unique"), F.round(unique * seconds_each / 3600, 1).alias("hours"))


def groups(files: DataFrame) -> DataFrame:
    """cluster_id, entries (path, folder, res, size_mb, decision) of each group of duplicates, in input order."""
    entry = F.struct("ord", "path", F.col("folder_rel").alias("folder"), paths.resolution(F.col("width"), F.col("height")).alias("res"), paths.megabytes(F.col("file_size")).alias("size_mb"), F.when(F.col("keep"), "keep").otherwise("skip").alias("decision"))
    listed = files.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return listed.withColumn("entries", F.transform("entries", lambda e: e.dropFields("ord")))


def scan_text(files: DataFrame, folder: str, most: int = 20) -> str:
    """The report to read: totals, folders by size, the first groups of duplicates. Folders and groups are listed, not files."""
    totals = scan_estimate(files).first()
    line = "-" * 48
    out = [line, f" SCAN REPORT -- {folder}", line, f" Total files found          : {totals.total:>8,}", f" Hash duplicates found      : {totals.skipped:>8,}", f" Unique after dedup         : {totals.unique:>8,}", line, " FOLDER BREAKDOWN", line]
    for row in counts(files, "folder_rel").toLocalIterator():
        out.append(f"  /{row.folder_rel:<38}: {row.n:>6,}")
    for i, group in enumerate(groups(files).orderBy("cluster_id").limit(most).collect()):
        out += [line, f" DUPLICATE DETAIL (hash dupes, top {most})", line] if not i else []
        out.append(f" Near-duplicate cluster ({len(group.entries)} photos):")
        out += [f"   {e.decision.upper()}   {e.folder:<32} {e.res}  ({e.size_mb}MB)" for e in group.entries]
    return "\n".join([*out, line, f" ESTIMATED UNIQUE PHOTOS AFTER DEDUP : {totals.unique:>8,}", f" ESTIMATED PHASE 1 RUNTIME           : ~{totals.hours:.1f} hours", line])


def write_scan(files: DataFrame, folder: str, path: str) -> dict[str, str]:
    """Writes the report below path and returns the folders: lines of skip and keep, sorted, folder counts and groups, each a
    JSON table written by all tasks, and `summary`, one object with the rest. No list of files is ever in one place."""
    for name, keep in (("skip", False), ("keep", True)):
        files.where(F.col("keep") == keep).select("path").sort("path").write.mode("overwrite").json(f"{path}/{name}")
    files.groupBy("folder_rel").agg(F.count("*").alias("n_files")).write.mode("overwrite").json(f"{path}/folder_counts")
    groups(files).drop("cluster_id").write.mode("overwrite").json(f"{path}/hash_dup_groups")
    head = files.agg(F.lit(1).alias("version"), F.lit(folder).alias("scan_folder"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("generated"), F.count("*").alias("total_files"))
    head.write.mode("overwrite").json(f"{path}/summary")
    files.sparkSession.createDataFrame([(scan_text(files, folder),)], "value string").write.mode("overwrite").text(f"{path}/text")
    return {name: f"{path}/{name}" for name in ("summary", "skip", "keep", "folder_counts", "hash_dup_groups", "text")}
