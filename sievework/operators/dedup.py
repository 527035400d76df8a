"""Near-duplicate clustering of 64-bit hashes: banded Hamming join, components, best of each cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..params import DEFAULT, Params
from ..sources.scratch import stage
from .components import connected_components
from .near import near_pairs

ID_BLOCK = 1 << 33


def global_index(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with its 0-based place in a total order, without a single-task sort: range partitions, then their offsets."""
    parted = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    parted = stage(parted, "ranges").withColumn("__part", F.floor(F.col("__at") / ID_BLOCK))
    sizes = parted.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = parted.join(F.broadcast(offsets), "__part")
    return placed.withColumn(name, F.col("__before") + F.col("__at") - F.col("__part") * ID_BLOCK).drop("__at", "__part", "__before")


def candidates(records: DataFrame) -> DataFrame:
    from ..functions.tiers import is_alive

    return records.where(is_alive(F.col("status")) & F.col("phash").isNotNull())


def representatives(rows: DataFrame, folder: str = "folder") -> DataFrame:
    """One row (the first) of each distinct hash of a folder, so that copies don't pair with each other."""
    return rows.groupBy("hi", "lo", folder).agg(F.min("ord").alias("ord"))


def members(rows: DataFrame, folder: str = "folder") -> DataFrame:
    """ord, first of every row: the representative of its hash and folder (a representative has itself)."""
    first = representatives(rows, folder).select(F.col("hi").alias("h"), F.col("lo").alias("l"), F.col(folder).alias("f"), F.col("ord").alias("first"))
    return rows.join(first, (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")) & F.col(folder).eqNullSafe(F.col("f"))).select("ord", "first")


def band_count(limit: int) -> int:
    """Bands that a hash is cut in: one more than half the distance, so one band has one difference at most."""
    return limit // 2 + 1


def hamming_pairs(rows: DataFrame, same: int, cross: int | None = None, folder: str = "folder") -> DataFrame:
    """a, b, distance of rows (ord, hi, lo, folder): within `same` in one folder, within `cross` across folders (a missing
    folder is like none).

    Each row goes packed to limit + 1 cells, of one band each (near.py); the pairs are made in the task of a cell and never
    shuffled. Equal hashes are compared once; their pairs are all in the result, so give it representatives() where many
    rows have one hash and these are not wanted.
    """
    rows = stage(rows.select(F.col("ord").cast("long"), F.col("hi").cast("long"), F.col("lo").cast("long"), F.col(folder).cast("string").alias("folder")).where("ord IS NOT NULL AND hi IS NOT NULL AND lo IS NOT NULL"), "hashes")
    # the bands that have one with one difference at most, in halves: one half has none
    return near_pairs(rows, same, cross, 2 * band_count(max(same, -1 if cross is None else cross) + 1))


def hamming_links(rows: DataFrame, same: int, cross: int | None = None, folder: str = "folder") -> DataFrame:
    """a, b: links that make the same components as all pairs do; equal hashes of a folder are a star."""
    first = representatives(rows, folder)
    star = rows.join(first.withColumnRenamed("ord", "first"), ["hi", "lo", folder]).where("ord <> first").select(F.col("first").alias("a"), F.col("ord").alias("b"))
    return star.unionByName(hamming_pairs(first, same, cross, folder).select("a", "b"))


def first_of(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """The first row of each group; each task passes on one row for a group, so large groups don't meet in one."""
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("__place = 1").drop("__place")


def clusters(rows: DataFrame, pairs: DataFrame, *best: Column) -> DataFrame:
    """rows with cluster_id (by first member, null for singletons) and is_best by the order `best`, then ord."""
    found = connected_components(pairs)
    roots = global_index(found.select("comp").distinct(), "cluster_id", "comp").select("comp", (F.col("cluster_id") + 1).cast("int").alias("cluster_id"))
    named = found.join(roots, "comp").select(F.col("node").alias("ord"), "cluster_id")
    joined = rows.join(named, "ord", "left")
    chosen = first_of(joined.where("cluster_id IS NOT NULL"), "cluster_id", *best, F.asc("ord")).select("ord", F.lit(True).alias("__best"))
    joined = joined.join(chosen, "ord", "left")
    return joined.withColumn("is_best", F.col("cluster_id").isNull() | F.coalesce("__best", F.lit(False))).drop("__best")


def cluster_duplicates(records: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Filter-phase records with cluster_id, is_cluster_best and rejected_duplicate set; folders never mix.

    records: ord and the filter schema. Best: tier pass before soft blur, then the sharpest, then input order.
    """
    from ..functions import paths

    high, low = vectors.hex_halves(F.col("phash"))
    rows = candidates(records).select("ord", high.alias("hi"), low.alias("lo"), paths.folder(F.col("path")).alias("folder"), "blur_tier", "blur_score")
    found = clusters(rows, hamming_links(rows, p.hash_same), F.when(F.col("blur_tier") == "pass", 0).otherwise(1), F.desc("blur_score")).select("ord", F.col("cluster_id").alias("__cluster"), "is_best")
    out = records.join(found, "ord", "left")
    best = F.coalesce("is_best", F.lit(True))
    return out.withColumns({"cluster_id": F.col("__cluster"), "is_cluster_best": best, "status": F.when(best, F.col("status")).otherwise("rejected_duplicate")}).drop("__cluster", "is_best")


def keep_largest(files: DataFrame, group: str) -> DataFrame:
    """files with keep: the one of most pixels, then bytes, then input order, of each group (null group: every one)."""
    best = first_of(files.where(F.col(group).isNotNull()), group, F.desc("pixels"), F.desc("file_size"), F.asc("ord")).select("ord", F.lit(True).alias("__best"))
    return files.join(best, "ord", "left").withColumn("keep", F.col(group).isNull() | F.coalesce("__best", F.lit(False))).drop("__best")


def scan_report(files: DataFrame, hashes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """files (ord and the scan schema) with cluster_id and keep, from hashes (ord, phash): raw files always stay.

    Hashes within `hash_same` in one folder or `hash_cross` across folders are duplicates; the largest stays.
    """
    from ..functions import tiers

    high, low = vectors.hex_halves(F.col("phash"))
    rows = files.where(~tiers.is_raw(F.col("path"))).join(hashes.where("phash IS NOT NULL"), "ord").select("ord", high.alias("hi"), low.alias("lo"), F.col("folder_rel").alias("folder"))
    found = clusters(rows, hamming_links(rows, p.hash_same, p.hash_cross)).select("ord", "cluster_id")
    return keep_largest(files.join(found, "ord", "left"), "cluster_id")
