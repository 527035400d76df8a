"""File scans, metadata, decoded images and prior hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images, paths, tiers

HEAD_BYTES = 1 << 16


def scan(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """path, file_size of every image file below folder; contents are not read. limit: the first ones by path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    found = found.select("path", F.col("length").alias("file_size")).where(tiers.is_image(F.col("path")))
    return found.orderBy("path").limit(limit) if limit else found


def kinds(files: DataFrame) -> DataFrame:
    """n_raw, n_plain of a scan."""
    raw = tiers.is_raw(F.col("path"))
    return files.agg(F.count_if(raw).alias("n_raw"), F.count_if(~raw).alias("n_plain"))


def file_table(spark: SparkSession, folder: str) -> DataFrame:
    """Files with size and header dimensions (0 where the header does not tell)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(tiers.is_image(F.col("path")))
    head = found.select("path", F.col("length").alias("file_size"), images.header_facts(F.substring("content", 1, HEAD_BYTES)).alias("h"))
    relative = F.regexp_replace(paths.folder(F.col("path")), F.lit(r"^(file:)?/*"), F.lit(""))
    size = [F.col("h.width").alias("width"), F.col("h.height").alias("height"), (F.col("h.width").cast("bigint") * F.col("h.height")).alias("pixels")]
    return head.select("path", F.lower(paths.basename(F.col("path"))).alias("filename_lower"), relative.alias("folder_rel"), "file_size", *size)


def capture_times(spark: SparkSession, folder: str) -> DataFrame:
    """path, capture_time: when the picture was taken, else when it was changed, else null."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(tiers.is_image(F.col("path")))
    head = found.select("path", images.header_facts(F.substring("content", 1, HEAD_BYTES)).alias("h"))
    return head.select("path", paths.exif_time(F.col("h.original"), F.col("h.changed")).alias("capture_time"))


def folder_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("folder_rel").agg(F.count("*").alias("n_files"))


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """path, height, width, channels, data of the images that the JVM decodes; the others have height -1."""
    found = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(folder)
    # the other sources write one slash
    origin = F.regexp_replace("image.origin", "^file:/+", "file:/")
    names = {"height": "height", "width": "width", "nChannels": "channels", "data": "data"}
    return found.select(origin.alias("path"), *[F.col(f"image.{c}").alias(n) for c, n in names.items()]).where(tiers.is_image(F.col("path")))


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of every image file below folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.where(tiers.is_image(F.col("path"))).select("path", "content")


def measured(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the filter phase: one decode gives all metrics, the status follows from these."""
    rows = decoded(spark, folder)
    m = rows.select("path", images.image_metrics("data", "height", "width", "channels").alias("m")).select("path", "m.*")
    return m.withColumns({"blur_tier": tiers.blur_tier(F.col("blur_score")), "status": tiers.status(F.col("blur_score"), F.col("exposure_mean")), "cluster_id": F.lit(None).cast("int"), "is_cluster_best": F.lit(True)})


def known_hashes(outputs: DataFrame) -> DataFrame:
    """path, phash from earlier outputs (path, phash, file_ord): the last file that has one wins."""
    return outputs.where("phash IS NOT NULL").groupBy("path").agg(F.max_by("phash", "file_ord").alias("phash"))


def with_known_hashes(files: DataFrame, known: DataFrame) -> DataFrame:
    return files.join(known, "path", "left")


def skip_list(report: DataFrame) -> DataFrame:
    return report.select(F.explode("skip").alias("path")).distinct()


def without_skipped(files: DataFrame, skip: DataFrame) -> DataFrame:
    return files.join(skip, "path", "left_anti")
