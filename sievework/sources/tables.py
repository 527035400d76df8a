"""Record tables, vectors, persons and exports: reads with explicit schemas, atomic writes."""

from __future__ import annotations

import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import paths
from ..params import ALIVE, DEFAULT


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_records(spark: SparkSession, path: str, columns: str = schema.RECORD) -> DataFrame | None:
    """A JSON array of records, or a table that save() wrote or plain Parquet; None if there is none. Malformed JSON fails."""
    if not exists(spark, path):
        return None
    if path.endswith(".json"):
        return spark.read.schema(columns).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return load(spark, path)


POINTER = "_current"


def _versions(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _current(spark: SparkSession, path: str) -> str | None:
    jvm, folder, files = _versions(spark, path)
    pointer = jvm.org.apache.hadoop.fs.Path(folder, POINTER)
    if not files.exists(pointer):
        return None
    stream = files.open(pointer)
    try:
        return f"{path}/{stream.readLine()}"
    finally:
        stream.close()


def _replace(spark: SparkSession, text: str, path) -> None:
    """Writes a small text file beside a path and renames it over that, in one step."""
    jvm = spark.sparkContext._jvm
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fresh = jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{path.getName()}-{uuid.uuid4().hex}")
    stream = files.create(fresh)
    stream.write(text.encode())
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    context.rename(files.makeQualified(fresh), files.makeQualified(path), options)


def save_text(spark: SparkSession, text: str, path: str) -> None:
    """A small file, old or new and never a part of it."""
    _replace(spark, text, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))


def save(df: DataFrame, path: str) -> None:
    """Writes a new version below path and then switches the pointer to it by one atomic rename: a reader, or a run after a
    crash, sees the old or the new table whole. df may read the old one; versions other than these two go."""
    spark = df.sparkSession
    jvm, folder, files = _versions(spark, path)
    before = _current(spark, path)
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    _replace(spark, name, jvm.org.apache.hadoop.fs.Path(folder, POINTER))
    for found in files.listStatus(folder):
        own = found.getPath().getName()
        if own.startswith("v-") and own != name and not (before or "").endswith(own):
            files.delete(found.getPath(), True)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The table that save() wrote, or plain Parquet."""
    return spark.read.parquet(_current(spark, path) or path)


def save_vectors(vectors: DataFrame, path: str) -> None:
    """path, embedding of the pictures that have one."""
    save(vectors.where("embedding IS NOT NULL").select("path", F.col("embedding").cast("array<float>").alias("embedding")), path)


def eligible(records: DataFrame) -> DataFrame:
    """Rows that may be selected: alive, with a score."""
    return records.where(F.col("status").isin(*ALIVE) & F.col("final_score").isNotNull())


def selected_in_order(records: DataFrame) -> DataFrame:
    return records.where("selected").orderBy(F.coalesce("selection_rank", F.lit(9999)), "ord")


def coverage(records: DataFrame, vectors: DataFrame) -> DataFrame:
    """coverage_percent, enough: share of records with a vector."""
    have = vectors.select("path").distinct().withColumn("__has", F.lit(True))
    share = F.coalesce(F.avg(F.when(F.col("__has"), 1.0).otherwise(0.0)) * 100, F.lit(0.0))
    return records.join(have, "path", "left").agg(share.alias("coverage_percent")).withColumn("enough", F.col("coverage_percent") >= DEFAULT.coverage_percent)


def load_vectors(spark: SparkSession, path: str, records: DataFrame) -> DataFrame | None:
    """The vectors, or None if they are missing or cover less than half of the records."""
    if not exists(spark, path):
        return None
    vectors = load(spark, path)
    return vectors if coverage(records, vectors).first().enough else None


def save_person(persons: DataFrame, path: str) -> None:
    """Overwrites the persons in it and leaves the others."""
    persons.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").parquet(path)


def load_persons(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("name", "embedding", "sources")


def person_names(persons: DataFrame) -> DataFrame:
    return persons.select("name").distinct().orderBy("name")


def copy_plan(rows: DataFrame, keep_same_names: bool = True) -> DataFrame:
    """path, folder, target of rows (ord, path, folder). A second file of the same name gets a numbered name, or is left out."""
    from pyspark.sql import Window

    name = paths.basename(F.col("path"))
    place = F.row_number().over(Window.partitionBy("folder", name).orderBy("ord"))
    numbered = F.when(F.col("__n") == 1, name).otherwise(F.concat(paths.stem(F.col("path")), F.lit("_"), F.col("__n"), F.regexp_extract(name, r"(\.[^.]*)$", 1)))
    rows = rows.withColumn("__n", place)
    if not keep_same_names:
        rows = rows.where("__n = 1")
    return rows.select("ord", "path", "folder", F.concat_ws("/", "folder", numbered).alias("target"))


def copy_files(plan: DataFrame, root: str) -> DataFrame:
    """Copies each planned file below root where it is not yet there: path, target, copied."""

    def run(batches):
        import pandas as pd

        for rows in batches:
            done = []
            for source, target in zip(rows["path"], rows["target"], strict=True):
                to = Path(root, target)
                try:
                    to.parent.mkdir(parents=True, exist_ok=True)
                    fresh = not to.exists()
                    if fresh:
                        shutil.copy2(str(source).removeprefix("file:"), to)
                    done.append(fresh)
                except OSError:
                    done.append(False)
            yield pd.DataFrame({"path": rows["path"], "target": rows["target"], "copied": done})

    return plan.select("path", "target").mapInPandas(run, "path string, target string, copied boolean")


def pending(rows: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """Rows without a finished result."""
    return rows.join(done.select(key), key, "left_anti")
