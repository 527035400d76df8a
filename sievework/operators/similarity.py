"""Vector matching against small reference sets: persons, exclusive pairs, label prompts, centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..params import DEFAULT

#: Most reference vectors (persons, prompts) that are packed into one row and sent to every task.
MAX_REFERENCES = 10_000


def reference_array(references: DataFrame, label: str, embedding: str) -> Column:
    """The reference set as one array of (label, embedding, norm), in label order: a scalar subquery, size checked."""
    packed = references.select(F.struct(F.col(label).alias("label"), F.transform(embedding, lambda x: x.cast("double")).alias("embedding")).alias("r"))
    all_of = F.array_sort(F.collect_list("r"))
    checked = F.when(F.count("*") <= MAX_REFERENCES, all_of).otherwise(F.raise_error(F.lit(f"over {MAX_REFERENCES} reference vectors")))
    return packed.agg(checked.alias("references")).scalar()


def similarities(rows: DataFrame, embedding: str, references: DataFrame, label: str, reference_embedding: str, digits: int = 6) -> DataFrame:
    """rows with `sims`: array of (sim, label) for each reference. No row is multiplied, nothing is shuffled."""
    scored = lambda r: F.struct(F.round(vectors.cosine(F.col(embedding), r["embedding"]), digits).alias("sim"), r["label"].alias("label"))
    return rows.withColumn("__references", reference_array(references, label, reference_embedding)).withColumn("sims", F.transform("__references", scored)).drop("__references")


def matches(rows: DataFrame, threshold: float = DEFAULT.person_similarity) -> DataFrame:
    """rows of similarities() with `found`: the labels within the threshold, most similar first, ties by label."""
    found = F.filter("sims", lambda s: s["sim"] >= threshold)
    order = lambda a, b: F.when(a["sim"] > b["sim"], -1).when(a["sim"] < b["sim"], 1).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0)
    return rows.withColumn("found", F.array_sort(found, order))


def _without(found: Column, label: Column) -> Column:
    return F.filter(found, lambda s: s["label"] != label)


def resolve_confusions(rows: DataFrame, exclusive: list[tuple]) -> DataFrame:
    """rows of matches(): of two labels that exclude each other only the better stays, and `warned` tells so."""
    labels = lambda found: F.transform(found, lambda s: s["label"])
    found, warned = F.col("found"), F.lit(False)
    for a, b in exclusive:
        both = F.array_contains(labels(found), F.lit(a)) & F.array_contains(labels(found), F.lit(b))
        at_a, at_b = F.array_position(labels(found), F.lit(a)), F.array_position(labels(found), F.lit(b))
        loser = F.when(at_a < at_b, F.lit(b)).otherwise(F.lit(a))
        found = F.when(both, _without(found, loser)).otherwise(found)
        warned = warned | both
    return rows.withColumn("warned", warned).withColumn("found", found)


def persons_of(faces: DataFrame, key: str) -> DataFrame:
    """Sorted distinct labels over the faces of each key, and whether any face was warned of."""
    flat = faces.select(key, F.explode_outer(F.transform("found", lambda s: s["label"])).alias("label"), "warned")
    return flat.groupBy(key).agg(F.array_sort(F.collect_set("label")).alias("persons_matched"), F.max("warned").alias("confusion_warning"))


def best_labels(rows: DataFrame, k: int = 2) -> DataFrame:
    """rows of similarities() with `top`: the k most similar labels, ties by label."""
    order = lambda a, b: F.when(a["sim"] > b["sim"], -1).when(a["sim"] < b["sim"], 1).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0)
    return rows.withColumn("top", F.slice(F.transform(F.array_sort("sims", order), lambda s: s["label"]), 1, k))


def centroids(rows: DataFrame, label: str, embedding: str) -> DataFrame:
    """label, centroid, n: unit-length mean vector of each label (a zero mean stays as it is)."""
    at = rows.select(label, F.posexplode(embedding).alias("at", "x"))
    means = at.groupBy(label, "at").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    listed = means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("l"), F.max("n").alias("n"))
    return listed.select(label, vectors.unit(F.transform("l", lambda s: s["m"])).alias("centroid"), "n")


def tag_histogram(rows: DataFrame, tags: str, k: int = 5) -> DataFrame:
    counted = rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "tag").limit(k)


def rank_matches(rows: DataFrame, key: str) -> DataFrame:
    """key, place, label, sim: found matches as rows, in order."""
    flat = rows.select(key, F.posexplode("found").alias("at", "m"))
    return flat.select(key, (F.col("at") + 1).alias("place"), F.col("m.label").alias("label"), F.col("m.sim").alias("sim"))


