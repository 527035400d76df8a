"""Enrichment of alive records from detected faces and picture vectors; detection itself is a pluggable model."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tiers, vectors
from ..params import DEFAULT, Params
from ..sources.tables import pending
from . import similarity

FACE = "struct<x:int,y:int,w:int,h:int,embedding:array<double>,smile:double,eyes:int>"


#: Seconds after which a detection counts as failed.
TIMEOUT_S = 60.0


def within(call: Callable, value, seconds: float):
    """call(value), or TimeoutError; a call that is too late is left behind in a thread that does not hold up the worker."""
    out: queue.Queue = queue.Queue(1)

    def run() -> None:
        try:
            out.put((call(value), None))
        except Exception as error:
            out.put((None, error))

    threading.Thread(target=run, daemon=True).start()
    try:
        found, error = out.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError from None
    if error is not None:
        raise error
    return found


def detect(rows: DataFrame, load: Callable[[], Callable[[bytes], list[dict]]], content: str = "content", timeout: float = TIMEOUT_S) -> DataFrame:
    """path, faces, failed: faces by a detector that is loaded once in each worker; a failure or a call over the timeout has
    null faces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = load()
        for batch in batches:
            faces, failed = [], []
            for value in batch[content]:
                try:
                    faces.append(within(find, bytes(value), timeout))
                    failed.append(False)
                except Exception:
                    faces.append(None)
                    failed.append(True)
            yield pd.DataFrame({"path": batch["path"], "faces": faces, "failed": failed})

    return rows.select("path", content).mapInPandas(run, f"path string, faces array<{FACE}>, failed boolean")


def resumed(rows: DataFrame, done: DataFrame | None, load: Callable, content: str = "content") -> DataFrame:
    """detect() for rows that have no finished result yet, with those that have."""
    if done is None:
        return detect(rows, load, content)
    return done.unionByName(detect(pending(rows, done.where("NOT failed")), load, content))


def embedded(rows: DataFrame, load: Callable[[], Callable[[bytes], list[float]]], content: str = "content") -> DataFrame:
    """path, embedding: vectors by an embedder that is loaded once in each worker; null where it fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = load()
        for batch in batches:
            out = []
            for value in batch[content]:
                try:
                    out.append([float(x) for x in embed(bytes(value))])
                except Exception:
                    out.append(None)
            yield pd.DataFrame({"path": batch["path"], "embedding": out})

    return rows.select("path", content).mapInPandas(run, "path string, embedding array<float>")


def enrolled(pictures: DataFrame, name: str, load: Callable, content: str = "content") -> DataFrame:
    """name, embedding, sources: the centroid of the pictures' faces; a picture without exactly one face is an error."""
    found = detect(pictures, load, content).select("path", F.when((~F.col("failed")) & (F.size("faces") == 1), F.get("faces", F.lit(0))["embedding"]).alias("embedding"))
    wrong = found.where("embedding IS NULL").limit(10).collect()
    if wrong:
        raise ValueError(f"not exactly one face in {', '.join(r.path for r in wrong)}")
    center = similarity.centroids(found.withColumn("name", F.lit(name)), "name", "embedding")
    sources = found.agg(F.array_sort(F.collect_list("path")).alias("sources"))  # of one person
    return center.select("name", F.col("centroid").alias("embedding")).crossJoin(F.broadcast(sources))


def matching_enabled(names: list[str], manual: str | None = None) -> bool:
    """Whether persons can be told by face: someone besides the one who is tagged by hand is enrolled."""
    return any(n != manual for n in names)


def match_faces(faces: DataFrame, persons: DataFrame, exclusive: list[tuple] = (), p: Params = DEFAULT) -> DataFrame:
    """path, persons_matched (sorted), confusion_warning over the faces of each picture."""
    flat = faces.where(F.size("faces") > 0).select("path", F.explode(F.transform("faces", lambda f: f["embedding"])).alias("embedding"))
    scored = similarity.similarities(flat, "embedding", persons, "name", "embedding")
    return similarity.persons_of(similarity.resolve_confusions(similarity.matches(scored, p.person_similarity), list(exclusive)), "path")


def person_flags(people: list[str]) -> dict[str, Column]:
    return {f"has_{name}": F.array_contains("persons_matched", name) for name in people}


def enriched(records: DataFrame, faces: DataFrame, persons: DataFrame | None = None, exclusive: list[tuple] = (), flags: list[str] = (), p: Params = DEFAULT) -> DataFrame:
    """Records (with width, height) and their face columns. Rows that are not alive get null blocks, moments stay.

    A failed detection has null faces_detected, so it is found again by resumed() and counted as an error.
    """
    none = F.array().cast("array<string>")
    found = faces.select("path", "faces")
    if persons is not None:
        found = found.join(match_faces(faces, persons, exclusive, p), "path", "left")
    else:
        found = found.withColumns({"persons_matched": none, "confusion_warning": F.lit(False)})
    rows = records.drop("faces", "persons_matched", "confusion_warning").join(found, "path", "left")
    rows = rows.withColumns({"persons_matched": F.coalesce("persons_matched", none), "confusion_warning": F.coalesce("confusion_warning", F.lit(False))})
    count = F.when(F.col("faces").isNotNull(), F.size("faces"))
    tags = tiers.shot_tags(count, F.col("blur_tier"), tiers.aspect_ratio(F.col("width"), F.col("height")))
    values = {
        "faces_detected": count,
        "face_bboxes": F.transform("faces", lambda f: F.struct(f["x"].alias("x"), f["y"].alias("y"), f["w"].alias("w"), f["h"].alias("h"))),
        "persons_matched": F.col("persons_matched"),
        "confusion_warning": F.col("confusion_warning"),
        "is_group_photo": F.coalesce(tiers.is_group(count), F.lit(False)),
        "shot_type": tags,
        "primary_shot_type": F.get(tags, F.lit(0)),
        "max_smile_score": F.array_max(F.transform("faces", lambda f: f["smile"])),
        "has_closed_eyes": F.coalesce(F.exists("faces", lambda f: f["eyes"] < 2), F.lit(False)),
        **person_flags(list(flags)),
    }
    no, text = F.lit(False), F.lit(p.unknown)
    dead = {"faces_detected": F.lit(0), "persons_matched": none, "confusion_warning": no, "is_group_photo": no, "shot_type": none, "primary_shot_type": text, "has_closed_eyes": no}
    return tiers.when_alive(rows, values, dead | {f"has_{n}": no for n in flags}).drop("faces")


def with_event_tags(records: DataFrame, pictures: DataFrame, prompts: DataFrame, k: int = 2) -> DataFrame:
    """Records with clip_event_tags: the labels of the k prompts most like the picture, as slugs; none without a vector."""
    unit = pictures.select("path", vectors.unit(F.col("embedding")).alias("embedding"))
    top = similarity.best_labels(similarity.similarities(unit, "embedding", prompts, "label", "embedding"), k)
    slugs = F.transform("top", lambda t: F.lower(F.replace(t, F.lit(" "), F.lit("_"))))
    tagged = top.select("path", slugs.alias("clip_event_tags"))
    return records.drop("clip_event_tags").join(tagged, "path", "left").withColumn("clip_event_tags", F.coalesce("clip_event_tags", F.array().cast("array<string>")))


def verify(rows: DataFrame, persons: DataFrame, name: str, p: Params = DEFAULT) -> DataFrame:
    """rows (path, embedding) with the similarity to one person and whether it would be a match."""
    scored = similarity.similarities(rows, "embedding", persons.where(F.col("name") == name), "name", "embedding")
    return scored.select("path", F.get("sims", F.lit(0))["sim"].alias("similarity")).withColumn("match", F.col("similarity") >= p.person_similarity)
