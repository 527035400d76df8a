"""Scoring stage: model scores through pluggable scorers, blending, burst comparison, final scores, reweighting."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import images, replies, scores, tiers
from ..params import DEFAULT, Params


@dataclass(frozen=True)
class Scorer:
    """A model behind a loader: load() runs once in each worker and gives a function from content to a score or None."""

    name: str
    load: Callable[[], Callable[[bytes], float | None]]
    on_failure: float | None = None


def stub(name: str, on_failure: float | None = None) -> Scorer:
    """Deterministic scorer by content digest, for tests and dry runs."""
    return Scorer(name, lambda: lambda content: int.from_bytes(hashlib.sha256(name.encode() + content).digest()[:4], "big") / 0xFFFFFFFF, on_failure)


def loaded(scorer: Scorer | None) -> Callable[[bytes], float | None] | None:
    """The scorer's function with its own value for a failure; None without a model or if it can't be loaded."""
    if scorer is None:
        return None
    try:
        model = scorer.load()
    except Exception:
        return None

    def score(content: bytes) -> float | None:
        try:
            found = model(content)
        except Exception:
            found = None
        return scorer.on_failure if found is None else float(found)

    return score


def run_scorer(rows: DataFrame, scorer: Scorer, column: str, content: str = "content") -> DataFrame:
    """rows with the scorer's column; a failure gives the scorer's own value for it, null included."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = loaded(scorer) or (lambda value: scorer.on_failure)
        for values in series:
            yield pd.Series([score(bytes(value)) for value in values], dtype="float64")

    return rows.withColumn(column, F.pandas_udf(run, "double")(F.col(content)))


AESTHETICS = "path string, brisque_score double, laion_score double, laion_method string, nima_score double, nima_method string, musiq_score double"


def aesthetics(pictures: DataFrame, brisque: Scorer | None = None, laion: Scorer | None = None, nima: Scorer | None = None, musiq: Scorer | None = None) -> DataFrame:
    """The AESTHETICS of pictures (path, content), all models in one pass over the contents.

    brisque: 0.5 where it fails or is missing. The laion column has the first model of laion, nima, brisque that loads, and
    brisque where that raises; its method tells which. musiq: null where it fails or is missing, so the blend leaves it out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, extra = loaded(brisque), loaded(musiq)
        method, main = next(((n, f) for n, f in (("laion", loaded(laion)), ("nima", loaded(nima))) if f), ("brisque", None))
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                low = base(bytes(content)) if base else None
                low = round(0.5 if low is None else low, 6)
                found = main(bytes(content)) if main else None
                own, value = (method, round(found, 6)) if found is not None else ("brisque", low)
                more = extra(bytes(content)) if extra else None
                rows.append((path, low, value, own, value, own, None if more is None else round(more, 6)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in AESTHETICS.split(", ")])

    return pictures.select("path", "content").mapInPandas(run, AESTHETICS)


def call_model(rows: DataFrame, ask: Callable[[bytes], str], content: str = "content", attempts: int = 2, breaker: int = 10, pause_s: float = 0.0) -> DataFrame:
    """rows (path, content) -> path, reply, asked. After `breaker` failures in a row the task asks no more: its further rows
    have asked = false, so they are open for the next run instead of being scored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failures = 0
        for batch in batches:
            out, asked = [], []
            for value in batch[content]:
                reply = None
                asked.append(failures < breaker)
                for _ in range(attempts if failures < breaker else 0):
                    try:
                        reply = ask(bytes(value))
                        break
                    except Exception:
                        reply = None
                failures = 0 if reply is not None else failures + 1
                out.append(reply)
            time.sleep(pause_s)
            yield pd.DataFrame({"path": batch["path"], "reply": out, "asked": asked})

    return rows.select("path", content).mapInPandas(run, "path string, reply string, asked boolean")


def with_ratings(rows: DataFrame, reply: str = "reply", asked: str = "asked") -> DataFrame:
    """emotion_score, memorability_score and llava_fallback from a reply; what can't be read is 0.5 and a fallback. Rows that
    were not asked get none."""
    r = replies.ratings(F.col(reply))
    failed = F.coalesce(r["emotion"].isNull() | r["memorability"].isNull(), F.lit(True))
    value = lambda n: F.when(F.col(asked), F.when(failed, 0.5).otherwise(F.round(r[n], 6)))
    return rows.withColumns({"emotion_score": value("emotion"), "memorability_score": value("memorability"), "llava_fallback": F.when(F.col(asked), failed)})


def with_aesthetic(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """aesthetic_score: the blend of the three aesthetic scores that are there."""
    parts = {n: F.col(f"{n}_score") for n in ("brisque", "laion", "musiq")}
    return rows.withColumn("aesthetic_score", F.round(scores.blend(parts, p.blend), 6))


def with_composition(rows: DataFrame, p: Params = DEFAULT, boxes: str = "face_bboxes", width: str = "width", height: str = "height", peak: tuple[str, str] | None = None) -> DataFrame:
    b, w, h = (F.col(c) for c in (boxes, width, height))
    penalty = scores.distraction(F.col(peak[0]), F.col(peak[1]), b, w, h, p) if peak else F.lit(1.0)
    return rows.withColumns({"rot_score": F.round(scores.rule_of_thirds(b, w, h, p), 6), "prominence_score": F.round(scores.prominence(b, w, h), 6), "distraction_penalty": penalty})


def burst_subsets(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """ord, path, burst_group_id, place, n: the first rows of each burst that is compared, in input order; n rows of it are."""
    group = Window.partitionBy("burst_group_id")  # a burst of one moment; larger ones are not compared
    low, high = p.burst_groups
    placed = rows.where(F.col("burst_group_id").isNotNull() & tiers.is_alive(F.col("status")))
    placed = placed.select("ord", "path", "burst_group_id", F.row_number().over(group.orderBy("ord")).alias("place"), F.count("*").over(group).alias("size"))
    placed = placed.where(F.col("size").between(low, high) & (F.col("place") <= p.burst_compare))
    return placed.select("ord", "path", "burst_group_id", "place", F.least("size", F.lit(p.burst_compare)).cast("int").alias("n"))


def compared_bursts(rows: DataFrame, ranks: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """rows with burst_llm_rank and the burst-adjusted emotion; ranks: (burst_group_id, reply), a list for each group.

    A list names the places of burst_subsets() from the best on and must be as long as these. The raw emotion stays, so a
    second run does not multiply it again.
    """
    lists = burst_subsets(rows, p).join(ranks.select("burst_group_id", "reply"), "burst_group_id")
    lists = lists.withColumn("ranks", replies.rank_list(F.col("reply"), F.col("n")))
    at = F.transform("ranks", lambda r, i: F.when(r == F.col("place"), i + 1))
    ranked = lists.select("ord", F.filter(at, lambda i: i.isNotNull()).alias("__at"))
    out = rows.drop("burst_llm_rank", "burst_emotion_score").join(ranked, "ord", "left")
    # a list that names a row twice adjusts it twice; its last place is its rank
    emotion = F.reduce("__at", F.col("emotion_score").cast("double"), lambda e, i: scores.burst_emotion(i, e, p))
    last = F.when(F.size("__at") > 0, F.element_at("__at", F.lit(-1)))
    out = out.withColumns({"burst_llm_rank": F.when(F.col("__at").isNotNull(), last).cast("int"), "burst_emotion_score": F.when(F.size("__at") > 0, emotion).otherwise(F.col("emotion_score"))})
    return out.drop("__at")


def rank_bursts(subsets: DataFrame, pictures: DataFrame, rank: Callable[[bytes], str], p: Params = DEFAULT) -> DataFrame:
    """burst_group_id, reply: the model's ranking of each burst's contact sheet (PNG); none where it fails.

    subsets: burst_subsets(); pictures: path, data, height, width, channels of decoded ones.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        try:
            shown = [images.gray(d, h, w, c) for d, h, w, c in group.sort_values("place")[["data", "height", "width", "channels"]].itertuples(index=False)]
            reply = rank(images.png(images.contact_sheet(shown)))
        except Exception:
            reply = None
        return pd.DataFrame({"burst_group_id": group["burst_group_id"].iloc[:1], "reply": [reply]})

    kind = subsets.schema["burst_group_id"].dataType.simpleString()
    return subsets.join(pictures, "path").groupBy("burst_group_id").applyInPandas(run, f"burst_group_id {kind}, reply string")


def with_final(rows: DataFrame, p: Params = DEFAULT, weights: dict[str, float] | None = None) -> DataFrame:
    """Records with base_score, final_score and score_components; rows that are not alive get none."""
    scored = rows.withColumn("__s", scores.final_score(p, weights))
    values = {c: F.col(f"__s.{c}") for c in ("base_score", "final_score", "score_components")}
    return tiers.when_alive(scored, values, {}).drop("__s")


def reweight(rows: DataFrame, weights: dict[str, float], blend_weights: dict[str, float] | None = None, p: Params = DEFAULT) -> DataFrame:
    """Stored model scores under other weights: a projection, no model runs."""
    if blend_weights:
        rows = rows.withColumn("aesthetic_score", F.round(scores.blend({n: F.col(f"{n}_score") for n in blend_weights}, blend_weights), 6))
    return with_final(rows, p, weights)
