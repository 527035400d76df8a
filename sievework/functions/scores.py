"""Score arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULT, Params


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def missing_as(x: Column, default: float) -> Column:
    """x, or the default where x is null or 0."""
    return F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(default))


def inverted_percent(raw: Column) -> Column:
    return clamp(1 - raw / 100)


def percent(raw: Column) -> Column:
    return clamp(raw / 100)


def tenth(raw: Column) -> Column:
    return clamp(raw / 10)


def expected_rating(probabilities: Column) -> Column:
    """Expected value of a 10-bin rating distribution, over 10."""
    ranks = F.sequence(F.lit(1), F.lit(10))
    return F.aggregate(F.zip_with(probabilities, ranks, lambda p, r: p * r), F.lit(0.0).cast("double"), lambda s, x: s + x) / 10


def blend(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the scores that are not null; 0.5 if none is."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, score in scores.items():
        total = total + F.coalesce(score * weights[name], F.lit(0.0))
        weight = weight + F.when(score.isNotNull(), weights[name]).otherwise(0.0)
    return F.coalesce(total / F.nullif(weight, F.lit(0.0)), F.lit(0.5))


def final_score(p: Params = DEFAULT, weights: dict[str, float] | None = None) -> Column:
    """Struct of base_score, final_score and score_components from a scored record's columns."""
    w = weights or p.weights
    parts = {
        "aesthetic": F.coalesce("aesthetic_score", "laion_score", "nima_score", F.lit(0.0)),
        "emotion": F.coalesce("emotion_score", F.lit(0.0)),
        "memorability": F.coalesce("memorability_score", F.lit(0.0)),
        "rot": F.coalesce("rot_score", F.lit(0.5)),
        "prominence": F.coalesce("prominence_score", F.lit(0.5)),
    }
    base = parts["aesthetic"] * w["aesthetic"]
    for name in ("emotion", "memorability", "rot", "prominence"):
        base = base + parts[name] * w[name]
    candid = F.coalesce(F.array_contains("shot_type", "candid"), F.lit(False))
    closed = F.coalesce(F.col("has_closed_eyes"), F.lit(False))
    soft = F.coalesce(F.col("blur_tier") == "soft_blur", F.lit(False))
    distraction = missing_as(F.col("distraction_penalty"), 1.0)
    times = lambda flag, factor: F.when(flag, factor).otherwise(1.0)
    final = base * times(candid, p.candid) * times(closed, p.closed_eyes) * times(soft, p.soft_blur) * distraction
    flags = [candid.alias("candid_bonus"), closed.alias("closed_eyes_penalty"), soft.alias("soft_blur_penalty"), (distraction < 1).alias("distraction_penalty")]
    components = F.struct(*[F.round(x, 6).alias(name) for name, x in parts.items()], *flags)
    return F.struct(F.round(base, 6).alias("base_score"), F.round(final, 6).alias("final_score"), components.alias("score_components"))


def rule_of_thirds(boxes: Column, width: Column, height: Column, p: Params = DEFAULT) -> Column:
    """Greatest closeness of a box centre to a thirds point; 0.5 without boxes."""
    sigma = F.least(width, height) * p.thirds_sigma
    points = [(a / 3, b / 3) for a in (1, 2) for b in (1, 2)]

    def near(box: Column) -> Column:
        x, y = box["x"] + box["w"] / 2, box["y"] + box["h"] / 2
        return F.greatest(*[F.exp(-(F.pow(x - width * a, 2) + F.pow(y - height * b, 2)) / (2 * sigma * sigma)) for a, b in points])

    best = F.array_max(F.transform(boxes, near))
    return F.when(F.coalesce(F.size(boxes), F.lit(0)) <= 0, 0.5).otherwise(F.greatest(F.lit(0.0), best))


def prominence(boxes: Column, width: Column, height: Column) -> Column:
    """Largest box's share of the frame; 0.5 without boxes."""
    share = F.array_max(F.transform(boxes, lambda b: b["w"] * b["h"])) / F.greatest(width * height, F.lit(1))
    return F.when(F.coalesce(F.size(boxes), F.lit(0)) <= 0, 0.5).otherwise(F.least(F.lit(1.0), share))


def distraction(peak_x: Column, peak_y: Column, boxes: Column, width: Column, height: Column, p: Params = DEFAULT) -> Column:
    """The penalty where the salient point is far from every box centre; 1 without boxes or point."""
    limit = p.distraction_share * F.sqrt(width * width + height * height)
    far = F.forall(boxes, lambda b: F.sqrt(F.pow(b["x"] + b["w"] / 2 - peak_x, 2) + F.pow(b["y"] + b["h"] / 2 - peak_y, 2)) > limit)
    known = (F.coalesce(F.size(boxes), F.lit(0)) > 0) & peak_x.isNotNull() & peak_y.isNotNull()
    return F.when(known & far, p.distraction).otherwise(1.0)


def burst_emotion(rank: Column, emotion: Column, p: Params = DEFAULT) -> Column:
    """Emotion times the multiplier of its rank in the burst; missing or zero emotion counts as 0.5. Not clamped."""
    first, second, rest = p.burst_multipliers
    factor = F.when(rank == 1, first).when(rank == 2, second).otherwise(rest)
    return F.when(rank.isNotNull(), F.round(missing_as(emotion, 0.5) * factor, 6)).otherwise(emotion)


