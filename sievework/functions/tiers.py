"""Quality tiers, the status decision tree and shot-type tags as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import ALIVE, DEFAULT, PLAIN_EXTENSIONS, RAW_EXTENSIONS, Params


def blur_tier(score: Column, p: Params = DEFAULT) -> Column:
    return F.when(score < p.blur_hard, "hard_reject").when(score < p.blur, "soft_blur").when(score.isNotNull(), "pass")


def status(blur: Column, exposure: Column, p: Params = DEFAULT) -> Column:
    """Final status of a row from its metrics; a missing metric that is needed means `error`."""
    tier = blur_tier(blur, p)
    bad = (exposure < p.dark) | (exposure > p.bright)
    return (
        F.when(tier.isNull(), "error")
        .when(tier == "hard_reject", "rejected_blur")
        .when(exposure.isNull(), "error")
        .when(bad & (tier == "soft_blur"), "rejected_blur_and_exposure")
        .when(exposure < p.dark, "rejected_dark")
        .when(exposure > p.bright, "rejected_bright")
        .when(tier == "soft_blur", "soft_blur_surviving")
        .otherwise("surviving")
    )


def is_alive(status_: Column) -> Column:
    return F.coalesce(status_.isin(*ALIVE), F.lit(False))


def when_alive(df: DataFrame, values: dict[str, Column], dead: dict[str, Column]) -> DataFrame:
    """Sets columns in rows that are alive and gives the others their null block; no row is dropped."""
    alive = is_alive(F.col("status"))
    return df.withColumns({name: F.when(alive, value).otherwise(dead.get(name, F.lit(None))) for name, value in values.items()})


def aspect_ratio(width: Column, height: Column) -> Column:
    return width / F.greatest(height, F.lit(1))


def shot_tags(faces: Column, tier: Column, ratio: Column) -> Column:
    """Array of tags: by number of faces, then candid for soft blur, then detail or venue without faces."""
    tags = F.array(
        F.when(faces == 1, F.lit("solo_portrait")).when(faces == 2, F.lit("couple")).when(faces >= 3, F.lit("group")),
        F.when(tier == "soft_blur", F.lit("candid")),
        F.when((faces == 0) & (ratio < 1.5), F.lit("detail")).when(faces == 0, F.lit("venue")),
    )
    found = F.filter(tags, lambda t: t.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown")))


def is_group(faces: Column) -> Column:
    return faces >= 3


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def is_raw(path: Column) -> Column:
    return extension(path).isin(*RAW_EXTENSIONS)


def is_image(path: Column) -> Column:
    return extension(path).isin(*RAW_EXTENSIONS, *PLAIN_EXTENSIONS)
