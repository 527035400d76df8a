"""Expressions at their boundary values."""

import math

import pytest
from pyspark.sql import functions as F

from sievework.functions import paths, replies, scores, tiers, vectors


def column(spark, expression, **values):
    frame = spark.createDataFrame([tuple(v[0] for v in values.values())], ", ".join(f"{k} {v[1]}" for k, v in values.items()))
    return frame.select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    ("blur", "exposure", "status"),
    [
        (39.999, 100.0, "rejected_blur"),
        (40.0, 100.0, "soft_blur_surviving"),
        (99.999, 100.0, "soft_blur_surviving"),
        (100.0, 100.0, "surviving"),
        (100.0, 29.999, "rejected_dark"),
        (100.0, 30.0, "surviving"),
        (100.0, 225.0, "surviving"),
        (100.0, 225.001, "rejected_bright"),
        (50.0, 29.999, "rejected_blur_and_exposure"),
        (50.0, 225.001, "rejected_blur_and_exposure"),
        (None, 100.0, "error"),
        (100.0, None, "error"),
        (10.0, None, "rejected_blur"),
    ],
)
def test_status(spark, blur, exposure, status):
    assert column(spark, tiers.status(F.col("b"), F.col("e")), b=(blur, "double"), e=(exposure, "double")) == status


@pytest.mark.parametrize(
    ("faces", "tier", "ratio", "tags"),
    [
        (1, "pass", 1.0, ["solo_portrait"]),
        (2, "soft_blur", 1.0, ["couple", "candid"]),
        (3, "pass", 1.0, ["group"]),
        (0, "pass", 1.49, ["detail"]),
        (0, "pass", 1.5, ["venue"]),
        (0, "soft_blur", 2.0, ["candid", "venue"]),
    ],
)
def test_shot_tags(spark, faces, tier, ratio, tags):
    assert column(spark, tiers.shot_tags(F.col("f"), F.col("t"), F.col("r")), f=(faces, "int"), t=(tier, "string"), r=(ratio, "double")) == tags


def test_blend_redistributes_null_weights(spark):
    weights = {"brisque": 0.2, "laion": 0.4, "musiq": 0.4}
    for values in [(0.1, 0.5, 0.9), (None, 0.5, 0.9), (0.1, None, None), (None, None, None), (0.0, 0.0, 0.0)]:
        row = dict(zip(weights, values, strict=True))
        known = {k: v for k, v in row.items() if v is not None}
        want = sum(weights[k] * v for k, v in known.items()) / sum(weights[k] for k in known) if known else 0.5
        got = column(spark, scores.blend({k: F.col(k) for k in weights}, weights), **{k: (v, "double") for k, v in row.items()})
        assert got == pytest.approx(want)


def test_clamp_keeps_null(spark):
    for value, want in [(None, None), (-1.0, 0.0), (0.3, 0.3), (7.0, 1.0)]:
        assert column(spark, scores.clamp(F.col("v")), v=(value, "double")) == want


def test_rule_of_thirds_and_prominence(spark):
    frame = spark.sql("SELECT array(named_struct('x', 190, 'y', 140, 'w', 20, 'h', 20)) AS b, cast(array() AS array<struct<x:int,y:int,w:int,h:int>>) AS none, 600 AS w, 450 AS h")
    row = frame.select(
        scores.rule_of_thirds(F.col("b"), F.col("w"), F.col("h")).alias("r"),
        scores.rule_of_thirds(F.col("none"), F.col("w"), F.col("h")).alias("r0"),
        scores.prominence(F.col("b"), F.col("w"), F.col("h")).alias("p"),
        scores.distraction(F.lit(500), F.lit(400), F.col("b"), F.col("w"), F.col("h")).alias("d"),
        scores.distraction(F.lit(200), F.lit(150), F.col("b"), F.col("w"), F.col("h")).alias("d0"),
    ).first()
    assert row.r == pytest.approx(math.exp(0))
    assert (row.r0, row.p, row.d, row.d0) == (0.5, pytest.approx(400 / 270000), 0.9, 1.0)


def test_replies(spark):
    reply = '```json\n{"emotion": "8", "memorability": 12}\n```'
    got = column(spark, replies.ratings(F.col("r")), r=(reply, "string"))
    assert (got.emotion, got.memorability) == (0.8, 1.0)
    assert column(spark, replies.ratings(F.col("r")), r=("not json", "string")).emotion is None
    assert column(spark, replies.rank_list(F.col("r"), F.lit(3)), r=("[2, 1, 3]", "string")) == [2, 1, 3]
    assert column(spark, replies.rank_list(F.col("r"), F.lit(2)), r=("[2, 1, 3]", "string")) is None


def test_paths(spark):
    path = r"C:\Photos\Day One\IMG_0042.JPG"
    got = [column(spark, f(F.col("p")), p=(path, "string")) for f in (paths.basename, paths.parent_name, paths.folder_label, paths.sequence_number, paths.stem, tiers.extension)]
    assert got == ["IMG_0042.JPG", "Day One", "day_one", 42, "IMG_0042", "jpg"]
    assert column(spark, paths.folder_label(F.col("p")), p=("a.jpg", "string")) == "unknown"
    assert column(spark, paths.sequence_number(F.col("p")), p=("/x/none.jpg", "string")) == -1


def test_cosine_and_hamming(spark):
    assert column(spark, vectors.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))), z=(1, "int")) == 0.0
    high, low = vectors.hex_halves(F.col("h"))
    zero = F.lit(0).cast("long")
    assert column(spark, vectors.hamming(high, low, zero, zero), h=("ffffffff00000001", "string")) == 33
