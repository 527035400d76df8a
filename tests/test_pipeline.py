"""Sources and phases over a folder of generated pictures."""

import hashlib
import struct
import zlib

import sys

import numpy as np
from pyspark import cloudpickle

from sievework.functions import images
from sievework.operators import scoring
from sievework.plans import cli, phases, pipeline
from sievework.sources import files, tables


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests


def png(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\x00" + row.tobytes() for row in pixels.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def pictures(folder):
    rng = np.random.default_rng(1)
    sharp = rng.integers(0, 256, (48, 64))
    (folder / "day").mkdir()
    (folder / "day" / "a1.png").write_bytes(png(sharp))
    (folder / "day" / "a2.png").write_bytes(png(np.clip(sharp + 1, 0, 255)))
    (folder / "day" / "flat.png").write_bytes(png(np.full((48, 64), 128)))
    (folder / "day" / "dark.png").write_bytes(png(sharp // 12))
    (folder / "other.png").write_bytes(png(rng.integers(0, 256, (40, 40))))
    (folder / "notes.txt").write_text("no picture")


def test_phases(spark, tmp_path):
    (tmp_path / "in").mkdir()
    pictures(tmp_path / "in")
    table = {r.filename_lower: (r.width, r.height) for r in files.file_table(spark, str(tmp_path / "in")).collect()}
    assert table["a1.png"] == (64, 48) and len(table) == 5
    run = pipeline.Run(spark, str(tmp_path / "in"), str(tmp_path / "work"))
    assert pipeline.execute(run, skip_review=True) == ["filter", "enrich", "burst", "score", "select"]
    rows = {r.path.rsplit("/")[-1]: r for r in run.read("selected").collect()}
    assert {rows["a1.png"].laion_method, rows["a1.png"].llava_fallback} == {"brisque", False} and rows["other.png"].brisque_score == 0.5
    assert rows["flat.png"].status == "rejected_blur" and rows["dark.png"].status.startswith("rejected")
    assert sorted(rows[n].status for n in ("a1.png", "a2.png")) == ["rejected_duplicate", "surviving"]
    assert rows["other.png"].selected and rows["other.png"].moment_label == "in"
    assert not rows["flat.png"].selected and rows["flat.png"].final_score is None


def vector(content):
    return np.frombuffer(hashlib.sha256(content).digest()[:8], np.uint8).astype(float) - 128


def faces(content):
    if len(content) % 2:
        raise ValueError("no detector for odd files")
    unit = vector(content) / np.linalg.norm(vector(content))
    return [{"x": 4, "y": 5, "w": 20, "h": 20, "embedding": unit.tolist(), "smile": 0.9, "eyes": 2}]


MODELS = pipeline.Models(
    faces=lambda: faces,
    embed=lambda: vector,
    prompts=(("wedding decor", tuple([1.0] * 8)), ("group photo", tuple([-1.0] * 8))),
    brisque=scoring.stub("brisque"),
    laion=scoring.stub("laion"),
    musiq=scoring.stub("musiq"),
    rate=lambda content: f'{{"emotion": {len(content) % 10}, "memorability": 5}}',
    rank=lambda content: "[2, 1]",
)


def test_phases_with_models(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rng = np.random.default_rng(7)
    for i in range(8):
        (tmp_path / "in" / f"IMG_{i:03}.png").write_bytes(png(rng.integers(0, 256, (40, 50 + i))))
    run = pipeline.Run(spark, str(tmp_path / "in"), str(tmp_path / "work"), models=MODELS)
    pipeline.execute(run, skip_review=True)
    rows = run.read("selected").orderBy("path").collect()
    alive = [r for r in rows if r.final_score is not None]
    assert len(alive) == 3 and sum(r.status == "rejected_burst" for r in rows) == 5
    assert len({r.final_score for r in alive}) == len({r.laion_score for r in alive}) == 3 and len({r.emotion_score for r in alive}) > 1
    assert all((r.width, r.height) == (50 + int(r.path[-7:-4]), 40) for r in rows)
    assert all(r.laion_method == "laion" and 0 < r.musiq_score < 1 and r.rot_score is not None and r.llava_fallback is False for r in alive)
    assert {r.primary_shot_type for r in alive if r.faces_detected == 1} <= {"solo_portrait"} and all(len(r.clip_event_tags) == 2 for r in alive)
    assert [r.selection_rank for r in sorted(alive, key=lambda r: r.selection_rank)] == [1, 2, 3] and all(r.mmr_score is not None for r in alive)
    before = {r.path: (r.laion_score, r.emotion_score, r.final_score) for r in run.read("scored").collect()}
    # a resumed run asks no model again, one of a test writes beside
    again = pipeline.Run(spark, run.folder, run.work, models=pipeline.Models(rate=lambda content: 1 / 0), resume=True, test=True)
    pipeline.score_phase(again)
    assert {r.path: (r.laion_score, r.emotion_score) for r in again.read("scored_test").collect()} == {p: v[:2] for p, v in before.items() if v[2] is not None}
    assert {r.path: (r.laion_score, r.emotion_score, r.final_score) for r in run.read("scored").collect()} == before
    pipeline.reweight_phase(run, {"aesthetic": 1.0, "emotion": 0.0, "memorability": 0.0, "rot": 0.0, "prominence": 0.0})
    assert all(r.base_score == r.aesthetic_score for r in run.read("scored").where("final_score IS NOT NULL").collect())


def test_single_phases_by_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    pictures(tmp_path / "in")
    folder, work = str(tmp_path / "in"), str(tmp_path / "work")
    assert phases.main(["filter", folder, work, "--scan-report"]) == 0
    read = lambda name: spark.read.json(f"{work}/scan/{name}").collect()
    assert [r.path.rsplit("/")[-1] for r in read("skip")] == ["a2.png"] and len(read("keep")) == 4
    assert read("summary")[0].total_files == 5 and {e.decision for e in read("hash_dup_groups")[0].entries} == {"keep", "skip"}
    text = "\n".join(r.value for r in spark.read.text(f"{work}/scan/text").collect())
    assert "Total files found          :        5" in text and "Near-duplicate cluster (2 photos)" in text and "SKIP" in text
    for args in (["filter"], ["enrich", "--skip-clip"], ["burst"], ["score", "--skip-nima", "--skip-musiq", "--skip-llava", "--models", "tests.test_pipeline:MODELS"], ["score", "--reweight"], ["select", "--no-mmr"], ["review"]):
        assert phases.main([args[0], folder, work, *args[1:], "--log", str(tmp_path / "log")]) == 0
    run = pipeline.Run(spark, folder, work)
    rows = {r.path.rsplit("/")[-1]: r for r in run.read("selected").collect()}
    assert sorted(rows) == ["a1.png", "dark.png", "flat.png", "other.png"]  # the scan report's skips are left out
    assert rows["other.png"].laion_method == "brisque" and rows["other.png"].laion_score == rows["other.png"].brisque_score != 0.5
    assert "phase score" in (tmp_path / "log").read_text()


def test_save_switches_whole_versions(spark, tmp_path):
    path = str(tmp_path / "table")
    tables.save(spark.range(3), path)
    for n in (4, 5, 6):
        tables.save(tables.load(spark, path).unionByName(spark.range(1)), path)
        assert tables.load(spark, path).count() == n
    assert sum(p.is_dir() for p in (tmp_path / "table").iterdir()) == 2
    (tmp_path / "table" / "v-left-by-a-crash").mkdir()
    assert tables.load(spark, path).count() == 6


def test_pictures_for_models():
    rng = np.random.default_rng(3)
    pixels = rng.integers(0, 256, (30, 50, 3)).astype(np.uint8)
    back = images.bounded(pixels.tobytes(), 30, 50, 3, 100)
    assert (back == pixels[:, :, ::-1]).all()
    small = images.bounded(pixels.tobytes(), 30, 50, 3, 10)
    assert small.shape == (6, 10, 3) and abs(small.mean() - pixels.mean()) < 1
    assert images.header_size(images.png(small)) == (10, 6)
    picture = np.full((120, 160), 100.0) + rng.normal(0, 1, (120, 160))
    picture[80:90, 120:130] += 120
    x, y = images.salient_point(picture)
    assert abs(x - 125) < 15 and abs(y - 85) < 15


def test_enrolled_person_and_slow_detector(spark, tmp_path):
    import time

    from sievework.operators import enrich

    content = spark.createDataFrame([("a", bytearray(b"12")), ("b", bytearray(b"1234"))], "path string, content binary")
    person = enrich.enrolled(content, "Ann", lambda: faces).first()
    mean = np.mean([vector(b"12") / np.linalg.norm(vector(b"12")), vector(b"1234") / np.linalg.norm(vector(b"1234"))], 0)
    assert person.name == "Ann" and person.sources == ["a", "b"] and np.allclose(person.embedding, mean / np.linalg.norm(mean))
    slow = enrich.detect(content, lambda: lambda c: time.sleep(3 * (len(c) == 4)) or [], timeout=1.0)
    assert {r.path: r.failed for r in slow.collect()} == {"a": False, "b": True}


def test_plan_names():
    assert pipeline.planned("score", skip_review=True) == ["score", "select"]
    assert pipeline.planned("score", only="burst") == ["burst"]
    assert cli.main(["x", "y", "--dry-run", "--only", "filter"]) == 0


def test_image_metrics():
    flat = np.full((20, 20), 90.0)
    assert images.laplacian_variance(flat) == 0
    assert images.shrink(np.ones((50, 70)), 32).round(9).tolist() == np.ones((32, 32)).tolist()
    assert images.metrics(None, 0, 0, 0) == (None, None, None)
    assert images.header_size(b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x10\x00\x20\x03") == (32, 16)


def test_persons_are_overwritten_one_by_one(spark, tmp_path):
    path = str(tmp_path / "persons")
    frame = lambda name, x: spark.createDataFrame([(name, [x], ["s"])], "name string, embedding array<double>, sources array<string>")
    tables.save_person(frame("a", 1.0), path)
    tables.save_person(frame("b", 2.0), path)
    tables.save_person(frame("a", 3.0), path)
    assert {r.name: r.embedding[0] for r in tables.load_persons(spark, path).collect()} == {"a": 3.0, "b": 2.0}


def test_copy_plan_and_copies(spark, tmp_path):
    for d in ("x", "y"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "i.jpg").write_text(d)
    rows = spark.createDataFrame([(1, str(tmp_path / "x/i.jpg"), "out"), (2, str(tmp_path / "y/i.jpg"), "out")], "ord long, path string, folder string")
    assert [r.target for r in tables.copy_plan(rows).orderBy("ord").collect()] == ["out/i.jpg", "out/i_2.jpg"]
    assert [r.ord for r in tables.copy_plan(rows, keep_same_names=False).collect()] == [1]
    done = tables.copy_files(tables.copy_plan(rows), str(tmp_path)).collect()
    assert all(r.copied for r in done) and (tmp_path / "out/i_2.jpg").read_text() == "y"
