"""The phases as one lazy plan each, and the registry that runs a part of them."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images, tiers
from ..operators import dedup, enrich, report, scoring, select, sessions
from ..params import DEFAULT, Params
from ..sources import files, tables
from ..sources.scratch import stage

Phase = Callable[["Run"], None]
log = logging.getLogger("sievework")
#: Rows of a test run.
TEST_ROWS = 20


@dataclass(frozen=True)
class Models:
    """Pluggable models; a phase goes without those that are missing, as if they had failed to load.

    faces: loader of content -> list of faces (enrich.FACE); embed: loader of content -> vector; rate and rank: content ->
    reply; the scorers give 0..1. All get PNG bytes of a bounded size.
    """

    faces: Callable | None = None
    embed: Callable | None = None
    prompts: tuple[tuple[str, tuple[float, ...]], ...] = ()
    brisque: scoring.Scorer | None = None
    laion: scoring.Scorer | None = None
    nima: scoring.Scorer | None = None
    musiq: scoring.Scorer | None = None
    rate: Callable[[bytes], str] | None = None
    rank: Callable[[bytes], str] | None = None


@dataclass
class Run:
    """What the phases share: the session, the work folder, parameters, models and flags. Each phase's table is a folder in it.

    test: the first TEST_ROWS rows alone, nothing of a full run is written over; resume: values that an earlier run of the
    phase found are kept; skip: models that are left out (nima, musiq, llava, composition, clip); mmr: selection by diversity.
    """

    spark: SparkSession
    folder: str
    work: str
    params: Params = DEFAULT
    vectors: str | None = None
    models: Models = field(default_factory=Models)
    persons: str | None = None
    exclusive: list = field(default_factory=list)
    manual: str | None = None
    test: bool = False
    resume: bool = False
    skip: frozenset = frozenset()
    mmr: bool = True

    def path(self, name: str) -> str:
        return f"{self.work.rstrip('/')}/{name}"

    def read(self, name: str) -> DataFrame:
        """A phase's table; a JSON array of records beside it is read where there is no table."""
        for path in (self.path(name), f"{self.path(name)}.json"):
            if (found := tables.read_records(self.spark, path)) is not None:
                return found
        raise FileNotFoundError(self.path(name))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Saves a phase's table, of a test run beside it, and reads it again."""
        name = f"{name}_test" if self.test else name
        tables.save(df, self.path(name))
        log.info("%s: written", name)
        return self.read(name)

    def earlier(self, name: str) -> DataFrame | None:
        """What an earlier run of a phase wrote, if the run resumes it."""
        return self.read(name) if self.resume and tables.exists(self.spark, self.path(name)) else None

    def input(self, name: str) -> DataFrame:
        rows = self.read(name)
        return rows.where(tiers.is_alive(F.col("status"))).orderBy("ord").limit(TEST_ROWS) if self.test else rows

    def note(self, summary: DataFrame) -> None:
        """Prints a summary of a few rows."""
        for row in summary.limit(100).collect():
            text = "  ".join(f"{k}={v}" for k, v in row.asDict().items())
            log.info("%s", text)
            print(text)


def with_order(rows: DataFrame, column: str = "path") -> DataFrame:
    """rows with ord, their place by path: input order decides ties."""
    return dedup.global_index(rows, "ord", column)


def with_columns_of(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """rows with these columns, null where they are not there yet."""
    return rows.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in rows.columns})


def with_earlier(rows: DataFrame, earlier: DataFrame | None, columns: list[str]) -> DataFrame:
    """rows with the columns that an earlier result has for their paths."""
    if earlier is None:
        return rows
    have = [c for c in columns if c in earlier.columns]
    return rows.drop(*have).join(earlier.select("path", *have), "path", "left")


def pictures(run: Run, rows: DataFrame) -> DataFrame:
    """path, data, height, width, channels of the alive rows that decode, and content, their bounded PNG bytes."""
    alive = rows.where(tiers.is_alive(F.col("status"))).select("path")
    found = files.decoded(run.spark, run.folder).where("height > 0").join(alive, "path", "left_semi")
    return found.withColumn("content", images.encoded(F.col("data"), F.col("height"), F.col("width"), F.col("channels")))


def filter_phase(run: Run) -> None:
    skipped = run.path("scan_report")
    rows = files.measured(run.spark, run.folder)
    if tables.exists(run.spark, skipped):
        rows = files.without_skipped(rows, files.skip_list(run.read("scan_report")))
    if run.test:
        rows = rows.join(files.scan(run.spark, run.folder, TEST_ROWS).select("path"), "path", "left_semi")
    out = run.write(dedup.cluster_duplicates(with_order(rows), run.params), "filtered")
    run.note(report.counts(out, "status"))


def enrich_phase(run: Run) -> None:
    rows = run.input("filtered").join(files.capture_times(run.spark, run.folder), "path", "left")
    sizes = files.file_table(run.spark, run.folder).select("path", "width", "height")
    rows = sessions.with_moments(rows, run.params).drop("width", "height").join(sizes, "path", "left")
    shown = pictures(run, rows)
    faces = run.path("faces_test" if run.test else "faces")
    if run.models.faces:
        done = tables.load(run.spark, faces) if run.resume and tables.exists(run.spark, faces) else None
        tables.save(enrich.resumed(shown, done, run.models.faces), faces)
        found = tables.load(run.spark, faces)
        persons = tables.load_persons(run.spark, run.persons) if run.persons else None
        names = [r.name for r in tables.person_names(persons).collect()] if persons is not None else []
        known = persons if enrich.matching_enabled(names, run.manual) else None
        rows = enrich.enriched(rows, found, known, run.exclusive, names, run.params)
    if run.models.embed and "clip" not in run.skip:
        where = run.vectors or run.path("vectors")
        if not (run.resume and tables.exists(run.spark, where)):
            tables.save_vectors(enrich.embedded(shown, run.models.embed), where)
        if run.models.prompts:
            prompts = run.spark.createDataFrame([(i, label, list(v)) for i, (label, v) in enumerate(run.models.prompts)], "idx int, label string, embedding array<float>")
            rows = enrich.with_event_tags(rows, tables.load(run.spark, where), prompts)
    out = run.write(rows, "enriched")
    run.note(report.moment_summary(out))
    if run.models.faces:
        run.note(report.face_summary(out))


def burst_phase(run: Run) -> None:
    rows = run.input("enriched")
    empty = {"primary_shot_type": F.lit(run.params.unknown), "max_smile_score": F.lit(None).cast("double")}
    rows = rows.withColumns({c: v for c, v in empty.items() if c not in rows.columns})
    out = run.write(sessions.apply_bursts(rows, run.params), "bursts")
    run.note(report.counts(out, "status"))


def score_phase(run: Run) -> None:
    """Model scores of the alive rows that have none yet, composition, ratings, burst comparison, final scores."""
    m, p = run.models, run.params
    model = {"brisque_score": "double", "laion_score": "double", "laion_method": "string", "nima_score": "double", "nima_method": "string", "musiq_score": "double"}
    composed = {"rot_score": "double", "prominence_score": "double", "distraction_penalty": "double"}
    rated = {"emotion_score": "double", "memorability_score": "double", "llava_fallback": "boolean"}
    others = {"shot_type": "array<string>", "has_closed_eyes": "boolean", "face_bboxes": "array<struct<x:int,y:int,w:int,h:int>>", "width": "int", "height": "int", "burst_group_id": "int"}
    rows = with_earlier(run.input("bursts"), run.earlier("scored"), [*model, *composed, *rated])
    rows = stage(with_columns_of(rows, model | composed | rated | others), "rows")
    alive = tiers.is_alive(F.col("status"))
    open_rows = lambda column: rows.where(alive & F.col(column).isNull())

    nima = None if "nima" in run.skip else m.nima
    laion = None if "nima" in run.skip else m.laion
    musiq = None if "musiq" in run.skip else m.musiq
    todo = open_rows("laion_score")
    new = scoring.aesthetics(pictures(run, todo), m.brisque, laion, nima, musiq)
    rows = _filled(rows, new, list(model))
    if "composition" not in run.skip:
        todo = open_rows("rot_score")
        peaks = pictures(run, todo).select("path", images.salient_points(F.col("data"), F.col("height"), F.col("width"), F.col("channels")).alias("peak")).select("path", "peak.*")
        new = scoring.with_composition(todo.drop(*composed).join(peaks, "path", "left"), p, peak=("peak_x", "peak_y")).select("path", *composed)
        rows = _filled(rows, new, list(composed))
    todo = open_rows("emotion_score")
    if m.rate is None or "llava" in run.skip:
        new = todo.select("path", F.lit(0.5).alias("emotion_score"), F.lit(0.5).alias("memorability_score"), F.lit(False).alias("llava_fallback"))
    else:
        new = scoring.with_ratings(scoring.call_model(pictures(run, todo), m.rate)).select("path", *rated)
    rows = stage(_filled(rows, new, list(rated)), "scores")
    if m.rank is not None and "llava" not in run.skip:
        subsets = scoring.burst_subsets(rows, p)
        rows = scoring.compared_bursts(rows, scoring.rank_bursts(subsets, files.decoded(run.spark, run.folder), m.rank), p)
    out = run.write(scoring.with_final(scoring.with_aesthetic(rows, p), p), "scored")
    run.note(report.statistics(tables.eligible(out), "final_score"))
    run.note(report.method_counts(out))


def _filled(rows: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """rows with the new values where they have none."""
    named = new.select("path", *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.join(named, "path", "left").withColumns({c: F.coalesce(c, f"__{c}") for c in columns})
    return joined.drop(*[f"__{c}" for c in columns])


def reweight_phase(run: Run, weights: dict | None = None) -> None:
    """Stored scores under the run's weights; no model runs."""
    rows = scoring.reweight(run.read("scored"), weights or run.params.weights, run.params.blend, run.params)
    run.note(report.statistics(tables.eligible(run.write(rows, "scored")), "final_score"))


def select_phase(run: Run) -> None:
    rows = run.read("scored")
    where = run.vectors or run.path("vectors")
    vectors = tables.load_vectors(run.spark, where, tables.eligible(rows)) if run.mmr else None
    out = run.write(select.select_records(rows, vectors, run.params), "selected")
    chosen = out.where("selected")
    run.note(report.shares(chosen, "moment_label").orderBy(F.desc("n")))
    run.note(report.top(chosen, "final_score", "ord").select("path", "final_score"))


def scan_phase(run: Run) -> dict[str, str]:
    """The scan report beside the phases: a table of files with keep, and the texts of the report."""
    found = with_order(files.file_table(run.spark, run.folder))
    hashes = files.measured(run.spark, run.folder).join(found.select("path", "ord"), "path").select("ord", "phash")
    judged = run.write(dedup.scan_report(found, hashes, run.params), "scanned")
    tables.save(judged.where("NOT keep").select(F.array("path").alias("skip")), run.path("scan_report"))
    run.note(report.scan_estimate(judged))
    return report.write_scan(judged, run.folder, run.path("scan"))


#: Name, whether it is the review, phase; in this order. The review has its files in operators/review.py, its window is the user's.
PHASES: list[tuple[str, bool, Phase | None]] = [
    ("filter", False, filter_phase),
    ("enrich", False, enrich_phase),
    ("burst", False, burst_phase),
    ("score", False, score_phase),
    ("select", False, select_phase),
    ("review", True, None),
]


def planned(first: str | None = None, only: str | None = None, skip_review: bool = False) -> list[str]:
    """Names of the phases to run; only beats first."""
    names = [n for n, _, _ in PHASES]
    for name in (first, only):
        if name is not None and name not in names:
            raise ValueError(f"no phase {name}; there are {', '.join(names)}")
    if only is not None:
        return [only]
    start = names.index(first) if first else 0
    return [n for n, review, _ in PHASES[start:] if not (review and skip_review)]


def execute(run: Run, first: str | None = None, only: str | None = None, skip_review: bool = False, dry_run: bool = False) -> list[str]:
    """Runs the planned phases; the first that fails ends the run. Phases without code of their own are left to the user."""
    names = planned(first, only, skip_review)
    if not dry_run:
        steps = {n: step for n, _, step in PHASES}
        for name in names:
            if steps[name]:
                log.info("phase %s", name)
                steps[name](run)
    return names
