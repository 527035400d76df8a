"""Command line of single phases: python -m sievework.plans.phases PHASE FOLDER WORK [flags]

FOLDER has the pictures, WORK the tables of the phases. Models come from `--models MODULE:NAME`, a pipeline.Models.
"""

from __future__ import annotations

import argparse
import importlib
import logging
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import enrich, review
from ..sources import files, tables
from . import pipeline


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__)
    phases = top.add_subparsers(dest="phase", required=True)

    def add(name: str, *flags: str, **values: str) -> argparse.ArgumentParser:
        phase = phases.add_parser(name)
        phase.add_argument("folder")
        phase.add_argument("work")
        phase.add_argument("--models", metavar="MODULE:NAME")
        phase.add_argument("--log")
        for flag in flags:
            phase.add_argument(f"--{flag}", action="store_true")
        for value, text in values.items():
            phase.add_argument(f"--{value.replace('_', '-')}", help=text)
        return phase

    add("filter", "test", "scan-report", input_override="another folder of pictures; its table is filtered_sample")
    add("burst", "test")
    add("enrich", "test", "skip-clip", "resume", persons="table of enrolled persons", vectors="table of picture vectors", verify_person="only print each picture's similarity to one person")
    add("score", "test", "skip-nima", "skip-llava", "skip-composition", "skip-musiq", "resume", "reweight")
    add("select", "no-mmr", vectors="table of picture vectors")
    add("review")
    enroll = add("enroll", "list", person_name="name of the person that FOLDER shows")
    enroll.set_defaults(persons=None)
    return top


def models(spec: str | None) -> pipeline.Models:
    if not spec:
        return pipeline.Models()
    module, name = spec.split(":")
    return getattr(importlib.import_module(module), name)


def logger(path: str | None) -> None:
    """Progress to a file, if one is named, and warnings to the console."""
    log = logging.getLogger("sievework")
    log.setLevel(logging.INFO)
    for old in list(log.handlers):
        log.removeHandler(old)
    console = logging.StreamHandler()
    console.setLevel(logging.WARNING)
    for handler in [console, *([logging.FileHandler(path, encoding="utf-8")] if path else [])]:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(handler)


def main(args: list[str] | None = None) -> int:
    given = parser().parse_args(args)
    logger(given.log)
    started = time.time()
    spark = SparkSession.builder.getOrCreate()
    flag = lambda name: getattr(given, name, False)
    run = pipeline.Run(spark, given.folder, given.work, models=models(given.models), vectors=getattr(given, "vectors", None), persons=getattr(given, "persons", None), test=flag("test"), resume=flag("resume"), mmr=not flag("no_mmr"))
    run.skip = frozenset(n for n in ("nima", "llava", "composition", "musiq", "clip") if flag(f"skip_{n}"))
    PHASES[given.phase](run, given)
    pipeline.log.info("phase %s took %.1f s", given.phase, time.time() - started)
    return 0


def _filter(run: pipeline.Run, given) -> None:
    if given.input_override:
        run.folder, run.test = given.input_override, False
    if given.scan_report:
        pipeline.scan_phase(run)
        return
    if given.input_override:
        run.work = run.path("sample")
    pipeline.filter_phase(run)


def _enrich(run: pipeline.Run, given) -> None:
    if not given.verify_person:
        pipeline.enrich_phase(run)
        return
    faces = enrich.detect(files.contents(run.spark, run.folder), run.models.faces)
    rows = faces.where("NOT failed").select("path", F.explode("faces").alias("f")).select("path", "f.embedding")
    run.note(enrich.verify(rows, tables.load_persons(run.spark, run.persons), given.verify_person).orderBy("path"))


def _score(run: pipeline.Run, given) -> None:
    (pipeline.reweight_phase if given.reweight else pipeline.score_phase)(run)


def _review(run: pipeline.Run, given) -> None:
    """Tells what there is to review and where an earlier review stopped; the window is the user's."""
    rows = tables.selected_in_order(run.read("selected"))
    saved = review.read_progress(run.spark, run.path("review_progress.json"))
    reviews = saved[1] if saved else run.spark.createDataFrame([], "path string, status string, person_tags array<string>")
    run.note(review.resume_counts(rows, reviews))


def _enroll(run: pipeline.Run, given) -> None:
    path = run.path("persons")
    if given.list or not given.person_name:
        run.note(tables.person_names(tables.load_persons(run.spark, path)))
        return
    tables.save_person(enrich.enrolled(files.contents(run.spark, run.folder), given.person_name, run.models.faces), path)


PHASES = {
    "filter": _filter,
    "enrich": _enrich,
    "burst": lambda run, given: pipeline.burst_phase(run),
    "score": _score,
    "select": lambda run, given: pipeline.select_phase(run),
    "review": _review,
    "enroll": _enroll,
}

if __name__ == "__main__":
    raise SystemExit(main())
