"""Command line: python -m sievework.plans.cli FOLDER WORK [--from PHASE] [--only PHASE] [--skip-review] [--dry-run]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import pipeline


def main(args: list[str] | None = None) -> int:
    names = [n for n, _, _ in pipeline.PHASES]
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("work")
    parser.add_argument("--from", dest="first", choices=names)
    parser.add_argument("--only", choices=names)
    parser.add_argument("--skip-review", action="store_true")
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--vectors")
    given = parser.parse_args(args)
    if given.dry_run:
        print("\n".join(pipeline.planned(given.first, given.only, given.skip_review)))
        return 0
    spark = SparkSession.builder.getOrCreate()
    pipeline.execute(pipeline.Run(spark, given.folder, given.work, vectors=given.vectors), given.first, given.only, given.skip_review)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
