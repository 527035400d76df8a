"""Review log: events folded to the last state, facets, summary, export plan."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from ..sources.tables import copy_plan, exists, save_text

RESERVED = frozenset("ADGF")
MAX_EXTRA = 5


def statuses(events: DataFrame) -> DataFrame:
    """path, status from events (seq, path, action, arg): `status` sets it, `cycle` turns approved and unreviewed.

    The last `status` event counts, then the cycles after it: the first makes approved unless it was, and so on.
    """
    last = events.where("action = 'status'").groupBy("path").agg(F.max_by("arg", "seq").alias("set_to"), F.max("seq").alias("at"))
    turns = events.where("action = 'cycle'").join(last, "path", "left").where(F.col("seq") > F.coalesce("at", F.lit(-1)))
    turned = turns.groupBy("path").agg(F.count("*").alias("turns"))
    joined = last.join(turned, "path", "full").withColumns({"set_to": F.coalesce("set_to", F.lit("unreviewed")), "turns": F.coalesce("turns", F.lit(0))})
    odd = F.col("turns") % 2 == 1
    after = F.when(F.col("set_to") == "approved", F.when(odd, "unreviewed").otherwise("approved")).otherwise(F.when(odd, "approved").otherwise("unreviewed"))
    return joined.select("path", F.when(F.col("turns") == 0, F.col("set_to")).otherwise(after).alias("status"))


def tags(events: DataFrame) -> DataFrame:
    """path, person_tags: labels toggled an odd number of times, in the order they were last put on."""
    by_tag = events.where("action = 'toggle'").groupBy("path", "arg").agg(F.count("*").alias("n"), F.max("seq").alias("at")).where("n % 2 = 1")
    listed = by_tag.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "arg"))).alias("l"))
    return listed.select("path", F.transform("l", lambda s: s["arg"]).alias("person_tags"))


def fold(events: DataFrame) -> DataFrame:
    """path, status, person_tags: the last state; without events a path is absent."""
    joined = statuses(events).join(tags(events), "path", "full")
    return joined.select("path", F.coalesce("status", F.lit("unreviewed")).alias("status"), F.coalesce("person_tags", F.array().cast("array<string>")).alias("person_tags"))


def with_reviews(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    joined = rows.join(reviews.select("path", F.col("status").alias("review_status"), "person_tags"), "path", "left")
    return joined.withColumns({"review_status": F.coalesce("review_status", F.lit("unreviewed")), "person_tags": F.coalesce("person_tags", F.array().cast("array<string>"))})


@dataclass(frozen=True)
class Facets:
    """An empty facet is no constraint."""

    shots: tuple[str, ...] = ()
    low: float = 0.0
    high: float = 1.0
    statuses: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()


def facet_test(facets: Facets, shot: str = "primary_shot_type", score: str = "final_score", status: str = "review_status", tag: str = "person_tags") -> Column:
    value = F.coalesce(F.col(score), F.lit(0.0))
    test = (value >= facets.low) & (value <= facets.high)
    if facets.shots:
        test &= F.col(shot).isin(*facets.shots)
    if facets.statuses:
        test &= F.col(status).isin(*facets.statuses)
    if facets.tags:
        test &= F.arrays_overlap(F.col(tag), F.array(*[F.lit(t) for t in facets.tags]))
    return test


def summary(rows: DataFrame, people: list[str], p: Params = DEFAULT) -> DataFrame:
    approved = F.count_if(F.col("review_status") == "approved")
    each = [F.count_if(F.array_contains("person_tags", name)).alias(f"n_{name}") for name in people]
    return rows.agg(F.count("*").alias("total"), approved.alias("approved"), F.count_if(F.col("review_status") == "rejected").alias("rejected"), F.count_if(F.col("review_status") == "unreviewed").alias("unreviewed"), (approved > p.review_warning).alias("warning"), *each)


def export_plan(rows: DataFrame, root: str = "", keep_same_names: bool = True) -> DataFrame:
    """Approved rows to the root, tagged rows to each person's folder, whether approved or not."""
    approved = rows.where("review_status = 'approved'").select("ord", "path", F.lit(root or ".").alias("folder"))
    tagged = rows.select("ord", "path", F.explode("person_tags").alias("name"))
    tagged = tagged.select("ord", "path", F.concat_ws("/", F.lit(root or "."), "name").alias("folder"))
    return copy_plan(approved.unionByName(tagged), keep_same_names)


def save_progress(reviews: DataFrame, people: list[dict], path: str) -> None:
    """Writes a review's progress as one JSON object, whole or not at all: version, persons (letter, name, color) and reviews
    by path. A review is over the selected rows, a few hundred."""
    found = {r.path: {"status": r.status, "person_tags": list(r.person_tags or [])} for r in reviews.select("path", "status", "person_tags").toLocalIterator()}
    save_text(reviews.sparkSession, json.dumps({"version": 1, "persons": people, "reviews": found}, indent=2), path)


def read_progress(spark: SparkSession, path: str) -> tuple[list[dict], DataFrame] | None:
    """Persons and reviews (path, status, person_tags) of a saved review; None if there is none that can be read."""
    if not exists(spark, path):
        return None
    kind = "persons array<struct<letter:string,name:string,color:string>>, reviews map<string,struct<status:string,person_tags:array<string>>>"
    saved = spark.read.schema(f"version int, {kind}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    first = saved.select("persons", "_corrupt", F.col("reviews").isNotNull().alias("whole")).first()
    if first is None or first["_corrupt"] is not None or not first.whole:
        return None
    rows = saved.select(F.explode("reviews").alias("path", "r")).select("path", "r.status", F.coalesce("r.person_tags", F.array().cast("array<string>")).alias("person_tags"))
    return [p.asDict() for p in first.persons or []], rows


def resume_counts(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """reviewed, remaining of the rows to review."""
    done = reviews.agg(F.count_if(F.col("status") != "unreviewed").alias("reviewed"))
    return rows.agg(F.count("*").alias("n")).crossJoin(F.broadcast(done)).select("reviewed", (F.col("n") - F.col("reviewed")).alias("remaining"))  # one row each


@dataclass
class People:
    """Extra people of a review: a letter that is free and a name each."""

    letters: dict[str, str] = field(default_factory=dict)

    def add(self, letter: str, name: str) -> None:
        letter, name = letter.strip().upper(), name.strip()
        if not re.fullmatch("[A-Z]", letter):
            raise ValueError("a single letter is needed")
        if letter in RESERVED or letter in self.letters:
            raise ValueError(f"{letter} is taken")
        if not name:
            raise ValueError("a name is needed")
        if len(self.letters) >= MAX_EXTRA:
            raise ValueError(f"at most {MAX_EXTRA} people can be added")
        self.letters[letter] = name
