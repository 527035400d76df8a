"""Selection of the best rows under quotas, and with diversity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from ..sources.scratch import stage


def best_first(score: str, tie: str) -> list[Column]:
    return [F.desc(F.coalesce(F.nullif(F.col(score), F.lit(0.0)), F.lit(0.0))), F.asc(tie)]


def one_cap(rows: DataFrame, group: str, cap: int, score: str, tie: str) -> DataFrame:
    """The `cap` best rows of each group, with their place. Needs no fold."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*best_first(score, tie)))
    return rows.withColumn("place", place).where(F.col("place") <= cap)


def _open(value, unknown: str) -> bool:
    return value is None or value == unknown


def greedy(rows: DataFrame, n: int, moment: str, moment_cap: int, shot: str, shot_cap: int, score: str, tie: str, unknown: str = DEFAULT.unknown) -> DataFrame:
    """(tie, selection_rank) of n rows, best first, skipping rows whose moment or shot type is full; `unknown` never is.

    A skipped row uses up neither quota, so the choice is a fold in score order. It needs few rows. Of one (moment,
    shot) group the chosen rows are its first ones, min(quotas, n) at most. And of one shot type only its first
    quota + n such rows matter: at most n / moment_cap moments ever fill up, which hold moment_cap of these rows each,
    so among that many rows there are enough in moments that are not full. So the fold gets a number of rows that
    depends on n and the shot types, not on the input.
    """
    names = {"t": tie, "m": moment, "s": shot, "v": score}
    slim = rows.select(*[F.col(c).alias(k) for k, c in names.items()]).withColumn("v", F.coalesce("v", F.lit(0.0)))
    first = [F.desc("v"), F.asc("t")]
    free = lambda c: F.coalesce(F.col(c) == unknown, F.lit(True))
    cap = F.least(F.when(free("m"), n).otherwise(moment_cap), F.when(free("s"), n).otherwise(shot_cap), F.lit(n))
    slim = slim.withColumn("g", F.row_number().over(Window.partitionBy("m", "s").orderBy(*first))).where((F.col("g") <= n) & (F.col("g") <= cap))
    most = F.when(free("s"), n).otherwise(shot_cap) + n
    slim = slim.withColumn("g", F.row_number().over(Window.partitionBy("s").orderBy(*first))).where(F.col("g") <= 2 * n).where(F.col("g") <= most).drop("g")

    def fold(table: pa.Table) -> pa.Table:
        data = table.to_pandas().sort_values(["v", "t"], ascending=[False, True])
        used: dict[tuple, int] = {}
        chosen = []
        for t, m, s in zip(data["t"], data["m"], data["s"], strict=True):
            m, s = (None if pd.isna(x) else x for x in (m, s))
            quotas = [(("m", m), moment_cap)] * (not _open(m, unknown)) + [(("s", s), shot_cap)] * (not _open(s, unknown))
            if len(chosen) == n:
                break
            if all(used.get(k, 0) < c for k, c in quotas):
                chosen.append(t)
                for k, _ in quotas:
                    used[k] = used.get(k, 0) + 1
        return pa.table({"t": pa.array(chosen, table.schema.field("t").type), "selection_rank": pa.array(range(1, len(chosen) + 1), pa.int32())})

    kind = slim.schema["t"].dataType.simpleString()
    return slim.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(fold, f"t {kind}, selection_rank int").withColumnRenamed("t", tie)


def mmr(scores: np.ndarray, vectors: list, n: int, weight: float, moments: list, shots: list, moment_cap: int, shot_cap: int, unknown: str, state: "Picks | None" = None, end: tuple | None = None, keys: list | None = None) -> list[tuple[int, float]]:
    """(row, value) picks: greatest weight * score - (1 - weight) * greatest similarity to the picks, first on ties.

    Rows are in score order. Similarities to the picks are kept as a running maximum, so a pick costs one product. With
    `end`, (value, score, key) of the first row that is not among these, the picks stop where that row might be next.
    """
    size = len(scores)
    state = state or Picks()
    has = np.array([v is not None for v in vectors], bool)
    width = next((len(v) for v in [*state.vectors, *vectors] if v is not None), 1)
    matrix = np.zeros((size, width))
    for i in np.flatnonzero(has):
        matrix[i] = vectors[i]
    nearest = state.nearest(matrix)
    free = np.ones(size, bool)
    members: dict[tuple, list[int]] = {}
    for i in range(size):
        for key in (("m", moments[i]), ("s", shots[i])):
            if not _open(key[1], unknown):
                members.setdefault(key, []).append(i)
    out: list[tuple[int, float]] = []
    while state.count < n and free.any():
        near = np.where(has, nearest, 0.0) if state.vectors else np.zeros(size)
        value = np.where(free, weight * scores - (1 - weight) * near, -np.inf)
        i = int(value.argmax())
        if end is not None:
            lead = value[i] - end[0] or scores[i] - end[1]
            if lead < 0 or (lead == 0 and keys[i] > end[2]):
                break
        out.append((i, round(float(value[i]), 6)))
        free[i] = False
        for key, cap in ((("m", moments[i]), moment_cap), (("s", shots[i]), shot_cap)):
            if not _open(key[1], unknown):
                state.used[key] = state.used.get(key, 0) + 1
                if state.used[key] >= cap:
                    free[members[key]] = False
        first = has[i] and not state.vectors
        state.count += 1
        if has[i]:
            state.vectors.append(matrix[i].copy())
            nearest = np.maximum(nearest, matrix @ matrix[i])
        if first and end is not None:
            break  # similarities count from now on and may be negative: the other rows' values can grow once
    return out


class Picks:
    """What the picks so far mean for the next ones: their vectors, and how far the quotas are used."""

    def __init__(self) -> None:
        self.count = 0
        self.vectors: list[np.ndarray] = []
        self.used: dict[tuple, int] = {}

    def nearest(self, matrix: np.ndarray) -> np.ndarray:
        out = np.full(len(matrix), -np.inf)
        for v in self.vectors:
            out = np.maximum(out, matrix @ v)
        return out

    def full(self, kind: str, cap: int) -> list:
        return [key[1] for key, n in self.used.items() if key[0] == kind and n >= cap]


#: Rows that a round of diverse() brings to one place, for each pick that is wanted.
ROUND = 10


def _values(picks: Picks, weight: float):
    """mapInArrow function: rows (t, v, e, m, s) with their value beside the picks."""
    held = [np.array(v) for v in picks.vectors]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Picks()
        known.vectors = held
        for batch in batches:
            score, vectors = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
            near = np.zeros(len(score))
            at = [i for i, v in enumerate(vectors) if v is not None]
            if at and held:
                near[at] = known.nearest(np.array([vectors[i] for i in at], float))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight * score - (1 - weight) * near)], [*batch.schema.names, "value"])

    return run


def diverse(rows: DataFrame, n: int, score: str, embedding: str, tie: str, weight: float = DEFAULT.mmr_lambda, moment: str | None = None, moment_cap: int = DEFAULT.moment_cap, shot: str | None = None, shot_cap: int | None = None, unknown: str = DEFAULT.unknown, batch: int | None = None) -> DataFrame:
    """(tie, selection_rank, mmr_score) of n rows by maximal marginal relevance, under quotas if columns are named.

    A row's value only falls as rows are picked (its greatest similarity to the picks grows) and quotas only close rows,
    so a round needs the rows of the greatest values alone: all tasks value their rows beside the picks so far, `batch`
    rows (ROUND n by default) come to the driver, and picks are made there as long as they come before the first row
    that stayed behind. Each round picks one row at least; vectors of any length and any sign are exact.
    """
    spark = rows.sparkSession
    named = {"t": F.col(tie), "v": F.coalesce(F.col(score).cast("double"), F.lit(0.0)), "e": F.col(embedding)}
    named |= {"m": F.col(moment).cast("string") if moment else F.lit(unknown), "s": F.col(shot).cast("string") if shot else F.lit(unknown)}
    slim = stage(rows.select(*[c.alias(k) for k, c in named.items()]), "scored")
    batch, caps = batch or ROUND * n, (moment_cap, shot_cap or n)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema)
    picks, found = Picks(), []
    while picks.count < n:
        left = slim
        for column, cap in (("m", caps[0]), ("s", caps[1])):
            if full := picks.full(column, cap):
                left = left.where(F.col(column).isNull() | ~F.col(column).isin(full))
        if found:
            left = left.where(~F.col("t").isin([t for t, _ in found]))
        valued = left.mapInArrow(_values(picks, weight), f"{kind}, value double")
        table = valued.orderBy(F.desc("value"), F.desc("v"), "t").limit(batch + 1).toPandas()
        end = None
        if len(table) > batch:
            last = table.iloc[batch]
            end, table = (last["value"], last["v"], last["t"]), table.iloc[:batch]
        table = table.sort_values(["v", "t"], ascending=[False, True]).reset_index(drop=True)
        clean = lambda c: [None if x is None else x for x in table[c]]  # noqa: E731,B023
        keys = table["t"].tolist()
        new = mmr(table["v"].to_numpy(float), clean("e"), n, weight, clean("m"), clean("s"), *caps, unknown, picks, end, keys)
        found += [(keys[i], value) for i, value in new]
        if end is None or not new:
            break
    kind = slim.schema["t"].dataType.simpleString()
    return spark.createDataFrame([(t, i, v) for i, (t, v) in enumerate(found, 1)], f"t {kind}, selection_rank int, mmr_score double").withColumnRenamed("t", tie)


def select_records(records: DataFrame, vectors: DataFrame | None, p: Params = DEFAULT) -> DataFrame:
    """Records with selected, selection_rank and mmr_score; with vectors by diversity, else greedily."""
    from ..sources.tables import eligible

    rows = eligible(records)
    if vectors is None:
        chosen = greedy(rows, p.select_n, "moment_label", p.moment_cap, "primary_shot_type", p.shot_cap, "final_score", "ord", p.unknown)
        chosen = chosen.withColumn("mmr_score", F.lit(None).cast("double"))
    else:
        chosen = diverse(rows.join(vectors, "path", "left"), p.select_n, "final_score", "embedding", "ord", p.mmr_lambda, "moment_label", p.moment_cap, "primary_shot_type", p.shot_cap, p.unknown)
    rest = records.drop("selected", "selection_rank", "mmr_score")
    return rest.join(F.broadcast(chosen), "ord", "left").withColumn("selected", F.col("selection_rank").isNotNull())  # n rows


