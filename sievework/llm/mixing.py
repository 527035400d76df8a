"""Mixing sources to target weights: multivariate-hypergeometric splitting tree over blocks of documents.

A document's size is its number of words. Sources in code-point order (null last) weigh WEIGHTS, repeating, and share
SHARE of all sizes; a target stops at twice its source's size and the excess is reshared by weight. Each source's
documents are dealt by hash into blocks, which a permuted order numbers. A source's quota is a number of block draws:
of all blocks if the target reaches the source's size, and then of as many as bring its words to the target; the last
drawn block is taken in part, by document in hash order plus the documents that fill the gap best, largest first.

The quotas are split over output shards by a binary tree: a node draws how many of its draws go left from the
multivariate hypergeometric distribution, so shards have the sources in proportion and exact numbers of draws. A shard
draws the next blocks of each source's permuted order, as many as its quota, so shards are disjoint; what the mix takes
is what the shards draw, each document 0, 1 or 2 times. `place` shuffles a shard's documents.

Bounds: at most MAX_SOURCES sources are held on the driver (more is an error), and MAX_BLOCKS blocks of each; the tree
keeps only sources that a node draws from, so it takes memory by draws, whatever the number of shards. A source's last
block has about 1/MAX_BLOCKS of it at most.

Defined cases: null, empty and wordless texts have size 0; a null source is a source; documents without words in a
block that is drawn are taken, with 0 words; equal rows (id and text) fare alike; with no words at all every target is
0; an empty table gives no rows; further columns are kept by mix(), with `_in` behind a name that mix() gives itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, column, free_names, materialise, small_batches

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
BLOCK_WORDS, MAX_BLOCKS, MAX_SOURCES = 1 << 15, 4096, 100_000
SHARDS = 16
SEED = 17
GIVEN = ("size", "source_size", "target", "taken", "copies", "draws")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Of sources in order: share of the total by weight, none above cap times its size."""
    size = np.array(sizes, float)
    weight = np.resize(np.array(weights, float), len(size))
    out, free = np.zeros(len(size)), np.ones(len(size), bool)
    while free.any():
        left = share * size.sum() - cap * size[~free].sum()
        out[free] = left * weight[free] / weight[free].sum()
        above = free & (out > cap * size)
        if not above.any():
            break
        free &= ~above
        out[above] = cap * size[above]
    return out.tolist()


def split_quotas(draws: np.ndarray, shards: int, rng: np.random.Generator) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, sources, quotas): how many of each source's draws a shard gets, for sources that it gets any of.

    A source's quotas sum to its draws; the shards' sums differ by one at most.
    """
    todo = [(0, shards, np.flatnonzero(draws), draws[draws > 0])]
    while todo:
        first, n, source, quota = todo.pop()
        if n == 1 or not len(source):
            if len(source):
                yield first, source, quota
            continue
        left = n // 2
        total = int(quota.sum())
        # shard k of n has total // n draws, and the first total % n have one more
        want = left * (total // n) + min(left, total % n)
        chosen = np.zeros(len(quota), np.int64)
        rest = total
        for i, k in enumerate(quota.tolist()):  # marginals, one source after the other
            if not want:
                break
            chosen[i] = rng.hypergeometric(k, rest - k, want) if rest - k else want
            want, rest = want - int(chosen[i]), rest - k
        other = quota - chosen
        todo += [(first + left, n - left, source[other > 0], other[other > 0]), (first, left, source[chosen > 0], chosen[chosen > 0])]


def _sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.withColumn("__size", size).withColumn("__hash", F.xxhash64(F.lit(SEED), "doc_id", "text"))


def _choose(block: pa.Table) -> pa.Table:
    """Of a source's boundary block (hash, gap, size): the last hash of the run that fits the gap, and what fills the rest."""
    hashes, sizes = (block.column(c).to_numpy() for c in ("hash", "size"))
    order = np.argsort(hashes)
    hashes, sizes = hashes[order], sizes[order]
    left = block.column("gap")[0].as_py()
    upto = sizes.cumsum()
    run = int(np.searchsorted(upto, left, "right"))
    cut = int(hashes[run - 1]) if run else None
    left -= int(upto[run - 1]) if run else 0
    fill = []
    rest = np.arange(run, len(sizes))
    for k in rest[np.argsort(-sizes[run:], kind="stable")].tolist():  # the largest that fits, again and again
        if 0 < sizes[k] <= left:
            fill.append(int(hashes[k]))
            left -= int(sizes[k])
    used = set(fill)
    spare = [k for k in rest.tolist() if int(hashes[k]) not in used] if left >= 1 else []
    best = min(spare, key=lambda k: (abs(sizes[k] - left), hashes[k]), default=None)
    if best is not None and abs(sizes[best] - left) < left:
        fill.append(int(hashes[best]))
    return pa.table({"number": pa.array([block.column("number")[0].as_py()], pa.int32()), "cut": pa.array([cut], pa.int64()), "fill": pa.array([fill], pa.list_(pa.int64()))})


def _plan(narrow: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """Sources (source, number, source_size, target, blocks) and drawn blocks (number, block, drawn, cut, fill): drawn has the
    shard, pass and part flag of each draw."""
    spark = narrow.sparkSession
    found = narrow.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES or sum(len(r.source or "") + 64 for r in found) > BROADCAST_BYTES:
        raise ValueError(f"over {MAX_SOURCES} sources, or their names over {BROADCAST_BYTES} bytes")
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    goal = targets([r.size for r in found])
    rows = [(r.source, i, r.size, t, max(1, min(MAX_BLOCKS, math.ceil(r.size / BLOCK_WORDS))), int(t >= r.size), t - r.size if t >= r.size else t) for i, (r, t) in enumerate(zip(found, goal, strict=True))]
    sources = spark.createDataFrame(rows, "source string, number int, source_size long, target double, blocks int, base int, rest double")
    dealt = narrow.join(F.broadcast(sources), narrow["source"].eqNullSafe(sources["source"])).drop("source")
    dealt = dealt.withColumn("block", F.pmod("hash", F.col("blocks")).cast("int"))

    sizes = dealt.groupBy("number", "block").agg(F.sum("size").alias("size"), F.first("base").alias("base"), F.first("rest").alias("rest"))
    order = Window.partitionBy("number").orderBy(F.xxhash64(F.lit(SEED + 1), "number", "block"), "block")
    run = sizes.withColumn("before", F.sum("size").over(order) - F.col("size")).withColumn("rank", F.row_number().over(order) - 1)
    whole = F.col("before") + F.col("size") <= F.col("rest")
    part = ~whole & (F.col("before") < F.col("rest"))
    blocks = materialise(run.select("number", "block", "base", "rank", (F.col("rest") - F.col("before")).alias("gap"), whole.alias("whole"), part.alias("part")), "blocks")

    # the last drawn block of each source: at most one for each source
    edge = F.broadcast(blocks.where("part").select("number", "block", "gap"))
    inside = dealt.join(edge, ["number", "block"]).groupBy("number", "hash", "gap").agg(F.sum("size").alias("size"))
    cuts = inside.groupBy("number").applyInArrow(_choose, "number int, cut long, fill array<long>")

    # whole blocks are the first of the permuted order, one that is taken in part follows; both passes are one row of draws
    counted = blocks.groupBy("number").agg(F.first("base").alias("base"), F.count("*").alias("n"), F.count_if("whole").alias("whole"), F.count_if("part").alias("part"))
    counts = {r.number: r for r in counted.collect()}
    quota = np.array([counts[i].base * counts[i].n + counts[i].whole + counts[i].part if i in counts else 0 for i in range(len(rows))], np.int64)
    tree = [(int(i), shard, int(q)) for shard, source, part_ in split_quotas(quota, shards, np.random.default_rng(SEED)) for i, q in zip(source, part_, strict=True)]
    drawn, at = [], {}
    for i, shard, q in sorted(tree):  # a shard's draws of a source follow those of the shard before
        start = at.get(i, 0)
        drawn.append((i, shard, start, start + q, counts[i].n))
        at[i] = start + q
    quotas = spark.createDataFrame(drawn, "number int, shard int, start long, stop long, n long")
    draws = quotas.withColumn("draw", F.explode(F.sequence("start", F.col("stop") - 1)))
    draws = draws.select("number", "shard", (F.col("draw") % F.col("n")).alias("rank"), (F.col("draw") >= F.col("n")).cast("int").alias("pass"))
    ranked = blocks.select("number", "block", F.col("rank").cast("long").alias("rank"), (F.col("part") & (F.col("base") == 0)).alias("first"), (F.col("part") & (F.col("base") == 1)).alias("second"))
    partly = F.when(F.col("pass") == 0, F.col("first")).otherwise(F.col("second")).alias("part")
    plan = draws.join(ranked, ["number", "rank"]).groupBy("number", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", partly))).alias("drawn"))
    return sources.drop("base", "rest"), materialise(plan.join(F.broadcast(cuts), "number", "left"), "plan")


def mix(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of docs with size, source_size, target, taken, copies and draws (array of shard and place)."""
    small_batches(docs.sparkSession)
    names = docs.columns
    inner = [c.lower() if c.lower() in ("doc_id", "text", "source") else f"c{i}" for i, c in enumerate(names)]
    own = docs.select(*[column(c).alias(n) for c, n in zip(names, inner, strict=True)])
    narrow = materialise(_sized(own).select("source", F.col("__size").alias("size"), F.col("__hash").alias("hash")), "sizes")
    sources, plan = _plan(narrow, shards)
    sources = sources.withColumnRenamed("source", "__source")
    rows = _sized(own).join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("__source"))).withColumn("block", F.pmod("__hash", F.col("blocks")).cast("int"))
    rows = rows.join(plan, ["number", "block"], "left")
    in_part = F.coalesce(F.col("__hash") <= F.col("cut"), F.lit(False)) | F.coalesce(F.array_contains("fill", F.col("__hash")), F.lit(False))
    mine = F.filter("drawn", lambda d: ~d["part"] | in_part)
    draws = F.transform(mine, lambda d: F.struct(d["shard"].alias("shard"), F.xxhash64(F.lit(SEED + 3) + d["pass"], "__hash").alias("place")))
    rows = rows.withColumn("__draws", F.coalesce(draws, F.array().cast("array<struct<shard:int,place:bigint>>")))
    copies = F.size("__draws")
    kept = [F.col(n).alias(c) for n, c in zip(inner, free_names(names, GIVEN), strict=True)]
    new = [F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * copies).alias("taken"), copies.alias("copies"), F.col("__draws").alias("draws")]
    return rows.select(*kept, *new)


def mixed_rows(mixed: DataFrame) -> DataFrame:
    """One row for each draw of mix()'s rows, with shard and place, in their order: whole files of one shard or of neighbours.

    Range partitions, so that a shard of any size is written by as many tasks as it needs.
    """
    given = ("shard", "place")
    names = free_names([c for c in mixed.columns if c != "draws"], given)
    kept = [column(c).alias(n) for c, n in zip([c for c in mixed.columns if c != "draws"], names, strict=True)]
    rows = mixed.select(*kept, F.explode("draws").alias("__draw")).withColumns({c: F.col(f"__draw.{c}") for c in given}).drop("__draw")
    return rows.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")
