"""Connected components of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stage

#: Most links that one task joins into components.
ONE_TASK_LINKS = 200_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (u, v) -> (u, smallest reachable)."""
    parent: dict = {}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(parent.setdefault(a, a)), find(parent.setdefault(b, b))
            if a != b:
                parent[max(a, b)] = min(a, b)
    if schema is not None:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, schema[0].type), pa.array([find(x) for x in nodes], schema[1].type)], schema=schema)


def connected_components(edges: DataFrame, max_rounds: int = 60, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(node, comp): comp is the smallest node reachable over edges (a, b). Nodes without edges are absent.

    Up to one_task links are joined in one task. More are contracted by large-star and small-star rounds (Kiveris et
    al. 2014): each keeps at most as many links as the one before and is written to the shared folder, as are the
    minima, so that joins with a node of very many links can be split. Ends when a round changes nothing.
    """
    links = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    n = links.count()
    if n <= one_task:
        done = stage(links.coalesce(1).mapInArrow(_union_find, links.schema), "components")
        return done.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    links = links.distinct()
    before = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "large")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select("u", "v", "m")
        links = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = stage(links, "round")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # a settled forest is made of stars: every node points at its smallest
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
