"""Connected components by alternating large and small stars; links stay distributed, each round is written once."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.llm.blocks import stored


def _forest(batches):
    """A task's links as a forest of stars around its smallest nodes."""
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        if len(parent) > 1_000_000:     # bounded memory: hand over what is joined so far
            yield _stars(parent, find)
            parent.clear()
    yield _stars(parent, find)


def _stars(parent, find):
    rows = [(x, find(x)) for x in list(parent) if find(x) != x]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], ["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's larger (smaller) neighbours point to its smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u")
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, comp (its component's smallest node) of every node with a link; `links` has u and v in any order."""
    edges = links.select("u", "v").where(F.col("u") != F.col("v")).mapInArrow(_forest, "u bigint, v bigint")
    edges = stored(edges.distinct())
    state = None
    while True:
        # v < u holds in every link; a small star after a large one
        edges = stored(_star(_star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        now = tuple(now.first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        state = now
