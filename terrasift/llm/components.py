"""Connected components of an edge table, by alternating large-star and small-star steps over DataFrames.

Each step replaces a node's edges by edges to the least id it sees. Least ids come from partial aggregates, and the
join back splits large partitions, so a hub with any share of the edges is never gathered in one task. Every step is
written to the shared folder. Each task first replaces its own edges by stars; what is then below a bound is left to one task. The number of steps grows with the logarithm of the longest chain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.store import drop, join_roots, keep, small_batches

#: Edges up to which one task does the rest (16 bytes each).
SMALL = 500_000


def _contract(batches):
    """Stars in place of a task's edges, part by part: fewer steps remain, and none where one task has all edges."""
    u, v = [], []

    def stars():
        ids, at = np.unique(np.concatenate(u + v), return_inverse=True)
        i, j = np.split(at, 2)
        root = join_roots(np.arange(len(ids)), i, j)
        while (root[root] != root).any():
            root = root[root]
        some = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]])], names=["u", "v"])

    for b in batches:
        u.append(b.column(0).to_numpy())
        v.append(b.column(1).to_numpy())
        if sum(map(len, u)) > 2 * SMALL + 1_000_000:
            yield stars()
            u, v = [], []
    if sum(map(len, u)):
        yield stars()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written first, so that the join back can be split at a hub.
    least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = keep(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Kept table (id, component) of all nodes that have an edge to another node; component is the least id reached.

    edges: columns u and v of integers, in any direction, repeats and loops allowed; rows with a null end are
    ignored. Without edges the result is empty.
    """
    small_batches(edges)
    plain = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v").distinct()
    now = keep(plain.mapInArrow(_contract, "u bigint, v bigint").distinct())
    if now.count() <= SMALL:
        done = keep(now.coalesce(1).mapInArrow(_contract, "u bigint, v bigint"))
        drop(now)
        return _named(done)
    mark = _mark(now)
    while True:
        after = keep(_small(_large(now)))
        drop(now)
        now, before = after, mark
        mark = _mark(now)
        if mark == before:
            break
    return _named(now)


def _named(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return keep(stars.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots))
