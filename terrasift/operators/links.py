"""What links reach: least ids over an edge table, first inside each task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges up to which one task does the rest, and those that a task holds at a time (16 bytes each).
SMALL, HELD = 500_000, 2_000_000


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the least one that it reaches by the edges i, j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        now = root.copy()
        for k in (i, j, root[i], root[j]):
            np.minimum.at(now, k, low)
        while (now[now] != now).any():
            now = now[now]
        if (now == root).all():
            return root
        root = now


def _stars(batches):
    """Edges (id, least) in place of a task's edges (u, v)."""
    held, size = [], 0

    def stars():
        pairs = np.concatenate(held, axis=1)
        ids, at = np.unique(pairs, return_inverse=True)
        root = _roots(len(ids), *at.reshape(pairs.shape))
        moved = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["id", "least"])

    for b in batches:
        held.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]))
        size += b.num_rows
        if size > HELD:
            yield stars()
            held, size = [], 0
    if size:
        yield stars()


def least_reached(edges: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """id, least: for each node of the edges (u, v: integers, in one direction or both) that reaches a lesser id, the least one.

    Each task puts stars in place of its own edges; where few are left, one task does the rest. Else least ids spread along
    the stars and then jump to what those know, until nothing changes: stars are short, so rounds are few. keep(df) writes a
    table and reads it back.
    """
    kind = "id bigint, least bigint"
    stars = keep(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(_stars, kind).distinct())
    if stars.count() <= SMALL:
        return keep(stars.coalesce(1).mapInArrow(_stars, kind))
    links = keep(stars.select("id", F.col("least").alias("other")).union(stars.select(F.col("least"), F.col("id"))))
    label = keep(links.select("id", F.col("id").alias("least")).distinct())
    while True:
        near = links.join(label.select(F.col("id").alias("other"), "least"), "other").groupBy("id").agg(F.min("least").alias("near"))
        step = label.join(near, "id").select("id", "least", F.least("least", "near").alias("to"))
        jump = step.join(label.select(F.col("id").alias("to"), F.col("least").alias("far")), "to")
        after = keep(jump.select("id", F.least("to", "far").alias("new"), (F.least("to", "far") != F.col("least")).alias("moved")))
        label = after.select("id", F.col("new").alias("least"))
        if after.filter("moved").isEmpty():
            return label.filter("least <> id")
