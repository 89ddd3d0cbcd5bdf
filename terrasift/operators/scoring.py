"""Scoring of placements against reference runs, with axis-parallel boxes in exact rectangle arithmetic.

Boxes: model, segment, x0, y0, x1, y1. Areas of overlap are computed on the grid of all edges of a segment (coordinate
compression), per segment, so segments are independent of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cover_cells(boxes: DataFrame) -> DataFrame:
    """segment, x0, y0, x1, y1, n, models: cells between neighbouring edges, with how many boxes (models) cover them."""
    edges = lambda a, b, out: boxes.select("segment", F.explode(F.array(a, b)).alias("v")).groupBy("segment").agg(F.array_sort(F.collect_set("v")).alias("e")).select("segment", F.explode(F.transform(F.sequence(F.lit(1), F.size("e") - 1), lambda i: F.struct(F.col("e")[i - 1].alias(out + "0"), F.col("e")[i].alias(out + "1")))).alias("s")).select("segment", "s.*")
    strips = boxes.join(edges("x0", "x1", "cx"), "segment").filter((F.col("x0") <= F.col("cx0")) & (F.col("cx1") <= F.col("x1")))
    cells = strips.join(edges("y0", "y1", "cy"), "segment").filter((F.col("y0") <= F.col("cy0")) & (F.col("cy1") <= F.col("y1")))
    return cells.groupBy("segment", "cx0", "cx1", "cy0", "cy1").agg(F.count("*").alias("n"), F.countDistinct("model").alias("models"), F.collect_set("model").alias("by"))


def coverage_area(boxes: DataFrame, k: int) -> DataFrame:
    """segment, area covered by at least k boxes."""
    return cover_cells(boxes).filter(F.col("n") >= k).groupBy("segment").agg(F.sum((F.col("cx1") - F.col("cx0")) * (F.col("cy1") - F.col("cy0"))).alias("area"))


def score(candidate: DataFrame, references: DataFrame) -> DataFrame:
    """segment, precision, recall, iou, scale, score: candidate boxes against what at least half of the reference models
    cover. Segments the candidate leaves out score 0. scale: the smaller of both areas over the larger."""
    k = references.groupBy("segment").agg(F.ceil(F.countDistinct("model") / 2).alias("k"))
    both = cover_cells(candidate.withColumn("model", F.lit("\0")).unionByName(references)).join(k, "segment")
    ours = F.array_contains("by", "\0")
    theirs = F.size(F.filter("by", lambda m: m != "\0")) >= F.col("k")
    area = (F.col("cx1") - F.col("cx0")) * (F.col("cy1") - F.col("cy0"))
    sums = both.groupBy("segment").agg(F.sum(F.when(ours, area).otherwise(0.0)).alias("a"), F.sum(F.when(theirs, area).otherwise(0.0)).alias("b"), F.sum(F.when(ours & theirs, area).otherwise(0.0)).alias("c"))
    precision, recall, iou = F.col("c") / F.nullif("a", F.lit(0.0)), F.col("c") / F.nullif("b", F.lit(0.0)), F.col("c") / F.nullif(F.col("a") + F.col("b") - F.col("c"), F.lit(0.0))
    scale = F.when((F.col("a") > 0) & (F.col("b") > 0), F.least("a", "b") / F.greatest("a", "b")).otherwise(0.0)
    out = sums.select("segment", precision.alias("precision"), recall.alias("recall"), iou.alias("iou"), scale.alias("scale"))
    parts = F.filter(F.array("precision", "recall", "iou"), lambda x: x.isNotNull())
    mean = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(parts), F.lit(0))
    return out.withColumn("score", F.coalesce(F.col("scale") * mean, F.lit(0.0)))
