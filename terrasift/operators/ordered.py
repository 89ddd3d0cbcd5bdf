"""Windows over groups that may be large: a group is cut into stretches of its order, each a window of its own.

What a stretch needs from those before and after it (a count, a least value, the nearest known value) is one row a stretch;
these rows are put in order in a second, small window and joined back. So no task holds a group, whatever its share of all
rows and however uneven its order; the order has to be a number.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.shared import written

#: Stretches of the order, of about as many rows each.
STRETCHES = 256


def _cut(df: DataFrame, order: str) -> DataFrame:
    """Adds the stretch of each row: bounds are quantiles of the order over all rows, so no range of it, however crowded or far
    off, fills a stretch. Only equal orders can't be parted. Nulls come first."""
    bounds = sorted(set(df.approxQuantile(order, [k / STRETCHES for k in range(1, STRETCHES)], 0.2 / STRETCHES)))
    if not bounds:
        return df.withColumn("_s", F.lit(-1).cast("long"))
    made = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="_o", outputCol="_s", handleInvalid="keep").transform(df.withColumn("_o", F.col(order).cast("double")))
    return made.withColumn("_s", F.when(F.col("_o").isNull(), -1).otherwise(F.col("_s")).cast("long")).drop("_o")


def _joined(df: DataFrame, rows: DataFrame, group: list[str]) -> DataFrame:
    """df with the columns that rows has for its group and stretch; null groups are a group."""
    names = [f"_g{i}" for i in range(len(group))]
    small = rows.withColumnsRenamed(dict(zip(group, names, strict=True))).withColumnRenamed("_s", "_t")
    on = F.col("_s") == F.col("_t")
    for g, n in zip(group, names, strict=True):
        on = on & F.col(g).eqNullSafe(F.col(n))
    return df.join(small, on).drop(*names, "_t")


def row_numbers(df: DataFrame, group: list[str], order: str, name: str = "row", tie: list[str] | None = None) -> DataFrame:
    """Adds the number of each row in its group (from 1)."""
    cut = _cut(df, order)
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    rows = cut.groupBy(*group, "_s").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*group, "_s").orderBy(order, *(tie or [])))
    return _joined(cut.withColumn("_own", own), rows, group).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_s")


def running_min(df: DataFrame, group: list[str], order: str, value: Column, name: str) -> DataFrame:
    """Adds the least value so far, this row's included."""
    cut = _cut(df.withColumn("_v", value), order)
    before = F.min("_m").over(Window.partitionBy(*group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    rows = cut.groupBy(*group, "_s").agg(F.min("_v").alias("_m")).withColumn("_before", before).drop("_m")
    own = F.min("_v").over(Window.partitionBy(*group, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return _joined(cut.withColumn("_own", own), rows, group).withColumn(name, F.least("_own", "_before")).drop("_own", "_before", "_s", "_v")


def running_sum(df: DataFrame, group: list[str], order: str, value: Column, name: str, tie: list[str] | None = None) -> DataFrame:
    """Adds the sum so far, this row's value included."""
    cut = _cut(df.withColumn("_v", value), order)
    before = F.sum("_m").over(Window.partitionBy(*group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    rows = cut.groupBy(*group, "_s").agg(F.sum("_v").alias("_m")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_m")
    own = F.sum("_v").over(Window.partitionBy(*group, "_s").orderBy(order, *(tie or [])).rowsBetween(Window.unboundedPreceding, 0))
    return _joined(cut.withColumn("_own", own), rows, group).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_s", "_v")


def neighbours(df: DataFrame, group: list[str], order: str, value: Column, left: str | None = None, right: str | None = None, tie: list[str] | None = None) -> DataFrame:
    """Adds the nearest value before a row, and after it, that isn't null. Rows of equal order go by the columns of tie; without
    them by the value, nulls first."""
    cut = _cut(df.withColumn("_v", value), order)
    tie = tie or ["_v"]
    place = F.when(F.col("_v").isNotNull(), F.struct(F.col(order).alias("o"), *(F.col(t).alias(f"t{i}") for i, t in enumerate(tie)), F.col("_v").alias("v")))
    ends = cut.groupBy(*group, "_s").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    w = Window.partitionBy(*group).orderBy("_s")
    ends = ends.withColumn("_pre", F.last("_last.v", True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_post", F.first("_first.v", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    own = Window.partitionBy(*group, "_s").orderBy(order, *tie)
    out = _joined(cut, ends.drop("_first", "_last"), group)
    for name, found in ((left, F.coalesce(F.last("_v", True).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.col("_pre"))), (right, F.coalesce(F.first("_v", True).over(own.rowsBetween(1, Window.unboundedFollowing)), F.col("_post")))):
        if name:
            out = out.withColumn(name, found)
    return out.drop("_pre", "_post", "_s", "_v")


#: Share of a group's values to either side of its middle that a sketch brackets, and different values that one task puts in order.
NEAR, MANY = 0.002, 1 << 20


def _on(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def medians(df: DataFrame, keys: list[str], value: str, many: int = MANY) -> DataFrame:
    """keys..., median: exact, and null where a group has no values.

    A quantile sketch of each group brackets its middle by values, however they are spread; what is below is counted, values
    inside are counted one by one, equal ones together. As long as a group has more than `many` different values inside, the
    bracket is made smaller by the same means. So no task holds a group's values.
    """
    v = df.select(*keys, F.col(value).cast("double").alias("_v"))
    sketch = F.percentile_approx("_v", F.array(F.lit(0.5 - NEAR), F.lit(0.5 + NEAR)), F.lit(int(2 / NEAR)))
    ends = written(v.groupBy(*keys).agg(sketch.alias("_q"), F.count("_v").alias("_n")))
    own = v.filter("_v is not null").alias("a").join(ends.alias("b"), _on("a", "b", keys)).select(*(F.col(f"a.{k}") for k in keys), "_v", F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"), "_n")
    # Values below the bracket are one row of a group: the null value.
    counted = own.filter(F.col("_v") <= F.col("_hi")).groupBy(*keys, F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_k"), F.first("_n").alias("_n"))
    counted = written(counted)
    while counted.groupBy(*keys).agg(F.count("_v").alias("d")).filter(F.col("d") > many).limit(1).count():
        counted = written(_closer(counted, keys))
    seen = F.sum("_k").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0))
    inside = counted.withColumn("_end", seen)
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    at = lambda r: F.min(F.when(F.col("_end") > r, F.col("_v")))
    found = inside.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("median"))
    return ends.alias("a").join(found.alias("b"), _on("a", "b", keys), "left").select(*(F.col(f"a.{k}") for k in keys), "median")


def _closer(counted: DataFrame, keys: list[str], cuts: int = 64) -> DataFrame:
    """Counted values (keys, _v, _k, _n; null: those below) with only the parts around the middle left, the rest put to those below."""
    splits = counted.groupBy(*keys).agg(F.percentile_approx("_v", F.array(*(F.lit(k / cuts) for k in range(1, cuts))), F.lit(10 * cuts)).alias("_q"))
    part = F.when(F.col("_v").isNull(), -1).otherwise(F.size(F.filter("_q", lambda q: q < F.col("_v"))))
    cut = counted.alias("a").join(splits.alias("b"), _on("a", "b", keys)).select(*(F.col(f"a.{k}") for k in keys), "_v", "_k", "_n", part.alias("_c"))
    parts = cut.groupBy(*keys, "_c").agg(F.sum("_k").alias("_m"), F.first("_n").alias("_n"))
    end = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("_end", end)
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    # Parts that end at or before the lower middle are below; those that start behind the upper one don't matter.
    kind = F.when(F.col("_end") <= low, "below").when(F.col("_end") - F.col("_m") > high, "above").otherwise("inside")
    told = cut.alias("a").join(parts.select(*keys, "_c", kind.alias("_kind")).alias("b"), _on("a", "b", [*keys, "_c"])).filter("_kind <> 'above'")
    return told.groupBy(*(F.col(f"a.{k}") for k in keys), F.when(F.col("_kind") == "inside", F.col("_v")).alias("_v")).agg(F.sum("_k").alias("_k"), F.first("_n").alias("_n"))
