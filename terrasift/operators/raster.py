"""Raster operators over cell tables (raster, r, c, z): zonal and focal statistics, terrain, georeferencing.

Neighbourhoods are equi-joins on shifted row and column numbers or windows over rows, so a raster of any size is spread
over all tasks; what has to be done in order, labelling and flooding, is done by squares whose edges are then matched.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions import flow

#: Cells along the side of a square by which zones meet cells.
TILE = 64
AROUND = flow.AROUND


def zonal_stats(cells: DataFrame, boxes: DataFrame, size: float, zone: str = "zone") -> DataFrame:
    """zone, raster, n, min, max, mean of the raster's valid cells whose centre is in the zone's box. Boxes (zone, raster, x0,
    y0, x1, y1) are cut to whole rows and columns first and to squares of TILE cells, so that zones meet cells by an equi-join
    on the raster and the square, and a range."""
    whole = boxes.select(zone, "raster", *(F.ceil(F.col(a) / size - 0.5).alias(b) for a, b in (("y0", "r0"), ("x0", "c0"))), *(F.floor(F.col(a) / size - 0.5).alias(b) for a, b in (("y1", "r1"), ("x1", "c1"))))
    square = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / TILE), F.floor(F.col(b) / TILE)))
    squares = whole.filter("r0 <= r1 and c0 <= c1").withColumn("_r", square("r0", "r1")).withColumn("_c", square("c0", "c1"))
    valid = cells.filter(F.col("z").isNotNull() & ~F.isnan("z")).withColumn("_r", F.floor(F.col("r") / TILE)).withColumn("_c", F.floor(F.col("c") / TILE))
    joined = valid.join(squares, ["raster", "_r", "_c"]).filter(F.col("r").between(F.col("r0"), F.col("r1")) & F.col("c").between(F.col("c0"), F.col("c1")))
    return joined.groupBy(zone, "raster").agg(F.count("*").alias("n"), F.min("z").alias("min"), F.max("z").alias("max"), F.avg("z").alias("mean"))


def focal_min(cells: DataFrame, radius: int) -> DataFrame:
    """raster, r, c, low: the least value within the radius (in cells, of centres). Each cell sends its value to its
    neighbours, summed up before the shuffle."""
    shifts = F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in range(-radius, radius + 1) for dc in range(-radius, radius + 1) if dr * dr + dc * dc <= radius * radius))
    sent = cells.select("raster", "r", "c", "z", F.explode(shifts).alias("s")).select("raster", (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"), "z")
    low = sent.groupBy("raster", "r", "c").agg(F.min("z").alias("low"))
    return low.join(cells.select("raster", "r", "c"), ["raster", "r", "c"], "left_semi")


def slopes(cells: DataFrame, size: float) -> DataFrame:
    """raster, r, c, dx, dy: central differences, one-sided at the edges, 0 where there is no neighbour."""
    row, col = Window.partitionBy("raster", "r").orderBy("c"), Window.partitionBy("raster", "c").orderBy("r")

    def gradient(at: str, w):
        before = F.when(F.lag(at).over(w) == F.col(at) - 1, F.lag("z").over(w))
        after = F.when(F.lead(at).over(w) == F.col(at) + 1, F.lead("z").over(w))
        steps = before.isNotNull().cast("int") + after.isNotNull().cast("int")
        return F.when(steps > 0, (F.coalesce(after, F.col("z")) - F.coalesce(before, F.col("z"))) / (steps * size)).otherwise(0.0)

    return cells.withColumn("dx", gradient("c", row)).withColumn("dy", gradient("r", col)).select("raster", "r", "c", "dx", "dy")


def hillshade(cells: DataFrame, size: float, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """raster, r, c, shade from 0 to 1."""
    s = slopes(cells, size)
    zenith, turn = np.radians(90 - altitude), np.radians((360 - azimuth + 90) % 360)
    slope, aspect = F.atan(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)), F.atan2(F.col("dy"), -F.col("dx"))
    shade = float(np.cos(zenith)) * F.cos(slope) + float(np.sin(zenith)) * F.sin(slope) * F.cos(F.lit(float(turn)) - aspect)
    return s.select("raster", "r", "c", F.greatest(shade, F.lit(0.0)).alias("shade"))


#: Cells along the side of a square that one task floods at once.
SQUARE = 256


def _around(df: DataFrame, side: int, own: bool) -> DataFrame:
    """Rows (raster, r, c, ...) for each square whose cells touch theirs: _r, _c; with own, for their own square too."""
    at = lambda c: F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor((F.col(c) + d) / side)))
    near = df.withColumn("_r", F.explode(at("r"))).withColumn("_c", F.explode(at("c")))
    return near if own else near.filter((F.col("_r") != F.floor(F.col("r") / side)) | (F.col("_c") != F.floor(F.col("c") / side)))


def fill(cells: DataFrame, keep: Callable[[DataFrame], DataFrame], step: float = flow.STEP, side: int = SQUARE) -> DataFrame:
    """raster, r, c, z with sinks raised to where they spill over, each step inwards a little higher; water leaves where a
    neighbour is missing.

    A square is flooded by itself first. Then only heights of cells on its edge travel: a square is flooded again from
    what its neighbours' edges came to, as long as that lowers an edge, so a round works on squares whose surroundings have
    changed, and there are as many rounds as squares that the longest flooded path crosses. keep(df) writes a round. The
    surface is the same as that of one flood over the whole raster.
    """
    kind = dict(cells.dtypes)["raster"]
    key = ["raster", "_r", "_c"]
    squares = keep(_around(cells.select("raster", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("z").cast("double").alias("z")), side, True).groupBy(*key).agg(F.collect_list(F.struct("r", "c", "z")).alias("cells")))
    squares = squares.filter(F.exists("cells", lambda x: (F.floor(x.r / side) == F.col("_r")) & (F.floor(x.c / side) == F.col("_c"))))

    def flood(edges: bool):
        def run(frames):
            for f in frames:
                for raster, tr, tc, own, given in zip(f["raster"], f["_r"], f["_c"], f["cells"], f["given"], strict=True):
                    r0, c0 = tr * side - 1, tc * side - 1
                    z, level = np.full((side + 2, side + 2), np.inf), np.full((side + 2, side + 2), np.inf)
                    for x in own:
                        z[x["r"] - r0, x["c"] - c0] = x["z"]
                    here = np.isfinite(z)
                    open_ = np.zeros_like(here)
                    for dr, dc in AROUND:
                        open_[1:-1, 1:-1] |= ~here[1 + dr : side + 1 + dr, 1 + dc : side + 1 + dc]
                    level[open_ & here] = z[open_ & here]
                    for x in given if given is not None else ():
                        level[x["r"] - r0, x["c"] - c0] = x["v"]
                    out = flow.raised(z, level, step)
                    take = np.zeros_like(here)
                    take[1:-1, 1:-1] = here[1:-1, 1:-1]
                    if edges:
                        take[2:-2, 2:-2] = False
                        take &= np.isfinite(out)
                    r, c = np.nonzero(take)
                    yield pd.DataFrame({"raster": raster, "r": r + r0, "c": c + c0, "v": out[take]})

        return run

    fields = f"raster {kind}, r long, c long, v double"
    asked = lambda given: given.groupBy(*key).agg(F.collect_list(F.struct("r", "c", "v")).alias("given"))
    none = F.lit(None).cast("array<struct<r: bigint, c: bigint, v: double>>")
    edge = keep(squares.withColumn("given", none).mapInPandas(flood(True), fields))
    changed = edge
    while True:
        stirred = _around(changed, side, False).select(*key).distinct()
        given = asked(_around(edge, side, False).join(stirred, key, "left_semi"))
        fresh = squares.join(given, key).mapInPandas(flood(True), fields)
        before = edge.withColumnRenamed("v", "before")
        changed = keep(fresh.join(before, ["raster", "r", "c"], "left").filter("before is null or v < before").select("raster", "r", "c", "v"))
        if changed.isEmpty():
            break
        edge = keep(edge.union(changed).groupBy("raster", "r", "c").agg(F.min("v").alias("v")))
    done = squares.join(asked(_around(edge, side, False)), key, "left").select(*key, "cells", "given").mapInPandas(flood(False), fields)
    return done.withColumnRenamed("v", "z")


def receivers(cells: DataFrame, size: float = 1.0) -> DataFrame:
    """raster, r, c, to_r, to_c: the neighbour of steepest descent (null for none; least row, then column wins ties)."""
    shifts = F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(float(np.hypot(dr, dc)) * size).alias("d")) for dr, dc in AROUND))
    sent = cells.select("raster", F.explode(shifts).alias("s"), "r", "c", "z").select("raster", (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"), F.col("r").alias("from_r"), F.col("c").alias("from_c"), F.col("z").alias("low"), F.col("s.d").alias("d"))
    down = cells.join(sent, ["raster", "r", "c"]).withColumn("drop", (F.col("z") - F.col("low")) / F.col("d")).filter("drop > 0")
    best = down.groupBy("raster", "r", "c").agg(F.max_by(F.struct("from_r", "from_c"), F.struct("drop", -F.col("from_r"), -F.col("from_c"))).alias("to"))
    return cells.select("raster", "r", "c").join(best, ["raster", "r", "c"], "left").select("raster", "r", "c", F.col("to.from_r").alias("to_r"), F.col("to.from_c").alias("to_c"))


def watershed(tree: DataFrame, outlets: DataFrame, checkpoint, rounds: int = 10_000) -> DataFrame:
    """raster, r, c, outlet: cells that drain to the outlets (raster, r, c, outlet), by pointer doubling over receivers:
    as many rounds as the logarithm of the longest path."""
    own = outlets.select("raster", F.col("r").alias("to_r"), F.col("c").alias("to_c"), "outlet")
    # An outlet and a cell without a receiver end their paths.
    jump = tree.join(outlets.select("raster", "r", "c", F.lit(True).alias("stop")), ["raster", "r", "c"], "left")
    end = F.col("stop").isNotNull() | F.col("to_r").isNull()
    jump = checkpoint(jump.select("raster", "r", "c", F.when(end, F.col("r")).otherwise(F.col("to_r")).alias("to_r"), F.when(end, F.col("c")).otherwise(F.col("to_c")).alias("to_c")))
    for _ in range(rounds):
        nxt = jump.select("raster", F.col("r").alias("to_r"), F.col("c").alias("to_c"), F.col("to_r").alias("far_r"), F.col("to_c").alias("far_c"))
        far = checkpoint(jump.join(nxt, ["raster", "to_r", "to_c"]).select("raster", "r", "c", F.col("far_r").alias("to_r"), F.col("far_c").alias("to_c"), ((F.col("far_r") != F.col("to_r")) | (F.col("far_c") != F.col("to_c"))).alias("moved")))
        moved = far.filter("moved").isEmpty()
        jump = far.drop("moved")
        if moved:
            return jump.join(own, ["raster", "to_r", "to_c"]).select("raster", "r", "c", "outlet")
    raise RuntimeError("receivers in a circle")


def accumulate(tree: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """raster, r, c, through: how many cells drain through each cell, itself included, over receivers (to_r, to_c).

    Pointer doubling with partial sums: with each round a cell gives the sum of the paths that it knows to the cell twice as
    far down, so there are as many rounds as the logarithm of the longest path. Sums are made before they are shuffled."""
    at = ["raster", "r", "c"]
    now = keep(tree.select(*at, "to_r", "to_c", F.lit(1).cast("long").alias("through")))
    while not now.filter("to_r is not null").isEmpty():
        given = now.filter("to_r is not null").groupBy("raster", F.col("to_r").alias("r"), F.col("to_c").alias("c")).agg(F.sum("through").alias("more"))
        far = now.filter("to_r is not null").select("raster", F.col("r").alias("to_r"), F.col("c").alias("to_c"), F.col("to_r").alias("far_r"), F.col("to_c").alias("far_c"))
        step = now.join(given, at, "left").join(far, ["raster", "to_r", "to_c"], "left")
        now = keep(step.select(*at, F.col("far_r").alias("to_r"), F.col("far_c").alias("to_c"), (F.col("through") + F.coalesce("more", F.lit(0))).alias("through")))
    return now.select(*at, "through")


def snap(accumulation: DataFrame, points: DataFrame, n: int, point: str = "point") -> DataFrame:
    """raster, point, r, c: points (raster, point, r, c) moved to the cell of greatest accumulation within n rows and columns
    (least row, then column wins ties). Points meet the cells of the squares that they reach into."""
    square = lambda c: F.explode(F.sequence(F.floor((F.col(c) - n) / TILE), F.floor((F.col(c) + n) / TILE)))
    near = points.select("raster", point, F.col("r").alias("pr"), F.col("c").alias("pc"), square("r").alias("_r"), "c").withColumn("_c", square("c")).drop("c")
    cells = accumulation.withColumn("_r", F.floor(F.col("r") / TILE)).withColumn("_c", F.floor(F.col("c") / TILE))
    met = cells.join(near, ["raster", "_r", "_c"]).filter((F.abs(F.col("r") - F.col("pr")) <= n) & (F.abs(F.col("c") - F.col("pc")) <= n))
    best = met.groupBy("raster", point).agg(F.max_by(F.struct("r", "c"), F.struct("through", -F.col("r"), -F.col("c"))).alias("at"))
    return best.select("raster", point, "at.*")


def channel_height(cells: DataFrame, beds: DataFrame, reach: int, size: float, height: float) -> DataFrame:
    """raster, r, c, above: cells within `reach` cells of a bed sample (raster, r, c, z) and at most `height` above the
    nearest one (least row, then column wins ties). Bed samples go to the cells around them, the nearest one stays."""
    shifts = F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(dr * dr + dc * dc).alias("d")) for dr in range(-reach, reach + 1) for dc in range(-reach, reach + 1) if dr * dr + dc * dc <= reach * reach))
    sent = beds.select("raster", F.explode(shifts).alias("s"), "r", "c", F.col("z").alias("bed")).select("raster", (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"), F.struct(F.col("s.d").alias("d"), F.col("r").alias("br"), F.col("c").alias("bc")).alias("near"), "bed")
    nearest = sent.groupBy("raster", "r", "c").agg(F.min_by("bed", "near").alias("bed"))
    return cells.join(nearest, ["raster", "r", "c"]).select("raster", "r", "c", (F.col("z") - F.col("bed")).alias("above")).filter(F.col("above") <= height)


def affine_fit(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., ax, bx, cx, ay, by, cy, rms, n: least squares of x = ax + bx u + cx v and y = ay + by u + cy v over points
    (u, v, x, y), from sums alone (centred, by Cramer's rule). Fewer than three points, or points in line, give nulls."""
    means = points.groupBy(*keys).agg(*(F.avg(c).alias(f"m{c}") for c in "uvxy"), F.count("*").alias("n"))
    c = points.join(means, keys) if keys else points.crossJoin(F.broadcast(means))
    d = {k: F.col(k) - F.col(f"m{k}") for k in "uvxy"}
    pairs = ("uu", "uv", "vv", "ux", "vx", "xx", "uy", "vy", "yy")
    s = c.groupBy(*keys).agg(*(F.sum(d[a] * d[b]).alias(f"s{a}{b}") for a, b in pairs), *(F.first(f"m{k}").alias(f"m{k}") for k in "uvxy"), F.first("n").alias("n"))
    det = F.col("suu") * F.col("svv") - F.col("suv") ** 2
    ok = (F.col("n") >= 3) & (det > 1e-12 * F.col("suu") * F.col("svv"))
    out: dict[str, Column] = {}
    rest = F.lit(0.0)
    for k in "xy":
        b = (F.col(f"su{k}") * F.col("svv") - F.col(f"sv{k}") * F.col("suv")) / det
        v = (F.col(f"sv{k}") * F.col("suu") - F.col(f"su{k}") * F.col("suv")) / det
        out |= {f"b{k}": F.when(ok, b), f"c{k}": F.when(ok, v), f"a{k}": F.when(ok, F.col(f"m{k}") - b * F.col("mu") - v * F.col("mv"))}
        rest = rest + F.greatest(F.col(f"s{k}{k}") - b * F.col(f"su{k}") - v * F.col(f"sv{k}"), F.lit(0.0))
    return s.select(*keys, *(v.alias(k) for k, v in out.items()), F.when(ok, F.sqrt(rest / F.col("n"))).alias("rms"), "n")


def resample(cells: DataFrame, every: int, size: float) -> DataFrame:
    """raster, r, c, z: bilinear values at each `every`-th corner between cells."""
    base = cells.select("raster", "z", "r", "c")
    sent = base.select("raster", "z", F.explode(F.array(*(F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr in (0, 1) for dc in (0, 1)))).alias("n"))
    at = sent.select("raster", "n.*", "z").filter((F.col("r") % every == 0) & (F.col("c") % every == 0))
    return at.groupBy("raster", "r", "c").agg(F.avg("z").alias("z"), F.count("*").alias("k")).filter("k = 4").drop("k")
