"""Spatial joins, chainage and raster operators. Vectors stand for points and boxes, line items for raster cells."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from terrasift.functions import expressions, geometry
from terrasift.operators import raster, spatial
from terrasift.plans.registry import query, table
from terrasift.shared import checkpointer


def _points(spark, sf_dir, signed: bool = False):
    """Places made of vectors; with signed, small negative numbers are rounded to -0.0, as SQL has it, where F.round has 0.0."""
    value = lambda k: F.col("embedding")[k].cast("double") * 1000
    at = lambda k: F.when(F.round(value(k)) == 0, value(k) * 0.0).otherwise(F.round(value(k))) if signed else F.round(value(k))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", at(0).alias("x"), at(1).alias("y"), (5 + F.abs(at(2))).alias("w"))


_PTS = "p AS (SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE) * 1000) AS x, round(CAST(embedding[2] AS DOUBLE) * 1000) AS y, 5 + abs(round(CAST(embedding[3] AS DOUBLE) * 1000)) AS w FROM embeddings)"


@query(f"WITH {_PTS} SELECT a.vec_id, b.vec_id AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM p a JOIN p b ON a.vec_id < b.vec_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 20")
def distance_join(spark, sf_dir):
    p = spatial.as_box(_points(spark, sf_dir))
    return spatial.within_distance(p, p.withColumnRenamed("vec_id", "other"), "vec_id", "other", 20.0).filter("vec_id < other")


@query(f"""WITH {_PTS}, d AS (SELECT a.vec_id, b.vec_id AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM p a JOIN p b ON a.label <> 0 AND b.label = 0)
SELECT vec_id, arg_min(other, (distance, other)) AS other, min(distance) AS distance FROM d GROUP BY vec_id""")
def nearest_one(spark, sf_dir):
    """The nearest point of label 0 of each other point."""
    p = spatial.as_box(_points(spark, sf_dir))
    return spatial.nearest(p.filter("label <> 0"), p.filter("label = 0").withColumnRenamed("vec_id", "other"), "vec_id", "other", 10.0, checkpointer(spark))


def _boxes(spark, sf_dir):
    p = _points(spark, sf_dir)
    return p.select("vec_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("w")).alias("y1"))


@query(f"""WITH {_PTS} SELECT a.vec_id, min(b.vec_id) AS first FROM p a JOIN p b ON b.vec_id < a.vec_id AND greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.x + a.w - b.x - b.w), abs(a.y + a.w - b.y - b.w)) <= 12
  AND abs(a.w * a.w - b.w * b.w) <= 0.3 * greatest(a.w * a.w, b.w * b.w) GROUP BY a.vec_id""")
def same_feature(spark, sf_dir):
    """Features drawn twice: the first one that is alike."""
    return spatial.same_features(_boxes(spark, sf_dir), "vec_id", 0.3, 12.0)


@query(f"""WITH {_PTS} SELECT a.vec_id, b.vec_id AS catchment FROM p a JOIN p b ON b.vec_id % 10 = 0 AND a.vec_id % 10 <> 0
  AND greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.w, b.y + b.w) - greatest(a.y, b.y), 0) > 0.5 * a.w * a.w""")
def catchment_membership(spark, sf_dir):
    """Boxes with more than half their area inside a catchment."""
    b = _boxes(spark, sf_dir)
    near = spatial.within_distance(b.filter("vec_id % 10 <> 0"), b.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "catchment"), "vec_id", "catchment", 1.0, 60.0)
    j = near.join(b, "vec_id").join(b.select(F.col("vec_id").alias("catchment"), *(F.col(c).alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1"))), "catchment")
    side = lambda a, z: F.greatest(F.least(z, f"o_{z}") - F.greatest(a, f"o_{a}"), F.lit(0.0))
    return j.filter(side("x0", "x1") * side("y0", "y1") > 0.5 * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).select("vec_id", "catchment")


@query("""
WITH a AS (SELECT o_custkey AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 10 AS value, o_totalprice AS p FROM orders),
an AS (SELECT line, value, sum(p) OVER (PARTITION BY line ORDER BY value) / 1000 AS d FROM a), s AS (SELECT DISTINCT line, CAST(k AS DOUBLE) AS value FROM an, (VALUES (5), (17), (20), (33), (400)) t(k)),
r AS (SELECT s.line, s.value, (SELECT max(value) FROM an WHERE an.line = s.line AND an.value <= s.value) AS lo, (SELECT min(value) FROM an WHERE an.line = s.line AND an.value > s.value) AS hi FROM s)
SELECT r.line, r.value, round(CASE WHEN lo IS NULL THEN h.d + (r.value - hi) WHEN hi IS NULL THEN l.d + (r.value - lo) ELSE l.d + (r.value - lo) / (hi - lo) * (h.d - l.d) END, 6) AS distance
FROM r LEFT JOIN an l ON l.line = r.line AND l.value = lo LEFT JOIN an h ON h.line = r.line AND h.value = hi
""")
def chainage_lookup(spark, sf_dir):
    """Stations between anchors, piecewise linear; shifted beyond the outer anchors."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("line"), (F.row_number().over(w) * 10).cast("double").alias("value"), (F.sum("o_totalprice").over(w) / 1000).alias("at"))
    stations = o.select("line").distinct().select("line", F.explode(F.array(*(F.lit(float(k)) for k in (5, 17, 20, 33, 400)))).alias("value"))
    return spatial.chainage_lookup(stations, o).withColumn("distance", F.round("distance", 6))


def _cells(spark, sf_dir):
    """A raster of 60 columns from line items in order of their keys."""
    k = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("z"))
    return k.select(F.lit("dem").alias("raster"), F.floor((F.col("l_orderkey") / 4) / 60).alias("r"), F.floor((F.col("l_orderkey") / 4) % 60).alias("c"), "z").groupBy("raster", "r", "c").agg(F.min("z").alias("z"))


_CELLS = "k AS (SELECT l_orderkey, min(l_quantity) AS z FROM lineitem GROUP BY l_orderkey), cells AS (SELECT CAST(floor((l_orderkey / 4.0) / 60) AS BIGINT) AS r, CAST(floor((l_orderkey / 4.0) % 60) AS BIGINT) AS c, min(z) AS z FROM k GROUP BY ALL)"


def _two(spark, sf_dir):
    """Two rasters on the same grid: the second has other values, and holes."""
    cells = _cells(spark, sf_dir)
    return cells.unionByName(cells.filter("(r + c) % 5 <> 0").withColumn("raster", F.lit("dsm")).withColumn("z", F.col("z") * 2 + F.col("c")))


_TWO = f"{_CELLS}, two AS (SELECT 'dem' AS raster, r, c, z FROM cells UNION ALL SELECT 'dsm', r, c, z * 2 + c FROM cells WHERE (r + c) % 5 <> 0)"


@query(f"WITH {_TWO}, zones AS (SELECT i AS zone, CASE WHEN i % 3 = 0 THEN 'dsm' ELSE 'dem' END AS raster, i * 7.0 AS x0, i * 3.0 AS y0, i * 7.0 + 9 AS x1, i * 3.0 + 8 AS y1 FROM range(0, 12) t(i)) SELECT zone, raster, count(*) AS n, min(z) AS min, max(z) AS max, round(avg(z), 9) AS mean FROM two JOIN zones USING (raster) WHERE c + 0.5 BETWEEN x0 AND x1 AND r + 0.5 BETWEEN y0 AND y1 GROUP BY zone, raster")
def zonal_stats(spark, sf_dir):
    """Statistics of zones of two rasters, each over its own cells."""
    i = F.col("id")
    zones = spark.range(12).select(i.alias("zone"), F.when(i % 3 == 0, "dsm").otherwise("dem").alias("raster"), (i * 7.0).alias("x0"), (i * 3.0).alias("y0"), (i * 7.0 + 9).alias("x1"), (i * 3.0 + 8).alias("y1"))
    return raster.zonal_stats(_two(spark, sf_dir), zones, 1.0).withColumn("mean", F.round("mean", 9))


@query(f"WITH {_CELLS} SELECT a.r, a.c, min(b.z) AS low FROM cells a JOIN cells b ON (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 4 GROUP BY a.r, a.c")
def focal_min(spark, sf_dir):
    return raster.focal_min(_cells(spark, sf_dir), 2).drop("raster")


@query(f"""WITH {_CELLS}, d AS (SELECT a.r, a.c, b.r AS br, b.c AS bc, (a.z - b.z) / sqrt((a.r - b.r) ** 2 + (a.c - b.c) ** 2) AS fall FROM cells a JOIN cells b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r, a.c) <> (b.r, b.c) WHERE a.z > b.z),
best AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY fall DESC, br, bc) AS n FROM d) SELECT cells.r, cells.c, br AS to_r, bc AS to_c FROM cells LEFT JOIN best ON best.r = cells.r AND best.c = cells.c AND best.n = 1""")
def flow_receivers(spark, sf_dir):
    return raster.receivers(_cells(spark, sf_dir)).drop("raster")


_SHIFTS = "(VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) s(dr, dc)"
#: Each pass raises every cell to what its lowest neighbour asks for, until a pass changes nothing.
_FILLED = f"""{_CELLS}, near AS MATERIALIZED (SELECT a.r, a.c, a.z, b.r AS nr, b.c AS nc FROM cells a, {_SHIFTS} JOIN cells b ON b.r = a.r + dr AND b.c = a.c + dc),
flood AS (
  SELECT 0 AS k, cells.r, cells.c, cells.z, CASE WHEN count(near.r) < 8 THEN cells.z END AS f, true AS moved FROM cells LEFT JOIN near ON near.r = cells.r AND near.c = cells.c GROUP BY cells.r, cells.c, cells.z
  UNION ALL
  SELECT k + 1, r, c, any_value(z), min(f), bool_or(min(f) IS DISTINCT FROM min(f) FILTER (own)) OVER ()
  FROM (SELECT k, r, c, z, f, true AS own FROM flood WHERE moved
        UNION ALL SELECT k, n.r, n.c, n.z, CASE WHEN n.z > f THEN n.z ELSE f + 1e-4 END, false FROM flood JOIN near n ON n.nr = flood.r AND n.nc = flood.c WHERE moved AND f IS NOT NULL)
  GROUP BY k, r, c),
filled AS MATERIALIZED (SELECT r, c, f AS z FROM flood WHERE k = (SELECT max(k) FROM flood))"""
_TREE = f"""{_FILLED}, fall AS (SELECT a.r, a.c, b.r AS to_r, b.c AS to_c, row_number() OVER (PARTITION BY a.r, a.c ORDER BY (a.z - b.z) / sqrt(dr * dr + dc * dc) DESC, b.r, b.c) AS n
  FROM filled a, {_SHIFTS} JOIN filled b ON b.r = a.r + dr AND b.c = a.c + dc WHERE a.z > b.z),
tree AS MATERIALIZED (SELECT r, c, to_r, to_c FROM fall WHERE n = 1),
walk AS (SELECT r AS r0, c AS c0, r, c FROM cells UNION ALL SELECT r0, c0, to_r, to_c FROM walk JOIN tree USING (r, c)),
through AS MATERIALIZED (SELECT r, c, count(*) AS through FROM walk GROUP BY r, c)"""


@query(f"WITH RECURSIVE {_FILLED} SELECT r, c, z FROM filled")
def filled_surface(spark, sf_dir):
    """Sinks raised to where they spill over, square by square."""
    return raster.fill(_cells(spark, sf_dir), checkpointer(spark), side=24).drop("raster")


def _drained(spark, sf_dir):
    keep = checkpointer(spark)
    return keep(raster.receivers(keep(raster.fill(_cells(spark, sf_dir), keep, side=48)))), keep


@query(f"WITH RECURSIVE {_TREE} SELECT 'dem' AS raster, r0 AS r, c0 AS c, CAST(r AS VARCHAR) || '/' || CAST(c AS VARCHAR) AS outlet FROM walk ANTI JOIN tree USING (r, c)")
def d8_watershed(spark, sf_dir):
    """Sinks filled, receivers found, and the cells that drain to each cell without a lower neighbour."""
    tree, keep = _drained(spark, sf_dir)
    outlets = tree.filter("to_r is null").select("raster", "r", "c", F.concat_ws("/", "r", "c").alias("outlet"))
    return raster.watershed(tree, outlets, keep)


@query(f"WITH RECURSIVE {_TREE} SELECT r, c, through FROM through")
def flow_accumulation(spark, sf_dir):
    """How many cells drain through each."""
    return raster.accumulate(*_drained(spark, sf_dir)).drop("raster")


@query(f"""WITH RECURSIVE {_TREE}, best AS (
  SELECT p.r AS pr, p.c AS pc, t.r, t.c, through, row_number() OVER (PARTITION BY p.r, p.c ORDER BY through DESC, t.r, t.c) AS n
  FROM cells p JOIN through t ON t.r BETWEEN p.r - 4 AND p.r + 4 AND t.c BETWEEN p.c - 4 AND p.c + 4 WHERE p.r % 11 = 5 AND p.c % 11 = 5),
outlet AS (SELECT DISTINCT r, c, through FROM best WHERE n = 1),
first_ AS (SELECT r0, c0, min(k) AS k FROM (SELECT r0, c0, r, c, through AS k FROM walk JOIN outlet USING (r, c)) GROUP BY r0, c0)
SELECT o.r, o.c, o.through, count(*) AS own FROM outlet o JOIN walk w ON w.r = o.r AND w.c = o.c JOIN first_ f ON f.r0 = w.r0 AND f.c0 = w.c0 AND f.k = o.through GROUP BY o.r, o.c, o.through""")
def snapped_basins(spark, sf_dir):
    """Pour points moved to the strongest flow nearby, all that drains there and what does before it reaches another one."""
    tree, keep = _drained(spark, sf_dir)
    through = keep(raster.accumulate(tree, keep))
    points = tree.filter("r % 11 = 5 and c % 11 = 5").select("raster", F.concat_ws("/", "r", "c").alias("point"), "r", "c")
    outlets = raster.snap(through, points, 4).select("raster", "r", "c").distinct()
    own = raster.watershed(tree, outlets.withColumn("outlet", F.concat_ws("/", "r", "c")), keep).groupBy("raster", "outlet").agg(F.count("*").alias("own"))
    found = outlets.join(through, ["raster", "r", "c"]).withColumn("outlet", F.concat_ws("/", "r", "c"))
    return found.join(own, ["raster", "outlet"]).select("r", "c", "through", "own")


@query(f"""WITH {_CELLS}, b AS (SELECT r, c, z FROM cells WHERE r = 5), d AS (SELECT a.r, a.c, a.z - b.z AS above, row_number() OVER (PARTITION BY a.r, a.c ORDER BY (a.r - b.r) ** 2 + (a.c - b.c) ** 2, b.r, b.c) AS k FROM cells a JOIN b ON (a.r - b.r) ** 2 + (a.c - b.c) ** 2 <= 9)
SELECT r, c, above FROM d WHERE k = 1 AND above <= 10""")
def channel_height(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return raster.channel_height(cells, cells.filter("r = 5"), 3, 1.0, 10.0).drop("raster")


@query(f"""WITH {_CELLS} SELECT r, c, avg(z) AS z FROM (SELECT r + i AS r, c + j AS c, z FROM cells, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)) WHERE r % 3 = 0 AND c % 3 = 0 GROUP BY r, c HAVING count(*) = 4""")
def terrain_resample(spark, sf_dir):
    return raster.resample(_cells(spark, sf_dir), 3, 1.0).drop("raster")


_SLOPES = f"""{_CELLS}, g AS (SELECT a.r, a.c, a.z, w.z AS wz, e.z AS ez, n.z AS nz, s.z AS sz FROM cells a LEFT JOIN cells w ON w.r = a.r AND w.c = a.c - 1 LEFT JOIN cells e ON e.r = a.r AND e.c = a.c + 1 LEFT JOIN cells n ON n.c = a.c AND n.r = a.r - 1 LEFT JOIN cells s ON s.c = a.c AND s.r = a.r + 1),
slopes AS (SELECT r, c, CASE WHEN wz IS NULL AND ez IS NULL THEN 0 ELSE (coalesce(ez, z) - coalesce(wz, z)) / (CASE WHEN wz IS NULL OR ez IS NULL THEN 1 ELSE 2 END) END AS dx,
  CASE WHEN nz IS NULL AND sz IS NULL THEN 0 ELSE (coalesce(sz, z) - coalesce(nz, z)) / (CASE WHEN nz IS NULL OR sz IS NULL THEN 1 ELSE 2 END) END AS dy FROM g)"""


@query(f"WITH {_SLOPES} SELECT r, c, dx, dy FROM slopes")
def raster_gradient(spark, sf_dir):
    return raster.slopes(_cells(spark, sf_dir), 1.0).drop("raster")


@query(f"""WITH {_SLOPES} SELECT r, c, round(greatest(cos(radians(45)) * cos(atan(sqrt(dx ** 2 + dy ** 2))) + sin(radians(45)) * sin(atan(sqrt(dx ** 2 + dy ** 2))) * cos(radians(135) - atan2(dy, -dx)), 0), 9) AS shade FROM slopes""")
def hillshade(spark, sf_dir):
    return raster.hillshade(_cells(spark, sf_dir), 1.0).withColumn("shade", F.round("shade", 9)).drop("raster")


@query("""
WITH p AS (SELECT l_returnflag AS k, l_quantity AS u, l_discount * 100 AS v, l_extendedprice / 1000 AS y FROM lineitem),
m AS (SELECT k, avg(u) AS mu, avg(v) AS mv, avg(y) AS my FROM p GROUP BY k),
s AS (SELECT p.k, sum((u - mu) ** 2) AS uu, sum((u - mu) * (v - mv)) AS uv, sum((v - mv) ** 2) AS vv, sum((u - mu) * (y - my)) AS uy, sum((v - mv) * (y - my)) AS vy, any_value(mu) AS mu, any_value(mv) AS mv, any_value(my) AS my, count(*) AS n FROM p JOIN m ON m.k = p.k GROUP BY p.k)
SELECT k, round((uy * vv - vy * uv) / (uu * vv - uv * uv), 6) AS "by", round((vy * uu - uy * uv) / (uu * vv - uv * uv), 6) AS cy, round(my - (uy * vv - vy * uv) / (uu * vv - uv * uv) * mu - (vy * uu - uy * uv) / (uu * vv - uv * uv) * mv, 6) AS ay, n FROM s
""")
def affine_fit(spark, sf_dir):
    """Least squares of a plane, from sums."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("u"), (F.col("l_discount") * 100).alias("v"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return raster.affine_fit(p, ["k"]).select("k", *(F.round(c, 6).alias(c) for c in ("by", "cy", "ay")), "n")


@query(f"WITH {_PTS} SELECT vec_id, w * w AS area, 4 * w AS length, x + w / 2 AS cx, y + w / 2 AS cy FROM p")
def geometry_measures(spark, sf_dir):
    """Area, length and centroid of boxes as WKB, in Arrow UDFs."""
    b = _boxes(spark, sf_dir).select("vec_id", geometry.st_box("x0", "y0", "x1", "y1").alias("g"))
    return b.select("vec_id", geometry.st_area("g").alias("area"), geometry.st_length("g").alias("length"), F.round(geometry.st_x("g"), 6).alias("cx"), F.round(geometry.st_y("g"), 6).alias("cy"))


@query(f"""WITH {_PTS} SELECT a.vec_id, round(greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.w, b.y + b.w) - greatest(a.y, b.y), 0), 6) AS shared FROM p a JOIN p b ON b.vec_id = a.vec_id + 1""")
def overlay_boxes(spark, sf_dir):
    """The intersection of each box with the next one, by the general overlay."""
    b = _boxes(spark, sf_dir).select("vec_id", geometry.st_box("x0", "y0", "x1", "y1").alias("g"))
    n = b.select((F.col("vec_id") - 1).alias("vec_id"), F.col("g").alias("h"))
    return b.join(n, "vec_id").select("vec_id", F.round(geometry.st_area(geometry.st_intersection("g", "h")), 6).alias("shared"))


@query("""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 100.0 * p_size WHEN 1 THEN 0.0 ELSE 50.0 * p_size - 25 END AS area, CASE p_size % 3 WHEN 1 THEN least(10.0 + p_size, 100) - 10 END AS length FROM part
""")
def geometry_expressions(spark, sf_dir):
    """JSON expressions, one per row, over shared references."""
    size = F.col("p_size")
    expr = (
        F.when(size % 3 == 0, F.format_string('{"bbox": [0, 0, %d, 100]}', size))
        .when(size % 3 == 1, F.format_string('{"substring": {"line": "axis", "from_m": 10, "to_m": %d}}', size + 10))
        .otherwise(F.format_string('{"difference": [{"bbox": [0, 0, %d, 50]}, {"bbox": [0, 0, 5, 5]}]}', size))
    )
    parts = table(spark, sf_dir, "part").filter("p_size % 3 <> 2 or p_size >= 5").select("p_partkey", expr.alias("expr"))
    small = table(spark, sf_dir, "part").filter("p_size % 3 = 2 and p_size < 5").select("p_partkey", F.format_string('{"bbox": [0, 0, %d, 1]}', 50 * size - 25).alias("expr"))
    refs = json.loads('{"axis": {"line": [[0, 0], [60, 0], [60, 40]]}}')
    out = expressions.evaluate_parts(parts.union(small), refs=refs, key="p_partkey")
    return out.select("p_partkey", F.round("area", 6).alias("area"), F.when(F.col("area") == 0, F.round("length", 6)).alias("length"))


@query(f"""WITH {_PTS}, b AS (SELECT label, x AS x0, y AS y0, x + w AS x1, y + w AS y1 FROM p),
ex AS (SELECT label, v AS a, lead(v) OVER (PARTITION BY label ORDER BY v) AS z FROM (SELECT label, x0 AS v FROM b UNION SELECT label, x1 FROM b)),
ey AS (SELECT label, v AS a, lead(v) OVER (PARTITION BY label ORDER BY v) AS z FROM (SELECT label, y0 AS v FROM b UNION SELECT label, y1 FROM b)),
c AS (SELECT DISTINCT b.label, ex.a AS xa, ex.z AS xz, ey.a AS ya, ey.z AS yz FROM b JOIN ex ON ex.label = b.label AND ex.a >= x0 AND ex.z <= x1 JOIN ey ON ey.label = b.label AND ey.a >= y0 AND ey.z <= y1)
SELECT label, round(sum((xz - xa) * (yz - ya)), 4) AS area FROM c GROUP BY label""")
def dissolved_area(spark, sf_dir):
    """The area that all boxes of a label cover together, united cell by cell."""
    b = _boxes(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    shapes = b.select("label", geometry.st_box("x0", "y0", "x1", "y1").alias("geom"))
    return spatial.dissolve(shapes, ["label"], 64.0).groupBy("label").agg(F.round(F.sum(geometry.st_area("geom")), 4).alias("area"))
