"""Every operator and measure of the expression language over boxes made of vectors, against closed forms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from terrasift.functions import expressions
from terrasift.plans.registry import query, table
from terrasift.plans.spatial import _PTS, _points

# One line for each: the measure of an expression over a box at (x, y) of width w, and what it has to be, in SQL. In the measures
# letters stand for numbers: see _LETTERS.
_LETTERS = {"X": "x", "Y": "y", "W": "w", "H": "w / 2", "R": "x + w", "T": "y + w", "P": "x + 0.5D", "Q": "y + 0.25D", "N": "x + 0.75D", "M": "y + 0.75D", "U": "x + w + 0.5D", "V": "y + w + 0.5D"}
_BOX = '{"bbox":[X,Y,R,T]}'
_EAST = '{"line":[[X,Y],[R,Y]]}'
_BENT = '{"line":[[X,Y],[R,Y],[R,T]]}'
_AXIS = '"axis"'
CASES: list[tuple[str, str]] = [
    ('{"bounds":{"point":[X,Y]}}', "[x, y, x, y]"),
    ('{"length_m":%s}' % _BENT, "[2 * w]"),
    ('{"area_m2":{"polygon":[[X,Y],[R,Y],[X,T]]}}', "[w * w / 2]"),
    ('{"area_ha":%s}' % _BOX, "[w * w / 10000]"),
    ('{"area_km2":{"wkt":"POLYGON((X Y, R Y, R T, X T, X Y))"}}', "[w * w / 1000000]"),
    ('{"bounds":{"raster_pixel":{"transform":[X,2,0,Y,0,-2],"pixel":[W,1]}}}', "[x + 2 * w + 1, y - 3, x + 2 * w + 1, y - 3]"),
    ('{"bounds":{"start":%s}}' % _BENT, "[x, y, x, y]"),
    ('{"bounds":{"end":%s}}' % _BENT, "[x + w, y + w, x + w, y + w]"),
    ('{"bounds":{"endpoint_near":{"line":%s,"to":{"point":[R,T]}}}}' % _EAST, "[x + w, y, x + w, y]"),
    ('{"bounds":{"centroid":%s}}' % _BOX, "[x + w / 2, y + w / 2, x + w / 2, y + w / 2]"),
    ('{"distance_m":[{"representative_point":%s},%s]}' % (_BOX, _BOX), "[0.0]"),
    ('{"distance_m":[{"point":[R,T]},%s]}' % _EAST, "[w]"),
    ('{"bounds":{"nearest_point":{"on":%s,"to":{"point":[X,T]}}}}' % _EAST, "[x, y, x, y]"),
    ('{"bounds":{"interpolate":{"line":%s,"at_m":H}}}' % _BENT, "[x + w / 2, y, x + w / 2, y]"),
    ('{"length_m":{"substring":{"line":%s,"from_m":1,"to_m":W}}}' % _BENT, "[w - 1]"),
    ('{"length_m":{"between":{"line":%s,"from":{"point":[X,Y]},"to":{"point":[R,Y]},"extend_m":[0,1]}}}' % _BENT, "[w + 1]"),
    ('{"length_m":{"window":{"line":%s,"center":{"point":[R,Y]},"length_m":W}}}' % _BENT, "[w]"),
    ('{"bounds":{"start":{"stream":{"layer":"streams","where":{"NAME":"A"},"elevations":[9,2]}}}}', "[100.0, 0, 100, 0]"),
    ('{"bounds":{"chainage_point":{"chainage":"hm","at":10}}}', "[20.0, 0, 20, 0]"),
    ('{"length_m":{"reach":{"chainage":"hm","from":10,"to":35}}}', "[50.0]"),
    ('{"area_m2":{"buffer":{"geom":%s,"distance":2,"cap":"flat"}}}' % _EAST, "[4 * w]"),
    ('{"area_m2":{"buffer":{"geom":{"point":[X,Y]},"distance":W}}}', "[16 * w * w * sin(pi() / 16)]"),
    ('{"area_m2":{"union":[%s,{"bbox":[X,Y,R,T]}]}}' % _BOX, "[w * w]"),
    ('{"area_m2":{"intersection":[%s,{"polygon":[[X,Y],[R,Y],[X,T]]}]}}' % _BOX, "[w * w / 2]"),
    ('{"area_m2":{"difference":[%s,{"polygon":[[X,Y],[R,Y],[X,T]]}]}}' % _BOX, "[w * w / 2]"),
    ('{"area_m2":{"half_plane":{"line":%s,"side":"north","extent_m":10,"end_extension_m":0}}}' % _EAST, "[10 * w]"),
    ('{"area_m2":{"half_plane":{"line":%s,"side":"south","extent_m":10}}}' % _EAST, "[10 * w + 200]"),
    ('{"area_m2":{"half_plane":{"line":%s,"side":"left","extent_m":4}}}' % _BENT, "[8 * w - 16]"),
    ('{"area_m2":{"half_plane":{"line":%s,"side":"right","extent_m":4}}}' % _BENT, "[8 * w + 64 * sin(pi() / 16)]"),
    ('{"area_m2":{"half_plane":{"line":%s,"side":"east","extent_m":W,"end_extension_m":0}}}' % '{"line":[[X,Y],[R,T]]}', "[w * w]"),
    ('{"area_m2":{"nearest_part":{"geom":{"bbox":[0,0,20,20]},"lines":[{"line":[[0,0],[0,20]]},{"line":[[20,0],[20,20]]}],"index":1,"cell_m":2}}}', "[200.0]"),
    ('{"area_m2":{"largest":{"union":[%s,{"bbox":[R,T,U,V]}]}}}' % _BOX, "[w * w]"),
    ('{"count":{"polygons_only":%s}}' % _BENT, "[0.0]"),
    ('{"length_m":{"simplify":{"geom":{"line":[[X,Y],[P,Q],[R,Y]]},"tolerance_m":1}}}', "[w]"),
    ('{"area_m2":{"convex_hull":{"polygon":[[0,0],[2,0],[2,1],[1,1],[1,2],[0,2]]}}}', "[3.5]"),
    ('{"area_m2":{"fill_holes":{"wkt":"POLYGON((X Y, R Y, R T, X T, X Y), (P Q, N Q, N M, P Q))"}}}', "[w * w]"),
    ('{"area_m2":{"dem_mask":{"dem":"slope","within":{"bbox":[0,0,100,100]},"min":3,"max":6}}}', "[4000.0]"),
    ('{"area_m2":{"terrain":{"dem":"flat","channels":[{"line":[[5,5],[95,5]]}],"max_dist_m":15,"height_m":1}}}', "[2000.0]"),
    ('{"area_m2":{"watershed":{"dem":"bowl","pour_point":{"point":[15,5]},"snap_m":10}}}', "[900.0]"),
    ('{"area_m2":{"watershed":{"dem":"bowl","pour_point":{"point":[15,15]},"snap_m":0}}}', "[400.0]"),
    ('{"area_m2":{"georef_pixels":{"transform":[X,2,0,Y,0,2],"pixels":[[0,0],[W,0],[W,W],[0,W]]}}}', "[4 * w * w]"),
    ('{"area_m2":{"georef_color":{"image":"map","rule":"R > 200 and B < 50","min_pixels":4,"transform":[X,2,0,Y,0,2]}}}', "[64.0]"),
    ('{"bounds":{"point_wgs84":[9,0]}}', "[500000.0, 0, 500000, 0]"),
    ('{"area_m2":{"file":"areas"}}', "[150.0]"),
    ('{"along_m":{"line":%s,"from":{"point":[X,Y]},"to":{"point":[R,T]}}}' % _BENT, "[2 * w]"),
    ('{"chainage":{"chainage":"hm","point":{"point":[30,7]}}}', "[15.0]"),
    ('{"chainage_range":{"chainage":"hm","geom":{"bbox":[10,0,40,5]}}}', "[5.0, 20]"),
    ('{"count":{"union":[{"bbox":[0,0,1,1]},{"bbox":[0,5,1,6]}]}}', "[2.0]"),
    ('{"elevation_m":{"dem":"slope","point":{"point":[35,15]}}}', "[3.0]"),
    ('{"dem_stats":{"dem":"slope","geom":{"bbox":[0,0,100,50]}}}', "[50.0, 0, 9, 4.5]"),
    ('{"gradient_pct":{"dem":"slope","line":{"line":[[5,5],[55,5]]}}}', "[10.0]"),
    ('{"width_m":%s}' % _BOX, "[w / 2]"),
    ('{"fit":{"expr":{"buffer":{"geom":{"line":[[0,0],[100,0]]},"width":"$param","cap":"flat"}},"target":800,"low":1,"high":20,"tolerance":0.0001}}', "[8.0, 800]"),
    ('{"sensitivity":{"expr":{"buffer":{"geom":%s,"width":"$param","cap":"flat"}},"values":[2,4]}}' % _EAST, "[2 * w, 4 * w]"),
    ('{"check":{"measure":{"area_m2":%s},"report_value":50}}' % _BOX, "[w * w, w * w - 50, 2 * w * w - 100]"),
    ('{"area_m2":{"intersection":[%s,{"difference":[{"bbox":[X,Y,R,T]},{"buffer":{"geom":%s,"distance":1,"cap":"flat"}}]}]}}' % (_BOX, _EAST), "[w * (w - 1)]"),
    ('{"area_m2":"loop"}', "NULL"),
    ('{"area_m2":{"nothing":1}}', "NULL"),
]


def context() -> dict:
    """Layers, references, stations, elevations and an image that the cases use."""
    line = lambda *p: ("line", [np.array(p, float)])
    box = lambda a, b: ("polygon", [[np.array([(a, 0), (b, 0), (b, 10), (a, 10), (a, 0)], float)]])
    rgb = np.zeros((8, 8, 3), np.uint8)
    rgb[2:6, 1:5, 0] = 255
    rgb[7, 7, 0] = 255
    bowl = np.array([[5, 1, 5], [5, 3, 5], [5, 5, 5]], float)
    return {
        "layers": {"streams": [({"id": 1, "NAME": "A"}, line((0, 0), (100, 0))), ({"id": 2, "NAME": "B"}, line((0, 9), (9, 9)))], "areas": [({"id": 1}, box(0, 10)), ({"id": 2}, box(5, 15))]},
        "refs": {"axis": {"line": [[0, 0], [200, 0]]}, "loop": {"buffer": {"geom": "loop", "distance": 1}}},
        "chainages": {"hm": {"line": "axis", "unit_m": 2, "anchors": [{"value": 0, "at": "start"}, {"value": 100, "at": "end"}]}},
        "dems": {"slope": expressions.Dem(np.tile(np.arange(10.0), (10, 1)), 0, 0, 10), "flat": expressions.Dem(np.zeros((10, 10)), 0, 0, 10), "bowl": expressions.Dem(bowl, 0, 0, 10)},
        "images": {"map": rgb},
        "zone": 32,
    }


_CASE = " ".join(f"WHEN {i} THEN {v}" for i, (_, v) in enumerate(CASES))


@query(f"WITH {_PTS}, q AS (SELECT vec_id, i, CASE i {_CASE} END AS v FROM p, range(0, {len(CASES)}) t(i) WHERE vec_id % 8 = i % 8) SELECT vec_id, CAST(i AS INT) AS op, list_transform(v, lambda a: round(CAST(a AS DOUBLE), 4)) AS value, v IS NULL AS wrong FROM q")
def geometry_operators(spark, sf_dir):
    """All operators and measures; every vector's box goes through an eighth of them. A place of -0.0 keeps its sign."""
    p = _points(spark, sf_dir, signed=True).select("vec_id", "x", "y", "w")
    texts = F.array(*(F.struct(F.lit(i).alias("op"), F.lit(t).alias("t")) for i, (t, _) in enumerate(CASES)))
    rows = p.select("*", F.explode(texts).alias("c")).filter(F.col("vec_id") % 8 == F.col("c.op") % 8)
    spec = F.col("c.t")
    for letter, value in _LETTERS.items():
        # Only where a number is meant: between punctuation or blanks.
        spec = F.regexp_replace(spec, F.lit(rf"(?<=[\[, (:]){letter}(?=[\], )}}])"), F.expr(value).cast("string"))
    rows = rows.select(F.concat_ws("/", "vec_id", "c.op").alias("k"), spec.alias("spec"))
    out = expressions.evaluate_measures(rows, "k", **context())
    at = F.split("k", "/")
    return out.select(at[0].cast("long").alias("vec_id"), at[1].cast("int").alias("op"), F.transform("value", lambda v: F.when(v == 0, v).otherwise(F.round(v, 4))).alias("value"), F.col("error").isNotNull().alias("wrong"))
