"""Placed parts, their segments, runs and sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.functions.text import text_key
from terrasift.operators import links, spatial
from terrasift.operators.raster import TILE


def outcomes(segments: DataFrame, parts: DataFrame) -> DataFrame:
    """segment, n_parts, outcome, issue: one row per input segment; a declared outcome overrides what the parts say, and
    contradicting it is an issue. segments: segment, declared (null, located or unresolved)."""
    n = parts.groupBy("segment").agg(F.count("*").alias("n_parts"))
    j = segments.join(n, "segment", "left").withColumn("n_parts", F.coalesce("n_parts", F.lit(0)))
    seen = F.when(F.col("n_parts") > 0, "located").otherwise("unresolved")
    return j.select("segment", "n_parts", F.coalesce("declared", seen).alias("outcome"), F.when(F.col("declared") != seen, F.concat(F.lit("declared_"), "declared")).alias("issue"))


def run_groups(runs: DataFrame, segments: DataFrame) -> DataFrame:
    """run, grp, base: runs with equal segment lists (ids and caseless processes) are a group; the base is the declared one
    if it exists, else the newest pipeline run of the group, else the newest of all.

    runs: run, kind, created, base_run. segments: run, segment, process.
    """
    sign = F.sha1(F.to_json(F.array_sort(F.collect_list(F.struct("segment", text_key("process").alias("p"))))))
    g = runs.join(segments.groupBy("run").agg(sign.alias("grp")), "run")
    newest = g.groupBy("grp").agg(F.max_by("run", F.struct((F.col("kind") == "pipeline").cast("int"), "created", "run")).alias("newest"))
    known = runs.select(F.col("run").alias("base_run"), F.lit(True).alias("there"))
    return g.join(newest, "grp").join(known, "base_run", "left").select("run", "grp", F.when(F.col("there"), F.col("base_run")).otherwise(F.col("newest")).alias("base"))


def top_runs(runs: DataFrame) -> DataFrame:
    """Runs that aren't children of another. runs: run, child_runs array."""
    children = runs.select(F.explode("child_runs").alias("run"))
    return runs.join(children, "run", "left_anti")


def reused_footprints(parts: DataFrame) -> DataFrame:
    """first, second: pairs of neighbouring extents of different segments and processes with equal geometry; each repeat is
    paired with the first of its geometry, not with all. parts: part, pos, segment, process, geom."""
    key = F.sha2(F.col("geom").cast("binary"), 256)
    p = parts.withColumn("k", key)
    firsts = p.groupBy("k").agg(F.min_by(F.struct("part", "segment", "process", "geom"), "pos").alias("f"))
    j = p.join(firsts, "k").filter((F.col("f.part") != F.col("part")) & (F.col("f.segment") != F.col("segment")) & (F.col("f.process") != F.col("process")) & (F.col("f.geom") == F.col("geom")))
    return j.select(F.col("f.part").alias("first"), F.col("part").alias("second"))


def accounting(inputs: DataFrame, outputs: DataFrame, excluded: DataFrame) -> DataFrame:
    """id, problem: every input id must be used exactly once over outputs (ids array) and exclusions (id)."""
    used = outputs.select(F.explode("ids").alias("id")).union(excluded.select("id")).groupBy("id").agg(F.count("*").alias("n"))
    j = inputs.select("id", F.lit(True).alias("i")).join(used, "id", "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("i").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    return j.select("id", problem.alias("problem")).filter("problem is not null")


def endpoint_degrees(lines: DataFrame) -> DataFrame:
    """dangling, junctions, closed of a network. lines: x0, y0, x1, y1."""
    shut = (F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1"))
    ends = lines.select(F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("e"))
    degree = ends.groupBy("e.x", "e.y").agg(F.count("*").alias("n"))
    a = degree.agg(F.count_if(F.col("n") == 1).alias("dangling"), F.count_if(F.col("n") > 2).alias("junctions"))
    return a.crossJoin(F.broadcast(lines.agg(F.count_if(shut).alias("closed"))))


def covered_share(cells: DataFrame, zones: DataFrame, size: float) -> DataFrame:
    """zone, share: the share of a box's area over which its raster has cells; exact parts of cells, summed per zone.

    zones: zone, raster, x0, y0, x1, y1. They meet cells by squares of TILE cells."""
    square = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size / TILE), F.floor(F.col(b) / size / TILE)))
    squares = zones.withColumn("_r", square("y0", "y1")).withColumn("_c", square("x0", "x1"))
    tiled = cells.withColumn("_r", F.floor(F.col("r") / TILE)).withColumn("_c", F.floor(F.col("c") / TILE))
    inside = lambda k, a, b: (F.col(k) * size < F.col(b)) & ((F.col(k) + 1) * size > F.col(a))
    j = tiled.join(squares, ["raster", "_r", "_c"]).filter(inside("c", "x0", "x1") & inside("r", "y0", "y1"))
    part = (F.least((F.col("c") + 1) * size, F.col("x1")) - F.greatest(F.col("c") * size, F.col("x0"))) * (F.least((F.col("r") + 1) * size, F.col("y1")) - F.greatest(F.col("r") * size, F.col("y0")))
    got = j.groupBy("zone").agg(F.sum(part).alias("a"))
    return zones.join(got, "zone", "left").select("zone", (F.coalesce("a", F.lit(0.0)) / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).alias("share"))


def sites(boxes: DataFrame, reach: float, models: int, keep) -> DataFrame:
    """box (an integer), site of boxes that touch when grown by `reach`, in chains, if at least that many models have one there.

    Equal boxes are one place from the start, so copies are not listed in pairs; places spread their least ids along the pairs
    that touch. keep(df) writes a table and reads it back.
    """
    shape = ["x0", "y0", "x1", "y1"]
    b = boxes.select("box", "model", *shape)
    known = F.lit(True)
    for c in shape:
        known = known & (F.abs(F.col(c)) < float("inf"))
    places = keep(b.filter(known).groupBy(*shape).agg(F.min("box").alias("place")))
    pairs = spatial.within_distance(places, places.withColumnRenamed("place", "other"), "place", "other", 2 * reach).filter("place < other")
    least = links.least_reached(pairs.select(F.col("place").alias("u"), F.col("other").alias("v")), keep)
    named = places.join(least, places["place"] == least["id"], "left").select(*shape, F.coalesce("least", "place").alias("site"))
    sited = keep(b.join(named, shape, "left").select("box", "model", F.coalesce("site", "box").alias("site")))
    wide = sited.groupBy("site").agg(F.countDistinct("model").alias("n")).filter(F.col("n") >= models)
    return sited.join(wide.select("site"), "site", "left_semi").select("box", "site")


def affected(issues: DataFrame, known: DataFrame, run: str = "run") -> DataFrame:
    """run, segments: all segments of a run's issues; null if an issue names none or an unknown one."""
    rows = issues.select(run, F.explode_outer("segment_ids").alias("segment")).join(known.select(run, "segment", F.lit(True).alias("k")), [run, "segment"], "left")
    g = rows.groupBy(run).agg(F.bool_and(F.coalesce("k", F.lit(False))).alias("ok"), F.array_sort(F.collect_set("segment")).alias("s"))
    return g.select(run, F.when(F.col("ok"), F.col("s")).alias("segments"))


def gazetteer(df: DataFrame, fields: list[str], least: int = 4) -> DataFrame:
    """name, sources: distinct names of at least `least` letters from the fields, with the fields that have them."""
    pairs = df.select(F.explode(F.array(*(F.struct(F.trim(F.col(f).cast("string")).alias("name"), F.lit(f).alias("src")) for f in fields))).alias("p")).select("p.*")
    return pairs.filter(F.length("name") >= least).groupBy("name").agg(F.array_sort(F.collect_set("src")).alias("sources"))


def georeferencing_reasons(g: DataFrame) -> DataFrame:
    """figure, reasons: why a fit isn't accepted. g: figure, n_controls, n_checks, span, max_check, crs, provenance."""
    reasons = {"too_few_controls": F.col("n_controls") < 4, "no_check_points": F.col("n_checks") < 1, "controls_too_close": F.col("span") < 0.3, "check_error": F.col("max_check") > 25.0, "no_crs": F.col("crs").isNull(), "no_provenance": F.coalesce(F.trim("provenance"), F.lit("")) == ""}
    return g.select("figure", F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in reasons.items())), lambda x: x.isNotNull()).alias("reasons"))


def captions(pages: DataFrame) -> DataFrame:
    """doc, page, kind, number, title: captions at the beginning of lines; up to four lines go on until one ends a sentence,
    is empty or begins another caption."""
    lines = pages.select("doc", "page", F.split("text", "\n", -1).alias("l"))
    start = "(?i)^\\s*(fig(?:ure)?|abb(?:ildung)?|tab(?:le|elle)?)\\.?\\s*([0-9]+(?:[.-][0-9]+)?)\\s*[:.]?\\s*(.*)$"
    at = lines.select("doc", "page", "l", F.posexplode("l").alias("i", "line")).filter(F.col("line").rlike(start))
    more = F.slice("l", F.col("i") + 2, F.lit(4))
    zero = F.struct(F.regexp_extract("line", start, 3).alias("t"), F.regexp_extract("line", start, 3).rlike("[.!?]\\s*$").alias("done"))

    def step(s, x):
        stop = s.done | (F.trim(x) == "") | x.rlike(start)
        return F.struct(F.when(stop, s.t).otherwise(F.concat_ws(" ", s.t, F.trim(x))).alias("t"), (stop | x.rlike("[.!?]\\s*$")).alias("done"))

    title = F.aggregate(more, zero, step, lambda s: F.trim(s.t))
    kind = F.when(F.lower(F.trim("line")).startswith("tab"), "table").otherwise("figure")
    return at.select("doc", "page", kind.alias("kind"), F.regexp_extract("line", start, 2).alias("number"), title.alias("title"))
