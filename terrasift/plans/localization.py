"""Placement methods, their checks, event boundaries, trials and recovery over the driver tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from terrasift.functions import schemas
from terrasift.operators import language_gate, localization, methods, ordered, separation, state, trials
from terrasift.plans.registry import query, table

_FACTS = methods.Facts(
    candidates={
        "S1": {"kind": "streams", "layer": "streams", "name": "Main", "geom_type": "LineString"},
        "S2": {"kind": "streams", "layer": "streams", "name": "Side", "geom_type": "LineString", "flows_into": "S1"},
        "C1": {"kind": "catchment", "layer": "catchments", "name": "Basin", "geom_type": "Polygon"},
        "R1": {"kind": "roads", "layer": "roads", "name": "Road", "geom_type": "LineString"},
        "P1": {"kind": "place", "layer": "places", "name": "Village", "geom_type": "Point"},
    },
    main="S1",
    catchment="C1",
    stationed=True,
    named=frozenset({"P1"}),
    roles={"buildings": "houses", "road_land": "land"},
    figures={"F1": {"segments": ["1"], "geometry": {"bbox": [0, 0, 9, 9]}}},
)

# Each part takes a method by its key; numbers of its row go into the answer.
_ANSWERS = [
    ("report_outline", '{"candidate":"F1"}'),
    ("location_point", '{"center":"xy: %1$d, -5"}'),
    ("channel_reach", '{"from_point":"hm: %1$d","to_point":"hm:%2$d,5"}'),
    ("feature_geometry", '{"candidate":"P1"}'),
    ("catchment", "{}"),
    ("elevation_band", '{"min_elev_m":%1$d}'),
    ("reach_corridor", '{"stream":"S2","from_point":"mouth","to_point":"hm: %2$d","max_dist_m":%1$d,"within_catchment":true}'),
    ("valley_floor", '{"river":"S2","upstream":"confluence: S2","downstream":"source","side":"left"}'),
    ("feature", '{"candidate":"R1"}'),
    ("road_stretch", '{"candidate":"R1","center":"P1","length_m":%1$d}'),
    ("buildings_near", '{"center":"building: %2$d","radius_m":%1$d}'),
    ("named_area", '{"center":"place: P1","radius_m":%1$d}'),
    ("point_area", '{"center":"P1"}'),
    ("expression", '{"expression":"{\\"bbox\\": [0, 0, %1$d, 1]}"}'),
    ("feature", '{"candidate":"X9"}'),
]


def _answers(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf_dir, "part").select(k.alias("part_id"), size, (k % len(_ANSWERS)).alias("m"), (k % 4).alias("s"))
    args = F.coalesce(*(F.when(F.col("m") == i, F.replace(F.replace(F.lit(a), F.lit("%1$d"), size.cast("string")), F.lit("%2$d"), (F.col("part_id") % 7).cast("string"))) for i, (_, a) in enumerate(_ANSWERS)))
    name = F.element_at(F.array(*(F.lit(n) for n, _ in _ANSWERS)), (F.col("m") + 1).cast("int"))
    given = F.when(F.col("s") == 0, F.format_string('{"value":%d,"basis":"report"}', size)).when(F.col("s") == 1, F.lit('{"report_area_ha":2.5,"fit_report_area":true}')).otherwise(F.lit("{}"))
    return p.select("part_id", (F.col("s") % 2).cast("string").alias("seg_id"), F.concat(F.lit('{"method":"'), name, F.lit('","args":'), args, F.lit(',"parameter":'), given, F.lit("}")).alias("answer"))


@query("""
WITH p AS (SELECT p_partkey AS k, p_size AS n, p_partkey % 15 AS m, p_partkey % 4 AS s, p_partkey % 7 AS q FROM part),
e AS (SELECT *, CASE m WHEN 0 THEN CASE WHEN s % 2 = 1 THEN '{"bbox": [0, 0, 9, 9]}' END
  WHEN 1 THEN '{"point": [' || n || '.0, -5.0]}' WHEN 2 THEN '{"reach": {"chainage": "hm", "from": ' || n || '.0, "to": ' || q || '.5}}' WHEN 3 THEN '"P1"' WHEN 4 THEN '"catch"'
  WHEN 5 THEN '{"dem_mask": {"max": null, "min": ' || n || ', "within": "catch"}}'
  WHEN 6 THEN '{"terrain": {"channels": [{"between": {"from": {"start": "S2"}, "line": "S2", "to": {"chainage_point": {"at": ' || q || '.0, "chainage": "hm"}}}}], "height_m": "$param", "max_dist_m": ' || n || '.0, "within": "catch"}}'
  WHEN 7 THEN replace('{"terrain": {"channels": [@], "height_m": "$param", "max_dist_m": 300.0, "within": {"intersection": [{"buffer": {"cap": "flat", "distance": 300.0, "geom": @}}, {"half_plane": {"end_extension_m": 0, "extent_m": 2000, "line": @, "side": "right"}}]}}}',
     '@', '{"between": {"from": {"endpoint_near": {"line": "S2", "to": "S1"}}, "line": "S2", "to": {"end": "main"}}}')
  WHEN 8 THEN '{"buffer": {"cap": "flat", "geom": "R1", "width": "$param"}}'
  WHEN 9 THEN '{"buffer": {"cap": "flat", "geom": {"window": {"center": {"representative_point": "P1"}, "length_m": ' || n || '.0, "line": "R1"}}, "width": "$param"}}'
  WHEN 10 THEN '{"layer": "houses", "within_distance": {"distance": ' || n || '.0, "geom": {"centroid": {"ids": [' || q || '], "layer": "houses"}}}}'
  WHEN 11 THEN CASE WHEN n >= 50 THEN '{"buffer": {"distance": ' || n || '.0, "geom": {"representative_point": "P1"}}}' END
  WHEN 12 THEN '{"buffer": {"distance": "$param", "geom": {"representative_point": "P1"}}}' WHEN 13 THEN '{"bbox": [0, 0, ' || n || ', 1]}' END AS expression FROM p),
r AS (SELECT *, CASE WHEN m IN (6, 7) THEN 'height_above_channel_m' WHEN m IN (8, 9) THEN 'width_m' WHEN m = 12 THEN 'radius_m' END AS name, CASE WHEN m IN (6, 7) THEN 3 WHEN m IN (8, 9) THEN 6 WHEN m = 12 THEN 30 END AS d,
  CASE WHEN m IN (8, 9) THEN 0.75 ELSE 0.5 END AS lo, CASE WHEN m IN (6, 7) THEN 1.5 WHEN m IN (8, 9) THEN 1.25 ELSE 2.0 END AS hi FROM e),
v AS (SELECT *, CASE WHEN s = 0 THEN n ELSE d END AS x FROM r)
SELECT k AS part_id, expression, CASE WHEN expression IS NULL OR name IS NULL THEN NULL WHEN m IN (6, 7) AND s = 1 THEN 'fit 2.5' ELSE name || '=' || round(CAST(x AS DOUBLE), 3) || ' (' || round(CAST(x * lo AS DOUBLE), 3) || ' to ' || round(CAST(x * hi AS DOUBLE), 3) || ')' END AS parameter,
  CASE WHEN expression IS NULL THEN NULL WHEN m = 0 THEN 'documented' WHEN m IN (1, 2, 3, 4, 10, 11) OR (m = 8 AND s = 0) THEN 'approximate' WHEN m = 12 THEN 'hypothesis' ELSE 'modelled' END AS placement,
  expression IS NOT NULL AND name IS NOT NULL AND m <> 12 AND s <> 0 AND NOT (m IN (6, 7) AND s = 1) AS rule_5d,
  CASE WHEN m = 6 THEN ['S2/hm: ' || q] ELSE CAST([] AS VARCHAR[]) END AS far_stations, expression IS NULL AS wrong FROM v
""")
def compiled_methods(spark, sf_dir):
    """All methods of the menu compiled; outlines of other segments, small radii and unknown candidates are errors."""
    out = methods.compile_answers(_answers(spark, sf_dir), _FACTS)
    p = F.from_json("parameter", "name string, value double, sensitivity array<double>, fit_area_ha double")
    said = F.when(p.fit_area_ha.isNotNull(), F.concat(F.lit("fit "), p.fit_area_ha)).when(p["name"].isNotNull(), F.concat(p["name"], F.lit("="), p.value, F.lit(" ("), p.sensitivity[0], F.lit(" to "), p.sensitivity[1], F.lit(")")))
    return out.select("part_id", "expression", said.alias("parameter"), "placement", F.coalesce("rule_5d", F.lit(False)).alias("rule_5d"), F.coalesce("far_stations", F.array().cast("array<string>")).alias("far_stations"), F.col("error").isNotNull().alias("wrong"))


def _claims(spark, sf_dir):
    """Orders as claims: every method with high and low claims for named and other features."""
    k, pick = F.col("o_orderkey"), lambda by, *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.floor(F.col("o_orderkey") / by) % len(xs) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", pick(1, *methods.MENU).alias("method"), (F.col("o_custkey") % 3 == 0).alias("rule_5d"), (F.col("o_custkey") % 2 == 0).alias("named"), (k % 2).cast("int").alias("is_hypo"),
        pick(2, "high", "medium", "low", None).alias("confidence"), pick(3, "event_extent", "location", None).alias("geometry_role"), pick(5, "high", None, "low").alias("location_confidence"), pick(7, "high", "medium", "low", "unknown").alias("boundary_confidence"),
    )


_PICK = lambda by, *xs: f"list_extract([{', '.join('NULL' if x is None else repr(x) for x in xs)}], CAST(floor(o_orderkey / {by}.0) % {len(xs)} + 1 AS BIGINT))"
_CLAIMS = f"""c AS (SELECT o_orderkey, {_PICK(1, *methods.MENU)} AS method, o_custkey % 3 = 0 AS rule_5d, o_custkey % 2 = 0 AS named, o_orderkey % 2 AS h, {_PICK(2, "high", "medium", "low", None)} AS c0,
  {_PICK(3, "event_extent", "location", None)} AS r0, {_PICK(5, "high", None, "low")} AS l0, {_PICK(7, "high", "medium", "low", "unknown")} AS b0 FROM orders),
f AS (SELECT *, rule_5d OR method = 'point_area' AS forced, named AND method IN ('catchment', 'feature', 'feature_geometry', 'location_point') AS sure, method IN ('location_point', 'channel_reach', 'feature_geometry') AS place FROM c),
g AS (SELECT *, CASE WHEN forced THEN 1 ELSE h END AS is_hypo, CASE WHEN forced THEN 'low' ELSE coalesce(c0, 'low') END AS c1 FROM f),
i AS (SELECT *, coalesce(l0, c1) AS l1, CASE WHEN method = 'named_area' THEN 'search_area' WHEN place THEN 'location' ELSE coalesce(r0, 'event_extent') END AS geometry_role, CASE WHEN method = 'named_area' THEN 'unknown' ELSE b0 END AS b1 FROM g)"""


@query(f"""WITH {_CLAIMS}
SELECT o_orderkey, is_hypo, geometry_role, CASE WHEN c1 = 'high' AND (is_hypo = 1 OR NOT sure) THEN 'medium' ELSE c1 END AS confidence, CASE WHEN l1 = 'high' AND method <> 'report_outline' AND NOT sure THEN 'medium' ELSE l1 END AS location_confidence,
  CASE WHEN geometry_role <> 'event_extent' THEN 'unknown' WHEN rule_5d AND b1 IN ('high', 'medium') THEN 'low' WHEN b1 = 'high' AND method <> 'report_outline' THEN 'medium' ELSE b1 END AS boundary_confidence,
  CASE WHEN method = 'buildings_near' AND is_hypo = 0 THEN 'buildings near a place are no more than a hypothesis' END AS error,
  CAST((c1 = 'high' AND (is_hypo = 1 OR NOT sure))::INT + (place AND r0 = 'event_extent')::INT + (l1 = 'high' AND method <> 'report_outline' AND NOT sure)::INT + (geometry_role <> 'event_extent' AND b1 <> 'unknown')::INT
    + (geometry_role = 'event_extent' AND b1 = 'high' AND method <> 'report_outline')::INT + (geometry_role = 'event_extent' AND rule_5d AND b1 IN ('high', 'medium'))::INT AS INT) AS n_adjusted FROM i
""".replace("(place AND r0 = 'event_extent')", "coalesce(place AND r0 = 'event_extent', false)"))
def classified_methods(spark, sf_dir):
    """Claims that are too high lowered, and how often."""
    out = methods.classify(_claims(spark, sf_dir))
    return out.select("o_orderkey", "is_hypo", "geometry_role", "confidence", "location_confidence", "boundary_confidence", "error", F.size("adjustments").alias("n_adjusted"))


@query("""
WITH p AS (SELECT p_partkey AS part_id, list_extract(['location_point', 'buildings_near', 'named_area', 'catchment'], p_partkey % 4 + 1) AS method, p_size AS a, CASE WHEN p_partkey % 3 <> 0 THEN 20.0 END AS r, p_size * 2.0 AS st, CASE p_partkey % 5 WHEN 0 THEN 'Im Bereich ' WHEN 1 THEN 'au total ' WHEN 2 THEN 'nearby ' ELSE '' END || p_name AS q FROM part)
SELECT part_id, unnest(list_filter([CASE WHEN r > 0 AND NOT (a / r BETWEEN 0.67 AND 1.5) THEN 'area_differs' END, CASE WHEN st > 63 THEN 'station_beyond_line' END, CASE WHEN method IN ('location_point', 'buildings_near') AND regexp_matches(q, '(?i)\\bim bereich\\b|\\bnear\\b') THEN 'area_as_point' END,
  CASE WHEN method <> 'catchment' AND regexp_matches(q, '(?i)\\bau total\\b') THEN 'total_as_place' END], lambda x: x IS NOT NULL)) AS code FROM p
""")
def placement_consistency(spark, sf_dir):
    """Areas, stations and wordings that contradict a placement."""
    k = F.col("p_partkey")
    method = F.element_at(F.array(*(F.lit(x) for x in ("location_point", "buildings_near", "named_area", "catchment"))), (k % 4 + 1).cast("int"))
    quote = F.concat(F.when(k % 5 == 0, "Im Bereich ").when(k % 5 == 1, "au total ").when(k % 5 == 2, "nearby ").otherwise(""), "p_name")
    parts = table(spark, sf_dir, "part").select(k.alias("part_id"), method.alias("method"), F.col("p_size").alias("area_ha"), F.when(k % 3 != 0, 20.0).alias("report_area_ha"), F.array(F.col("p_size") * 2.0).alias("stations"), F.array(quote).alias("quotes"))
    return localization.part_issues(parts, 60.0)


@query("""
WITH s AS (SELECT n_nationkey AS stream, lower(n_name) AS name FROM nation WHERE length(n_name) >= 4 UNION SELECT r_regionkey + 100, lower(r_name) FROM region WHERE length(r_name) >= 4 UNION SELECT 200 + n_nationkey, 'to ' || n_nationkey || ' b' FROM nation),
q AS (SELECT s_suppkey % 40 AS seg_id, lower('the ' || n_name || 'bach to ' || s_suppkey || ' b in ' || r_name) AS q FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
u AS (SELECT s_suppkey % 40 AS seg_id, s_nationkey AS stream FROM supplier WHERE s_suppkey % 3 = 0)
SELECT DISTINCT seg_id, stream FROM q JOIN s ON contains(q, name) WHERE (seg_id, stream) NOT IN (SELECT seg_id, stream FROM u)
""")
def unmapped_streams(spark, sf_dir):
    """Streams that quotations name (also as part of a longer word) and no part uses."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    streams = n.select(F.col("n_nationkey").alias("id"), F.array("n_name").alias("names")).union(r.select(F.col("r_regionkey") + 100, F.array("r_name"))).union(n.select(F.col("n_nationkey") + 200, F.array(F.concat(F.lit("to "), F.col("n_nationkey").cast("string"), F.lit(" b")))))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    quote = F.concat(F.lit("the "), "n_name", F.lit("bach to "), F.col("s_suppkey").cast("string"), F.lit(" b in "), "r_name")
    used = F.when(F.col("s_suppkey") % 3 == 0, F.array("s_nationkey")).otherwise(F.array().cast("array<int>"))
    return localization.unmapped_streams(s.select((F.col("s_suppkey") % 40).alias("seg_id"), used.alias("used"), F.array(quote).alias("quotes")), streams)


@query("""
SELECT conv_id AS seg_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') = 1 AND count(DISTINCT turn) >= 3 AND conv_id % 5 <> 0
""")
def scarce_parts(spark, sf_dir):
    """Segments of one part whose evidence is on three pages or more."""
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "seg_id")
    return localization.scarce_parts(c.select("seg_id", (F.col("seg_id") % 5 == 0).alias("wide")).distinct(), c.filter("role = 'user'").select("seg_id"), c.select("seg_id", F.col("turn").alias("page")))


@query("""
SELECT l_orderkey, CASE WHEN e > 0 THEN 'build_errors' WHEN v > 0 THEN 'validation_errors' WHEN f > 0 THEN 'incomplete' WHEN t > 0 THEN 'partial' WHEN r > 0 THEN 'review_incomplete' WHEN i > 0 THEN 'revision_required' WHEN u > 0 THEN 'delivered_with_unresolved' ELSE 'delivered' END AS status
FROM (SELECT l_orderkey, count(*) FILTER (l_quantity > 49) AS e, count(*) FILTER (l_quantity > 47) AS v, count(*) FILTER (l_discount > 0.095) AS f, count(*) FILTER (l_tax > 0.075) AS t, count(*) FILTER (l_returnflag = 'R' AND l_quantity < 10) AS r, count(*) FILTER (l_linenumber > 5) AS i, count(*) FILTER (l_linestatus = 'O') AS u FROM lineitem GROUP BY l_orderkey)
""")
def run_status(spark, sf_dir):
    """The terminal state of each run from what is left of it."""
    c = lambda cond, name: F.count_if(cond).alias(name)
    q = F.col("l_quantity")
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(c(q > 49, "e"), c(q > 47, "v"), c(F.col("l_discount") > 0.095, "f"), c(F.col("l_tax") > 0.075, "t"), c((F.col("l_returnflag") == "R") & (q < 10), "r"), c(F.col("l_linenumber") > 5, "i"), c(F.col("l_linestatus") == "O", "u"))
    return n.select("l_orderkey", localization.final_status(*(F.col(x) for x in "evftriu")).alias("status"))


@query("""
WITH c AS (SELECT o_orderkey AS seg_id, o_orderkey % 9 AS d FROM orders) SELECT seg_id, CASE WHEN d >= 2 THEN 2 ELSE d END AS round, d > 2 AS wrong FROM c
""")
def correction_loop(spark, sf_dir):
    """Two rounds of corrections; each answers again only what is wrong (an answer is right from round d on)."""
    from terrasift.shared import checkpointer

    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seg_id"), (F.col("o_orderkey") % 9).alias("d"))
    have, wrong = localization.correction_rounds(items, lambda x, k: x.withColumn("round", F.lit(k)), lambda a: a.filter("round < d").select("seg_id"), checkpointer(spark))
    return have.join(wrong.withColumn("wrong", F.lit(True)), "seg_id", "left").select("seg_id", "round", F.coalesce("wrong", F.lit(False)).alias("wrong"))


@query("""
WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t, split_part(text, ' ', 1) AS w FROM documents),
e AS (SELECT d.*, CASE WHEN doc_id % 13 = 0 THEN page + 100000 WHEN doc_id % 11 = 0 AND page > 1 THEN page - 1 ELSE page END AS start, CASE WHEN doc_id % 7 = 0 THEN '' ELSE w END AS title, CASE WHEN doc_id % 5 = 0 THEN 'no such heading' ELSE w END AS q, (doc_id % 17) / 10.0 AS c FROM d),
k AS (SELECT e.*, row_number() OVER (PARTITION BY source, start ORDER BY doc_id) AS n FROM e),
j AS (SELECT k.*, p.t AS body, p.page AS there, p.doc_id % 19 = 0 AS toc, replace(lower(trim(regexp_replace(k.title, '\\s+', ' ', 'g'))), 'ß', 'ss') AS tk, replace(lower(trim(regexp_replace(k.q, '\\s+', ' ', 'g'))), 'ß', 'ss') AS qk FROM k LEFT JOIN d p ON p.source = k.source AND p.page = k.start)
SELECT source AS doc, doc_id AS event, unnest(list_filter([CASE WHEN there IS NULL THEN 'outside' END, CASE WHEN n > 1 AND there IS NOT NULL THEN 'repeated' END, CASE WHEN toc THEN 'toc' END, CASE WHEN tk = '' THEN 'no_title' END,
  CASE WHEN there IS NOT NULL AND tk <> '' AND NOT contains(replace(body, 'ß', 'ss'), tk) THEN 'title_absent' END, CASE WHEN c > 1 THEN 'bad_confidence' END, CASE WHEN c < 0.8 THEN 'unreliable' END,
  CASE WHEN there IS NOT NULL AND (qk = '' OR NOT contains(replace(body, 'ß', 'ss'), qk)) THEN 'quote_absent' END], lambda x: x IS NOT NULL)) AS code FROM j
""")
def boundary_issues(spark, sf_dir):
    """Proposed starts of events checked against the pages they name."""
    i, page = F.col("doc_id"), F.col("page")
    docs = table(spark, sf_dir, "documents")
    # Ids are numbered without their texts.
    numbers = ordered.row_numbers(docs.select("doc_id", F.col("source").alias("doc")), ["doc"], "doc_id", "page").select("doc_id", F.col("page").cast("int").alias("page"))
    d = docs.select("doc_id", F.col("source").alias("doc"), "text").join(numbers, "doc_id")
    w = F.split_part("text", F.lit(" "), F.lit(1))
    start = F.when(i % 13 == 0, page + 100000).when((i % 11 == 0) & (page > 1), page - 1).otherwise(page)
    events = d.select("doc", i.alias("event"), F.when(i % 7 == 0, "").otherwise(w).alias("title"), start.alias("start_page"), F.when(i % 5 == 0, "no such heading").otherwise(w).alias("heading_quote"), ((i % 17) / 10.0).alias("confidence"))
    return separation.boundary_issues(events, d.select("doc", "page", "text", (i % 19 == 0).alias("is_toc")))


@query("""
WITH r AS (SELECT o_custkey AS doc, o_orderkey AS first, o_orderkey + o_orderkey % 70 - 2 AS last FROM orders), b AS (SELECT *, max(last) OVER (PARTITION BY doc ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
SELECT doc, first, CASE WHEN last < first OR last > 50000 THEN 'outside' ELSE 'overlap' END AS code FROM b WHERE last < first OR last > 50000 OR first <= before
""")
def range_issues(spark, sf_dir):
    k = F.col("o_orderkey")
    return separation.range_issues(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), k.alias("first"), (k + k % 70 - 2).alias("last"), F.lit(50000).alias("n_pages")))


@query("""
WITH p AS (SELECT doc_id AS page, text, string_split(text, chr(10)) AS l FROM documents), n AS (SELECT page, text, l, unnest(range(1, len(l) + 1)) AS i FROM p),
h AS (SELECT page, length(array_to_string(list_slice(l, 1, i - 1), chr(10))) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS start, length(l[i]) AS n, length(text) AS total FROM n WHERE regexp_matches(l[i], '^[A-Z][^ ]* [a-z]+ [^ ]*[.]$|[0-9]{4}')),
s AS (SELECT doc_id AS page FROM documents WHERE doc_id % 6 = 0), a AS (SELECT page + d AS page, max(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS own FROM s, (VALUES (-1), (0), (1)) t(d) GROUP BY 1),
w AS (SELECT a.page, 0 AS lo, least(length(text), CASE WHEN own = 1 THEN 600 ELSE 160 END) AS hi FROM a JOIN p ON p.page = a.page UNION ALL SELECT h.page, greatest(start - 160, 0), least(start + n + 1 + 700, total) FROM h JOIN a ON a.page = h.page),
f AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY page ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM w), g AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM f),
m AS (SELECT page, k, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY ALL)
SELECT m.page, md5(string_agg(substring(text, lo + 1, hi - lo), chr(10) || '[...]' || chr(10) ORDER BY lo)) AS context FROM m JOIN p ON p.page = m.page GROUP BY m.page
""")
def heading_windows(spark, sf_dir):
    """What is shown around the headings of pages and of their neighbours."""
    pages = table(spark, sf_dir, "documents").select(F.lit(0).alias("doc"), F.col("doc_id").alias("page"), "text")
    heading = F.col("line").rlike(r"^[A-Z][^ ]* [a-z]+ [^ ]*[.]$|[0-9]{4}")
    return separation.page_context(pages, heading, pages.filter("page % 6 = 0").select("doc", "page")).select("page", F.md5("context").alias("context"))


@query("""
WITH p AS (SELECT c_custkey AS plan, c_custkey % 4 AS repeats, c_custkey % 3 AS nm, c_custkey % 5 AS nr FROM customer),
c AS (SELECT plan, unnest(list_filter([CASE WHEN repeats < 2 THEN 'few_repeats' END, CASE WHEN nm < 2 THEN 'few_models' END, CASE WHEN plan % 7 = 0 AND nm > 0 THEN 'repeated_model' END, CASE WHEN plan % 11 = 0 AND nm > 0 THEN 'unknown_effort' END,
  CASE WHEN nr + (plan % 13 = 0 AND nr > 0)::INT < 2 THEN 'few_reports' END, CASE WHEN plan % 13 = 0 AND nr > 0 THEN 'repeated_report' END, CASE WHEN plan % 6 = 0 AND nr > 0 THEN 'no_inputs' END, CASE WHEN plan % 4 = 1 AND plan % 6 <> 0 AND nr > 0 THEN 'bad_input' END], lambda x: x IS NOT NULL)) AS code FROM p)
SELECT plan, code FROM c
""")
def trial_plan_issues(spark, sf_dir):
    """Plans that can't be run, and all that is wrong with them."""
    p = F.col("plan")
    plans = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("plan"), (F.col("c_custkey") % 4).alias("repeats"))
    model = plans.filter("plan % 3 > 0").select("plan", F.explode(F.sequence(F.lit(1), (p % 3).cast("int"))).alias("i"))
    models = model.select("plan", F.concat(F.lit("m"), "i").alias("model"), F.when(p % 11 == 0, "most").when(F.col("i") == 1, "low").alias("effort"))
    models = models.union(models.filter("plan % 7 = 0 and model = 'm1'"))
    paths = F.when(p % 6 == 0, F.array().cast("array<string>")).when(p % 4 == 1, F.array(F.lit("a.PDF"), F.lit("b.xls"))).otherwise(F.array(F.lit("a.PDF"), F.lit("b.docx")))
    reports = plans.filter("plan % 5 > 0").select("plan", F.explode(F.sequence(F.lit(1), (p % 5).cast("int"))).alias("report"), paths.alias("inputs"))
    return trials.plan_issues(plans, models, reports.union(reports.filter("plan % 13 = 0 and report = 1")))


@query("""
WITH j AS (SELECT r_regionkey AS plan, 'm' || m AS model, n_nationkey AS report, k AS repetition, m, n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey, (VALUES (1), (2)) a(m), (VALUES (1), (2), (3)) b(k)),
o AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY m, n_nationkey, repetition) AS place, 'C' || lpad(CAST(row_number() OVER (PARTITION BY plan ORDER BY sha256('1729/' || model || '/' || report || '/' || repetition)) AS VARCHAR), 3, '0') AS alias FROM j)
SELECT plan, model, report, repetition, place, alias, CASE WHEN place % 4 = 1 THEN 'interrupted' ELSE 'pending' END AS state FROM o WHERE place % 4 <> 0
""")
def trial_jobs(spark, sf_dir):
    """Jobs in the order of running, under blind aliases, and what of them is left."""
    m = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("plan"), F.explode(F.array(*(F.struct(F.lit(f"m{i}").alias("model"), F.lit(i).alias("pos")) for i in (1, 2)))).alias("m")).select("plan", "m.*")
    r = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("plan"), F.col("n_nationkey").alias("report"), F.col("n_nationkey").alias("pos"))
    planned = trials.jobs(m, r, 3, 1729)
    job = planned.withColumn("alias", F.concat_ws("/", "plan", "alias"))
    results = job.filter("place % 4 in (0, 1)").select("alias", F.when(F.col("place") % 4 == 0, "completed").otherwise("running").alias("state"))
    todo = trials.left_to_run(job, results).select(F.col("alias").alias("j"), "state")
    return planned.join(todo, F.concat_ws("/", "plan", "alias") == F.col("j")).drop("j")


@query("""
WITH q AS (SELECT l_orderkey, sum(l_linenumber % 5) AS q, count(*) AS n FROM lineitem GROUP BY l_orderkey),
r AS (SELECT o_orderstatus, o_orderpriority, o_totalprice AS wall, o_orderkey % 3 = 0 AS ready, o_orderkey % 5 < 2 AS candidate, o_custkey % 4 AS calls, o_custkey % 4 // 2 AS first_pass, CASE WHEN n = 5 THEN q END AS quality FROM orders LEFT JOIN q ON l_orderkey = o_orderkey),
s AS (SELECT 'o_orderstatus' AS key_name, o_orderstatus AS key_value, * FROM r UNION ALL SELECT 'o_orderpriority', o_orderpriority, * FROM r)
SELECT key_name, key_value, count(*) AS runs, count(*) FILTER (ready) AS n_ready, round(avg(wall), 6) AS mean_wall, round(sum(wall) / nullif(count(*) FILTER (candidate), 0), 6) AS seconds_per_candidate, CAST(sum(first_pass) AS DOUBLE) / nullif(sum(calls), 0) AS first_pass_rate, avg(quality) AS quality, count(quality) AS rated FROM s GROUP BY ALL
""")
def trial_summary(spark, sf_dir):
    """Trials by model and by report, with ratings of runs that have all five marks."""
    k = F.col("o_orderkey")
    calls = (F.col("o_custkey") % 4).cast("double")
    runs = table(spark, sf_dir, "orders").select(k.alias("alias"), "o_orderstatus", "o_orderpriority", F.col("o_totalprice").alias("wall"), (k % 3 == 0).alias("ready"), (k % 5 < 2).alias("candidate"), calls.alias("calls"), F.floor(calls / 2).alias("first_pass"))
    marks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("alias"), (F.col("l_linenumber") % 5).cast("double").alias("mark"))
    return trials.summary(runs, marks, ["o_orderstatus", "o_orderpriority"]).withColumns({c: F.round(c, 6) for c in ("mean_wall", "seconds_per_candidate")})


@query("""
SELECT c_custkey AS run, CASE WHEN g THEN 'failed' ELSE status END AS status, CASE WHEN g AND c_custkey % 3 <> 1 THEN 'failed' ELSE 'running' END AS first_stage, CASE WHEN g THEN 'the process that worked on this has stopped' END AS error
FROM (SELECT *, status IN ('running', 'queued') AND c_nationkey % 4 <> 3 AND c_custkey % 10 <> 0 AND c_custkey % 6 <> 1 AS g FROM (SELECT c_custkey, c_nationkey, list_extract(['running', 'queued', 'done'], c_custkey % 3 + 1) AS status FROM customer))
""")
def interrupted_runs(spark, sf_dir):
    """Runs whose worker has stopped become failed; other hosts (every fourth) and runs without a worker stay."""
    k, host = F.col("c_custkey"), (F.col("c_nationkey") % 4).cast("string")
    runs = table(spark, sf_dir, "customer").select(k.alias("run"), F.element_at(F.array(*(F.lit(x) for x in ("running", "queued", "done"))), (k % 3 + 1).cast("int")).alias("status"), F.when(k % 3 != 1, "split").alias("stage"), F.create_map(F.lit("split"), F.lit("running"), F.lit("pipeline"), F.lit("pass")).alias("stages"), host.alias("host"), F.when(k % 10 != 0, k).alias("pid"), F.lit(None).cast("string").alias("error"))
    seen = spark.range(3).select(F.col("id").cast("string").alias("host"), F.lit(None).cast("long").alias("pid"))
    live = runs.filter("run % 6 = 1").select("host", "pid")
    return state.interrupted(runs, seen.union(live)).select("run", "status", F.col("stages")["split"].alias("first_stage"), "error")


@query("""
WITH c AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_suppkey % 3 END AS seen, s_suppkey % 3 AS now, w FROM supplier, (VALUES ('a'), ('b')) t(w) WHERE NOT (w = 'b' AND s_suppkey % 2 = 0))
SELECT k, w AS writer, seen = now AND w = 'a' AS taken FROM c
""")
def optimistic_commits(spark, sf_dir):
    """Of two writers the first that saw the current version is taken."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("k"), (k % 3).alias("version"), F.lit("old").alias("body"))
    seen = F.when(F.col("k") % 5 == 0, 0).otherwise(F.col("k") % 3)
    change = lambda w, at: s.select("k", seen.cast("long").alias("version"), F.lit(w).alias("body"), F.lit(w).alias("writer"), F.lit(at).alias("at"))
    changes = change("a", 1).union(change("b", 2).filter("k % 2 <> 0"))
    after, refused = state.commit(s, changes, "k")
    done = after.filter("body <> 'old'").select("k", F.col("body").alias("writer"), F.lit(True).alias("taken"))
    return done.union(refused.select("k", "writer", F.lit(False)))


@query("""
WITH s AS (SELECT vec_id, label, list_transform(embedding[1:3], lambda x: abs(round(CAST(x AS DOUBLE), 2)) * 3) AS v FROM embeddings), m AS (SELECT *, list_max(v) AS top, list_reverse_sort(v)[2] AS second FROM s),
n AS (SELECT *, CASE WHEN v[3] = top AND v[3] > v[1] AND v[3] > v[2] THEN 'German' WHEN v[1] = top AND v[1] >= v[2] AND v[1] > v[3] THEN 'English' WHEN v[1] = top AND v[1] > v[3] THEN 'English' WHEN v[1] = top THEN 'English' WHEN v[2] = top AND v[2] >= v[3] THEN 'French' ELSE 'German' END AS name FROM m)
SELECT vec_id, CASE WHEN top >= 0.8 AND top - second >= 0.2 AND NOT (name = 'English' AND label % 2 = 0) THEN name ELSE 'Unknown' END AS language, round(top, 6) AS confidence, round(top - second, 6) AS margin FROM n
""")
def language_confidence(spark, sf_dir):
    """Languages by score, sure enough and ahead of the next; English only if a second test agrees."""
    at = lambda i: F.abs(F.round(F.col("embedding")[i].cast("double"), 2)) * 3
    scores = F.create_map(F.lit("English"), at(0), F.lit("French"), at(1), F.lit("German"), at(2))
    e = table(spark, sf_dir, "embeddings").select("vec_id", language_gate.confident(scores, F.col("label") % 2 != 0).alias("c"))
    return e.select("vec_id", "c.language", F.round("c.confidence", 6).alias("confidence"), F.round("c.margin", 6).alias("margin"))


@query("""
WITH s AS (SELECT conv_id, turn * 50 + turn % 3 * 10 AS b, turn * 50 + 50 AS e, role, count(*) OVER (PARTITION BY conv_id) * 50 + 25 AS n FROM conversations), g AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY conv_id ORDER BY b), 0) AS before, lead(b) OVER (PARTITION BY conv_id ORDER BY b) IS NULL AS last FROM s)
SELECT conv_id AS parent, before AS "begin", b AS "end", NULL AS language FROM g WHERE before < b UNION ALL SELECT conv_id, b, e, role FROM g UNION ALL SELECT conv_id, e, n, NULL FROM g WHERE last AND e < n
""")
def span_cover(spark, sf_dir):
    """Every character covered once by language spans and the gaps between them."""
    from pyspark.sql import Window

    t = F.col("turn")
    n = F.count("*").over(Window.partitionBy("conv_id")) * 50 + 25
    spans = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("parent"), n.alias("length"), (t * 50 + t % 3 * 10).alias("begin"), (t * 50 + 50).alias("end"), F.col("role").alias("language"))
    return language_gate.cover(spans)


_SCHEMA = {"type": "object", "properties": {"k": {"type": ["string", "null"]}, "n": {"type": ["integer", "null"]}, "items": {"type": "array", "items": {"type": "object", "properties": {"v": {"type": ["number", "null"]}}}}}}


@query("""
SELECT event_id, '{"items": [{"v": ' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE CAST(event_id % 7 AS VARCHAR) END || '}], "k": ' || CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '"' || event_type || '"' END || ', "n": null}' AS restored FROM events
""")
def restored_nulls(spark, sf_dir):
    """Answers in the reduced form with the nulls that it leaves out."""
    i = F.col("event_id")
    inner = F.when(i % 3 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"v":'), (i % 7).cast("string"), F.lit("}")))
    answer = F.concat(F.lit("{"), F.when(i % 2 == 0, F.lit("")).otherwise(F.concat(F.lit('"k":"'), "event_type", F.lit('",'))), F.lit('"items":['), inner, F.lit("]}"))
    return table(spark, sf_dir, "events").select("event_id", schemas.restore(answer, json.loads(json.dumps(_SCHEMA))).alias("restored"))
