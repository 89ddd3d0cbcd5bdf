"""Placed parts, runs and sites over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrasift.operators import extract
from terrasift.operators import placements as P
from terrasift.plans.registry import query, table
from terrasift.plans.spatial import _PTS, _TWO, _points, _two
from terrasift.shared import written


@query("""
WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey), j AS (SELECT o_orderkey, coalesce(n, 0) AS n, CASE WHEN o_orderkey % 5 = 0 THEN 'located' WHEN o_orderkey % 7 = 0 THEN 'unresolved' END AS declared FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)
SELECT o_orderkey AS segment, n AS n_parts, coalesce(declared, CASE WHEN n > 0 THEN 'located' ELSE 'unresolved' END) AS outcome, CASE WHEN declared <> CASE WHEN n > 0 THEN 'located' ELSE 'unresolved' END THEN 'declared_' || declared END AS issue FROM j
""")
def segment_outcomes(spark, sf_dir):
    k = F.col("o_orderkey")
    segments = table(spark, sf_dir, "orders").select(k.alias("segment"), F.when(k % 5 == 0, "located").when(k % 7 == 0, "unresolved").alias("declared"))
    return P.outcomes(segments, table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("segment")))


@query("""
WITH r AS (SELECT DISTINCT conv_id AS run FROM conversations), s AS (SELECT conv_id AS run, list_sort(list(turn)) AS sig FROM conversations GROUP BY conv_id),
g AS (SELECT r.run, sig FROM r JOIN s ON s.run = r.run), n AS (SELECT sig, arg_max(run, (CASE WHEN run % 3 = 0 THEN 1 ELSE 0 END, run % 10, run)) AS newest FROM g GROUP BY sig)
SELECT g.run, CASE WHEN g.run % 4 = 0 AND g.run + 1 IN (SELECT run FROM r) THEN g.run + 1 ELSE newest END AS base FROM g JOIN n ON n.sig = g.sig
""")
def run_bases(spark, sf_dir):
    """Runs grouped by what they segment; the base of each."""
    c = table(spark, sf_dir, "conversations")
    r = F.col("run")
    runs = c.select(F.col("conv_id").alias("run")).distinct().select("run", F.when(r % 3 == 0, "pipeline").otherwise("agent").alias("kind"), (r % 10).alias("created"), F.when(r % 4 == 0, r + 1).alias("base_run"))
    return P.run_groups(runs, c.select(F.col("conv_id").alias("run"), F.col("turn").alias("segment"), F.lit("p").alias("process"))).select("run", "base")


@query("SELECT o_orderkey AS run FROM orders WHERE o_orderkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice < 100000 UNION SELECT o_orderkey * 2 FROM orders WHERE o_totalprice < 100000)")
def parent_runs(spark, sf_dir):
    n = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.when(F.col("o_totalprice") < 100000, F.array("o_custkey", F.col("o_orderkey") * 2)).alias("child_runs"))
    return P.top_runs(n).select("run")


@query("""
WITH f AS (SELECT p_brand || p_size AS g, min(p_partkey) AS first FROM part GROUP BY 1) SELECT first, b.p_partkey AS second FROM part b JOIN f ON f.g = b.p_brand || b.p_size JOIN part a ON a.p_partkey = first
WHERE first <> b.p_partkey AND a.p_partkey % 7 <> b.p_partkey % 7 AND a.p_type <> b.p_type
""")
def footprint_reuse(spark, sf_dir):
    """Extents that repeat the geometry of an earlier segment's."""
    k = F.col("p_partkey")
    return P.reused_footprints(table(spark, sf_dir, "part").select(k.alias("part"), k.alias("pos"), (k % 7).alias("segment"), F.col("p_type").alias("process"), F.concat("p_brand", F.col("p_size").cast("string")).alias("geom")))


@query("""
WITH u AS (SELECT doc_id AS id FROM labels WHERE doc_id % 4 <> 1 UNION ALL SELECT doc_id FROM labels WHERE doc_id % 9 = 0 UNION ALL SELECT doc_id + 9000000 FROM labels WHERE doc_id % 50 = 2), c AS (SELECT id, count(*) AS n FROM u GROUP BY id)
SELECT coalesce(l.doc_id, c.id) AS id, CASE WHEN c.id IS NULL THEN 'missing' WHEN l.doc_id IS NULL THEN 'unknown' ELSE 'repeated' END AS problem FROM labels l FULL JOIN c ON c.id = l.doc_id WHERE c.id IS NULL OR l.doc_id IS NULL OR n > 1
""")
def consolidation_accounting(spark, sf_dir):
    i = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    outputs = i.filter("id % 4 <> 1").groupBy((F.col("id") % 20).alias("g")).agg(F.collect_list("id").alias("ids"))
    extra = i.filter("id % 9 = 0").union(i.filter("id % 50 = 2").select(F.col("id") + 9000000))
    return P.accounting(i, outputs, extra)


@query("""
WITH l AS (SELECT o_custkey % 40 AS x0, o_orderkey % 9 AS y0, o_custkey % 13 AS x1, o_orderkey % 4 AS y1 FROM orders), e AS (SELECT x0 AS x, y0 AS y FROM l UNION ALL SELECT x1, y1 FROM l), d AS (SELECT count(*) AS n FROM e GROUP BY x, y)
SELECT count(*) FILTER (n = 1) AS dangling, count(*) FILTER (n > 2) AS junctions, (SELECT count(*) FROM l WHERE x0 = x1 AND y0 = y1) AS closed FROM d
""")
def stream_degrees(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return P.endpoint_degrees(o.select((F.col("o_custkey") % 40).alias("x0"), (F.col("o_orderkey") % 9).alias("y0"), (F.col("o_custkey") % 13).alias("x1"), (F.col("o_orderkey") % 4).alias("y1")))


@query(f"""WITH {_TWO}, z AS (SELECT i AS zone, CASE WHEN i % 2 = 0 THEN 'dsm' ELSE 'dem' END AS raster, i * 5.5 AS x0, i * 2.5 AS y0, i * 5.5 + 9.25 AS x1, i * 2.5 + 7.75 AS y1 FROM range(0, 9) t(i))
SELECT zone, round(coalesce(sum((least(c + 1, x1) - greatest(c, x0)) * (least(r + 1, y1) - greatest(r, y0))) FILTER (c IS NOT NULL), 0) / ((any_value(x1) - any_value(x0)) * (any_value(y1) - any_value(y0))), 9) AS share
FROM z LEFT JOIN two ON two.raster = z.raster AND c < x1 AND c + 1 > x0 AND r < y1 AND r + 1 > y0 GROUP BY zone""")
def dem_coverage(spark, sf_dir):
    i = F.col("id")
    zones = spark.range(9).select(i.alias("zone"), F.when(i % 2 == 0, "dsm").otherwise("dem").alias("raster"), (i * 5.5).alias("x0"), (i * 2.5).alias("y0"), (i * 5.5 + 9.25).alias("x1"), (i * 2.5 + 7.75).alias("y1"))
    return P.covered_share(_two(spark, sf_dir), zones, 1.0).withColumn("share", F.round("share", 9))


@query(f"""WITH RECURSIVE {_PTS}, n AS (SELECT a.vec_id AS u, b.vec_id AS v FROM p a JOIN p b ON sqrt(greatest(a.x - b.x - 3, b.x - a.x - 3, 0) ** 2 + greatest(a.y - b.y - 3, b.y - a.y - 3, 0) ** 2) <= 2),
t(u, v) AS (SELECT u, u FROM n UNION SELECT t.u, n.v FROM t JOIN n ON n.u = t.v), s AS (SELECT u AS box, min(v) AS site FROM t GROUP BY u)
SELECT box, site FROM s WHERE site IN (SELECT site FROM s GROUP BY site HAVING count(DISTINCT box % 3) >= 2)""")
def ref_sites(spark, sf_dir):
    """Clusters of boxes that at least two models support."""
    p = _points(spark, sf_dir)
    boxes = p.select(F.col("vec_id").alias("box"), (F.col("vec_id") % 3).alias("model"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 3).alias("x1"), (F.col("y") + 3).alias("y1"))
    return P.sites(boxes, 1.0, 2, written)


@query("""
WITH i AS (SELECT conv_id AS run, turn, CASE WHEN conv_id % 6 = 5 AND turn = 1 THEN NULL WHEN conv_id % 6 = 4 AND turn = 0 THEN -1 ELSE turn END AS s FROM conversations)
SELECT run, CASE WHEN count(*) FILTER (s IS NULL OR s = -1) = 0 THEN list_sort(list(DISTINCT s)) END AS segments FROM i GROUP BY run
""")
def affected_segments(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), "turn")
    ids = F.when((F.col("run") % 6 == 5) & (F.col("turn") == 1), F.array().cast("array<bigint>")).when((F.col("run") % 6 == 4) & (F.col("turn") == 0), F.array(F.lit(-1).cast("bigint"))).otherwise(F.array("turn"))
    return P.affected(c.select("run", ids.alias("segment_ids")), c.select("run", F.col("turn").alias("segment")))


@query("SELECT name, list_sort(list(DISTINCT src)) AS sources FROM (SELECT trim(p_brand) AS name, 'p_brand' AS src FROM part UNION ALL SELECT trim(p_type), 'p_type' FROM part) WHERE length(name) >= 4 GROUP BY name")
def gazetteer_names(spark, sf_dir):
    return P.gazetteer(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


@query("""
SELECT c_custkey AS figure, list_filter([CASE WHEN c_custkey % 6 < 4 THEN 'too_few_controls' END, CASE WHEN c_custkey % 3 < 1 THEN 'no_check_points' END, CASE WHEN c_acctbal / 10000 < 0.3 THEN 'controls_too_close' END,
  CASE WHEN c_acctbal / 100 > 25 THEN 'check_error' END, CASE WHEN c_custkey % 11 = 0 THEN 'no_crs' END, CASE WHEN c_custkey % 5 = 0 THEN 'no_provenance' END], lambda x: x IS NOT NULL) AS reasons FROM customer
""")
def georeferencing(spark, sf_dir):
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    return P.georeferencing_reasons(table(spark, sf_dir, "customer").select(k.alias("figure"), (k % 6).alias("n_controls"), (k % 3).alias("n_checks"), (b / 10000).alias("span"), (b / 100).alias("max_check"), F.when(k % 11 != 0, "EPSG:1").alias("crs"), F.when(k % 5 == 0, " ").otherwise("map").alias("provenance")))


@query("SELECT source AS doc, doc_id AS page, 'figure' AS kind, CAST(doc_id AS VARCHAR) AS number, 'Title ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' goes on.' ELSE '.' END AS title FROM documents")
def figure_captions(spark, sf_dir):
    """Captions (made to stand before each text), with the lines that continue them."""
    i = F.col("doc_id").cast("string")
    text = F.concat(F.lit("Fig. "), i, F.lit(": Title "), i, F.when(F.col("doc_id") % 2 == 0, "\n goes on.\nOther").otherwise(".\nOther"))
    return P.captions(table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), text.alias("text")))


@query("""
SELECT doc_id AS doc, page, arg_max(title, (confidence, title)) AS title, CASE WHEN count(DISTINCT lower(trim(title))) > 1 OR max(confidence) < 0.8 THEN 'review' ELSE 'accepted' END AS state
FROM (SELECT doc_id % 50 AS doc_id, doc_id % 4 AS page, CASE WHEN doc_id % 6 = 0 THEN 'B' ELSE 'A' END AS title, (doc_id % 10) / 10.0 AS confidence FROM documents) GROUP BY ALL
""")
def event_boundaries(spark, sf_dir):
    """Boundaries found several times: the most confident wins, conflicts go to review."""
    d = F.col("doc_id")
    return extract.resolve_boundaries(table(spark, sf_dir, "documents").select((d % 50).alias("doc"), (d % 4).alias("page"), F.when(d % 6 == 0, "B").otherwise("A").alias("title"), ((d % 10) / 10.0).alias("confidence")))


@query("""
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)with') THEN 'Erosion' WHEN regexp_matches(text, '(?i)mit ') THEN 'Deposition' ELSE 'unknown' END AS answer, 1 AS attempts FROM documents
""")
def classified_texts(spark, sf_dir):
    """Labels from the rule extractor, through the call contract."""
    rules = extract.RuleExtractor([("with", "Erosion"), ("mit ", "Deposition")])
    log = extract.call(table(spark, sf_dir, "documents"), "doc_id", "text", rules, extract.one_of(extract.PHASES))
    return extract.accepted(log).select(F.col("key").cast("long").alias("doc_id"), "answer", "attempts")
