"""Aggregations: sessions, counters, distributions, votes, scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrasift.operators import metrics as M
from terrasift.operators import scoring
from terrasift.plans.registry import query, table
from terrasift.sources import readers


def _log(spark, sf_dir):
    """Events as a call log: each user is a run, `signup` starts a stage, and values are waiting times."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", "ts", "event_type", "value")


@query("""
SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS execution FROM events
""")
def timing_sessions(spark, sf_dir):
    return M.executions(_log(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type") == "signup").select("user_id", "event_id", "execution")


_COUNTS = """count(*) FILTER (attempt = 1) AS requests, count(*) AS attempts, count(*) FILTER (attempt > 1) AS retries,
       count(*) FILTER (regexp_matches(error, '(?i)time[d ]*out')) AS timeouts, count(*) FILTER (outcome <> 'pass') AS failed, round(sum(wait), 6) AS waited"""
_CALLS = """SELECT user_id, event_type AS stage, event_id % 3 + 1 AS attempt, CASE WHEN event_id % 5 = 0 THEN 'fail' ELSE 'pass' END AS outcome,
  CASE WHEN event_id % 10 = 0 THEN 'Timed out' WHEN event_id % 5 = 0 THEN 'bad answer' END AS error, coalesce(value, 0) AS wait FROM events"""


def _calls(spark, sf_dir):
    i = F.col("event_id")
    return _log(spark, sf_dir).select("user_id", F.col("event_type").alias("stage"), (i % 3 + 1).alias("attempt"), F.when(i % 5 == 0, "fail").otherwise("pass").alias("outcome"), F.when(i % 10 == 0, "Timed out").when(i % 5 == 0, "bad answer").alias("error"), F.col("value").alias("wait"))


@query(f"SELECT stage, {_COUNTS} FROM ({_CALLS}) GROUP BY stage")
def timing_counts(spark, sf_dir):
    out = _calls(spark, sf_dir).groupBy("stage").agg(*M.counters(F.col("attempt"), F.col("outcome"), F.col("error"), F.col("wait")))
    return out.withColumn("waited", F.round("waited", 6))


@query(f"SELECT coalesce(stage, 'total') AS stage, CAST(user_id AS BIGINT) AS user_id, {_COUNTS} FROM ({_CALLS}) GROUP BY GROUPING SETS ((user_id, stage), (user_id))")
def timing_statistics(spark, sf_dir):
    """By run and stage, with totals, in one pass."""
    calls = _calls(spark, sf_dir)
    sets = calls.groupingSets([["user_id", "stage"], ["user_id"]], "user_id", "stage").agg(*M.counters(F.col("attempt"), F.col("outcome"), F.col("error"), F.col("wait")))
    return sets.withColumn("stage", F.coalesce("stage", F.lit("total"))).withColumn("waited", F.round("waited", 6)).withColumn("user_id", F.col("user_id").cast("long"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS ready, avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) AS share, sum(CASE WHEN event_type = 'purchase' THEN value END) AS tokens FROM events GROUP BY user_id")
def run_metrics(spark, sf_dir):
    """Per run; sums over nothing are null, not 0."""
    ready = F.col("event_type") == "purchase"
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(ready).alias("ready"), F.avg(ready.cast("double")).alias("share"), F.sum(F.when(ready, F.col("value"))).alias("tokens"))


_DIST = "count(o_totalprice) AS n, round(avg(o_totalprice), 7) AS mean, round(median(o_totalprice), 6) AS median, min(o_totalprice) AS min, max(o_totalprice) AS max, round(stddev_samp(o_totalprice), 4) AS stdev"


def _rounded(df):
    return df.withColumns({c: F.round(c, places) for c, places in (("mean", 7), ("median", 6), ("stdev", 4))})


@query(f"SELECT o_custkey, {_DIST} FROM orders GROUP BY o_custkey")
def distribution(spark, sf_dir):
    return _rounded(M.distributions(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice"))


@query(f"SELECT 'o_orderstatus' AS key_name, o_orderstatus AS key_value, {_DIST} FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'o_orderpriority', o_orderpriority, {_DIST} FROM orders GROUP BY o_orderpriority")
def summarize_by_each(spark, sf_dir):
    return _rounded(M.distributions_by_each(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice"))


@query("SELECT l_returnflag, sum(l_quantity) / nullif(count(*) FILTER (l_linestatus = 'O'), 0) AS cost FROM lineitem GROUP BY l_returnflag")
def failure_adjusted(spark, sf_dir):
    """All time spent over what came of it; null if nothing did."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg((F.sum("l_quantity") / F.nullif(F.count_if(F.col("l_linestatus") == "O"), F.lit(0))).alias("cost"))


@query("""
WITH v AS (SELECT conv_id, (length(text) % 3) AS shift, turn FROM conversations), c AS (SELECT conv_id, shift, count(*) AS n, min(turn) AS seen FROM v GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, seen) AS k, sum(n) OVER (PARTITION BY conv_id) AS total FROM c)
SELECT conv_id, CASE WHEN n >= greatest(2, 0.3 * total) THEN shift ELSE 0 END AS shift, n AS votes FROM t WHERE k = 1
""")
def mode_offset(spark, sf_dir):
    """The vote on a page offset, first seen first."""
    v = table(spark, sf_dir, "conversations").select("conv_id", (F.length("text") % 3).alias("shift"), "turn")
    return M.mode_vote(v, "conv_id", "shift", "turn", 0.3)


@query("""
WITH l AS (SELECT source, doc_id, string_split('Report ' || right('00000000' || CAST(doc_id AS VARCHAR), 8) || chr(10) || text || chr(10) || 'Set in ' || lang, chr(10)) AS t FROM documents),
e AS (SELECT source, doc_id, unnest(list_concat(list_slice(t, 1, 3), list_slice(t, greatest(len(t) - 2, 1), len(t)))) AS line FROM l),
n AS (SELECT source, count(*) AS pages FROM documents GROUP BY source), g AS (SELECT source, regexp_replace(line, '[0-9]', '#', 'g') AS line, count(DISTINCT doc_id) AS pages FROM e GROUP BY ALL)
SELECT g.source, md5(line) AS line, g.pages FROM g JOIN n ON n.source = g.source WHERE g.pages >= greatest(3, floor(0.4 * n.pages))
""")
def boilerplate_lines(spark, sf_dir):
    """First and last lines, digits masked, that many pages of a source share; pages have a running head and a foot of their language."""
    head = F.concat(F.lit("Report "), F.right(F.concat(F.lit("00000000"), F.col("doc_id").cast("string")), F.lit(8)))
    text = F.concat(head, F.lit("\n"), "text", F.lit("\nSet in "), "lang")
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.split(text, "\n", -1).alias("t"))
    edge = F.concat(F.slice("t", 1, 3), F.slice("t", F.greatest(F.size("t") - 2, F.lit(1)), F.lit(3)))
    lines = docs.select("source", "doc_id", F.explode(edge).alias("line")).withColumn("line", F.regexp_replace("line", "[0-9]", "#"))
    pages = docs.groupBy("source").agg(F.count("*").alias("all"))
    shared = lines.distinct().groupBy("source", "line").agg(F.count("*").alias("pages"))
    return shared.join(pages, "source").filter(F.col("pages") >= F.greatest(F.lit(3), F.floor(0.4 * F.col("all")))).select("source", F.md5("line").alias("line"), "pages")


@query("""
WITH w AS (SELECT source, doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{4,}')) AS name FROM documents), g AS (SELECT name, count(*) AS mentions, list_sort(list(DISTINCT source)) AS sources FROM w GROUP BY name)
SELECT name, mentions, sources FROM g ORDER BY mentions DESC, name LIMIT 30
""")
def quoted_names(spark, sf_dir):
    """The 30 names mentioned most, with where."""
    names = table(spark, sf_dir, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{4,})"), F.lit(1))).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("mentions"), F.array_sort(F.collect_set("source")).alias("sources")).orderBy(F.desc("mentions"), "name").limit(30)


@query("""
SELECT doc_id, clue FROM (SELECT doc_id, clue, row_number() OVER (PARTITION BY doc_id, substring(clue, 1, 10) ORDER BY i) AS k FROM (
  SELECT doc_id, unnest(c) AS clue, unnest(range(0, len(c))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+[^0-9]{0,12}') AS c FROM documents))) WHERE k = 1
""")
def distinct_clues(spark, sf_dir):
    """The first clue of each page and beginning."""
    c = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("([0-9]+[^0-9]{0,12})"), F.lit(1))).alias("i", "clue"))
    k = F.row_number().over(Window.partitionBy("doc_id", F.substring("clue", 1, 10)).orderBy("i"))
    return c.withColumn("k", k).filter("k = 1").select("doc_id", "clue")


_RANK = "CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '5-LOW' THEN 0 END"


@query(f"SELECT o_custkey, arg_min(o_orderpriority, {_RANK}) AS confidence FROM orders GROUP BY o_custkey")
def weakest_confidence(spark, sf_dir):
    ranks = {"5-LOW": 0, "4-NOT SPECIFIED": 1, "3-MEDIUM": 2, "2-HIGH": 3, "1-URGENT": 4}
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(M.weakest(ranks, F.col("o_orderpriority")).alias("confidence"))


@query("""
SELECT p_brand, CASE min(CASE WHEN p_type LIKE 'PROMO%' THEN 0 WHEN p_size > 40 THEN 1 WHEN p_size > 20 THEN 2 ELSE 3 END) WHEN 0 THEN 'measured' WHEN 1 THEN 'located' WHEN 2 THEN 'extent' ELSE 'unresolved' END AS tier FROM part GROUP BY p_brand
""")
def precision_tier(spark, sf_dir):
    """The most specific part wins."""
    tier = F.when(F.col("p_type").startswith("PROMO"), 0).when(F.col("p_size") > 40, 1).when(F.col("p_size") > 20, 2).otherwise(3)
    names = F.array(*(F.lit(x) for x in ("measured", "located", "extent", "unresolved")))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min(tier).alias("t")).select("p_brand", F.element_at(names, F.col("t") + 1).alias("tier"))


@query("SELECT avg(l_discount) AS progress, bool_or(l_quantity > 49) AS any_big, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'returned' WHEN count(*) FILTER (l_linestatus = 'O') > 0 THEN 'open' ELSE 'done' END AS status, l_orderkey FROM lineitem GROUP BY l_orderkey")
def collection_progress(spark, sf_dir):
    status = F.when(F.count_if(F.col("l_returnflag") == "R") > 0, "returned").when(F.count_if(F.col("l_linestatus") == "O") > 0, "open").otherwise("done")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.avg("l_discount").alias("progress"), F.bool_or(F.col("l_quantity") > 49).alias("any_big"), status.alias("status"))


@query("""
WITH i AS (SELECT source AS doc, doc_id AS page, md5(split_part(text, ' ', 1)) AS digest, n_chars AS width, n_chars // 2 AS height FROM documents)
SELECT doc, page, digest, width, height FROM i ANTI JOIN (SELECT doc, digest FROM i GROUP BY ALL HAVING count(DISTINCT page) >= 3) o USING (doc, digest)
""")
def repeated_figures(spark, sf_dir):
    """Pictures (the first word stands for one) but for logos, those on three pages of a document or more."""
    images = table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.md5(F.split("text", " ")[0]).alias("digest"), F.col("n_chars").alias("width"), F.expr("n_chars div 2").alias("height"))
    return readers.logo_filter(images).select("doc", "page", "digest", "width", "height")


def _boxes(spark, sf_dir):
    """Vectors as boxes: label and hundreds of the id are the segment, the id tells the model, the first four numbers place the box."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda k: F.round(F.col("embedding")[k].cast("double") * 100)
    return e.select((F.col("vec_id") % 3).cast("string").alias("model"), (F.floor(F.col("vec_id") / 100) * 100 + F.col("label")).alias("segment"), at(0).alias("x0"), at(1).alias("y0"), (at(0) + 10 + F.abs(at(2))).alias("x1"), (at(1) + 10 + F.abs(at(3))).alias("y1"))


_BOX = """b AS (SELECT CAST(vec_id % 3 AS VARCHAR) AS model, CAST(floor(vec_id / 100.0) AS BIGINT) * 100 + label AS segment, round(CAST(embedding[1] AS DOUBLE) * 100) AS x0, round(CAST(embedding[2] AS DOUBLE) * 100) AS y0,
  round(CAST(embedding[1] AS DOUBLE) * 100) + 10 + abs(round(CAST(embedding[3] AS DOUBLE) * 100)) AS x1, round(CAST(embedding[2] AS DOUBLE) * 100) + 10 + abs(round(CAST(embedding[4] AS DOUBLE) * 100)) AS y1 FROM embeddings),
ex AS (SELECT segment, v AS a, lead(v) OVER (PARTITION BY segment ORDER BY v) AS z FROM (SELECT segment, x0 AS v FROM b UNION SELECT segment, x1 FROM b)),
ey AS (SELECT segment, v AS a, lead(v) OVER (PARTITION BY segment ORDER BY v) AS z FROM (SELECT segment, y0 AS v FROM b UNION SELECT segment, y1 FROM b)),
c AS (SELECT b.segment, ex.a AS xa, ex.z AS xz, ey.a AS ya, ey.z AS yz, count(*) AS n, list(DISTINCT model) AS who FROM b JOIN ex ON ex.segment = b.segment AND ex.a >= x0 AND ex.z <= x1 JOIN ey ON ey.segment = b.segment AND ey.a >= y0 AND ey.z <= y1 GROUP BY ALL)"""


@query(f"WITH {_BOX} SELECT segment, sum((xz - xa) * (yz - ya)) AS area FROM c WHERE n >= 2 GROUP BY segment")
def coverage_boxes(spark, sf_dir):
    """Area covered by at least two boxes of a segment."""
    return scoring.coverage_area(_boxes(spark, sf_dir), 2)


def _scores(model: str) -> str:
    """SQL of the scores of a model against what the others agree on."""
    return f"""
WITH {_BOX}, k AS (SELECT segment, ceil(count(DISTINCT model) / 2) AS k FROM b WHERE model <> '{model}' GROUP BY segment),
a AS (SELECT c.segment, coalesce(sum((xz - xa) * (yz - ya)) FILTER (list_contains(who, '{model}')), 0) AS a, coalesce(sum((xz - xa) * (yz - ya)) FILTER (len(list_filter(who, lambda m: m <> '{model}')) >= k), 0) AS b,
  coalesce(sum((xz - xa) * (yz - ya)) FILTER (list_contains(who, '{model}') AND len(list_filter(who, lambda m: m <> '{model}')) >= k), 0) AS c FROM c JOIN k ON k.segment = c.segment GROUP BY c.segment)
SELECT segment, c / nullif(a, 0) AS precision, c / nullif(b, 0) AS recall, c / nullif(a + b - c, 0) AS iou, CASE WHEN a > 0 AND b > 0 THEN least(a, b) / greatest(a, b) ELSE 0 END AS scale,
  coalesce(CASE WHEN a > 0 AND b > 0 THEN least(a, b) / greatest(a, b) ELSE 0 END * list_avg(list_filter([c / nullif(a, 0), c / nullif(b, 0), c / nullif(a + b - c, 0)], lambda x: x IS NOT NULL)), 0) AS score FROM a
"""


@query(_scores("0"))
def ref_scoring_boxes(spark, sf_dir):
    """Model 0 against what the others agree on."""
    boxes = _boxes(spark, sf_dir)
    return scoring.score(boxes.filter("model = '0'"), boxes.filter("model <> '0'"))


@query("SELECT round(avg(score), 9) AS ceiling FROM (" + " UNION ALL ".join(f"SELECT avg(score) AS score FROM ({_scores(m)})" for m in "012") + ")")
def leave_one_out(spark, sf_dir):
    """Each model against the others: the mean score that a reference itself reaches."""
    boxes = _boxes(spark, sf_dir)
    out = None
    for m in ("0", "1", "2"):
        s = scoring.score(boxes.filter(F.col("model") == m), boxes.filter(F.col("model") != m)).agg(F.lit(m).alias("model"), F.avg("score").alias("score"))
        out = s if out is None else out.union(s)
    return out.agg(F.round(F.avg("score"), 9).alias("ceiling"))
