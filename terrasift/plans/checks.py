"""Constraint queries, set operations, sorts and state over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrasift.functions.text import natural_key
from terrasift.operators import quality as Q
from terrasift.operators import state
from terrasift.plans.registry import query, table


@query("""
SELECT conv_id, turn, unnest(list_filter([CASE WHEN role NOT IN ('user', 'assistant') THEN 'role_not_allowed' END, CASE WHEN length(trim(text)) < 20 THEN 'text_too_short' END,
  CASE WHEN turn > 0 AND role = 'system' THEN 'system_not_first' END, CASE WHEN contains(text, chr(10)) AND length(text) > 600 THEN 'long_with_breaks' END], lambda x: x IS NOT NULL)) AS code FROM conversations
""")
def violations_candidate(spark, sf_dir):
    """Issue rows of a candidate, all rules in one pass."""
    t = F.col("text")
    rules = {"role_not_allowed": ~F.col("role").isin("user", "assistant"), "text_too_short": F.length(F.trim(t)) < 20, "system_not_first": (F.col("turn") > 0) & (F.col("role") == "system"), "long_with_breaks": t.contains("\n") & (F.length(t) > 600)}
    return Q.issues(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], rules)


@query("""
SELECT conv_id, NOT bool_or(role NOT IN ('user', 'assistant')) AS roles_ok, NOT bool_or(length(trim(text)) < 20 OR text IS NULL) AS texts_ok, NOT bool_or(turn > 6) AS length_ok FROM conversations GROUP BY conv_id
""")
def candidate_checks(spark, sf_dir):
    """The boolean checks of each candidate."""
    groups = {"roles_ok": [~F.col("role").isin("user", "assistant")], "texts_ok": [F.length(F.trim("text")) < 20, F.col("text").isNull()], "length_ok": [F.col("turn") > 6]}
    return Q.checks(table(spark, sf_dir, "conversations"), ["conv_id"], groups)


@query("SELECT doc_id, unnest(list_filter([CASE WHEN quality NOT IN (0, 1) THEN 'quality' END, CASE WHEN toxic = 1 AND quality = 1 THEN 'toxic_but_good' END], lambda x: x IS NOT NULL)) AS code FROM labels")
def violations_labels(spark, sf_dir):
    """Vocabulary and consistency of labels."""
    return Q.issues(table(spark, sf_dir, "labels"), ["doc_id"], {"quality": ~F.col("quality").isin(0, 1), "toxic_but_good": Q.implies(F.col("toxic") == 1, F.col("quality") == 0)})


@query("""
SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderstatus = 'F' AND o_totalprice > 400000 THEN 'closed_and_large' END, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 'urgent_open' END,
  CASE WHEN NOT (o_orderstatus <> 'P' OR o_totalprice > 1000) THEN 'pending_small' END], lambda x: x IS NOT NULL)) AS code FROM orders
""")
def violations_outcome(spark, sf_dir):
    """Located and unresolved outcomes must be consistent: implications as rules."""
    rules = {"closed_and_large": (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000), "urgent_open": Q.implies(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") != "O"), "pending_small": Q.implies(F.col("o_orderstatus") == "P", F.col("o_totalprice") > 1000)}
    return Q.issues(table(spark, sf_dir, "orders"), ["o_orderkey"], rules)


@query("""
WITH a AS (SELECT s_suppkey, s_name, s_acctbal FROM supplier), b AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 3 THEN 'x' ELSE s_name END AS s_name, s_acctbal + CASE WHEN s_suppkey % 7 = 0 THEN 0.5 ELSE 0.00001 END AS s_acctbal FROM supplier WHERE s_suppkey % 6 <> 0)
SELECT a.s_suppkey, unnest(CASE WHEN b.s_suppkey IS NULL THEN ['row'] ELSE list_filter([CASE WHEN a.s_name <> b.s_name THEN 's_name' END, CASE WHEN abs(a.s_acctbal - b.s_acctbal) > 0.0001 THEN 's_acctbal' END], lambda x: x IS NOT NULL) END) AS field FROM a LEFT JOIN b ON a.s_suppkey = b.s_suppkey
""")
def delivery_validation(spark, sf_dir):
    """Delivered against canonical rows, field by field, with a tolerance for numbers."""
    a = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    b = a.filter("s_suppkey % 6 <> 0").withColumn("s_name", F.when(F.col("s_suppkey") % 10 == 3, "x").otherwise(F.col("s_name"))).withColumn("s_acctbal", F.col("s_acctbal") + F.when(F.col("s_suppkey") % 7 == 0, 0.5).otherwise(0.00001))
    return Q.compare_tables(a, b, "s_suppkey", ["s_name", "s_acctbal"], 0.0001)


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'missing' ELSE 'reordered' END AS problem FROM labels WHERE doc_id % 9 = 0 OR doc_id % 5 = 1 UNION ALL SELECT doc_id + 5000000, 'unknown' FROM labels WHERE doc_id % 40 = 2")
def id_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").alias("pos"))
    r = e.filter("doc_id % 9 <> 0").withColumn("pos", F.when(F.col("doc_id") % 5 == 1, F.col("pos") + 1).otherwise(F.col("pos")))
    return Q.id_coverage(e, r.union(e.filter("doc_id % 40 = 2").select(F.col("doc_id") + 5000000, F.lit(0).cast("long"))), "doc_id")


@query("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 3 FROM region")
def candidate_union(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k")).union(table(spark, sf_dir, "region").select(F.col("r_regionkey") + 3)).distinct()


@query("SELECT n_nationkey AS k FROM nation INTERSECT SELECT s_nationkey FROM supplier")
def candidate_intersection(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def uninspected(spark, sf_dir):
    """All that hasn't been used."""
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 440000)")
def outside_references(spark, sf_dir):
    """Customers that no large order refers to."""
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 440000")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT event_id, list_sort(list_filter(json_keys(props), lambda k: k NOT IN ('a', 'b', 'page'))) AS unknown FROM events")
def unknown_keys(spark, sf_dir):
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.array_sort(Q.unknown_keys(m, ["a", "b", "page"])).alias("unknown"))


@query("SELECT source, list_filter(['en', 'de', 'fr', 'es'], lambda l: NOT list_contains(langs, l)) AS missing FROM (SELECT source, list(DISTINCT lang) AS langs FROM documents GROUP BY source)")
def missing_roles(spark, sf_dir):
    """Core roles that a package lacks."""
    roles = F.array(*(F.lit(x) for x in ("en", "de", "fr", "es")))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("l")).select("source", F.array_except(roles, "l").alias("missing"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations")
def candidate_order(spark, sf_dir):
    """The places of candidates in causal order."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("place"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def latest_first(spark, sf_dir):
    """Listings, the latest first."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", k.alias("place"))


@query("""
SELECT o_custkey, o_orderkey, k FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey) AS k FROM orders) WHERE k <= 10
""")
def evidence_priority(spark, sf_dir):
    """The first ten of each group by kind, then place (the feature is a list of ten)."""
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(rank, "o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("k", k).filter("k <= 10").select("o_custkey", "o_orderkey", "k")


@query("SELECT p_brand, p_partkey, k FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 40")
def kind_caps(spark, sf_dir):
    """At most forty of each kind (the feature)."""
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return table(spark, sf_dir, "part").withColumn("k", k).filter("k <= 40").select("p_brand", "p_partkey", "k")


@query("SELECT source, lang, n FROM (SELECT source, lang, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, seen) AS k FROM (SELECT source, lang, count(*) AS n, min(doc_id) AS seen FROM documents GROUP BY ALL)) WHERE k <= 2")
def top_votes(spark, sf_dir):
    """The two most frequent of each group; first seen first among equals."""
    n = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("seen"))
    k = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "seen"))
    return n.withColumn("k", k).filter("k <= 2").select("source", "lang", "n")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name || '-' || p_size) DESC, p_name || '-' || p_size, p_partkey) AS place FROM part")
def longest_first(spark, sf_dir):
    """Places of names by length, longest first."""
    name = F.concat("p_name", F.lit("-"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc(F.length(name)), name, "p_partkey")).alias("place"))


@query("""
SELECT doc_id FROM (SELECT doc_id, 0 AS a, doc_id AS b FROM documents WHERE doc_id < 2 UNION ALL SELECT * FROM (SELECT doc_id, 1, -n_chars FROM documents WHERE doc_id >= 2 ORDER BY n_chars DESC, doc_id LIMIT 5))
""")
def page_choice(spark, sf_dir):
    """The first two pages and the five longest others (the feature is a short list)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return d.filter("doc_id < 2").select("doc_id").union(d.filter("doc_id >= 2").orderBy(F.desc("n_chars"), "doc_id").limit(5).select("doc_id"))


@query("SELECT user_id, event_type AS stage, arg_max(event_id, event_id) AS revision, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def latest_revision(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("stage"), F.col("event_id").alias("revision"), "value")
    return state.latest(e, ["user_id", "stage"])


@query("""
SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 2 AND l_returnflag = 'A')
""")
def approval_gate(spark, sf_dir):
    """Candidates of which the current revision has passed."""
    c = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(2).alias("revision"))
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("revision"), F.when(F.col("l_returnflag") == "A", "pass").otherwise("fail").alias("status"))
    return state.gate(c, e, "o_orderkey").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR (o_totalprice > 200000 AND o_orderpriority <> '5-LOW') OR o_orderdate > TIMESTAMP '1998-01-01'")
def delta_polling(spark, sf_dir):
    """Rows whose version differs from what the client has, or that it lacks."""
    now = table(spark, sf_dir, "orders")
    old = now.withColumn("o_orderpriority", F.when(F.col("o_totalprice") > 200000, "5-LOW").otherwise(F.col("o_orderpriority")))
    seen = old.filter("o_orderstatus <> 'P' and o_orderdate <= timestamp'1998-01-01'")
    known = state.changed(seen, spark.createDataFrame([], "o_orderkey long, version string"), "o_orderkey").select("o_orderkey", "version")
    return state.changed(now, known, "o_orderkey").select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE source = 'src1' OR contains(text, '!')")
def resume_todo(spark, sf_dir):
    """What is left to do after a stop: no result, or one of other input."""
    todo = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"))
    done = table(spark, sf_dir, "documents").filter("source <> 'src1'").select("doc_id", F.sha2(F.translate("text", "!", ""), 256).alias("fingerprint"))
    return state.resume(todo, done, "doc_id", "fingerprint").select("doc_id")


@query("WITH c AS (SELECT c_custkey AS k, CAST(c_custkey * 3 AS BIGINT) AS pos, c_acctbal < 0 AS fresh, CAST(c_custkey % 100 AS BIGINT) AS p FROM customer) SELECT k, CASE WHEN fresh THEN (SELECT max(pos) FROM c) + 1 + p ELSE pos END AS pos FROM c")
def record_upsert(spark, sf_dir):
    """A replaced record moves to the end of the manifest."""
    c = table(spark, sf_dir, "customer")
    now = c.select(F.col("c_custkey").alias("k"), (F.col("c_custkey") * 3).cast("long").alias("pos"))
    new = c.filter("c_acctbal < 0").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 100).cast("long").alias("pos"))
    return state.replace_records(now, new, "k")


@query("SELECT user_id, stage, valid FROM (SELECT user_id, stage, min(fits) OVER (PARTITION BY user_id ORDER BY p ROWS UNBOUNDED PRECEDING) = 1 AS valid FROM (SELECT user_id, stage, p, CASE WHEN p = 0 OR user_id % (p + 2) <> 0 THEN 1 ELSE 0 END AS fits FROM (SELECT DISTINCT user_id FROM events), (VALUES ('a', 0), ('b', 1), ('c', 2)) s(stage, p)))")
def stage_validity(spark, sf_dir):
    """A stage is valid while all stages before it are what it has seen."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    s = users.select("user_id", F.explode(F.array(*(F.struct(F.lit(n).alias("stage"), F.lit(i).alias("p")) for i, n in enumerate("abc")))).alias("s")).select("user_id", "s.*")
    s = s.withColumn("token", F.concat("stage", F.col("user_id").cast("string")))
    before = F.translate("stage", "bc", "ab")
    s = s.withColumn("input_token", F.when(F.col("user_id") % (F.col("p") + 2) == 0, "stale").otherwise(F.concat(before, F.col("user_id").cast("string"))))
    return state.invalidate(s, ["a", "b", "c"], "user_id").select("user_id", "stage", "valid")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY array_to_string(list_transform(regexp_extract_all(p_name || p_size, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END), ''), p_partkey) AS place FROM part")
def natural_sort(spark, sf_dir):
    """Places in the natural order of ids, per brand."""
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy(natural_key(F.concat("p_name", F.col("p_size").cast("string"))), "p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", k.alias("place"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('7' || o_orderkey)) AS alias FROM orders")
def blind_aliases(spark, sf_dir):
    """Seeded shuffle: aliases in the order of a hash of seed and id."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.md5(F.concat(F.lit("7"), F.col("o_orderkey").cast("string")))))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", k.alias("alias"))
