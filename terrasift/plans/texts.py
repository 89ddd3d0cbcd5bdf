"""Scalar text functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrasift.functions import text as T
from terrasift.plans.registry import query, table

WS = "[\\x00\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
SQL_NORM = f"trim(regexp_replace(text, '{WS}', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({SQL_NORM}) AS fingerprint, CAST(length({SQL_NORM}) AS BIGINT) AS n FROM documents")
def normalize_hash(spark, sf_dir):
    n = T.normalize_text("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(n, 256).alias("fingerprint"), F.length(n).cast("long").alias("n"))


@query("SELECT doc_id, md5(replace(translate(regexp_replace(text, '([0-9])\"', '\\1′′', 'g'), '\"«»“”„‟″‶❝❞〝〞〟＂', ''), '′′', '″')) AS plain FROM documents")
def model_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.drop_quotes("text")).alias("plain"))


@query("""
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type WHEN lower(event_type) = 'purchase' THEN 'Purchase' WHEN lower(event_type) = 'signup' THEN 'Registration' ELSE event_type END AS label
FROM events
""")
def canonical_labels(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.canonicalize("event_type", ["click", "view", "Purchase"], {"signup": "Registration"}).alias("label"))


_GERMAN = "replace(replace(replace(replace(lower({0}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"
_NORM = "trim(regexp_replace(regexp_replace(translate(" + _GERMAN + ", 'áàâãåéèêëíìîïóòôõúùûýÿçñ', 'aaaaaeeeeiiiioooouuuyycn'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_NORM.format('text')}) AS name_key FROM documents")
def normalized_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.norm_name("text")).alias("name_key"))


@query("SELECT p_partkey, trim(regexp_replace(p_name || ' (' || p_brand || ')', '\\s*\\([^()]*\\)\\s*$', '')) AS name FROM part")
def clean_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.clean_name(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("name"))


@query("SELECT a.p_brand AS a, b.p_brand AS b FROM (SELECT DISTINCT p_brand FROM part) a JOIN (SELECT DISTINCT p_brand FROM part) b ON a.p_brand < b.p_brand AND levenshtein(a.p_brand, b.p_brand) <= 1")
def near_brands(spark, sf_dir):
    """Brands one edit apart: blocked on what is left of one deletion, so no cross product arises."""
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    cut = F.transform(F.sequence(F.lit(0), F.length("p_brand")), lambda i: F.concat(F.expr("''"), F.substring(F.col("p_brand"), F.lit(1), i - 1), F.substring(F.col("p_brand"), i + 1, F.length("p_brand"))))
    blocks = brands.select("p_brand", F.explode(F.array_distinct(F.concat(cut, F.array("p_brand")))).alias("block"))
    pairs = blocks.select(F.col("p_brand").alias("a"), "block").join(blocks.select(F.col("p_brand").alias("b"), "block"), "block")
    return pairs.filter((F.col("a") < F.col("b")) & T.within_one_edit("a", "b")).select("a", "b").distinct()


@query("SELECT n_nationkey, list_sort(list_distinct([n_name, replace(n_name, 'ei', 'ai'), replace(n_name, 'ai', 'ei')])) AS found FROM (SELECT n_nationkey, lower(n_name) || ' rhein main' AS n_name FROM nation)")
def spelling_variants(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lower("n_name"), F.lit(" rhein main")).alias("n_name"))
    return names.select("n_nationkey", F.array_sort(T.vowel_variants("n_name")).alias("found"))


@query("""
WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM benchmark),
n AS (SELECT DISTINCT token AS name FROM t WHERE length(token) BETWEEN 5 AND 9)
SELECT name, token, CASE WHEN name = token THEN 'exact'
  WHEN starts_with(token, name) AND length(token) - length(name) BETWEEN 1 AND 3 THEN 'inflected'
  WHEN length(name) >= 6 AND starts_with(token, name) THEN 'compound' ELSE 'fuzzy' END AS kind
FROM n, t WHERE name = token OR (starts_with(token, name) AND (length(token) - length(name) BETWEEN 1 AND 3 OR length(name) >= 6))
  OR (length(name) >= 7 AND abs(length(token) - length(name)) <= 1 AND levenshtein(name, token) <= 1)
""")
def token_matches(spark, sf_dir):
    """Names against tokens, blocked by a shared head or a shared half; the rule decides."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))
    tokens = table(spark, sf_dir, "benchmark").select(words.alias("token")).distinct()
    names = tokens.filter(F.length("token").between(5, 9)).select(F.col("token").alias("name"))
    # One edit leaves the first or the last three letters of a word of seven as they are; other kinds share the head.
    blocks = lambda c: F.array(F.concat(F.lit("<"), F.substring(c, 1, 3)), F.concat(F.lit(">"), F.expr(f"right({c}, 3)")))
    pairs = names.withColumn("block", F.explode(blocks("name"))).join(tokens.withColumn("block", F.explode(blocks("token"))), "block")
    return pairs.select("name", "token", T.token_match("name", "token").alias("kind")).filter("kind is not null").distinct()


@query("""
SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, '. ', '- '), '(\\p{Ll})-\\s+(\\p{Ll})', '\\1\\2', 'g'), '(\\p{Ll})-\\s+(\\p{Ll})', '\\1\\2', 'g')) AS joined FROM documents
""")
def dehyphenated(spark, sf_dir):
    """Divided words joined (texts made to have some)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit("- ")).alias("t"))
    return docs.select("doc_id", F.md5(T.dehyphenate("t")).alias("joined"))


@query("""
SELECT o_orderkey, list_sort(list_distinct(list_transform(regexp_extract_all(t, '(?i)\\bkm\\s*([0-9]+(?:[.,][0-9]+)?)', 1), lambda x: round(CAST(replace(x, ',', '.') AS DOUBLE), 3)))) AS stations
FROM (SELECT o_orderkey, 'from km ' || (o_orderkey % 90) || ',' || (o_orderkey % 7) || ' to KM' || (o_custkey % 50) AS t FROM orders)
""")
def station_numbers(spark, sf_dir):
    said = F.concat(F.lit("from km "), F.col("o_orderkey") % 90, F.lit(","), F.col("o_orderkey") % 7, F.lit(" to KM"), F.col("o_custkey") % 50)
    return table(spark, sf_dir, "orders").select("o_orderkey", T.station_values(said).alias("stations"))


@query("SELECT p_partkey, CASE WHEN length(s) + 4 > 24 THEN substring(s, 1, 7) || '-' || substring(sha256(s), 1, 12) ELSE s END || '.csv' AS name FROM (SELECT p_partkey, p_name || ' ' || p_type AS s FROM part)")
def bounded_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.bounded_filename(F.concat_ws(" ", "p_name", "p_type"), ".csv", 24).alias("name"))


@query(f"SELECT p_partkey, trim(regexp_replace({_NORM.format('p_name || p_brand')}, '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat("p_name", "p_brand")).alias("slug"))


@query("""
SELECT page_id, lower(trim(regexp_replace(regexp_replace(regexp_replace((page_id % 9) || '.' || (page_id % 4) || ' ' || url || ' ..... 12', '^\\s*(?:[0-9]+(?:\\.[0-9]+)*\\.?|[IVXLC]+\\.)\\s+', ''), '[ .…]{3,}[0-9]*\\s*$', ''), '\\s+', ' ', 'g'))) AS key
FROM pages
""")
def heading_keys(spark, sf_dir):
    heading = F.concat(F.col("page_id") % 9, F.lit("."), F.col("page_id") % 4, F.lit(" "), "url", F.lit(" ..... 12"))
    return table(spark, sf_dir, "pages").select("page_id", T.heading_key(heading).alias("key"))


@query("""
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name || '-' || p_size, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END), '') AS key,
       regexp_replace(p_size || '.0', '^([0-9]+)\\.0+$', '\\1') AS id FROM part
""")
def natural_sort_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.natural_key(F.concat("p_name", F.lit("-"), "p_size")).alias("key"), T.whole_number_id(F.concat(F.col("p_size").cast("string"), F.lit(".0"))).alias("id"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 7, 3) AS price FROM lineitem")
def half_even(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.round_half_even(F.col("l_extendedprice") / 7, 3).alias("price"))


@query("""
WITH c AS (SELECT doc_id, text, octet_length(encode(text)) AS n FROM documents),
p AS (SELECT doc_id, text, unnest(range(62, 252)) AS k FROM c WHERE n > 254)
SELECT doc_id, CASE WHEN n <= 254 THEN text ELSE (SELECT substring(p.text, 1, max(k)) FROM p WHERE p.doc_id = c.doc_id AND octet_length(encode(substring(p.text, 1, k))) <= 251 GROUP BY p.text) || '…' END AS text FROM c
""")
def attribute_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.shape_text("text").alias("text"))


@query("""
SELECT doc_id, unnest(regexp_extract_all(text, '(?s)(.{0,20}(?:[0-9]+).{0,20})', 1)) AS clue FROM documents
""")
def clue_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.clues("text", "[0-9]+", 20)).alias("clue"))


@query("SELECT event_id, CAST(props ->> '$.k' AS VARCHAR) AS k FROM events")
def parsed_answers(spark, sf_dir):
    """Fenced JSON answers, leniently parsed."""
    answer = F.concat(F.lit("Sure: ```json\n"), "props", F.lit("\n``` done"))
    return table(spark, sf_dir, "events").select("event_id", T.parse_json(answer, "k string").getField("k").alias("k"))


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS iso, CAST(ts AS DATE) AS day, date_trunc('minute', ts) AS minute FROM events
""")
def time_forms(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("iso"), F.to_date("ts").alias("day"), F.date_trunc("minute", "ts").alias("minute"))


@query("""
SELECT d.doc_id, b.item_id FROM documents d, benchmark b WHERE contains(lower(d.text), lower(b.text))
""")
def quotes_restored(spark, sf_dir):
    """Quotations found in texts. The inner words of a quotation are whole words of the text too, so four of them are an
    equi-join key; the caseless test on both texts decides. Quotations too short for a key are searched for in all texts."""
    words = F.split(F.lower("text"), "\\s+")
    benchmark, texts = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text")
    items = benchmark.filter(F.size(words) >= 6).select("item_id", F.col("text").alias("quote"), F.array_join(F.slice(words, 2, 4), " ").alias("key"))
    rest = benchmark.filter(F.size(words) < 6).select("item_id", F.col("text").alias("quote"))
    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 3), lambda i: F.array_join(F.slice(w, i, 4), " "))
    grams = F.flatten(F.transform(F.array(words), windows))
    keys = texts.filter(F.size(words) >= 4).select("doc_id", F.explode(F.array_distinct(grams)).alias("key"))
    holds = F.lower("text").contains(F.lower("quote"))
    # Ids meet first; texts and quotations are fetched only for those that share a key.
    near = keys.join(items.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    near = near.join(items.select("item_id", "quote"), "item_id").join(texts, "doc_id").filter(holds).select("doc_id", "item_id")
    return near.union(texts.join(F.broadcast(rest), holds).select("doc_id", "item_id")).distinct()
