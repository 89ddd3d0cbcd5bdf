"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.llm import chat_format, collocations, decontaminate, embedding_dedup, html_extract, jaccard_join, language_id, line_dedup, packing, pii, suffix_dedup, turn_repair, warc

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents"), 400)
    kept = F.coalesce(F.octet_length("kept_text"), F.lit(0)).cast("long")
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - kept).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(table(spark, sf_dir, "documents"), words=5, percent=80)


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 13)
    c = F.col("contamination")
    return found.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), c["contaminated"].alias("contaminated"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


@query
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = rows.unionByName(extra).withColumn("parts", F.array(chat_format.text_part(F.col("text"))))
    made = chat_format.format_chat(turns).select("*", F.length("formatted").cast("long").alias("formatted_chars"))
    back = chat_format.read_back(made.select("conv_id", "formatted", "loss_mask", "formatted_chars"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


ORACLE["op7_chat_formatting"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(16 + length(role) + length(text)
           + 2 * length(role || text) - length(replace(role || text, '\', '')) - length(replace(role || text, '<', ''))
           + length(role || text) - length(replace(role || text, '>', ''))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), 3)
    return out.select("doc_id", F.col("line_dedup.n_lines").alias("n_lines"), F.col("line_dedup.n_removed").alias("n_removed"), "text")


ORACLE["op3_line_dedup"] = r"""
WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
windows AS (
  SELECT doc_id, p, list_slice(l, p, p + 2) AS w
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM lines)),
ranked AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM windows
  WHERE trim(w[1], ' ') || trim(w[2], ' ') || trim(w[3], ' ') <> ''),
gone AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS i FROM ranked WHERE k > 1),
numbered AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM lines),
kept AS (
  SELECT n.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(l[n.i], chr(10) ORDER BY n.i) FILTER (g.i IS NULL) AS text
  FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.i = g.i GROUP BY n.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), buckets=8, budget=8192)


@query
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_archives(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op4_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT html, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY html)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html AND n >= 1000
"""


@query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main.text").alias("text"), F.length("main.text").cast("long").alias("n_chars"))


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), top=2000, least=30, longest=4)


ORACLE["op11_phrase_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM words
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) FROM words
  UNION ALL SELECT lang, 4, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] for i in range(1, len(w) - 2)]) FROM words),
f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY lang, phrase, k HAVING count(*) >= 30),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
c AS MATERIALIZED (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
halves AS MATERIALIZED (SELECT lang, phrase, k, a, w, unnest(range(1, k)) AS cut FROM c),
sides AS MATERIALIZED (SELECT lang, phrase, k, a, cut, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:], ' ') AS rest FROM halves),
cuts AS (
  SELECT s.lang, s.phrase, s.k, a, x.f AS l, y.f AS r, (2000000 * CAST(a AS HUGEINT)) // (CAST(x.f AS HUGEINT) + y.f) AS score, cut
  FROM sides s JOIN f x ON x.lang = s.lang AND x.phrase = first JOIN f y ON y.lang = s.lang AND y.phrase = rest),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (
  SELECT c.lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM c, (VALUES (2), (3)) s(m), (VALUES (1), (2), (3)) t(i) WHERE m < c.k AND i + m - 1 <= c.k GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase JOIN total t ON t.lang = b.lang
WHERE most IS NULL OR 100 * most < 80 * a QUALIFY rank <= 2000
"""


@query
def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    plain = F.filter("pii", lambda s: ~s.disguised)
    count = lambda kind: F.size(F.filter(plain, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    added = F.size(F.filter("pii", lambda s: s.disguised)).cast("long").alias("n_disguised")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(joined(plain), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), added)


@query
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repaired = turn_repair.repair(turn_repair.damage(talks), "conv")
    said = F.struct("place", F.concat("role", F.lit(":"), "text").alias("line"))
    texts = repaired.turns.filter("edit <> 'D'").groupBy(F.col("conv").alias("c")).agg(F.array_join(F.sort_array(F.collect_list(said)).getField("line"), "\n").alias("lines"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    out = talks.select("conv_id").distinct().join(repaired.report, same("conv_id", "conv"), "left").join(texts, same("conv_id", "c"), "left")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("lines", F.lit("")), 256).alias("repaired_sha256"))


ORACLE["op13_structure_repair"] = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
crc AS (
  SELECT * EXCLUDE key, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(key, ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
         lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) % 20 AS k FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE k WHEN 3 THEN [0, 1] ELSE [0] END) FROM crc WHERE k <> 0)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged),
rows AS (
  SELECT *, left(role, 1) AS i, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) AS before FROM numbered),
grammar(q, r, too) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts AS (
  SELECT q, '' AS labels, 0 AS cost, q AS too, CAST([] AS VARCHAR[]) AS lines FROM (VALUES (0), (1), (2), (3)) s(q)
  UNION ALL
  SELECT x.q, 'I' || labels, cost + 5, g.too, list_append(lines, CASE r WHEN 'u' THEN 'user:' ELSE 'assistant:' END)
  FROM inserts x JOIN grammar g ON g.q = x.too WHERE r <> 's' AND cost < 15),
best AS (
  SELECT r.conv_id, r.n + 1 AS pos, x.q, min({'cost': x.cost, 'audit': labels, 'lines': lines}) AS w
  FROM (SELECT conv_id, any_value(n) AS n FROM rows GROUP BY conv_id) r, inserts x WHERE x.too IN (0, 3) GROUP BY ALL
  UNION ALL
  SELECT r.conv_id, r.pos, x.q,
         min({'cost': x.cost + e.cost + b.w.cost, 'audit': x.labels || e.label || b.w.audit,
              'lines': x.lines || CASE e.label WHEN 'K' THEN [r.role || ':' || r.text] WHEN 'R' THEN [CASE e.r WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text] ELSE [] END || b.w.lines})
  FROM best b JOIN rows r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.pos = b.pos - 1
  JOIN (SELECT q, r, too, l AS label, CASE l WHEN 'K' THEN 0 ELSE 1 END AS cost FROM grammar, (VALUES ('K'), ('R')) s(l) WHERE l = 'K' OR r <> 's'
        UNION ALL SELECT q, NULL, q, 'D', 2 FROM (VALUES (0), (1), (2), (3)) s(q)) e0 ON e0.too = b.q
  JOIN (SELECT UNNEST([0, 1, 2, 3]) AS fault, UNNEST([0, NULL, NULL, 5]) AS more) m ON m.fault = r.fault
  JOIN LATERAL (SELECT e0.q, e0.r, e0.label, e0.cost + CASE e0.label WHEN 'D' THEN 0 ELSE more END AS cost) e ON e.cost IS NOT NULL AND (e.label <> 'K' OR e.r = r.i)
  JOIN inserts x ON x.too = e.q
  GROUP BY r.conv_id, r.pos, x.q),
report AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(w.cost, 0) AS BIGINT) AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN report p ON p.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.pos = 1 AND b.q = 0
"""
