"""Chains, folds and windows over conversations, documents and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrasift.operators import chains as C
from terrasift.operators import folds, language_gate, ordered
from terrasift.plans.registry import query, table
from terrasift.shared import checkpointer


def _chain(spark, sf_dir):
    """A conversation is a chain: turns are segments, each follows from the one before; event and process repeat."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chain"), (F.col("turn") + 10).alias("segment"), (F.col("turn") + 1).alias("causal_order"), "role")
    before = F.when(F.col("causal_order") > 1, F.array(F.col("segment") - 1)).otherwise(F.array().cast("array<bigint>"))
    return t.select("chain", "segment", "causal_order", before.alias("predecessors"), F.col("role").alias("event"), F.when(F.col("causal_order") % 3 == 0, "FLOW").otherwise("flow ").alias("process"), F.array(F.col("segment")).alias("evidence"))


_BASE = "SELECT conv_id AS chain, turn + 10 AS segment, turn + 1 AS causal_order, role AS event FROM conversations"


@query(f"""
WITH b AS ({_BASE}), f AS (SELECT chain, event, min(causal_order) AS o, list(segment ORDER BY causal_order) AS evidence FROM b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY o) AS id FROM f),
e AS (SELECT b.chain, r.id AS own, p.id AS other, min(b.causal_order) AS o FROM b JOIN r ON r.chain = b.chain AND r.event = b.event
      JOIN b pb ON pb.chain = b.chain AND pb.segment = b.segment - 1 JOIN r p ON p.chain = pb.chain AND p.event = pb.event WHERE r.id <> p.id GROUP BY ALL)
SELECT r.chain, r.id AS segment, event, array_to_string(evidence, ',') AS evidence,
       coalesce((SELECT string_agg(other, ',' ORDER BY o) FROM e WHERE e.chain = r.chain AND e.own = r.id), '') AS predecessors FROM r
""")
def exact_duplicates(spark, sf_dir):
    """Consolidation: one segment per event and process, evidence united, links remapped, renumbered."""
    out = C.consolidate(_chain(spark, sf_dir))
    return out.select("chain", "segment", "event", F.array_join("evidence", ",").alias("evidence"), F.array_join("predecessors", ",").alias("predecessors"))


@query("SELECT conv_id AS chain, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 4 AS segment, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 THEN CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 3 AS VARCHAR) ELSE '' END AS predecessors FROM conversations")
def reindex_chain(spark, sf_dir):
    return C.reindex(_chain(spark, sf_dir), 5).select("chain", "segment", F.array_join("predecessors", ",").alias("predecessors"))


@query("""
WITH p AS (SELECT conv_id, turn + 10 AS id, text FROM conversations WHERE turn % 2 = 0), r AS (SELECT conv_id, turn, text FROM conversations),
j AS (SELECT r.conv_id, r.turn, o.id AS old, row_number() OVER (PARTITION BY r.conv_id, o.id ORDER BY r.turn) AS k FROM r
      LEFT JOIN (SELECT conv_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t, min(id) AS id FROM p GROUP BY ALL) o ON o.conv_id = r.conv_id AND o.t = lower(trim(regexp_replace(r.text, '\\s+', ' ', 'g')))),
m AS (SELECT conv_id, max(id) AS top FROM p GROUP BY conv_id)
SELECT j.conv_id AS chain, turn, CASE WHEN old IS NOT NULL AND k = 1 THEN old ELSE coalesce(top, 0) + row_number() OVER (PARTITION BY j.conv_id, old IS NOT NULL AND k = 1 ORDER BY turn) END AS segment
FROM j LEFT JOIN m ON m.conv_id = j.conv_id
""")
def stable_ids(spark, sf_dir):
    """Segments keep the id that an equal segment had before."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chain"), "turn", F.col("text").alias("event"), F.lit("p").alias("process"))
    empty = F.array().cast("array<bigint>")
    revised = t.select("*", F.col("turn").alias("segment"), F.col("turn").alias("causal_order"), empty.alias("predecessors"))
    previous = t.filter("turn % 2 = 0").withColumn("segment", F.col("turn") + 10)
    return C.stable_ids(revised, previous).select("chain", "turn", "segment")


@query("""
WITH b AS (SELECT conv_id, turn + 10 AS segment, turn + 1 AS o, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
m AS (SELECT *, CASE WHEN o = 1 AND n > 2 THEN 3.5 ELSE o END AS place FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place, segment) AS new FROM m)
SELECT conv_id AS chain, segment, o AS old_order, new AS new_order FROM r WHERE new <> o
""")
def causal_reorder(spark, sf_dir):
    """The first segment of each chain of three or more moves to place 3; the audit of all changed orders."""
    chain = _chain(spark, sf_dir)
    moves = chain.groupBy("chain").agg(F.count("*").alias("n")).filter("n > 2").select("chain", F.lit(10).cast("long").alias("segment"), F.lit(3).cast("long").alias("to"))
    return C.move(chain, moves)[1]


@query("""
WITH b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS want FROM conversations WHERE turn <> 2)
SELECT conv_id AS chain, turn + 10 AS segment, 'not_contiguous' AS code FROM b WHERE want <> turn + 1
UNION ALL SELECT conv_id, turn + 10, 'unknown_predecessor' FROM b WHERE turn > 0 AND (conv_id, turn - 1) NOT IN (SELECT conv_id, turn FROM b)
""")
def causal_validation(spark, sf_dir):
    """Chains that lost their third segment: gaps in the order and links to nothing."""
    return C.chain_issues(_chain(spark, sf_dir).filter("causal_order <> 3"))


@query("""
WITH RECURSIVE o AS (SELECT o_orderkey AS k, o_orderkey % 3 AS chain, CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey % 700 END AS e FROM orders),
l AS (SELECT k AS a, k - 3 AS b FROM o WHERE k % 4 = 0 UNION ALL SELECT k, k - 21 FROM o WHERE k % 4 = 0), both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
e AS (SELECT x.k AS a, y.k AS b, x.chain FROM both_ways w JOIN o x ON x.k = w.a JOIN o y ON y.k = w.b AND y.chain = x.chain UNION SELECT x.k, y.k, x.chain FROM o x JOIN o y ON x.e = y.e AND x.chain = y.chain),
r(n) AS (SELECT k FROM o WHERE k IN (2, 16, 1000) UNION SELECT e.b FROM r JOIN e ON e.a = r.n)
SELECT n % 3 AS chain, n AS segment FROM r
""")
def correction_scope(spark, sf_dir):
    """What changes of three segments touch along links and through equal events, to the fixpoint."""
    k = F.col("o_orderkey")
    chain = table(spark, sf_dir, "orders").select((k % 3).alias("chain"), k.alias("segment"), F.when(k % 10 == 0, F.concat(F.lit("Event "), (k % 700).cast("string"))).otherwise(k.cast("string")).alias("event"), F.when(k % 4 == 0, F.array(k - 21, k - 3)).otherwise(F.array().cast("array<bigint>")).alias("predecessors"))
    seeds = chain.filter("segment in (2, 16, 1000)").select("chain", "segment")
    return C.scope(chain, seeds, checkpointer(spark))


@query("""
WITH RECURSIVE t AS (SELECT source AS doc, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
f(doc, i, doc_id, n_chars, used, batch) AS (
  SELECT doc, i, doc_id, n_chars, n_chars, 0 FROM t WHERE i = 1
  UNION ALL SELECT t.doc, t.i, t.doc_id, t.n_chars, CASE WHEN f.used + t.n_chars > 12000 THEN t.n_chars ELSE f.used + t.n_chars END, CASE WHEN f.used + t.n_chars > 12000 THEN f.batch + 1 ELSE f.batch END
  FROM f JOIN t ON t.doc = f.doc AND t.i = f.i + 1)
SELECT doc, doc_id, n_chars, batch FROM f
""")
def batch_pack(spark, sf_dir):
    """Greedy batches of at most 12,000 characters of each source's documents, in order."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), "doc_id", "n_chars")
    return folds.pack(docs, 12000, "doc", "doc_id", "n_chars", strict=False)


@query("""
WITH f AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 250)) AS a FROM documents)
SELECT doc_id, CAST(a / 250 AS BIGINT) AS fragment, md5(substring(text, a + 1, 350)) AS part FROM f WHERE a = 0 OR length(substring(text, a + 1, 350)) >= 40
""")
def sliding_fragments(spark, sf_dir):
    out = folds.fragments(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "fragment", F.md5("text").alias("part"))


@query("""
WITH RECURSIVE f(doc_id, text, a, b) AS (
  SELECT doc_id, text, 0, 0 FROM documents WHERE length(text) > 0
  UNION ALL SELECT doc_id, text, b, CASE WHEN length(text) - b <= 1000 THEN length(text)
     WHEN contains(substring(text, b + 501, 500), ' ') THEN b + 1000 - instr(reverse(substring(text, b + 501, 500)), ' ') + 1 ELSE b + 1000 END FROM f WHERE b < length(text))
SELECT doc_id AS chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS part, a AS char_start, b AS char_end, md5(substring(text, a + 1, b - a)) AS body FROM f WHERE b > 0
""")
def split_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return folds.split_chunks(docs, 1000).select("chunk_id", "part", "char_start", "char_end", F.md5("text").alias("body"))


@query("SELECT doc_id AS chunk_id, md5(text) AS body FROM documents WHERE length(text) > 0")
def rejoined_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return folds.rejoin(folds.split_chunks(docs, 1000)).select("chunk_id", F.md5("text").alias("body"))


@query("""
WITH RECURSIVE t AS (SELECT conv_id, CAST(length(text) AS BIGINT) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
f(conv_id, i, first, used, last_size, closed) AS (
  SELECT conv_id, i, i, s, s, CAST(NULL AS BIGINT) FROM t WHERE i = 0
  UNION ALL SELECT t.conv_id, t.i, CASE WHEN f.i + 1 > f.first AND f.used + t.s > 1500 THEN t.i - 1 ELSE f.first END, CASE WHEN f.i + 1 > f.first AND f.used + t.s > 1500 THEN f.last_size + t.s ELSE f.used + t.s END, t.s,
     CASE WHEN f.i + 1 > f.first AND f.used + t.s > 1500 THEN f.first END FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1),
e AS (SELECT conv_id, closed AS first, i - 1 AS last FROM f WHERE closed IS NOT NULL UNION ALL SELECT conv_id, arg_max(first, i), max(i) FROM f GROUP BY conv_id)
SELECT conv_id, first, last FROM e
""")
def page_batches(spark, sf_dir):
    """Greedy page runs that overlap by one page."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("s")))).alias("p"))
    return rows.select("conv_id", F.explode(folds.overlapping_pages(F.col("p.s"), 1500)).alias("r")).select("conv_id", "r.first", "r.last")


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), n AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l),
h AS (SELECT doc_id, greatest(i - 2, 0) AS lo, least(i, len(lines) - 1) AS hi FROM n WHERE contains(lower(lines[i]), 'the')),
w2 AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM h),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS passage FROM w2)
SELECT doc_id, CAST(passage AS BIGINT) AS passage, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM g GROUP BY doc_id, passage
""")
def clue_islands(spark, sf_dir):
    """Lines that hold a clue, with a line of context, merged into passages."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("l"))
    hits = lines.select("doc_id", F.size("l").alias("n"), F.posexplode("l").alias("i", "t")).filter(F.lower("t").contains("the"))
    spans = hits.select("doc_id", F.greatest(F.col("i") - 1, F.lit(0)).alias("lo"), F.least(F.col("i") + 1, F.col("n") - 1).alias("hi"))
    return folds.islands(spans, ["doc_id"])


_LETTERS = "length(regexp_replace(text, '[^\\p{L}]', '', 'g'))"


@query(f"""
SELECT report, file, chunk, CASE WHEN grouping(chunk) = 0 THEN 'chunk' WHEN grouping(file) = 0 THEN 'file' ELSE 'report' END AS grain, lang AS language, CAST(sum(n) AS BIGINT) AS letters
FROM (SELECT 'all' AS report, source AS file, doc_id AS chunk, lang, {_LETTERS} AS n FROM documents) GROUP BY GROUPING SETS ((report, lang), (report, file, lang), (report, file, chunk, lang))
""")
def language_grains(spark, sf_dir):
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", "")).cast("long")
    return language_gate.letter_counts(table(spark, sf_dir, "documents").select(F.lit("all").alias("report"), F.col("source").alias("file"), F.col("doc_id").alias("chunk"), F.col("lang").alias("language"), letters.alias("letters")))


@query(f"""
SELECT source, CASE WHEN sum(n) = 0 THEN 'Unknown' WHEN count(DISTINCT lang) FILTER (n > 0) = 1 THEN min(lang) FILTER (n > 0) ELSE 'Mixed' END AS label FROM (SELECT source, lang, {_LETTERS} AS n FROM documents) GROUP BY source
""")
def chunk_labels(spark, sf_dir):
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", "")).cast("long")
    sums = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.sum(letters).alias("n")).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("lang", F.lit("")), "n"))).alias("counts"))
    return sums.select("source", language_gate.chunk_label(F.col("counts")).alias("label"))


@query("""
WITH c AS (SELECT source, doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS known FROM documents)
SELECT source, doc_id, last_value(known IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS left_known,
       first_value(known IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS right_known FROM c
""")
def known_language(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select("source", "doc_id", F.when(F.col("doc_id") % 3 == 0, "Unknown").otherwise(F.col("lang")).alias("language"))
    return language_gate.known_neighbours(chunks, "doc_id", "source").drop("language")


@query("""
WITH s AS (SELECT conv_id AS parent, lang AS language, b, e FROM (SELECT conv_id, CASE WHEN turn % 2 = 0 THEN 'en' ELSE 'de' END AS lang, turn * 70 AS b, turn * 70 + 70 AS e FROM conversations)),
p AS (SELECT DISTINCT conv_id AS parent, k AS part, k * 100 AS b, k * 100 + 100 AS e FROM conversations, range(0, 4) r(k))
SELECT s.parent, part, language, greatest(s.b, p.b) AS "begin", least(s.e, p.e) AS "end" FROM s JOIN p ON s.parent = p.parent AND s.b < p.e AND p.b < s.e
""")
def span_overlap(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    spans = conv.select(F.col("conv_id").alias("parent"), F.when(F.col("turn") % 2 == 0, "en").otherwise("de").alias("language"), (F.col("turn") * 70).alias("begin"), (F.col("turn") * 70 + 70).alias("end"))
    parts = conv.select(F.col("conv_id").alias("parent")).distinct().select("parent", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("part")).select("*", (F.col("part") * 100).alias("begin"), (F.col("part") * 100 + 100).alias("end"))
    return language_gate.clip_spans(spans, parts)


@query("""
WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS start, count(*) OVER (PARTITION BY source) AS pages FROM documents), s AS (SELECT * FROM n WHERE doc_id % 3 = 0)
SELECT source, doc_id, start, coalesce(lead(start) OVER (PARTITION BY source ORDER BY start) - 1, pages) AS "end" FROM s
""")
def construct_ranges(spark, sf_dir):
    """Page ranges of a source's documents from those that start one; the last one runs to the end."""
    pages = ordered.row_numbers(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id", "start")
    total = pages.groupBy("source").agg(F.max("start").alias("pages"))
    starts = ordered.neighbours(pages.filter("doc_id % 3 = 0"), ["source"], "start", F.col("start"), right="next")
    return starts.join(total, "source").select("source", "doc_id", "start", F.coalesce(F.col("next") - 1, F.col("pages")).alias("end"))


@query("""
SELECT conv_id, turn, 'c' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS chunk, 'd' || dense_rank() OVER (PARTITION BY conv_id ORDER BY seen) AS doc
FROM (SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id, role) AS seen FROM conversations)
""")
def request_ids(spark, sf_dir):
    """Ids that hold within a request, in order of first sight."""
    w = Window.partitionBy("conv_id")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.min("turn").over(Window.partitionBy("conv_id", "role")).alias("seen"))
    return t.select("conv_id", "turn", F.concat(F.lit("c"), F.row_number().over(w.orderBy("turn"))).alias("chunk"), F.concat(F.lit("d"), F.dense_rank().over(w.orderBy("seen"))).alias("doc"))


@query("""
SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS next, row_number() OVER w AS index, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def collection_neighbours(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("previous"), F.lead("turn").over(w).alias("next"), F.row_number().over(w).alias("index"), F.count("*").over(Window.partitionBy("conv_id")).alias("total"))


@query("SELECT source, doc_id, min(z) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS bed FROM (SELECT source, doc_id, n_chars + (doc_id * 37) % 101 AS z FROM documents)")
def monotone_bed(spark, sf_dir):
    """A bed that never rises downstream: the running minimum along each line."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("n_chars") + F.col("doc_id") * 37 % 101).alias("z"))
    return ordered.running_min(d, ["source"], "doc_id", F.col("z"), "bed").drop("z")
