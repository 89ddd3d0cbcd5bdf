"""Feature selection: each operator of the predicate language over the driver tables, and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrasift.functions import predicates as P
from terrasift.plans.registry import QUERIES, ORACLE, query, table

#: name: (table, key, column, condition, SQL of the condition)
CASES = {
    "where_eq": ("part", "p_partkey", "p_brand", "Brand#13", "p_brand = 'Brand#13'"),
    "where_ne": ("customer", "c_custkey", "c_mktsegment", {"ne": "BUILDING"}, "c_mktsegment IS DISTINCT FROM 'BUILDING'"),
    "where_in": ("part", "p_partkey", "p_size", {"in": [1, 7, 30]}, "CAST(p_size AS VARCHAR) IN ('1', '7', '30')"),
    "where_not_in": ("part", "p_partkey", "p_size", {"not_in": [1, 7, 30]}, "coalesce(CAST(p_size AS VARCHAR) NOT IN ('1', '7', '30'), true)"),
    "where_contains": ("part", "p_partkey", "p_type", {"contains": "ON"}, "contains(p_type, 'ON')"),
    "where_icontains": ("part", "p_partkey", "p_type", {"icontains": "Econ"}, "contains(lower(p_type), 'econ')"),
    "where_startswith": ("customer", "c_custkey", "c_name", {"startswith": "Customer#0000001"}, "starts_with(c_name, 'Customer#0000001')"),
    "where_regex": ("part", "p_partkey", "p_name", {"regex": "^S[a-m]+ ?[a-z]*(t|ng)$"}, "regexp_matches(p_name, '(?i)^S[a-m]+ ?[a-z]*(t|ng)$')"),
    "where_isnull": ("documents", "doc_id", "lang", {"isnull": False}, "lang IS NOT NULL"),
    "where_lt": ("customer", "c_custkey", "c_acctbal", {"lt": 0}, "c_acctbal < 0"),
    "where_le": ("part", "p_partkey", "p_size", {"le": 3}, "p_size <= 3"),
    "where_gt": ("part", "p_partkey", "p_retailprice", {"gt": 910.5}, "p_retailprice > 910.5"),
    "where_ge": ("supplier", "s_suppkey", "s_acctbal", {"ge": 5000}, "s_acctbal >= 5000"),
}


def _register(name, source, key, column, condition, sql):
    def run(spark, sf_dir):
        return table(spark, sf_dir, source).filter(P.where(column, condition)).select(key, column)

    QUERIES[name] = run
    ORACLE[name] = f"SELECT {key}, {column} FROM {source} WHERE {sql}"


for _name, _case in CASES.items():
    _register(_name, *_case)


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey IN (3, 5, 8, 13, 21, 34) AND p_size >= 2")
def feature_selection(spark, sf_dir):
    """Ids that must exist, and attribute conditions together."""
    return P.select(table(spark, sf_dir, "part"), {"p_size": {"ge": 2}}, ids=[3, 5, 8, 13, 21, 34], id_column="p_partkey").select("p_partkey", "p_brand", "p_size")


@query("""
SELECT p_partkey, list_filter([CASE WHEN regexp_matches(p_name, '(?i)1[3-5]') THEN 'p_name' END, CASE WHEN regexp_matches(p_brand, '(?i)1[3-5]') THEN 'p_brand' END,
       CASE WHEN regexp_matches(p_type, '(?i)1[3-5]') THEN 'p_type' END], lambda x: x IS NOT NULL) AS matched
FROM part WHERE regexp_matches(p_name, '(?i)1[3-5]') OR regexp_matches(p_brand, '(?i)1[3-5]') OR regexp_matches(p_type, '(?i)1[3-5]')
ORDER BY p_partkey LIMIT 60
""")
def find_attributes(spark, sf_dir):
    """The first 60 features of which any attribute matches."""
    return P.find(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "1[3-5]", ["p_name", "p_brand", "p_type"]).select("p_partkey", "matched")


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
n AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l)
SELECT doc_id, i - 1 AS line, array_to_string(list_slice(lines, greatest(i - 1, 1), i + 1), chr(10)) AS passage
FROM n WHERE regexp_matches(lines[i], '(?i)license')
""")
def search_text(spark, sf_dir):
    """Lines that match, with a line of context on either side."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    hits = lines.select("doc_id", "lines", F.posexplode("lines").alias("line", "own")).filter(F.col("own").rlike("(?i)license"))
    first = F.greatest(F.col("line") - 1, F.lit(0))
    return hits.select("doc_id", F.col("line").cast("long").alias("line"), F.array_join(F.slice("lines", first + 1, F.col("line") + 2 - first), "\n").alias("passage"))


@query("SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem WHERE l_quantity % 200 > 20 AND abs(l_linenumber * 30 - l_quantity) < 60")
def color_rule_mask(spark, sf_dir):
    """A colour rule as a Column, over line items taken as pixels."""
    pixels = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") % 200).alias("R"), (F.col("l_linenumber") * 30).alias("G"), F.col("l_quantity").alias("B"))
    return pixels.filter(P.color_rule("(R>20)&(abs(G-B)<60)")).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query("""
SELECT doc_id, source AS file, text, CASE WHEN doc_id % 2 = 1 THEN 'x' || text END AS translated_text FROM documents
""")
def source_payload(spark, sf_dir):
    """Column pruning; a translation that says the same as the source is left out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("x"), "text")).otherwise(F.col("text")).alias("translated"))
    return docs.select("doc_id", F.col("source").alias("file"), "text", F.when(F.col("translated") != F.col("text"), F.col("translated")).alias("translated_text"))


@query("""
SELECT item_id, text, 'x' AS german FROM benchmark WHERE trim(coalesce(text, '')) <> ''
""")
def glossary_projection(spark, sf_dir):
    """Asked-for language columns of the rows that have any term in them."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("text"), F.lit("x").alias("german"), F.lit(None).cast("string").alias("french"))
    wanted = ["text"]
    return rows.filter(F.array_contains(F.array(*(F.trim(F.coalesce(c, F.lit(""))) != "" for c in wanted)), True)).select("item_id", "text", "german")


@query("""
SELECT doc_id FROM (SELECT doc_id, lang, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters FROM documents)
WHERE lang <> 'en' AND letters > 0
""")
def pending_translation(spark, sf_dir):
    """Chunks that need a translation: not English, with letters."""
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    return table(spark, sf_dir, "documents").filter((F.col("lang") != "en") & (letters > 0)).select("doc_id")
