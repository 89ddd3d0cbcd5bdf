"""Language share gate: which sources need translation."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrasift.plans.registry import query, table

THRESHOLD = 0.75


@query("""
SELECT source,
       CAST(sum(letters) AS BIGINT) AS total, CAST(sum(CASE WHEN lang = 'en' THEN letters ELSE 0 END) AS BIGINT) AS english,
       CASE WHEN sum(letters) = 0 THEN 'no_readable_text'
            WHEN sum(CASE WHEN lang = 'en' THEN letters ELSE 0 END) / sum(letters) > 0.75 THEN 'skip_translation'
            WHEN (sum(CASE WHEN lang = 'en' THEN letters ELSE 0 END) + sum(CASE WHEN lang IS NULL THEN letters ELSE 0 END)) / sum(letters) <= 0.75 THEN 'translate'
            ELSE 'unresolved' END AS decision
FROM (SELECT source, lang, length(regexp_replace(coalesce(text, ''), '[^\\p{L}]', '', 'g')) AS letters FROM documents)
GROUP BY source
""")
def language_gate(spark, sf_dir):
    letters = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}]", ""))
    sums = (
        table(spark, sf_dir, "documents")
        .select("source", "lang", letters.cast("long").alias("n"))
        .groupBy("source")
        .agg(F.sum("n").alias("total"), F.sum(F.when(F.col("lang") == "en", F.col("n")).otherwise(0)).alias("english"), F.sum(F.when(F.col("lang").isNull(), F.col("n")).otherwise(0)).alias("unresolved"))
    )
    lower, upper = F.col("english") / F.col("total"), (F.col("english") + F.col("unresolved")) / F.col("total")
    decision = F.when(F.col("total") == 0, "no_readable_text").when(lower > THRESHOLD, "skip_translation").when(upper <= THRESHOLD, "translate").otherwise("unresolved")
    return sums.select("source", "total", "english", decision.alias("decision"))
