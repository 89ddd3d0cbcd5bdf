"""Language shares: counts at three grains, the majority rule, chunk labels, and neighbours of known language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.operators.ordered import neighbours


def majority(total: Column, english: Column, unresolved: Column, threshold: float) -> Column:
    """Skip if English is above the threshold for certain, translate if it can't be, else unresolved."""
    lower, upper = english / total, (english + unresolved) / total
    return F.when(total == 0, "no_readable_text").when(lower > threshold, "skip_translation").when(upper <= threshold, "translate").otherwise("unresolved")


#: The least score of a language, and its least lead over the next one.
MIN_SCORE, MIN_LEAD = 0.80, 0.20


def confident(scores: Column, english: Column, least: float = MIN_SCORE, lead: float = MIN_LEAD) -> Column:
    """struct(language, confidence, margin, english_conflict): the top language if it is sure enough, else Unknown.

    scores: map of language to score. english: whether a test for English alone agrees; if it doesn't, English is no answer.
    Equal scores have no lead; no scores give Unknown with 0.
    """
    by_score = F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e.value).alias("s"), e.key.alias("k"))))
    top = F.coalesce(-F.get(by_score, F.lit(0)).s, F.lit(0.0))
    margin = top - F.coalesce(-F.get(by_score, F.lit(1)).s, F.lit(0.0))
    name = F.get(by_score, F.lit(0)).k
    conflict = F.coalesce((name == "English") & ~english, F.lit(False))
    sure = (top >= least) & (margin >= lead) & ~conflict
    return F.struct(F.when(sure, name).otherwise("Unknown").alias("language"), top.alias("confidence"), margin.alias("margin"), conflict.alias("english_conflict"))


def cover(spans: DataFrame, length: str = "length") -> DataFrame:
    """parent, begin, end, language: the spans and, with a null language, what lies before, between and after them, so that every
    character is covered once. spans: parent, length (of the parent), begin, end, language; begin is null for a parent
    without spans. Spans that overlap are an error."""
    w = Window.partitionBy("parent").orderBy("begin")
    s = spans.withColumn("_before", F.coalesce(F.lag("end").over(w), F.lit(0))).withColumn("_last", F.lead("begin").over(w).isNull())
    bad = (F.col("begin") < F.col("_before")) | (F.col("begin") >= F.col("end")) | (F.col("end") > F.col(length))
    s = s.filter(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("spans overlap or lie outside")).cast("boolean")).otherwise(F.lit(True)))
    part = lambda a, b, lang: F.struct(a.cast("long").alias("begin"), b.cast("long").alias("end"), lang.alias("language"))
    none = F.lit(None).cast("string")
    start = F.coalesce(F.col("begin"), F.col(length))
    rest = F.when(F.col("_last") & F.col("begin").isNotNull(), part(F.col("end"), F.col(length), none))
    parts = F.array(part(F.col("_before"), start, none), F.when(F.col("begin").isNotNull(), part(F.col("begin"), F.col("end"), F.col("language"))), rest)
    return s.select("parent", F.explode(F.filter(parts, lambda p: p.isNotNull() & (p.begin < p.end))).alias("p")).select("parent", "p.*")


def letter_counts(spans: DataFrame) -> DataFrame:
    """report, file, chunk, grain, language, letters: alphabetic counts by language at all three grains in one pass.

    spans: report, file, chunk, language (null: unresolved), letters. Counts reconcile between grains by construction.
    """
    cube = spans.groupingSets([["report", "language"], ["report", "file", "language"], ["report", "file", "chunk", "language"]], "report", "file", "chunk", "language")
    return cube.agg(F.sum("letters").alias("letters"), F.grouping_id().alias("g")).select("report", "file", "chunk", F.when(F.col("g") == 6, "report").when(F.col("g") == 2, "file").otherwise("chunk").alias("grain"), "language", "letters")


def chunk_label(counts: Column) -> Column:
    """Unknown if there are unresolved letters or none, the language if it is the only one, else Mixed. counts: map of
    language to letters, unresolved under ''."""
    some = F.map_filter(counts, lambda k, v: v > 0)
    return F.when((F.size(some) == 0) | F.coalesce(F.try_element_at(some, F.lit("")) > 0, F.lit(False)), "Unknown").when(F.size(some) == 1, F.map_keys(some)[0]).otherwise("Mixed")


def known_neighbours(chunks: DataFrame, order: str = "pos", group: str = "doc") -> DataFrame:
    """Adds left_known and right_known: the nearest language before and after that isn't Unknown."""
    return neighbours(chunks, [group], order, F.when(F.col("language") != "Unknown", F.col("language")), "left_known", "right_known")


def clip_spans(spans: DataFrame, parts: DataFrame) -> DataFrame:
    """Language spans cut to the parts they overlap: an interval join within each parent (equi-join first)."""
    s, p = spans.alias("s"), parts.alias("p")
    joined = s.join(p, (F.col("s.parent") == F.col("p.parent")) & (F.col("s.begin") < F.col("p.end")) & (F.col("p.begin") < F.col("s.end")))
    return joined.select("s.parent", F.col("p.part"), "s.language", F.greatest("s.begin", "p.begin").alias("begin"), F.least("s.end", "p.end").alias("end"))
