"""Joins of segments, citations and page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.functions.text import text_key
from terrasift.operators.ordered import neighbours
from terrasift.shared import written


def evidence_rows(segments: DataFrame, chunks: DataFrame, strict: bool = True) -> DataFrame:
    """One row per citation with its chunk's provenance. strict: a citation of no chunk is an error, else state `missing`.

    segments: segment, causal_order, evidence array<struct<chunk_id, quote>>. chunks: chunk_id and provenance columns.
    """
    cited = segments.select("segment", "causal_order", F.posexplode("evidence").alias("i", "e")).select("segment", "causal_order", "i", "e.chunk_id", "e.quote")
    joined = cited.join(chunks.withColumn("_there", F.lit(True)), "chunk_id", "left")
    if strict:
        joined = joined.filter(F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no such chunk: "), F.col("chunk_id").cast("string"))).cast("boolean")).otherwise(F.lit(True)))
        return joined.drop("_there")
    return joined.withColumn("state", F.when(F.col("_there").isNull(), "missing").otherwise("found")).drop("_there")


def citation_check(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id, quote, state: unknown_chunk, absent, ambiguous or verified (a caseless substring, exactly once)."""
    joined = citations.join(chunks.select("chunk_id", F.lower("text").alias("_t")), "chunk_id", "left")
    q = F.lower("quote")
    hits = F.size(F.split(F.replace(F.col("_t"), q, F.lit("\0")), "\0", -1)) - 1
    state = F.when(F.col("_t").isNull(), "unknown_chunk").when((q == "") | (hits == 0), "absent").when(hits > 1, "ambiguous").otherwise("verified")
    return joined.select("chunk_id", "quote", state.alias("state"))


def _grams(doc: Column, words: Column, n: int) -> Column:
    """Hashes of all n words that follow each other, with their document's name."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(doc, *(F.get(words, i + k) for k in range(n)))))


def quote_pages(quotes: DataFrame, pages: DataFrame, words: int = 4) -> DataFrame:
    """quote_id, doc, page, view, page_hint_ok: the first page that holds a quotation.

    quotes: quote_id, doc, quote, hint. pages: doc, page, text. Views in order of preference: the page as it is (the
    hinted one first), without soft hyphens (pages that have some), then a page with the next one.

    A rarest-gram index: of all runs of `words` inner words of a quotation, the one on the fewest pages decides which pages
    are searched for it. Pages meet quotations by hashes of their runs, and only those that a quotation has are kept; of two
    neighbouring pages only the runs over the seam are new, whatever is on one of them. Texts are fetched for what is left.
    """
    key = pages.select("doc", "page", text_key("text").alias("key"))
    split = F.split("key", " ")
    ends = key.select("doc", "page", F.slice(split, 1, words + 1).alias("head"), F.slice(split, F.greatest(F.size(split) - words, F.lit(1)), words + 1).alias("tail"))
    seams = written(neighbours(ends, ["doc"], "page", F.struct("page", "head"), right="next").filter("next is not null").select("doc", "page", F.col("next.page").alias("next"), "tail", F.col("next.head").alias("head")))
    q = quotes.select("quote_id", "doc", "hint", text_key("quote").alias("q")).withColumn("w", F.split("q", " "))
    long = q.filter(F.size("w") >= words + 2)
    asked = written(long.select("quote_id", F.explode(_grams(F.col("doc"), F.slice("w", F.lit(2), F.size("w") - 2), words)).alias("h")))
    soft = F.replace(F.col("key"), F.lit("\u00ad"), F.lit(""))
    views = key.select("doc", "page", F.lit(1).alias("view"), split.alias("w"))
    views = views.union(key.filter(F.col("key").contains("\u00ad")).select("doc", "page", F.lit(2), F.split(soft, " ")))
    views = views.union(seams.select("doc", "page", F.lit(3), F.concat(F.slice("tail", F.greatest(F.size("tail") - words + 2, F.lit(1)), words - 1), F.slice("head", 1, words - 1))))
    hits = views.select("doc", "page", "view", F.explode(_grams(F.col("doc"), F.col("w"), words)).alias("h"))
    hits = written(hits.join(asked.select("h").distinct(), "h", "left_semi"))
    # A run that no page has is on the fewest: its quotation is nowhere.
    often = asked.join(hits.groupBy("h").agg(F.count("*").alias("n")), "h", "left")
    rarest = often.groupBy("quote_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h")).getField("h").alias("h"))
    met = written(rarest.join(hits, "h").select("quote_id", "doc", "page", "view"))
    whole = met.filter("view = 1")
    after = whole.join(seams.select("doc", F.col("page").alias("before"), F.col("next").alias("page")), ["doc", "page"]).select("quote_id", "doc", F.col("before").alias("page"))
    over = whole.select("quote_id", "doc", "page").union(after).withColumn("view", F.lit(3))
    near = written(met.unionByName(over).distinct())
    near = near.filter("view < 3").withColumn("next", F.lit(None).cast(dict(pages.dtypes)["page"])).unionByName(near.filter("view = 3").join(seams.select("doc", "page", "next"), ["doc", "page"]))
    both = near.join(key, ["doc", "page"]).join(key.select("doc", F.col("page").alias("next"), F.col("key").alias("next_key")), ["doc", "next"], "left")
    text = F.when(F.col("view") == 2, soft).otherwise(F.concat_ws(" ", "key", "next_key"))
    found = both.select("quote_id", "doc", "page", "view", text.alias("key")).join(long.select("quote_id", "hint", "q"), "quote_id")
    # Quotations too short for a run are searched for in all pages of their document, and over the words next to each seam.
    short = q.filter((F.size("w") < words + 2) & (F.col("q") != "")).select("quote_id", "doc", "hint", "q")
    places = key.withColumn("view", F.lit(1)).unionByName(key.filter(F.col("key").contains("\u00ad")).select("doc", "page", soft.alias("key"), F.lit(2).alias("view")))
    places = places.unionByName(seams.select("doc", "page", F.concat_ws(" ", "tail", "head").alias("key"), F.lit(3).alias("view")))
    rest = short.join(places, "doc").select("quote_id", "doc", "page", "view", "key", "hint", "q")
    hits = found.select(*rest.columns).union(rest).filter(F.col("key").contains(F.col("q")))
    first = F.min(F.struct("view", F.when(F.col("page") == F.col("hint"), 0).otherwise(1).alias("k"), "page", "hint")).alias("at")
    best = hits.groupBy("quote_id", "doc").agg(first)
    return best.select("quote_id", "doc", "at.page", "at.view", F.col("at.page").eqNullSafe(F.col("at.hint")).alias("page_hint_ok"))


def toc_pages(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """title, page: the one page (outside the table of contents) that has the title as a heading; null if none or several.

    entries: doc, title_key. pages: doc, page, heading_key, is_toc.
    """
    lines = pages.filter(~F.col("is_toc")).select("doc", "page", F.col("heading_key").alias("title_key")).distinct()
    found = entries.join(lines, ["doc", "title_key"], "left").groupBy("doc", "title_key").agg(F.collect_set("page").alias("p"))
    return found.select("doc", "title_key", F.when(F.size("p") == 1, F.col("p")[0]).alias("page"))


def coverage(expected: DataFrame, returned: DataFrame, key: list[str], fixed: list[str]) -> DataFrame:
    """key..., problem: missing, unknown, repeated, or changed (a fixed field differs)."""
    e = expected.select(*key, F.struct(*fixed).alias("_e"))
    r = returned.groupBy(*key).agg(F.count("*").alias("_n"), F.first(F.struct(*fixed)).alias("_r"))
    j = e.join(r, key, "full_outer")
    problem = F.when(F.col("_r").isNull() & F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "unknown").when(F.col("_n") > 1, "repeated").when(~F.col("_e").eqNullSafe(F.col("_r")), "changed")
    return j.select(*key, problem.alias("problem")).filter("problem is not null")


def upsert(current: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new replace rows of current with equal keys; the others stay."""
    return current.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def reuse(current: DataFrame, previous: DataFrame, key: str, value: str, affected) -> DataFrame:
    """Rows that aren't affected take their value from the previous run where it has one."""
    old = previous.select(key, F.col(value).alias("_old"))
    return current.join(old, key, "left").withColumn(value, F.when(~affected, F.coalesce("_old", F.col(value))).otherwise(F.col(value))).drop("_old")
