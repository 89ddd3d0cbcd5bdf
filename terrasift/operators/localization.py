"""Checks of placed parts that a reviewer must not wave through, and the states of a placement run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words by which a report gives a place only as an area, or a total.
AREA_WORDING = r"(?i)\bim Bereich\b|\bin der Umgebung\b|\bin the area of\b|\bnear\b|\bnella zona\b|\bnei pressi\b|\bdans le secteur\b|\bà proximité\b"
TOTAL_WORDING = r"(?i)\binsgesamt\b|\bin total\b|\bin summe\b|\bcomplessivamente\b|\bau total\b"
#: How far a mapped area may be from the reported one, and a station beyond the line's length.
AREA_RATIO, STATION_SLACK, SPREAD_PAGES = (0.67, 1.5), 1.05, 3


def part_issues(parts: DataFrame, line_length: float | None) -> DataFrame:
    """part_id, code: area_differs, station_beyond_line, area_as_point, total_as_place.

    parts: part_id, method, area_ha, report_area_ha, stations (array of numbers), quotes (array of texts). One pass of
    column expressions; nulls break no rule.
    """
    said, ratio = F.concat_ws(" ", "quotes"), F.col("area_ha") / F.col("report_area_ha")
    place = F.col("method").isin("location_point", "buildings_near")
    beyond = F.exists("stations", lambda x: x > STATION_SLACK * line_length) if line_length else F.lit(False)
    rules = {
        "area_differs": (F.col("report_area_ha") > 0) & ~ratio.between(*AREA_RATIO),
        "station_beyond_line": beyond,
        "area_as_point": place & said.rlike(AREA_WORDING),
        "total_as_place": (place | (F.col("method") == "named_area")) & said.rlike(TOTAL_WORDING),
    }
    broken = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())
    return parts.select("part_id", F.explode(broken).alias("code"))


def unmapped_streams(parts: DataFrame, streams: DataFrame) -> DataFrame:
    """seg_id, stream: streams named in the quotations of a segment's parts of which no part of the segment makes use.

    parts: seg_id, used (array of stream ids that the part runs along or ends at), quotes. streams: id, names (array), a
    bounded table of candidates. A name of fewer than four letters isn't looked for. Quotations are matched per part before
    anything is grouped, so a segment's texts are never put together.
    """
    names = streams.select(F.col("id").alias("stream"), F.explode("names").alias("name")).filter(F.length("name") >= 4).select("stream", F.lower("name").alias("name")).distinct()
    said = parts.select("seg_id", F.explode("quotes").alias("q")).select("seg_id", F.lower("q").alias("q")).distinct()
    # A name's longest word stands in some word of the text, perhaps inside a compound; its first four letters are a gram of
    # that word, which makes it an equi-join. Names of short words only are looked for in all texts.
    word = lambda c: F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    longest = F.array_max(F.transform(word("name"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    names = names.withColumn("block", F.when(longest.n >= 4, F.substring(longest.w, 1, 4)))
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 3, F.lit(1))), lambda i: F.substr(c, i, F.lit(4)))
    blocks = said.withColumn("block", F.explode(F.array_distinct(F.flatten(F.transform(word("q"), grams)))))
    holds = F.col("q").contains(F.col("name"))
    near = blocks.join(names, "block").filter(holds).select("seg_id", "stream")
    short = said.join(F.broadcast(names.filter("block is null").drop("block")), holds).select("seg_id", "stream")
    found = near.union(short).distinct()
    used = parts.select("seg_id", F.explode("used").alias("stream")).distinct()
    return found.join(used, ["seg_id", "stream"], "left_anti")


def scarce_parts(segments: DataFrame, parts: DataFrame, evidence: DataFrame) -> DataFrame:
    """seg_id of segments with a single part though their evidence is on several pages, unless they concern a whole catchment.

    segments: seg_id, wide (boolean). evidence: seg_id, page.
    """
    single = parts.groupBy("seg_id").agg(F.count("*").alias("n")).filter("n = 1")
    spread = evidence.groupBy("seg_id").agg(F.countDistinct("page").alias("pages")).filter(F.col("pages") >= SPREAD_PAGES)
    return segments.filter(~F.coalesce("wide", F.lit(False))).join(single, "seg_id", "left_semi").join(spread, "seg_id", "left_semi").select("seg_id")


def final_status(errors: Column, validation: Column, failures: Column, todo: Column, review_error: Column, open_issues: Column, unresolved: Column) -> Column:
    """The terminal state of a run from counts of what is left; the first that applies."""
    # The states, the gravest first.
    states = [("build_errors", errors), ("validation_errors", validation), ("incomplete", failures), ("partial", todo), ("review_incomplete", review_error), ("revision_required", open_issues), ("delivered_with_unresolved", unresolved)]
    out = F.lit("delivered")
    for name, count in reversed(states):
        out = F.when(F.coalesce(count, F.lit(0)) > 0, F.lit(name)).otherwise(out)
    return out


def correction_rounds(items: DataFrame, answer: Callable[[DataFrame, int], DataFrame], check: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame], rounds: int = 2, key: str = "seg_id") -> tuple[DataFrame, DataFrame]:
    """Answers for all items, and issues that are left after a bounded number of corrections.

    answer(items, round) gives one row an item; check(answers) gives rows (key, ...) of what is wrong. Each round asks again
    only for what is wrong and replaces those answers; every round is written by keep(), so a stopped run resumes from it.
    """
    have = keep(answer(items, 0))
    wrong = keep(check(have))
    for k in range(1, rounds + 1):
        if wrong.isEmpty():
            break
        again = items.join(wrong.select(key).distinct(), key, "left_semi")
        made = keep(answer(again, k))
        have = keep(have.join(made.select(key), key, "left_anti").unionByName(made))
        wrong = keep(check(have))
    return have, wrong
