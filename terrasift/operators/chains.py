"""Causal chains: dense renumbering, duplicate consolidation, stable ids, reordering, checks, and scope fixpoints.

A chain is a table of segments: chain, segment, causal_order, predecessors array<bigint>, event, process, evidence.
Windows are partitioned by chain, so chains are independent and never gathered together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions.text import text_key


def _remap(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Predecessors through mapping (chain, old, new); links to nothing or to itself go, each stays once, in order."""
    edges = df.select("chain", "segment", F.posexplode("predecessors").alias("i", "old"))
    moved = edges.join(mapping, ["chain", "old"]).filter(F.col("new") != F.col("segment"))
    firsts = moved.groupBy("chain", "segment", "new").agg(F.min("i").alias("i"))
    lists = firsts.groupBy("chain", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "new"))), lambda x: x.new).alias("predecessors"))
    return df.drop("predecessors").join(lists, ["chain", "segment"], "left").withColumn("predecessors", F.coalesce("predecessors", F.array().cast("array<bigint>")))


def reindex(df: DataFrame, start: int = 1) -> DataFrame:
    """Segments and orders become start, start + 1, ... by causal_order; predecessors follow."""
    w = Window.partitionBy("chain").orderBy("causal_order", "segment")
    numbered = df.withColumn("new", (F.row_number().over(w) - 1 + start).cast("long"))
    mapping = numbered.select("chain", F.col("segment").alias("old"), "new")
    moved = numbered.withColumn("segment", F.col("new")).withColumn("causal_order", F.col("new")).drop("new")
    return _remap(moved, mapping)


def consolidate(df: DataFrame) -> DataFrame:
    """One segment per caseless (event, process): the first by order stays, evidence is the ordered distinct union."""
    key = F.struct(text_key("event").alias("e"), text_key("process").alias("p"))
    place = F.struct("causal_order", "segment")
    keyed = df.withColumn("key", key)
    groups = keyed.groupBy("chain", "key").agg(
        F.min_by(F.struct("segment", "causal_order", "event", "process"), place).alias("first"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("causal_order", "segment", "evidence"))), lambda x: x.evidence))).alias("evidence"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("causal_order", "segment", "predecessors"))), lambda x: x.predecessors))).alias("predecessors"),
    )
    kept = groups.select("chain", "key", "first.*", "evidence", "predecessors")
    mapping = keyed.select("chain", "key", F.col("segment").alias("old")).join(kept.select("chain", "key", F.col("segment").alias("new")), ["chain", "key"]).drop("key")
    return reindex(_remap(kept.drop("key"), mapping))


def stable_ids(revised: DataFrame, previous: DataFrame) -> DataFrame:
    """Segments that were there before (caseless event and process; the first claimant) keep their id, others get the next ones."""
    key = [text_key("event").alias("e"), text_key("process").alias("p")]
    old = previous.select("chain", *key, "segment").groupBy("chain", "e", "p").agg(F.min("segment").alias("old"))
    top = previous.groupBy("chain").agg(F.max("segment").alias("top"))
    joined = revised.select("*", *key).join(old, ["chain", "e", "p"], "left").join(top, "chain", "left")
    claim = F.row_number().over(Window.partitionBy("chain", "old").orderBy("causal_order", "segment"))
    joined = joined.withColumn("keeps", F.col("old").isNotNull() & (claim == 1))
    fresh = F.row_number().over(Window.partitionBy("chain", "keeps").orderBy("causal_order", "segment"))
    joined = joined.withColumn("new", F.when(F.col("keeps"), F.col("old")).otherwise(F.coalesce("top", F.lit(0)) + fresh).cast("long"))
    mapping = joined.select("chain", F.col("segment").alias("old_id"), "new").withColumnRenamed("old_id", "old")
    return _remap(joined.withColumn("segment", F.col("new")).drop("new", "old", "top", "keeps", "e", "p"), mapping)


def move(df: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """moves: chain, segment, to (from 1). Returns the renumbered chain and an audit row for every order that changed."""
    joined = df.join(moves, ["chain", "segment"], "left")
    down = F.col("to") > F.col("causal_order")
    place = F.coalesce(F.col("to") + F.when(down, 0.5).otherwise(-0.5), F.col("causal_order").cast("double"))
    w = Window.partitionBy("chain").orderBy(place, "segment")
    numbered = joined.withColumn("new_order", F.row_number().over(w).cast("long"))
    audit = numbered.filter(F.col("new_order") != F.col("causal_order")).select("chain", "segment", F.col("causal_order").alias("old_order"), "new_order")
    return numbered.withColumn("causal_order", F.col("new_order")).drop("new_order", "to"), audit


def chain_issues(df: DataFrame) -> DataFrame:
    """chain, segment, code: not_contiguous, duplicate_segment, unknown_predecessor, predecessor_not_earlier, duplicate_predecessor."""
    w = Window.partitionBy("chain")
    numbered = df.withColumn("want", F.row_number().over(w.orderBy("causal_order", "segment"))).withColumn("same", F.count("*").over(Window.partitionBy("chain", "segment")))
    own = numbered.select("chain", "segment", F.explode(F.filter(F.array(F.when(F.col("want") != F.col("causal_order"), F.lit("not_contiguous")), F.when(F.col("same") > 1, F.lit("duplicate_segment")), F.when(F.size(F.array_distinct("predecessors")) < F.size("predecessors"), F.lit("duplicate_predecessor"))), lambda x: x.isNotNull())).alias("code"))
    edges = df.select("chain", "segment", "causal_order", F.explode("predecessors").alias("p"))
    ends = df.select("chain", F.col("segment").alias("p"), F.col("causal_order").alias("p_order"))
    links = edges.join(ends, ["chain", "p"], "left").select("chain", "segment", F.when(F.col("p_order").isNull(), "unknown_predecessor").when(F.col("p_order") >= F.col("causal_order"), "predecessor_not_earlier").alias("code"))
    return own.union(links.filter("code is not null")).distinct()


def scope(df: DataFrame, seeds: DataFrame, checkpoint, rounds: int = 100) -> DataFrame:
    """Segments that a change of the seeds (chain, segment) touches: along predecessors, successors and equal events,
    until nothing is added. checkpoint(df) writes a round and reads it back; a graph deeper than `rounds` is an error."""
    edges = df.select("chain", "segment", F.explode("predecessors").alias("other"))
    both = edges.union(edges.select("chain", F.col("other").alias("segment"), F.col("segment").alias("other")))
    events = df.select("chain", "segment", text_key("event").alias("e"))
    # Links to what is no segment of the chain lead nowhere.
    both, events = checkpoint(both.join(events.select("chain", F.col("segment").alias("other")), ["chain", "other"], "left_semi").distinct()), checkpoint(events)
    reached = checkpoint(seeds.join(events.select("chain", "segment"), ["chain", "segment"], "left_semi").distinct())
    front = reached
    for _ in range(rounds):
        linked = front.join(both, ["chain", "segment"]).select("chain", F.col("other").alias("segment"))
        touched = front.join(events, ["chain", "segment"]).select("chain", "e").distinct()
        front = checkpoint(linked.union(events.join(touched, ["chain", "e"], "left_semi").select("chain", "segment")).distinct().join(reached, ["chain", "segment"], "left_anti"))
        if front.isEmpty():
            return reached
        reached = checkpoint(reached.union(front))
    raise RuntimeError("the scope did not settle")
