"""Run state as append-only tables: revisions, gates, audit, change polling, resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(stages: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the highest revision of each key."""
    rest = [c for c in stages.columns if c not in keys]
    return stages.groupBy(*keys).agg(F.max_by(F.struct(*rest), "revision").alias("_row")).select(*keys, "_row.*")


def invalidate(stages: DataFrame, order: list[str], run: str = "run") -> DataFrame:
    """Adds `valid`: a stage is valid if its token and those of all stages before it are what the next saw (`input_token`)."""
    place = F.create_map(*(F.lit(x) for i, s in enumerate(order) for x in (s, i)))[F.col("stage")]
    w = Window.partitionBy(run).orderBy(place)
    fits = F.coalesce(F.col("input_token") == F.lag("token").over(w), place == 0)
    marked = stages.withColumn("_fits", fits)
    return marked.withColumn("valid", F.min(F.col("_fits")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fits")


def gate(candidates: DataFrame, evaluations: DataFrame, key: str) -> DataFrame:
    """Candidates whose current revision has passed."""
    passed = evaluations.filter("status = 'pass'").select(key, F.col("revision"))
    return candidates.join(passed, [key, "revision"], "left_semi")


def changed(current: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of which the client's version hash differs, or that it doesn't have; version is added."""
    version = F.sha2(F.to_json(F.struct(*sorted(c for c in current.columns if c != key))), 256)
    now = current.withColumn("version", version)
    return now.join(known.select(key, F.col("version").alias("_known")), key, "left").filter(~F.col("version").eqNullSafe(F.col("_known"))).drop("_known")


def resume(todo: DataFrame, done: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """What is still to do: rows without a result of the same fingerprint."""
    return todo.join(done.select(key, fingerprint), [key, fingerprint], "left_anti")


def replace_records(current: DataFrame, new: DataFrame, key: str, order: str = "pos") -> DataFrame:
    """Upsert of a manifest: a replaced record moves to the end, in the order of the new ones."""
    last = current.agg(F.coalesce(F.max(order), F.lit(-1)).alias("_last"))
    added = new.crossJoin(F.broadcast(last)).withColumn(order, (F.col("_last") + 1 + F.col(order)).cast("long")).drop("_last")
    return current.join(new.select(key), key, "left_anti").unionByName(added)


#: States in which a run or a stage counts as being worked on.
BUSY, OPEN = ("running", "queued"), ("running", "queued", "pending")
INTERRUPTED = "the process that worked on this has stopped"


def interrupted(runs: DataFrame, workers: DataFrame) -> DataFrame:
    """runs with status, stages and error of those marked failed whose worker is known to have stopped.

    runs: run, status, stage (the current one), stages (map of stage to state), host, pid, error. workers: host, pid of live
    processes, and a row with a null pid for each host that was looked at: runs of other hosts, and runs without a worker,
    stay as they are.
    """
    live = workers.filter("pid is not null").select("host", "pid", F.lit(True).alias("_live")).distinct()
    seen = workers.filter("pid is null").select("host", F.lit(True).alias("_seen")).distinct()
    j = runs.join(live, ["host", "pid"], "left").join(seen, "host", "left")
    gone = F.coalesce(F.col("_seen"), F.lit(False)) & F.col("pid").isNotNull() & F.col("_live").isNull() & F.col("status").isin(*BUSY)
    stage = F.coalesce("stage", F.lit("pipeline"))
    stages = F.transform_values("stages", lambda k, v: F.when((k == stage) & v.isin(*OPEN), "failed").otherwise(v))
    out = j.withColumn("stages", F.when(gone, stages).otherwise(F.col("stages"))).withColumn("error", F.when(gone, INTERRUPTED).otherwise(F.col("error")))
    return out.withColumn("status", F.when(gone, "failed").otherwise(F.col("status"))).select(*runs.columns)


def commit(current: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """One writer at a time without locks: changes carry the version they were made from; of those made from the current
    version the first (least `at`, then `writer`) is taken and becomes the next version, the others come back as refused.

    current: key, version, ... changes: the same columns, with version the one seen, and writer, at. Unseen keys have version 0.
    """
    now = current.select(key, F.col("version").alias("_now"))
    j = changes.join(now, key, "left").withColumn("_now", F.coalesce("_now", F.lit(0)))
    turn = F.row_number().over(Window.partitionBy(key, "version").orderBy("at", "writer"))
    j = j.withColumn("_ok", (F.col("version") == F.col("_now")) & (turn == 1))
    taken = j.filter("_ok").withColumn("version", (F.col("version") + 1).cast(current.schema["version"].dataType)).select(*current.columns)
    return current.join(taken.select(key), key, "left_anti").unionByName(taken), j.filter(~F.col("_ok")).select(*changes.columns)
