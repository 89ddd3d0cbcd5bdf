"""Statistics over runs: call counters, sessions, distributions, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.operators.ordered import medians


def executions(log: DataFrame, run: str, order: list[str], starts: Column) -> DataFrame:
    """Adds `execution`: the number of starts so far in the run; 0 before the first (calls that belong to no stage)."""
    w = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("execution", F.sum(starts.cast("int")).over(w))


def counters(attempt: Column, outcome: Column, error: Column, wait: Column) -> list[Column]:
    """requests, attempts, retries, timeouts, failed, waited of a group of calls."""
    return [
        F.count_if(attempt == 1).alias("requests"),
        F.count("*").alias("attempts"),
        F.count_if(attempt > 1).alias("retries"),
        F.count_if(F.coalesce(error.rlike("(?i)time[d ]*out"), F.lit(False))).alias("timeouts"),
        F.count_if(F.coalesce(outcome != "pass", F.lit(True))).alias("failed"),
        F.sum(F.coalesce(wait, F.lit(0.0))).alias("waited"),
    ]


def _moments(value: Column) -> list[Column]:
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_samp(value).alias("stdev")]


def distributions(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys..., n, mean, median, min, max, stdev (null below two values) of the values that aren't null; all null but n for none."""
    m = medians(df, keys, value).withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.groupBy(*keys).agg(*_moments(F.col(value))).join(m, reduce(lambda a, b: a & b, on)).drop(*(f"_{k}" for k in keys))


def distributions_by_each(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The same by each key on its own: key_name, key_value, ..."""
    told = df.select(value, F.explode(F.array(*(F.struct(F.lit(k).alias("key_name"), F.col(k).cast("string").alias("key_value")) for k in keys))).alias("k")).select("k.*", value)
    return distributions(told, ["key_name", "key_value"], value)


def by_each(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """The same aggregates by each key on its own, in one pass: key_name, key_value, ..."""
    sets = df.groupingSets([[k] for k in keys], *keys).agg(*aggregates, F.grouping_id().alias("_g"))
    full = (1 << len(keys)) - 1
    name = F.coalesce(*(F.when(F.col("_g") == full - (1 << (len(keys) - 1 - i)), F.lit(k)) for i, k in enumerate(keys)))
    value = F.coalesce(*(F.when(F.col("_g") == full - (1 << (len(keys) - 1 - i)), F.col(k).cast("string")) for i, k in enumerate(keys)))
    return sets.select(name.alias("key_name"), value.alias("key_value"), *[c for c in sets.columns if c not in (*keys, "_g")])


def mode_vote(df: DataFrame, group: str, value: str, order: str, share: float, least: int = 2) -> DataFrame:
    """group, value: the most frequent value (first seen wins ties) if it has at least max(least, share of all rows), else 0."""
    votes = df.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    total = df.groupBy(group).agg(F.count("*").alias("total"))
    top = votes.groupBy(group).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("seen"))).alias("t"))
    return top.join(total, group).select(group, F.when(F.col("t.n") >= F.greatest(F.lit(least), share * F.col("total")), F.col(f"t.{value}")).otherwise(0).alias(value), F.col("t.n").alias("votes"))


def weakest(ranks: dict[str, int], value: Column) -> Column:
    """The least confident of a group: names by rank (0 is the weakest), null if none is known."""
    number = F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv))
    names = F.create_map(*(F.lit(x) for k, v in ranks.items() for x in (v, k)))
    return F.try_element_at(names, F.min(F.try_element_at(number, value)))
