"""Rules as data: each rule is a name and a condition that holds where it is broken; results are issue rows or flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """key..., code: one row for each broken rule, in one pass. A condition that is null isn't broken."""
    broken = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())
    return df.select(*key, F.explode(broken).alias("code"))


def checks(df: DataFrame, by: list[str], groups: dict[str, list[Column]]) -> DataFrame:
    """by..., a boolean for each group of conditions: whether none of them holds for any row."""
    none = lambda cs: ~F.bool_or(F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in cs]), F.lit(False)))
    out = [none(cs).alias(name) for name, cs in groups.items()]
    return df.groupBy(*by).agg(*out) if by else df.agg(*out)


def implies(a: Column, b: Column) -> Column:
    """The condition under which `a implies b` is broken."""
    return a & ~b


def unknown_keys(m: Column, allowed: list[str]) -> Column:
    return F.array_except(F.map_keys(m), F.array(*(F.lit(k) for k in allowed)))


def id_coverage(expected: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """key, problem: missing, unknown, reordered (position differs). Both have key and pos."""
    j = expected.select(key, F.col("pos").alias("e")).join(returned.select(key, F.col("pos").alias("r")), key, "full_outer")
    problem = F.when(F.col("r").isNull(), "missing").when(F.col("e").isNull(), "unknown").when(F.col("e") != F.col("r"), "reordered")
    return j.select(key, problem.alias("problem")).filter("problem is not null")


def compare_tables(a: DataFrame, b: DataFrame, key: str, fields: list[str], tolerance: float = 0.0) -> DataFrame:
    """key, field: rows that only one side has (field 'row'), and fields that differ by more than the tolerance."""
    x, y = a.select(key, F.struct(*fields).alias("x")), b.select(key, F.struct(*fields).alias("y"))
    j = x.join(y, key, "full_outer")
    kinds = dict(a.dtypes)

    def differs(f: str) -> Column:
        p, q = F.col(f"x.{f}"), F.col(f"y.{f}")
        return F.coalesce(F.abs(p - q) > tolerance, ~p.eqNullSafe(q)) if kinds[f] in ("double", "float") else ~p.eqNullSafe(q)

    both = F.filter(F.array(*(F.when(differs(f), F.lit(f)) for f in fields)), lambda v: v.isNotNull())
    return j.select(key, F.explode(F.when(F.col("x").isNull() | F.col("y").isNull(), F.array(F.lit("row"))).otherwise(both)).alias("field"))
