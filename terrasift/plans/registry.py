"""Registered queries: a name, a function of (spark, sf_dir), and the SQL that gives the same rows where there is one."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Modules of terrasift.plans that register queries when they are imported.
MODULES = ("language", "predicates", "texts", "citations", "chains", "statistics", "spatial", "checks", "placements", "terrain", "localization", "geometry", "files")


def query(sql: str | None = None):
    """Register the decorated function under its own name, with its SQL if given."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"terrasift.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
