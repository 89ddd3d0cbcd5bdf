"""The corpus pipeline: language ID, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. docs
are what the stage before kept. Result of run(): the packing of the documents that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from terrasift.llm.store import keep, sized

#: Least share by which the second best language has to be larger; below it a text's language is not told apart. Least share
#: by which the best one has to be smaller than the text without any; below it the text is in none of them. README has the
#: figures of labelled texts and of texts in other languages that they were chosen by.
MARGIN, GAIN = 0.01, 0.015


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language; `lang` becomes the predicted one."""
    found = language_id.identify(docs, language_id.fit(docs), MARGIN, gain=GAIN)
    return found.filter(F.col("language.lang") != "und").withColumn("lang", F.col("language.lang")).drop("language")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated three-line windows; documents of which nothing is left go. `n_chars` follows the text."""
    found = line_dedup.dedup(docs).filter((F.col("line_dedup.n_removed") == 0) | (F.trim("text") != ""))
    return found.withColumn("n_chars", F.when(F.col("line_dedup.n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("line_dedup")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays."""
    found = jaccard_join.link_components(docs.select("doc_id", "text"))
    gone = keep(found.filter("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(sized(gone), "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents; others stay whole."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Compression can't be expressed in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
