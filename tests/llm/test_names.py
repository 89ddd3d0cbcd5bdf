"""Extra columns whose names operators use inside themselves change nothing."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from terrasift.llm import chat_format, collocations, embedding_dedup, jaccard_join, line_dedup, packing, turn_repair, warc

NAMES = ["id", "u", "v", "c", "h", "h1", "rk", "row", "key", "size", "n", "text_", "batch", "bucket", "component", "weight", "leaf", "sha", "last", "conv", "pos", "fault", "phrase", "f"]


def crowded(df):
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(NAMES) if n not in df.columns))


def same(f, df):
    plain, crowd = (sorted(map(str, f(x).collect())) for x in (df, crowded(df)))
    assert plain == crowd and plain


def test_documents(spark):
    body = " ".join(f"w{i}" for i in range(40))
    rows = [(1, body), (2, body + " more"), (3, "a\nb\nc\nd"), (4, "x\na\nb\nc"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(jaccard_join.link_components, df)
    same(lambda d: packing.pack(d).drop("batch"), df)
    same(lambda d: line_dedup.dedup(d).select("doc_id", "text", "line_dedup"), df)
    same(lambda d: collocations.mine(d, least=2), df.withColumn("lang", F.lit("en")))


def test_other_tables(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 1200), (2, "v", "x" * 1200), (3, "w", None)], "page_id long, url string, html string")
    same(lambda d: warc.read_archives(warc.write_archives(d)), pages)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    same(embedding_dedup.near_duplicates, vectors)
    talks = spark.createDataFrame([(1, 0, "user", "Why?"), (1, 1, "assistant", "So."), (2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    same(lambda d: turn_repair.repair(d).report, talks)
    same(lambda d: chat_format.format_chat(d.withColumn("parts", F.array(chat_format.text_part(F.col("text"))))).select("conv_id", "formatted"), talks)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.withColumns({n: F.lit(1) for n in ("row", "key", "u", "component_id", "hits", "score", "starts")})
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, extra, sf)
        assert set(docs.columns) <= set(out.columns), name
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in stage(spark, docs, sf).select("doc_id").collect()), name
