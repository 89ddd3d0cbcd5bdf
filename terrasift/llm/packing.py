"""Packing by optimal length buckets: dynamic programming over the histogram of all lengths, then batches by a token budget.

The histogram has one entry for each length that occurs, whatever the longest is. n different lengths need at least
n * (n - 1) / 2 tokens, so what reaches the driver grows with the root of the tokens at most. Bucket boundaries minimise the padding of all documents when each is padded to its bucket's
longest length. Batches are formed inside a bucket; a bucket is dealt by a hash into shards of about ``SHARD`` documents,
each batched on its own, so that no task holds a bucket. At most one batch a shard is not full.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.llm.store import keep

SHARD = 20_000


def count_words(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(bare == "", 0).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The longest length of each bucket, ascending; least total padding, at most `buckets` of them.

    cost(i, j) = lengths[j] * documents(i..j) - tokens(i..j); tokens are the same for any choice and left out. What a last
    bucket from i + 1 costs is a line over lengths[j], steeper downwards as i grows, so the least one is at the front of a
    hull of lines, and a bucket more takes one pass. Whole numbers of any size, so nothing is rounded.
    """
    n = len(lengths)
    if not n:
        return []
    lengths = [int(x) for x in lengths]
    size = [0]
    for c in counts:
        size.append(size[-1] + int(c))
    best = [x * c for x, c in zip(lengths, size[1:], strict=True)]
    back = [[-1] * n]
    for _ in range(1, min(buckets, n)):
        now, choice, hull = best.copy(), [-1] * n, deque()
        for j in range(1, n):
            m, b = -size[j], best[j - 1]
            while len(hull) > 1:
                (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                if (b - b1) * (m1 - m2) > (b2 - b1) * (m1 - m):
                    break
                hull.pop()
            hull.append((m, b, j - 1))
            x = lengths[j]
            while len(hull) > 1 and hull[1][0] * x + hull[1][1] < hull[0][0] * x + hull[0][1]:
                hull.popleft()
            cost = hull[0][0] * x + hull[0][1] + x * size[j + 1]
            if cost < now[j]:
                now[j], choice[j] = cost, hull[0][2]
        back.append(choice)
        best = now
    out, j = [], n - 1
    for choice in back[:0:-1]:
        if choice[j] >= 0:
            out.append(lengths[j])
            j = choice[j]
    return [*out, lengths[j]][::-1]


def pack(documents: DataFrame, buckets: int = 8, budget: int = 8192, length: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket (from 0), bucket_length, batch (text, unique), padding.

    length: the column of token counts, words of `text` by default; null counts as 0. A batch has at most
    max(1, budget // bucket_length) documents, so only documents longer than the budget exceed it, alone. Ties are
    ordered by a hash of key and text, and repeated rows are packed one by one. Texts of any length are counted whole. Only the
    key, the text and the lengths are read, whatever else there is and however it is named. An empty table gives an empty result.
    """
    n = F.greatest(F.coalesce(length if length is not None else count_words(F.col(f"`{text}`")), F.lit(0)), F.lit(0)).cast("long")
    docs = keep(documents.select(F.col(f"`{key}`").alias("doc_id"), n.alias("n_tokens"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("rk")))
    histogram = sorted((r.n_tokens, r.c) for r in docs.groupBy("n_tokens").agg(F.count("*").alias("c")).collect())
    tops = boundaries(np.array([t for t, _ in histogram], np.int64), np.array([c for _, c in histogram], np.int64), buckets)
    if not tops:
        return docs.select("doc_id", "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("bucket_length"), F.lit("").alias("batch"), F.lit(0).cast("long").alias("padding"))
    number = [sum(c for t, c in histogram if lo < t <= hi) for lo, hi in zip([-1, *tops[:-1]], tops, strict=True)]
    pick = lambda values: F.coalesce(*(F.when(F.col("n_tokens") <= t, F.lit(v)) for t, v in zip(tops, values, strict=True)))
    out = docs.withColumn("bucket", pick(range(len(tops)))).withColumn("bucket_length", pick(tops).cast("long"))
    out = out.withColumn("shard", F.pmod(F.col("rk"), pick([-(-c // SHARD) for c in number]).cast("long")))
    order = Window.partitionBy("bucket", "shard").orderBy("rk", "doc_id")
    capacity = pick([max(1, budget // max(t, 1)) for t in tops])
    batch = F.floor((F.row_number().over(order) - 1) / capacity)
    return out.select("doc_id", "n_tokens", "bucket", "bucket_length", F.concat_ws("-", "bucket", "shard", batch).alias("batch"), (F.col("bucket_length") - F.col("n_tokens")).alias("padding"))
