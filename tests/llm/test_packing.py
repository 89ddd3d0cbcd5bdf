from collections import defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from terrasift.llm import packing


def padding(lengths, counts, tops):
    return sum(c * (min(t for t in tops if t >= x) - x) for x, c in zip(lengths, counts, strict=True))


def test_boundaries_are_optimal():
    r = np.random.default_rng(1)
    for _ in range(30):
        lengths = np.sort(r.choice(50, r.integers(1, 9), replace=False))
        counts = r.integers(1, 20, len(lengths))
        k = int(r.integers(1, 5))
        tops = packing.boundaries(lengths.astype(float), counts, k)
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for m in range(k) for c in combinations(lengths[:-1], m))
        assert len(tops) <= k and padding(lengths, counts, tops) == best


def test_batches(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 40)
    rows = [(i, " ".join(["w"] * (i * i % 97))) for i in range(300)] + [(7, None), (7, None), (None, "a b\tc\n"), (400, " ".join(["x"] * 900))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("other"))
    got = packing.pack(df, buckets=4, budget=200).collect()
    assert len(got) == len(rows)
    batches = defaultdict(list)
    for r in got:
        assert r.padding >= 0 and r.bucket_length == r.n_tokens + r.padding
        batches[r.batch].append(r)
    assert {r.doc_id: r.n_tokens for r in got}[None] == 3
    for b in batches.values():
        assert len({r.bucket for r in b}) == 1 and (len(b) == 1 or len(b) * b[0].bucket_length <= 200 or b[0].bucket_length == 0)
    full = defaultdict(list)
    for name, b in batches.items():
        full[name.rpartition("-")[0]].append(len(b))
    assert all(sum(n < max(x) for n in x) <= 1 for x in full.values())
    assert packing.pack(df.limit(0)).count() == 0


def exact(lengths, counts, k):
    """Least padding by trying every last boundary."""
    size = np.concatenate(([0], np.cumsum(counts)))
    best = lengths * size[1:]
    for _ in range(1, min(k, len(lengths))):
        best = np.array([min([best[j], *(best[i] + lengths[j] * (size[j + 1] - size[i + 1]) for i in range(j))]) for j in range(len(lengths))])
    return int(best[-1] - (lengths * counts).sum())


def test_many_lengths_are_optimal():
    r = np.random.default_rng(2)
    for k in (1, 2, 5, 8):
        lengths = np.sort(r.choice(5_000_000, 150, replace=False))
        counts = r.integers(1, 500, 150)
        tops = packing.boundaries(lengths, counts, k)
        assert len(tops) == k and padding(lengths, counts, tops) == exact(lengths, counts, k)


def test_one_huge_text_leaves_the_others_their_buckets(spark):
    lengths = [(i * i) % 611 + 1 for i in range(900)] + [1_000_000]
    df = spark.createDataFrame([(i, n, "") for i, n in enumerate(lengths)], "doc_id long, n long, text string")
    got = packing.pack(df, length=F.col("n")).collect()
    assert {r.doc_id: r.n_tokens for r in got} == dict(enumerate(lengths))
    assert len({r.bucket for r in got}) == 8
    kinds, counts = np.unique(lengths, return_counts=True)
    assert sum(r.padding for r in got) == exact(kinds, counts, 8)
