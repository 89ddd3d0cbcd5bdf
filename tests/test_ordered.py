"""Windows by stretches, medians, packing and splitting against plain Python."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.operators import folds, ordered, spatial
from terrasift.plans import registry
from tests.oracle import compare


@pytest.fixture
def rows():
    r = random.Random(3)
    out = []
    for g in ("a", "b", None):
        for o in r.sample(range(5000), 300):
            out.append((g, o, r.choice([None, None, r.randint(0, 50)])))
    return [*out, ("c", 7, None)]


def test_stretches(spark, rows, monkeypatch):
    monkeypatch.setattr(ordered, "STRETCHES", 7)
    df = spark.createDataFrame(rows, "g string, o long, v int").repartition(3)
    number = {(r.g, r.o): r.row for r in ordered.row_numbers(df, ["g"], "o").collect()}
    low = {(r.g, r.o): r.low for r in ordered.running_min(df, ["g"], "o", F.col("v"), "low").collect()}
    near = {(r.g, r.o): (r.left, r.right) for r in ordered.neighbours(df, ["g"], "o", F.col("v"), "left", "right").collect()}
    for g in ("a", "b", "c", None):
        own = sorted((o, v) for h, o, v in rows if h == g)
        for i, (o, _) in enumerate(own):
            seen = [v for _, v in own[: i + 1] if v is not None]
            assert number[g, o] == i + 1
            assert low[g, o] == (min(seen) if seen else None)
            before, after = [v for _, v in own[:i] if v is not None], [v for _, v in own[i + 1 :] if v is not None]
            assert near[g, o] == (before[-1] if before else None, after[0] if after else None)
    assert ordered.row_numbers(df.limit(0), ["g"], "o").count() == 0


def test_far_outliers_do_not_fill_a_stretch(spark):
    """Orders from 0 to 1000, and one of 1e12: the others still spread over the stretches."""
    df = spark.range(20_000).select((F.col("id") / 20).alias("o"), F.lit("g").alias("g")).union(spark.sql("select 1e12D, 'g'"))
    sizes = [r["count"] for r in ordered._cut(df, "o").groupBy("_s").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 200
    ties = spark.createDataFrame([("g", 1, k, k) for k in range(50)] + [("g", 0, 9, None), ("g", 2, 9, None)], "g string, o int, t int, v int")
    got = {(x.o, x.t): (x.left, x.right) for x in ordered.neighbours(ties, ["g"], "o", F.col("v"), "left", "right", tie=["t"]).collect()}
    assert got[1, 0] == (None, 1) and got[1, 49] == (48, None) and got[0, 9] == (None, 0) and got[2, 9] == (49, None)
    total = {(x.o, x.t): x.s for x in ordered.running_sum(ties.fillna(0, ["v"]), ["g"], "o", F.col("v"), "s", ["t"]).collect()}
    assert all(total[1, k] == sum(range(k + 1)) for k in range(50)) and total[2, 9] == sum(range(50))


@pytest.mark.parametrize("many", [1 << 20, 20])
def test_medians_with_an_outlier(spark, many):
    """One value of 1e12 among 20,000, and values bunched about the middle; brackets are narrowed until few values are inside."""
    r = random.Random(2)
    data = {"far": [r.random() for _ in range(20_000)] + [1e12], "bunch": [1e6 + r.randrange(4000) / 1e6 for _ in range(9_999)] + [r.random() for _ in range(10_000)], "ties": [3.0] * 5000 + [r.random() for _ in range(4_000)]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double").repartition(5)
    got = {x.k: x.median for x in ordered.medians(df, ["k"], "v", many).collect()}
    assert got == {k: statistics.median(vs) for k, vs in data.items()}


def test_medians(spark):
    r = random.Random(1)
    data = {"even": [r.random() for _ in range(100)], "odd": [r.choice((1.0, 2.0, 1e9)) for _ in range(51)], "one": [4.0], "same": [2.5] * 40, "none": [None, None], None: [1.0, 3.0], "some": [None, 5.0, 7.0]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    got = {x.k: x.median for x in ordered.medians(df, ["k"], "v").collect()}
    assert got == {k: statistics.median(w) if (w := [v for v in vs if v is not None]) else None for k, vs in data.items()}


def test_batches_and_splits(spark):
    def plain(sizes, limit):
        out, used, batch = [], 0, -1
        for s in sizes:
            if batch < 0 or used + s > limit:
                batch, used = batch + 1, 0
            used += s
            out.append(batch)
        return out, used, batch

    r = random.Random(2)
    for _ in range(200):
        sizes = np.array([r.choice((0, 1, 3, 9, 40)) for _ in range(r.randint(1, 30))])
        whole = plain(sizes.tolist(), 20)
        made = folds.batch_numbers(sizes, 20, 0, -1)
        assert (made[0].tolist(), *made[1:]) == whole
        k = r.randint(0, len(sizes))
        one = folds.batch_numbers(sizes[:k], 20, 0, -1)
        two = folds.batch_numbers(sizes[k:], 20, *one[1:])
        assert one[0].tolist() + two[0].tolist() == whole[0] and two[1:] == whole[1:]
    with pytest.raises(Exception, match="larger than a batch"):
        folds.pack(spark.createDataFrame([("a", 1, 30)], "doc string, pos int, size int"), 20).collect()
    text = "é" * 7 + " " + "b" * 25 + " cc dd " + "e" * 9
    ends = folds.split_points(text, 10)
    assert "".join(text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)) == text and all(b - a <= 10 for a, b in zip([0, *ends[:-1]], ends, strict=True))
    assert folds.split_points("", 10) == [] and folds.split_points("abc", 10) == [3]


def test_nearest_at_any_distance(spark):
    a = spatial.as_box(spark.createDataFrame([(1, 0.0, 0.0), (2, 1e6, 5.0)], "k long, x double, y double"))
    b = spatial.as_box(spark.createDataFrame([(7, 3.0, 4.0), (8, -3.0, 4.0)], "o long, x double, y double"))
    keep = lambda d: spark.createDataFrame(d.collect(), d.schema)
    got = sorted(map(tuple, spatial.nearest(a, b, "k", "o", 1.0, keep).collect()))
    assert got[0] == (1, 7, 5.0) and got[1][:2] == (2, 7)
    assert sorted(map(tuple, spatial.nearest(a, b, "k", "o", 1.0, keep, most=100.0).collect())) == [(1, 7, 5.0)]
    assert spatial.nearest(a, b.limit(0), "k", "o", 1.0, keep).count() == 0


def test_lines_that_many_pages_share(spark, tmp_path):
    """A threshold of 40 % of the pages; running head and foot are on all."""
    texts = [f"Head {i}\nbody {i} x\nFoot" if i < 5 else f"other{i}\ny{i}\nFoot" for i in range(10)]
    spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    f = registry.queries()["boilerplate_lines"]
    assert compare(spark, str(tmp_path), f, registry.oracle_sql()["boilerplate_lines"]) == ""
    assert sorted(r.pages for r in f(spark, str(tmp_path)).collect()) == [5, 5, 5, 5, 10, 10, 10]


@pytest.mark.parametrize(("block", "seed"), [(16, 1), (64, 2)])
def test_batches_of_large_groups(spark, block, seed):
    """Groups above a block's size are dealt in blocks: batches longer than a block, items above the limit, nothing at all."""
    r = random.Random(seed)
    rows = []
    for g, n in (("a", 400), (None, 90), ("b", 3), ("c", block), ("d", block + 1)):
        sizes = [r.choice([0, 1, 5, 30, 99, 100, 101, 250, None]) if g != "d" else 1 for _ in range(n)]
        rows += [(g, 7 * k - 50, s) for k, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc string, pos int, size int").repartition(3)
    want = {}
    for g in {g for g, *_ in rows}:
        used, batch = 0, -1
        for _, o, s in sorted((x for x in rows if x[0] == g), key=lambda x: x[1]):
            if batch < 0 or used + (s or 0) > 100:
                used, batch = 0, batch + 1
            used += s or 0
            want[g, o] = batch
    got = {(x.doc, x.pos): x.batch for x in folds.pack(df, 100, strict=False, block=block).collect()}
    assert got == want
    with pytest.raises(Exception, match="larger than a batch"):
        folds.pack(df, 100, block=block).collect()
