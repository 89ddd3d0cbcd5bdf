import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle

from terrasift.llm import collocations, queries
from tests.oracle import compare


def brute(rows, least, longest, top):
    """The definition, phrase by phrase; rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = {x: a for x, a in f.items() if len(x) > 2 and a >= least}
    best = {}
    for x, a in found.items():
        cuts = [(2_000_000 * a // (f[x[: k + 1]] + f[x[:1] + x[k + 1 :]]), k, f[x[: k + 1]], f[x[:1] + x[k + 1 :]]) for k in range(1, len(x) - 1)]
        inside = lambda y, x=x: any(y[i : i + len(x) - 1] == x[1:] for i in range(1, len(y)))
        if not any(y[0] == x[0] and len(y) > len(x) and inside(y) and 100 * b >= 80 * a for y, b in found.items()):
            best[x] = min(cuts)
    out = []
    for lang in n:
        order = sorted((-s, -found[x], " ".join(x[1:]).encode(), x) for x, (s, *_) in best.items() if x[0] == lang)
        for rank, (s, a, phrase, x) in enumerate(order[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, best[x][2], best[x][3], n[lang], -s))
    return sorted(out)


def corpus(seed, n=120):
    r = random.Random(seed)
    words = ["the", "The", "of", "new", "York", "city", "é", "ÉTÉ", "a-b", "x" * 300, " ", "ß", "1"]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(r.randint(0, 60)):
            text += r.choice(["new york city hall", "of the", *words]) + r.choice([" ", " ", "  ", "\t", " ", ". ", ", ", "!", "\n", " \r\n ", "\x0b"])
        rows.append((r.choice(["en", "en", "de", None]), text))
    return [*rows, ("en", None), (None, ""), ("fr", " . , "), ("en", rows[3][1]), ("en", rows[3][1]), ("de", "la la la la la la la la " * 30)]


@pytest.mark.parametrize(("shard", "batch"), [(1 << 20, 1 << 17), (40, 16), (7, 4)])
def test_against_brute_force(spark, monkeypatch, shard, batch):
    """Whatever the shards: phrases over their ends count once, overlaps count, pieces and texts end phrases."""
    rows = corpus(shard)
    monkeypatch.setattr(collocations, "SHARD", shard)
    monkeypatch.setattr(collocations, "BATCH", batch)
    cloudpickle.register_pickle_by_value(collocations)
    try:
        df = spark.createDataFrame([(*x, "p") for x in rows], "lang string, text string, phrase string").repartition(3)
        got = sorted(map(tuple, collocations.mine(df, top=40, least=6).collect()))
    finally:
        cloudpickle.unregister_pickle_by_value(collocations)
    assert got == brute(rows, 6, 4, 40)
    assert len(got) > 40


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 50)
    stream = collocations._Stream()
    text = b"one two, three" + b" " * 400 + b"four five" + b" ." * 200 + b" six " + b"y" * 2000 + b" seven"
    for _ in range(3):
        stream.add(text)
    [(own, at, places, vocabulary)] = stream.shards(3, last=True)
    said = [None if p < 0 else vocabulary[int(p)].as_py() for p in places]
    once = [None, "one", "two", None, "three", "four", "five", None, "six", "y" * 2000, "seven"]
    assert said == once * 3 and own == 24 and at == len(places)


def test_bitmaps():
    r = random.Random(3)
    places = np.array([r.choice([-1, 0, 1, 2, 3]) for _ in range(500)], np.int32)
    bitmaps = collocations.Bitmaps(places, 300, 4)
    levels = list(bitmaps.batches())
    assert len(levels) == 1
    level = levels[0]
    for k in range(1, 5):
        count = collocations.popcounts(len(level[0]), level[1], level[3])
        want = Counter(tuple(places[i : i + k].tolist()) for i in range(300) if i + k <= 500 and (places[i : i + k] >= 0).all())
        assert {tuple(p): int(c) for p, c in zip(level[0].tolist(), count, strict=True)} == want
        level = bitmaps.extend(*level)


def test_filter(spark):
    h = [0, 1, -1, 2**31 - 1, -(2**31), 524_287, 524_288, -1234567]
    bits = collocations._filter_of(spark.createDataFrame([(x,) for x in h], "h int"))
    assert collocations._passes(bits, np.array(h, np.int32).view(np.uint32).astype(np.uint64)).all()
    assert np.unpackbits(bits).sum() == len({x % collocations.FILTER for x in h})
    other = np.random.default_rng(1).integers(0, 2**32, 100_000).astype(np.uint64)
    assert collocations._passes(bits, other).sum() < 3


def test_score_is_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    rows = [("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 7), ("en", "b c", 2, 3), ("en", "c", 1, 5), ("en", "a b c", 3, 3)]
    freq = collocations.keep(spark.createDataFrame(rows, "lang string, phrase string, size int, f long"))
    got = {r.phrase: r for r in collocations.scored(freq).collect()}
    assert got["a b"].score == 2_000_000 * (big - 7) // (big + big - 1)
    assert (got["a b c"].score, got["a b c"].k, got["a b c"].l) == (0, 1, big)
    kept = collocations.uncovered(collocations.keep(collocations.scored(freq)))
    assert sorted(r.phrase for r in kept.collect()) == ["a b", "a b c"]


def test_empty_and_rare(spark):
    for rows in ([], [("en", "so it goes"), (None, None)]):
        df = spark.createDataFrame(rows, "lang string, text string")
        assert collocations.mine(df).count() == 0


def test_query_against_sql(spark, tmp_path):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(corpus(9, 900))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert compare(spark, str(tmp_path), queries.QUERIES["op11_phrase_collocations"], queries.ORACLE["op11_phrase_collocations"]) == ""
