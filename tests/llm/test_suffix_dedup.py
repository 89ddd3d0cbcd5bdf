import random
import re
from collections import defaultdict

import pytest
from pyspark import cloudpickle

from terrasift.llm import suffix_dedup


def brute(texts, length):
    seen = defaultdict(list)
    for i, t in enumerate(texts):
        for a in range(len(t) - length + 1):
            seen[t[a : a + length]].append((i, a))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, a in places:
                gone[i][a : a + length] = b"\1" * length
    return [bytes(c for c, g in zip(t, gs, strict=True) if not g) for t, gs in zip(texts, gone, strict=True)]


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    body = lambda n: " ".join(word() for _ in range(n))
    shared = [body(40) for _ in range(3)]
    texts = ["", None, "a" * 700, "ab" * 300, body(30)]
    for _ in range(14):
        base = body(r.randint(5, 120))
        for _ in range(r.randint(0, 2)):
            p = r.choice(shared)
            a = r.randint(0, 30)
            base = base[: len(base) // 2] + p[a : r.randint(a, len(p))] + base[len(base) // 2 :]
        texts.append(base)
    texts += [texts[7], texts[7], texts[8][:200] + "Z" + texts[8][200:]]
    return texts


@pytest.mark.parametrize("length", [64, 100])
def test_against_brute_force(spark, length):
    texts = corpus(length)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: bytes(r.kept_text) for r in suffix_dedup.dedup(df, length).collect()}
    want = brute([(t or "").encode() for t in texts], length)
    assert [got[i] for i in range(len(texts))] == want


def test_long_texts_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 900)
    texts = corpus(5) + [" ".join(map(str, range(900))), " ".join(map(str, range(300, 800)))]
    raw = suffix_dedup.BYTES.sequences([(t or "").encode() for t in texts])
    anchors = suffix_dedup.anchors_of(raw, 64)
    for i, t in enumerate(raw):
        starts = sorted(s for r, p, lo, hi in zip(*(anchors[c] for c in ("row", "pos", "jlo", "jhi")), strict=True) if r == i for s in range(p - hi, p - lo + 1))
        assert starts == list(range(len(t) - 63))


@pytest.mark.parametrize("length", [64, 100])
def test_long_texts_against_brute_force(spark, monkeypatch, length):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 900)
    long = " ".join(map(str, range(900)))
    texts = [*corpus(length), long, " ".join(map(str, range(2000, 2700))) + long[1000:1500], " ".join(map(str, range(5000, 5500)))]
    texts += [texts[-1]]
    cloudpickle.register_pickle_by_value(suffix_dedup)  # so that the workers have this CHUNK
    try:
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: bytes(r.kept_text) for r in suffix_dedup.dedup(df, length).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(suffix_dedup)
    assert [got[i] for i in range(len(texts))] == brute([(t or "").encode() for t in texts], length)
    for t in texts[-4:]:
        c = suffix_dedup.anchors_of(suffix_dedup.BYTES.sequences([t.encode()]), length)
        assert len(set(c["pos"])) == len(c["pos"])


def brute_shared(rows, n):
    """Words of each row in windows of n words that a row of another key or text has too."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    seen = defaultdict(set)
    for i, w in enumerate(words):
        for a in range(len(w) - n + 1):
            seen[tuple(w[a : a + n])].add(rows[i])
    out = []
    for w in words:
        gone = set()
        for a in range(len(w) - n + 1):
            if len(seen[tuple(w[a : a + n])]) > 1:
                gone.update(range(a, a + n))
        out.append(len(gone))
    return out


@pytest.mark.parametrize(("n", "chunk"), [(16, 1 << 19), (50, 1 << 19), (50, 150)])
def test_shared_words_against_brute_force(spark, monkeypatch, n, chunk):
    """Passages that documents share count, repeats within one document don't; case and white space make no difference."""
    r = random.Random(n)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 3)))
    body = lambda k: " ".join(word() for _ in range(k))
    passages = [body(k) for k in (15, 16, 17, 49, 50, 51, 90)]
    rows = [(i, " ".join([body(r.randint(0, 60)), *r.choices(passages, k=r.randint(0, 3)), body(r.randint(0, 60))])) for i in range(60)]
    own = body(60)
    rows += [(100, f"{own} {own} {own}"), (101, rows[3][1].upper().replace(" ", "\n ")), (102, None), (103, ""), (104, body(2000) + " " + passages[-1] + " " + body(500)), (105, "x " * 300), (106, "x " * 200)]
    rows += [rows[5], rows[100 - 40][:1] + ("other text",)]
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    cloudpickle.register_pickle_by_value(suffix_dedup)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((r.doc_id, r.n_shared_words, r.n_bytes) for r in suffix_dedup.dedup(df, words=n).collect())
    finally:
        cloudpickle.unregister_pickle_by_value(suffix_dedup)
    assert got == sorted((k, c, len((t or "").encode())) for (k, t), c in zip(rows, brute_shared(rows, n), strict=True))
    assert 0 < sum(c > 0 for _, c, _ in got) < len(got)


def test_empty_table_and_null_key(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.dedup(empty).count() == 0
    df = spark.createDataFrame([(None, "q" * 500), (None, "q" * 500), (3, None)], "doc_id long, text string")
    assert sorted(r.n_bytes - len(r.kept_text) for r in suffix_dedup.dedup(df).collect()) == [0, 500, 500]
