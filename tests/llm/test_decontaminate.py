import hashlib
import random
import re

import pytest

from terrasift.llm import decontaminate


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, n=13):
    out = {}
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for k, x in items:
            v = words(x)
            m = min(n, len(v))
            for p in range(len(v) - m + 1 if v else 0):
                for s in range(len(w) - m + 1):
                    if w[s : s + m] == v[p : p + m]:
                        hit.update(range(s, s + m))
                        ids.add(str(k))
        out[d] = (len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w))
    return out


def tables(spark):
    r = random.Random(2)
    vocab = ["Uno", "due", "três", "4x", "fünf", "six", "SEVEN"]
    body = lambda n: r.choice([" ", ", ", "-"]).join(r.choices(vocab, k=n))
    items = [(k, body(r.choice([0, 3, 12, 13, 14, 30]))) for k in range(12)] + [(50, None), (7, "six six"), (51, "!!")]
    docs = [(0, None), (1, ""), (2, "...")]
    for d in range(3, 60):
        t = body(r.randint(1, 80))
        if d % 3 == 0:
            t += " " + (r.choice(items)[1] or "") + " " + body(9)
        docs.append((d, t))
    return docs, items


@pytest.mark.parametrize("limit", [None, 150, 60])
def test_against_brute_force(spark, monkeypatch, limit):
    docs, items = tables(spark)
    if limit:
        monkeypatch.setattr(decontaminate, "MAX_BYTES", limit)
        assert sum(len((t or "").encode()) for _, t in items) / limit > 3
    d = spark.createDataFrame([(*x, "z", 1) for x in docs], "doc_id long, text string, hits string, contamination int").drop("contamination")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.contamination.n_words, r.contamination.n_hit, r.contamination["items"], r.contamination.contaminated) for r in decontaminate.find_hits(d, b).collect()}
    assert got == brute(docs, items)


def test_spans_documents_and_empty_tables(spark):
    b = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(20)))], "item_id long, text string")
    d = spark.createDataFrame([(1, "Keep, " + " ".join(f"T{i}" for i in range(15)) + " end"), (2, "t1 t2"), (3, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.remove(d, b).collect()) == [2, 3]
    assert {r.doc_id: r.text for r in decontaminate.remove(d, b, spans=True).collect()} == {1: "Keep,  end", 2: "t1 t2", 3: None}
    assert decontaminate.remove(d, b.limit(0)).count() == 3
    assert decontaminate.remove(d.limit(0), b).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_the_set_is_small():
    """What goes to the tasks is bounded by what is built: at most 2,000,000 windows are below 150 MB."""
    r = random.Random(1)
    items = [(k, " ".join(f"{r.randrange(10**6):x}" for _ in range(1000)).encode()) for k in range(100)]
    made = decontaminate.WindowSet(items, 13)
    windows = sum(map(len, made.keys.values()))
    assert windows == 100 * 988
    fixed = sum(x.nbytes for x in made.bits.values())
    assert fixed + (made.nbytes() - fixed) / windows * decontaminate.MAX_WINDOWS < 150 << 20
    assert made.scan([items[7][1].upper(), b"", items[3][1][:30]])[0][2] == ["7"]


def test_clashing_names(spark):
    b = spark.createDataFrame([("k", "a b c d e f g h i j k l m", "x")], "item_id string, text string, hits string")
    d = spark.createDataFrame([(1, "a b c d e f g h i j k l m", "r", "h", 5)], "doc_id long, text string, row string, hits string, items int")
    [r] = decontaminate.find_hits(d, b).collect()
    assert (r.row, r.hits, r["items"], r.contamination.n_hit, r.contamination["items"]) == ("r", "h", 5, 13, ["k"])
