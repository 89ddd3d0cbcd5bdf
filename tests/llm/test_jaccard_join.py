import random
import re

import numpy as np
import pytest

from terrasift.llm import components as components_module
from terrasift.llm import jaccard_join
from terrasift.llm.components import components
from terrasift.llm.store import join_roots


def brute(rows, words=5, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(words, len(w))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=150):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    line = r.choices(vocab, k=20)
    bases = [r.choices(vocab, k=r.randint(3, 90)) for _ in range(6)]
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "A b"), (1004, "a  B"), (1005, "one")]
    for i in range(n):
        b = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            b[r.randrange(len(b))] = r.choice(vocab)
        if r.random() < 0.4:
            b = b[: len(b) // 2] + line + b[len(b) // 2 :]
        rows.append((i * 3 % 997, " ".join(b)))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(jaccard_join, "BLOCK", 6)
        monkeypatch.setattr(jaccard_join, "LONG", 4)
    rows = corpus(3)
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, component_id int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_components(df).collect()}
    assert got == brute(rows)


def test_merge_lists():
    r = random.Random(1)
    for _ in range(200):
        lists = [sorted(r.sample(range(30), r.randint(0, 20))) for _ in range(r.randint(1, 9))]
        owners, spans = [], []
        for x in lists:
            spans.append((len(owners), len(owners) + len(x)))
            owners += x
        for least in range(1, 6):
            want = [(d, n) for d in range(30) if (n := sum(d in x for x in lists)) >= least]
            assert jaccard_join.merge_lists(owners, spans, least) == want


@pytest.mark.parametrize("few", [0, 8])
def test_block_links_span_the_same_components(monkeypatch, few):
    monkeypatch.setattr(jaccard_join, "FEW", few)
    r = np.random.default_rng(4)
    for shift in range(12):
        base = [np.unique(r.integers(0, 10**6, r.integers(1, 60)).astype(np.uint64)) for _ in range(5)]
        docs = [np.unique(np.concatenate((b[r.random(len(b)) > 0.07], r.integers(0, 10**6, r.integers(0, 4)).astype(np.uint64)))) for b in (base[k] for k in r.integers(0, 5, 60))]
        docs += [np.zeros(0, np.uint64)]
        for split in (None, 20):
            left, right = (docs, None) if split is None else (docs[:split], docs[split:])
            found = jaccard_join.block_links(left, right, 80)
            link = lambda i, j: len(docs[i]) and len(docs[j]) and 100 * len(np.intersect1d(docs[i], docs[j])) >= 80 * len(np.union1d(docs[i], docs[j]))
            pairs = [(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if (split is None or i < split <= j) and link(i, j)]
            assert all(link(i, j) for i, j in found)
            assert len(set(found)) == len(found) < len(docs)
            ends = [np.array(x).reshape(-1, 2).T for x in (found, pairs)]
            assert [join_roots(np.arange(len(docs)), *e).tolist() for e in ends][0] == join_roots(np.arange(len(docs)), *ends[1]).tolist()


def test_blocks_in_which_parity_rules_all_out_build_no_lists(monkeypatch):
    """Unlike documents with one long passage: few shingles short of a link, and none is merged or probed."""
    r = np.random.default_rng(6)
    draw = lambda n: r.integers(0, 2**64, n, dtype=np.uint64)
    passage = draw(300)
    docs = [np.unique(np.concatenate((passage, draw(300)))) for _ in range(40)]
    monkeypatch.setattr(jaccard_join, "merge_lists", None)
    monkeypatch.setattr(jaccard_join, "_links", None)
    assert jaccard_join.block_links(docs, None, 80) == jaccard_join.block_links(docs[:20], docs[20:], 80) == []


def test_a_group_in_which_nothing_links(spark, monkeypatch):
    """A passage that makes up most of many unlike texts chains them; neither sizes nor parity part all of them."""
    for name, n in (("BLOCK", 6), ("LONG", 4), ("WIDE", 8)):
        monkeypatch.setattr(jaccard_join, name, n)
    r = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join(passage + [f"x{i}.{k}" for k in range(r.randint(11, 30))])) for i in range(120)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 120, 10)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = brute(rows)
    assert got == want and len({c for _, c in want.values()}) > 80


def test_a_full_sketch_tells_what_many_share(spark, monkeypatch):
    """Some 350 shingles fall on a counter by chance; a passage of 100 documents is still not what is posted."""
    monkeypatch.setattr(jaccard_join, "SKETCH", 1 << 10)
    seen, refine = [], jaccard_join._refine
    monkeypatch.setattr(jaccard_join, "_refine", lambda chained, *a: (seen.append(chained.count()), refine(chained, *a))[1])
    r = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"x{r.random()}" for _ in range(900)] + passage * (i % 4 == 0))) for i in range(400)]
    rows += [(1000, rows[0][1] + " end")]
    monkeypatch.setattr(jaccard_join, "PER_COUNTER", 1 << 30, raising=False)
    got = {r.doc_id: r.component_id for r in jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: 0 if i == 1000 else i for i, _ in rows}
    assert seen == [0]


@pytest.mark.parametrize(("per", "counters"), [(1500, 1 << 10), (1, 1 << 12), (10, 1 << 11)])
def test_the_sketch_grows_with_the_texts_within_bounds(spark, monkeypatch, per, counters):
    for name, n in (("SKETCH", 1 << 10), ("PER_COUNTER", per), ("MOST", 1 << 12)):
        monkeypatch.setattr(jaccard_join, name, n)
    docs = spark.createDataFrame([(i, "a b c d e " + "x" * 1990) for i in range(8)] + [(9, None)], "doc_id long, text string")
    found = jaccard_join._sketch(docs, 5)
    assert len(found) == counters and sorted(set(found.tolist())) == [0, 6000]


def test_empty_and_repeated(spark):
    assert jaccard_join.link_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, "a B c d e  f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in jaccard_join.link_components(df).collect()) == [(0, 5), (5, 5), (5, 5), (7, 5)]


@pytest.mark.parametrize("small", [0, 500_000])
def test_components_of_a_chain_and_a_star(spark, monkeypatch, small):
    monkeypatch.setattr(components_module, "SMALL", small)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, k) for k in range(501, 560)] + [(3, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 500 for i in range(500, 560)}


def test_no_stage_of_the_sketch_has_two_python_nodes(spark, monkeypatch):
    # Each more node in a stage is one more worker a core, and workers stay in an executor's memory.
    df, plans = spark.createDataFrame(corpus(5, 20), "doc_id long, text string"), []
    collect = type(df).collect

    def seen(self):
        plans.append(re.findall(r"Exchange|\w+InArrow|\w+InPandas", self._jdf.queryExecution().executedPlan().toString()))
        return collect(self)

    monkeypatch.setattr(type(df), "collect", seen)
    levels = jaccard_join._sketch(df, 5)
    assert levels.any() and any("MapInArrow" in p for p in plans)
    assert all("Exchange" in pair for p in plans for pair in zip(p, p[1:], strict=False))
