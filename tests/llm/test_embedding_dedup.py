from collections import Counter

import numpy as np
import pytest

from terrasift.llm import embedding_dedup


def brute(rows, t=0.95):
    ids, good = [i for i, _ in rows], {}
    for k, (_, v) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v, np.float32).astype(float)
            good[k] = x / np.linalg.norm(x)
    link = {k: {j for j in good if j != k and len(good[j]) == len(good[k]) and good[k] @ good[j] >= t} for k in good}
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for j in link.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((ids[j] for j in seen if ids[j] is not None), default=None)
        out.append((ids[k], len(link.get(k, ())), low, low == ids[k]))
    return out


ORDER = lambda xs: sorted(xs, key=lambda x: tuple((y is None, y) for y in x))


def rows_of(seed, groups, dim=16):
    r = np.random.default_rng(seed)
    rows = [(1, None), (2, []), (3, [0.0] * dim), (4, [1.0] * (dim - 1) + [None]), (5, [float("nan")] + [1.0] * (dim - 1)), (6, [float("inf")] + [1.0] * (dim - 1)), (7, [1.0, 2.0]), (8, [1.0, 2.01])]
    for g in range(groups):
        base = r.standard_normal(dim)
        for k in range(int(r.integers(1, 25))):
            rows.append((100 + 997 * (g * 30 + k) % 4001, (base + r.standard_normal(dim) * r.choice([0, 0.02, 0.05, 0.2])).astype(np.float32).tolist()))
    return [*rows, (rows[20][0], rows[20][1]), (None, rows[21][1])]


@pytest.mark.parametrize("leaf", [384, 8])
def test_against_brute_force(spark, monkeypatch, leaf):
    """With the query's own trees; leaves of eight vectors in 16 dimensions are far harder than the query's."""
    monkeypatch.setattr(embedding_dedup, "LEAF", leaf)
    rows = rows_of(3, 14)
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, n_links int").repartition(4)
    got, want = [tuple(x) for x in embedding_dedup.near_duplicates(df).collect()], brute(rows)
    assert ORDER(x[0:1] for x in got) == ORDER(x[0:1] for x in want)
    if leaf == 384:
        assert ORDER(got) == ORDER(want)
    most = Counter()
    for i, n, _, _ in want:
        most[i] = max(most[i], n)
    assert all(n <= most[i] for i, n, _, _ in got)
    assert sum(x[1] for x in got) >= 0.95 * sum(x[1] for x in want)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_one_large_group_of_near_copies(spark, monkeypatch, kind):
    """A quarter of the vectors about one direction: no split may cut it, and it is compared in blocks and tiles."""
    for name, n in (("LEAF", 32), ("BLOCK", 40), ("TILE", 16)):
        monkeypatch.setattr(embedding_dedup, name, n)
    r = np.random.default_rng(5)
    base = r.standard_normal(32)
    x = np.concatenate((r.standard_normal((600, 32)), base + r.standard_normal((200, 32)) * 0.17 * np.linalg.norm(base) / np.sqrt(32))).astype(np.float32)
    rows = [(int(i), x[k].tolist()) for k, i in enumerate(r.permutation(len(x)))]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    got, want = ORDER(map(tuple, embedding_dedup.near_duplicates(df).collect())), ORDER(brute(rows))
    assert sum(w[1] for w in want) > 20_000
    assert got == want


def test_leaf_links_by_tiles(monkeypatch):
    r = np.random.default_rng(7)
    x = r.standard_normal((90, 8)) + 2.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    weight = r.integers(1, 9, 90)
    earlier = [np.sort(r.choice(40, r.integers(0, 4), replace=False)) for _ in x]
    start = np.concatenate(([0], np.cumsum([len(e) for e in earlier])))
    for tile, split in ((7, 0), (7, 33), (512, 0)):
        monkeypatch.setattr(embedding_dedup, "TILE", tile)
        gained, root = embedding_dedup.leaf_links(weight, x, np.concatenate(earlier), start, split, 0.9)
        pairs = [(i, j) for i in range(90) for j in range(i + 1, 90) if x[i] @ x[j] >= 0.9 and (not split or i < split <= j)]
        want = np.zeros(90, int)
        for i, j in pairs:
            if not set(earlier[i]) & set(earlier[j]):
                want[i] += weight[j]
                want[j] += weight[i]
        assert gained.tolist() == want.tolist()
        low = list(range(90))
        for _ in range(90):
            for i, j in pairs:
                low[i] = low[j] = min(low[i], low[j])
        assert root.tolist() == low


def test_empty_table(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def _unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("rows", [20_000, 1_000_000, 100_000_000])
def test_recall_of_isolated_pairs_and_of_a_dense_group(rows):
    """The query's trees, fitted on a sample of far fewer vectors than they are made for: pairs just above the threshold among
    others, and a quarter of all vectors about one direction. Routing is level by level and takes a moment at any size."""
    r = np.random.default_rng(rows)
    x = _unit(r.standard_normal((20_000, 64)))

    def near(base, cos):
        z = r.standard_normal(base.shape)
        z = _unit(z - (z * base).sum(1, keepdims=True) * base)
        return cos * base + np.sqrt(1 - cos * cos) * z

    x[300:600] = near(x[:300], 0.952)
    x[1000:6000] = near(np.repeat(x[999:1000], 5000, 0), np.sqrt(0.97))
    forest = embedding_dedup.Forest(x[r.choice(len(x), 8000, replace=False)], rows, 0.95)
    row, leaf = forest.leaves(x[:2000])
    leaves = [set() for _ in range(2000)]
    for i, k in zip(row.tolist(), leaf.tolist(), strict=True):
        leaves[i].add(k)
    assert np.mean([bool(leaves[i] & leaves[300 + i]) for i in range(300)]) >= 0.99
    i, j = r.integers(1000, 2000, (2, 5000))
    ok = (x[i] * x[j]).sum(1) >= 0.95
    assert ok.sum() > 2000 and np.mean([bool(leaves[a] & leaves[b]) for a, b in zip(i[ok], j[ok], strict=True)]) >= 0.99
    assert sum(v.nbytes for f in forest.fitted for v in f.values()) < 4 << 20
    # Each row has a path in each tree, and no leaf twice.
    assert all(len({k >> 56 for k in own}) == embedding_dedup.TREES for own in leaves) and len(row) == sum(map(len, leaves))
