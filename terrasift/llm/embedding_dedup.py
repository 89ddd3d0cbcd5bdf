"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits by random directions. Vectors within half a window of a split go both ways (spill): the window is as wide
as vectors at the threshold lie apart along a random direction, so near pairs seldom part; a pair is missed only if all
trees part it. Within a leaf all pairs are compared by cosine in double precision, so no link below the threshold is made.

Fitted once, on a bounded sample: at most ``SAMPLE`` vectors choose directions and split points; a node that the sample
leaves with few points splits all below it by these, so trees may be as deep as the number of rows asks for. Every
row is indexed. Of a few directions and all split points in the middle, a node takes those that leave the least to
compare, so splits run around dense groups. Where none leaves much less than the node itself, its points are mostly within
the threshold of each other: it stays whole as one large leaf, which is compared in pairs of blocks.

Equal vectors are one from the start. A pair is counted only in the first leaf that both are in, so links are counted
without listing pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasift.llm.components import components
from terrasift.llm.store import drop, join_roots, keep, sized, small_batches, tables_by_key

SAMPLE, LEAF, TREES, FEW, TRIES = 10_000, 384, 5, 32, 3
#: Rows in a block of a large leaf, and in a tile of a comparison.
BLOCK, TILE = 4096, 512
#: Share of the node's pairs that its halves may still hold; beyond it the node is not split.
STOP = 0.85
#: Bits of a leaf's number below its tree's.
_PATH = 56


class Forest:
    """Trees over unit vectors; leaves are numbered by tree and path, uniquely over trees.

    All nodes of a tree that lie equally deep choose among the same TRIES random directions, so rows are routed by one matrix
    product a tree and then level by level. Nodes are fitted once and kept as arrays: a direction's number, a split point and
    two children. Below a node with few points of the sample all nodes of a level are alike: a chain has one entry a level.
    """

    def __init__(self, sample: np.ndarray, rows: int, threshold: float, trees: int = TREES):
        self.dim, self.trees, self.leaf = sample.shape[1], trees, LEAF
        self.half = math.sqrt(max(0.0, 2 - 2 * threshold) / max(1, self.dim)) / 2
        self.fitted = [self._fit(sample, tree, float(rows)) for tree in range(trees)]

    def directions(self, tree: int, level: int) -> np.ndarray:
        w = np.random.default_rng((tree, level)).standard_normal((self.dim, TRIES))
        return w / np.linalg.norm(w, axis=0)

    def _split(self, along: np.ndarray):
        """(direction, split point, share of either side) of points' places along the directions, or None if they stay together."""
        best = None
        for k in range(along.shape[1]):
            order = np.sort(along[:, k])
            at = order[int(0.3 * len(order)) : int(0.7 * len(order)) + 1]
            left = np.searchsorted(order, at + self.half, "left") / len(order)
            right = 1 - np.searchsorted(order, at - self.half, "left") / len(order)
            cost = left**2 + right**2
            i = int(np.argmin(cost))
            if best is None or cost[i] < best[0]:
                best = (cost[i], k, at[i], left[i], right[i])
        return None if best[0] > STOP else best[1:]

    def _fit(self, sample: np.ndarray, tree: int, rows: float) -> dict[str, np.ndarray]:
        """Nodes (what, cut, left, right) and chains; a child is the number of a node, -1 for a leaf, or -2 - the number of a chain."""
        along: list[np.ndarray] = []
        what, cut, children, chains, links = [], [], [], [], []

        def level_of(n: int) -> np.ndarray:
            while len(along) <= n:
                along.append(sample @ self.directions(tree, len(along)))
            return along[n]

        def chain(points: np.ndarray, rows: float, level: int) -> int:
            chains.append((level, len(links), rows))
            while rows > self.leaf and level < _PATH - 1 and (got := self._split(level_of(level)[points])):
                links.append(got)
                rows, level = rows * max(got[2:]), level + 1
            return -1 - len(chains)

        def node(points: np.ndarray, rows: float, level: int) -> int:
            if rows <= self.leaf or level >= _PATH - 1:
                return -1
            if len(points) < 2 * FEW:
                return chain(points, rows, level)
            got = self._split(level_of(level)[points])
            if got is None:
                return -1
            k, at, left, right = got
            own = level_of(level)[points, k]
            what.append(k)
            cut.append(at)
            children.append([0, 0])
            todo.append((len(what) - 1, level + 1, (points[own < at + self.half], points[own >= at - self.half]), (rows * left, rows * right)))
            return len(what) - 1

        todo: list = []
        root = node(np.arange(len(sample)), rows, 0)
        while todo:
            number, level, points, sizes = todo.pop()
            for side in (0, 1):
                children[number][side] = node(points[side], sizes[side], level)
        columns = lambda x, n: np.array(x, float).reshape(-1, n)
        return {"root": np.array([root]), "levels": np.array([len(along)]), "what": np.array(what, int), "cut": np.array(cut, float), "children": np.array(children, int).reshape(-1, 2), "chains": np.append(columns(chains, 3), [[0, len(links), 0]], 0), "links": columns(links, 4)}

    def leaves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that the rows are in."""
        rows, leaves = [np.zeros(0, int)], [np.zeros(0, int)]
        for tree, f in enumerate(self.fitted):
            levels = int(f["levels"][0])
            along = unit @ np.concatenate([self.directions(tree, n) for n in range(levels)] or [np.zeros((self.dim, 0))], 1)
            row, path, at = np.arange(len(unit)), np.ones(len(unit), int), np.full(len(unit), f["root"][0])
            size = np.zeros(len(unit))
            chain, links = f["chains"], f["links"]
            for level in range(levels + 1):
                inside = at <= -2
                own = -2 - at[inside]
                fresh = chain[own, 0] == level
                size[inside] = np.where(fresh, chain[own, 2], size[inside])
                link = (chain[own, 1] + level - chain[own, 0]).astype(int)
                ended = (size[inside] <= self.leaf) | (link >= chain[own + 1, 1])
                done = at == -1
                done[np.flatnonzero(inside)[ended]] = True
                rows.append(row[done])
                leaves.append(tree << _PATH | path[done])
                go = ~done
                if not go.any():
                    break
                row, path, at, size = row[go], path[go], at[go], size[go]
                inside, link = at <= -2, link[~ended]
                k, cut, child, shares = np.zeros(len(at), int), np.zeros(len(at)), np.zeros((len(at), 2), int), np.ones((len(at), 2))
                k[~inside], cut[~inside], child[~inside] = f["what"][at[~inside]], f["cut"][at[~inside]], f["children"][at[~inside]]
                k[inside], cut[inside], shares[inside], child[inside] = links[link, 0].astype(int), links[link, 1], links[link, 2:], at[inside][:, None]
                place = along[row, level * TRIES + k]
                sides = (place < cut + self.half, place >= cut - self.half)
                row, path, at, size = (np.concatenate(x) for x in ([row[s] for s in sides], [path[s] * 2 + bit for bit, s in enumerate(sides)], [child[s, bit] for bit, s in enumerate(sides)], [(size * shares[:, bit])[s] for bit, s in enumerate(sides)]))
        return np.concatenate(rows), np.concatenate(leaves)


def _unit(flat: np.ndarray, rows: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(rows, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _together(flat: np.ndarray, start: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and rows j (a matrix) have a number in common; those of row k are flat[start[k]:start[k + 1]]."""
    sides = []
    for rows in (i, j):
        n = start[rows + 1] - start[rows]
        at = np.repeat(start[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        sides.append((np.repeat(np.arange(len(rows)), n), flat[at]))
    common = np.intersect1d(sides[0][1], sides[1][1])
    out = []
    for (row, code), rows in zip(sides, (i, j), strict=True):
        k = np.searchsorted(common, code)
        ok = k < len(common)
        ok[ok] = common[k[ok]] == code[ok]
        has = np.zeros((len(rows), len(common)), np.float32)
        has[row[ok], k[ok]] = 1
        out.append(has)
    return out[0] @ out[1].T > 0


def leaf_links(weight: np.ndarray, unit: np.ndarray, flat: np.ndarray, start: np.ndarray, split: int, threshold: float):
    """Of the pairs within the rows (or, with split > 0, of rows before split with rows from it on): for each row the
    weight of the rows linked to it first here, and the place of the least row that it reaches.

    flat and start: the earlier leaves of each row, as in _together."""
    n = len(weight)
    gained, root, heavy = np.zeros(n), np.arange(n), weight.astype(np.float64)
    for a in range(0, split or n, TILE):
        a2 = min(a + TILE, split or n)
        for b in range(split or a, n, TILE):
            b2 = min(b + TILE, n)
            linked = unit[a:a2] @ unit[b:b2].T >= threshold
            if a == b:
                linked = np.triu(linked, 1)
            i, j = np.nonzero(linked)
            if not len(i):
                continue
            apart = root[a + i] != root[b + j]
            root = join_roots(root, a + i[apart], b + j[apart])
            i, j = np.unique(i), np.unique(j)
            new = (linked[np.ix_(i, j)] & ~_together(flat, start, a + i, b + j)).astype(np.float64)
            gained[a + i] += new @ heavy[b + j]
            gained[b + j] += heavy[a + i] @ new
    return gained.astype(np.int64), root


def near_duplicates(embeddings: DataFrame, threshold: float = 0.95, vector: str = "embedding", key: str = "vec_id", trees: int = TREES) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id (least vec_id reachable), kept.

    Vectors that are null, zero, empty, or hold null or non-finite components link with nothing; vectors of different
    lengths don't link. Repeated rows are vectors of their own and link with each other. A null vec_id is never the least;
    its component is null if it stands alone. Labels and other columns are not read. An empty table gives an empty result.
    """
    small_batches(embeddings)
    kind = embeddings.schema[vector].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = F.col(f"`{vector}`").cast("array<float>" if single else "array<double>")
    bad = F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0), F.lit(True))
    rows = embeddings.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v"), bad.alias("bad"))
    rows = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(7), "v"))
    good = rows.filter(~F.col("bad"))
    classes = keep(good.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.min("v").alias("v")).withColumn("dim", F.size("v")))
    dims = [(r.dim, r.n) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).limit(65).collect()]
    if len(dims) > 64:
        raise ValueError("vectors of more than 64 lengths")
    found = None
    for dim, n in dims:
        part = _links_of(classes.filter(F.col("dim") == dim).select(F.col("h1").alias("c"), "weight", "v"), n, threshold, trees, np.float32 if single else np.float64)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = classes.select(F.col("h1").alias("c"), F.lit(0).cast("long").alias("gained"), F.col("h1").alias("root"))
    found = keep(found)
    links = found.groupBy("c").agg(F.sum("gained").alias("gained"))
    linked = components(found.select(F.col("c").alias("u"), F.col("root").alias("v")))
    told = classes.select("h1", "h2", "id", "weight").join(links.withColumnRenamed("c", "h1"), "h1", "left").join(linked.withColumnsRenamed({"id": "h1"}), "h1", "left")
    told = keep(told.select("h1", "h2", "id", (F.coalesce("gained", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "h1").alias("component")))
    named = keep(told.filter("n_links > 0").join(told.groupBy("component").agg(F.min("id").alias("component_id")), "component").select("h1", "h2", "n_links", "component_id"))
    own = rows.select("vec_id", F.when(~F.col("bad"), F.col("h1")).alias("h1"), F.when(~F.col("bad"), F.col("h2")).alias("h2"))
    out = own.join(sized(named), ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links_of(classes: DataFrame, n: int, threshold: float, trees: int, kind: type) -> DataFrame:
    """(c, gained, root) of classes (c, weight, v) of one vector length: links first counted in some leaf, and an edge."""
    spark = classes.sparkSession
    share = min(1.0, 0.8 * SAMPLE / max(n, 1))
    picked = classes.filter(F.pmod(F.xxhash64(F.lit(3), "c"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("c").limit(SAMPLE).select("v").collect()
    sample = np.array([r.v for r in picked] or [classes.first().v], np.float64)
    forest = spark.sparkContext.broadcast(Forest(_unit(sample, len(sample)), n, threshold, trees))

    def route(batches):
        for batch in batches:
            for x in range(0, batch.num_rows, 4096):
                b = batch.slice(x, 4096)
                flat = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(kind)
                row, leaf = forest.value.leaves(_unit(flat, b.num_rows))
                order = np.argsort(row, kind="stable")
                ends = np.cumsum(np.bincount(row, minlength=b.num_rows))
                leaves = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(leaf[order]))
                raw = [x.tobytes() for x in flat.reshape(b.num_rows, -1)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary()), leaves], names=["c", "weight", "v", "leaves"])

    routed = keep(classes.mapInArrow(route, "c bigint, weight bigint, v binary, leaves array<bigint>"))
    # Only leaves that are compared in blocks; there is at most one in so many rows and trees.
    large = keep(routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * BLOCK))
    m = routed.select("c", "weight", "v", "leaves", F.explode("leaves").alias("leaf")).join(sized(large), "leaf", "left")
    m = m.withColumn("blocks", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")).withColumn("k", F.pmod(F.xxhash64(F.lit(5), "c"), F.col("blocks")).cast("int"))
    m = m.withColumn("k2", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    earlier = F.filter("leaves", lambda x: x < F.col("leaf"))
    m = m.select("leaf", F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b"), (F.col("k") > F.col("k2")).alias("late"), "c", "weight", "v", earlier.alias("earlier"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = m.repartition(parts, "leaf", "a", "b").sortWithinPartitions("leaf", "a", "b", "late", "c")

    def compare(batches):
        for t in tables_by_key(batches, ["leaf", "a", "b"]):
            if t.num_rows < 2:
                continue
            t = t.combine_chunks()
            late, c, weight = (t.column(x).to_numpy() for x in ("late", "c", "weight"))
            unit = _unit(np.frombuffer(b"".join(t.column("v").to_pylist()), kind), len(c))
            earlier = t.column("earlier").combine_chunks()
            start = np.concatenate(([0], np.cumsum(earlier.value_lengths().to_numpy())))
            # Of two different blocks, those of the later one come last.
            one = t.column("a")[0] == t.column("b")[0]
            split = 0 if one else int((~late).sum())
            if not one and split in (0, len(c)):
                continue
            gained, root = leaf_links(weight, unit, earlier.flatten().to_numpy(), start, split, threshold)
            some = np.flatnonzero((gained > 0) | (root != np.arange(len(c))))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (c[some], gained[some], c[root[some]])], names=["c", "gained", "root"])

    found = keep(dealt.mapInArrow(compare, "c bigint, gained bigint, root bigint"))
    drop(routed, large)
    return found
