"""Jaccard join of documents on word shingles by T-occurrence search over inverted lists.

Two sets of sizes m and n at similarity t share at least T = ceil(t / (1 + t) * (m + n)) shingles. All but the T - 1
most frequent shingles of a document must therefore meet (``prefix``): only these are posted.

* Equal sets are one class from the start; copies are never compared or posted.
* Shingles are ordered by a count sketch over all documents, rare ones first, then by hash. The order only decides what is
  posted, never the result. Many rare shingles share a counter; counts are kept fine enough, and counters (within bounds)
  numerous enough, that a shingle of some dozens of documents stands out from what falls on its counter by chance.
* Lists of posted shingles give groups of documents that may be linked. Short lists give pairs that pass bounds on size,
  place in the prefix and parity; a long list is chained instead, first inside each task, so no list is gathered anywhere
  and no pairs are listed within a large group. What chains hold together is parted again by sizes and parity.
* Groups are searched in blocks of ``BLOCK`` documents, block against block where their sizes allow a link. In a pair of
  blocks each document's inverted lists are split as DivideSkip does: the long ones set aside, the short ones merged with
  a heap, then the long ones probed by binary search for what is still short of T. Pairs of blocks return a spanning forest
  of their links, at most one row per document.
* Components of those links are the result; two documents linked directly are always in one.
"""

from __future__ import annotations

import bisect
import heapq
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.components import components
from terrasift.llm.store import drop, join_roots, keep, sized, small_batches, tables_by_key
from terrasift.llm.textops import SPACED, mix, signed, texts_of, window_hashes, word_hashes

#: Least counters of the sketch, documents in a block of sets, length from which a list is chained, documents in a block of
#: parity bits, bytes of parity that are used there.
SKETCH, BLOCK, LONG, WIDE, FOLD = 1 << 21, 64, 64, 512, 512
#: Bytes of text for which the sketch has one counter (some 250 shingles), and most counters (2 bytes each in the tasks).
PER_COUNTER, MOST = 1500, 1 << 24
#: How soon a list counts as short (the longer the longest list, the more do), and so few candidates that none is merged.
SHORTER, FEW = 0.0085, 8


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of one with fewer words, the whole sequence as one."""
    hashes, at = word_hashes(texts, SPACED)
    out = []
    for i in range(len(texts)):
        own = hashes[at[i] : at[i + 1]]
        out.append(np.unique(window_hashes(own, min(words, len(own)))) if len(own) else own)
    return out


def _sliced(batches, column: int, rows: int = 512):
    for batch in batches:
        for x in range(0, batch.num_rows, rows):
            b = batch.slice(x, rows)
            yield b, texts_of(b.column(column))


def _counter(shingles: np.ndarray, counters: int) -> np.ndarray:
    return ((shingles >> np.uint64(11)) & np.uint64(counters - 1)).astype(np.int64)


def _parity(shingles: np.ndarray) -> bytes:
    """Bits that tell whether an odd number of the shingles falls on them: two sets' bits differ in no more places than the
    sets have members that aren't shared. As many bits as shingles, rounded up to a power of two, within limits."""
    bits = min(max(512, 1 << (max(len(shingles), 1) - 1).bit_length()), 16_384)
    odd = np.bincount(((shingles >> np.uint64(40)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Parity bytes (of one or, in rows, of many) for the smaller number of bytes: halves laid over each other."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def prefix_size(n: int, t: float) -> int:
    return n - math.ceil(t * n - 1e-9) + 1 if n else 0


def _links(n_common: int | np.ndarray, a, b, percent: int):
    return 100 * n_common >= percent * (a + b - n_common)


def merge_lists(owners: list[int], spans: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """(document, lists that have it) of documents in at least `least` of the sorted lists owners[start:end].

    A heap holds each list's next document. A document that comes too seldom can't be found by waiting: with least - 1 lists
    taken off the heap, nothing before the new top can reach `least`, so these lists jump there by binary search.
    """
    heap = [(owners[a], a, b) for a, b in spans if a < b]
    heapq.heapify(heap)
    out = []
    while len(heap) >= least:
        top, taken = heap[0][0], []
        while heap and heap[0][0] == top:
            taken.append(heapq.heappop(heap))
        if len(taken) >= least:
            out.append((top, len(taken)))
            ahead = top + 1
        else:
            while heap and len(taken) < least - 1:
                taken.append(heapq.heappop(heap))
            if not heap:
                break
            ahead = heap[0][0]
        for _, a, b in taken:
            a = bisect.bisect_left(owners, ahead, a + (owners[a] < ahead), b)
            if a < b:
                heapq.heappush(heap, (owners[a], a, b))
    return out


def _possible(docs: list[np.ndarray], sizes: np.ndarray, n_left: int, first: int, t: float) -> np.ndarray:
    """For each of the first n_left documents and each from `first` on, whether sizes and parity bits allow a link."""
    bits = min(max(512, 1 << (max(int(sizes.max()), 1) - 1).bit_length()), 16_384)
    signs = np.empty((len(docs), bits), np.float32)
    for i, s in enumerate(docs):
        signs[i] = 1 - 2 * (np.bincount(((s >> np.uint64(40)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1)
    a, b = sizes[:n_left, None], sizes[None, first:]
    ok = (b >= t * a - 1e-9) & (t * b <= a + 1e-9) & (a > 0)
    ok &= (bits - signs[:n_left] @ signs[first:].T) / 2 <= a + b - 2 * np.ceil(t / (1 + t) * (a + b) - 1e-9)
    if not first:
        # Within one list each pair counts once.
        ok &= np.arange(n_left)[:, None] < np.arange(len(docs))[None, :]
    return ok


def block_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between left and right (or within left), as places; right ones count from len(left).

    DivideSkip over the inverted lists of the second side: for each document of the first, T from the least size that can
    link; some T / (1 + log M) of its longest lists (M: the longest of them) are set aside, the rest merged with a heap for
    what is in as many of them as T still needs, and the long ones probed by binary search for those candidates. What is
    in one component already is not looked at again, nor what sizes and parity bits rule out; where few others are left, all
    lists are long ones.
    """
    docs = left if right is None else left + right
    first = 0 if right is None else len(left)
    members = docs[first:]
    if not members:
        return []
    sizes = np.array([len(x) for x in docs])
    may = _possible(docs, sizes, len(left), first, percent / 100)
    if not may.any():
        return []
    flat = np.concatenate(members)
    owner = np.repeat(np.arange(first, len(docs)), sizes[first:])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
    tokens, ends = flat[starts], np.concatenate((starts[1:], [len(flat)]))
    owners = owner.tolist()
    # The entries of all lists in order of (list, document), for binary search.
    entry = np.repeat(np.arange(len(starts)), ends - starts) * len(docs) + owner
    root, t, out = np.arange(len(docs)), percent / 100, []
    for i in range(len(left)):
        own = docs[i]
        if not len(own):
            continue
        other = first + np.flatnonzero(may[i])
        other = other[root[other] != root[i]]
        if not len(other):
            continue
        k = np.searchsorted(tokens, own)
        k = k[(k < len(tokens)) & (tokens[np.minimum(k, len(tokens) - 1)] == own)]
        need = math.ceil(t * len(own) - 1e-9)
        if len(k) < need:
            continue
        length = ends[k] - starts[k]
        aside = len(k) if len(other) <= FEW else min(need - 1, int(need / (1 + SHORTER * math.log2(max(2, int(length.max()))))))
        by_length = np.argsort(length, kind="stable")
        long_, short = k[by_length[len(k) - aside :]], k[by_length[: len(k) - aside]]
        if len(short):
            seen = merge_lists(owners, list(zip(starts[short].tolist(), ends[short].tolist(), strict=True)), max(1, need - aside))
        else:
            seen = [(j, 0) for j in other.tolist()]
        open_ = set(other.tolist())
        for j, common in seen:
            if j not in open_ or root[i] == root[j]:
                continue
            low = math.ceil(t / (1 + t) * (len(own) + sizes[j]) - 1e-9)
            if common + len(long_) < low:
                continue
            at = np.searchsorted(entry, long_ * len(docs) + j)
            common += int((entry[np.minimum(at, len(entry) - 1)] == long_ * len(docs) + j).sum())
            if _links(common, len(own), int(sizes[j]), percent):
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def _sketch(docs: DataFrame, words: int) -> np.ndarray:
    """For each counter, the logarithm of how many documents' shingles fall on it, in steps of 1 / 2000."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    counters = min(max(SKETCH, 1 << (size // PER_COUNTER).bit_length()), MOST)
    part = counters // 16

    def count(batches):
        total = np.zeros(counters, np.uint32)
        for _, texts in _sliced(batches, 1):
            for s in shingle_sets(texts, words):
                np.add.at(total, _counter(s, counters), np.uint32(1))
        if total.any():
            lane = TaskContext.get().partitionId() % 64
            for k in range(16):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([lane]), pa.array([zlib.compress(total[k * part : (k + 1) * part].tobytes(), 1)], pa.binary())], names=["k", "lane", "c"])

    def total(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(part, np.uint64)
        for b in batches:
            for x in b.column(b.schema.get_field_index("c")):
                out += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
        return np.minimum(out, np.iinfo(np.uint32).max).astype(np.uint32)

    def row(key: tuple[pa.Scalar, ...], counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([0]), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=["k", "lane", "c"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield row(key, total(batches))

    def level(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield row(key, np.round(np.log2(np.maximum(total(batches), 1)) * 2000).astype(np.uint16))

    # Counters of one part of the sketch are added up in lanes first, then over the lanes; tasks stream them. Levels are taken
    # where the lanes are added up: Python behind Python in one stage takes a second worker a core, which then stays.
    schema = "k bigint, lane bigint, c binary"
    lanes = docs.select("doc_id", "text").mapInArrow(count, schema).groupBy("k", "lane").applyInArrow(add, schema)
    rows = lanes.groupBy("k").applyInArrow(level, schema).collect()
    out = np.zeros(counters, np.uint16)
    for r in rows:
        out[r.k * part : (r.k + 1) * part] = np.frombuffer(zlib.decompress(r.c), np.uint16)
    return out


def link_components(documents: DataFrame, words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id reachable by links, itself included).

    Documents link when 100 * intersection >= percent * union of their shingle sets. Null and wordless texts have an
    empty set and link with nothing. Repeated rows come back as often as given; rows that share a doc_id are one document
    when components are named. Rows with a null doc_id get the component of a copy that has one, else null. An empty
    table gives an empty result.
    """
    small_batches(documents)
    docs = documents.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kinds = docs.sparkSession.sparkContext.broadcast(_sketch(docs, words))
    t = percent / 100

    def post(batches):
        kind = kinds.value
        for b, texts in _sliced(batches, 1):
            n, f, g, posted, parity = [], [], [], [], []
            for s in shingle_sets(texts, words):
                m = mix(s)
                n.append(len(s))
                f.append(int(np.bitwise_xor.reduce(m)) if len(s) else 0)
                g.append(int(np.add.reduce(mix(m))) if len(s) else 0)
                k = kind[_counter(s, len(kind))]
                p = prefix_size(len(s), t)
                # Sets come sorted, so a stable sort by kind orders by (kind, hash).
                posted.append(signed(s[np.argsort(k, kind="stable")[:p]].astype(np.uint64)))
                parity.append(_parity(s))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(signed(np.array(f, np.uint64))), pa.array(signed(np.array(g, np.uint64))), pa.array(posted, pa.list_(pa.int64())), pa.array(parity, pa.binary())],
                names=["doc_id", "n", "f", "g", "posted", "parity"],
            )

    sets = keep(docs.mapInArrow(post, "doc_id bigint, n bigint, f bigint, g bigint, posted array<bigint>, parity binary"))
    filled = sets.filter("n > 0")
    classes = keep(filled.groupBy("n", "f", "g").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("rep is not null"))
    copies = keep(filled.join(sized(keep(classes.filter("copies > 1").select("n", "f", "g", "rep"))), ["n", "f", "g"]).filter("doc_id is null or doc_id <> rep").select("doc_id", "n", "f", "g"))
    posted = filled.join(sized(copies), ["doc_id", "n", "f", "g"], "left_anti").filter("doc_id is not null")
    candidates = _candidates(posted, percent)
    groups = components(candidates)
    members = keep(_member_sets(docs, groups, words))
    drop(candidates, groups)
    first = keep(_search(members.withColumn("rest", F.lit(False)), percent, True))
    linked = components(first)
    # Large groups go on: all that isn't in the group's largest component so far, against everything in the group.
    joined = keep(members.filter("total > 2 * %d" % BLOCK).drop("set").join(linked.withColumnsRenamed({"id": "doc_id", "component": "now"}), "doc_id", "left").withColumn("now", F.coalesce("now", "doc_id")))
    if not joined.isEmpty():
        top = joined.groupBy("group", "now").agg(F.count("*").alias("c")).groupBy("group").agg(F.max_by("now", F.struct("c", "now")).alias("top"))
        rest = joined.join(top, "group").select("doc_id", (F.col("now") != F.col("top")).alias("rest"))
        linked = components(first.union(_search(members.join(rest, "doc_id"), percent, False)))
    # What is named below reads none of these any more.
    drop(first, members, joined)
    named = classes.join(linked.withColumnRenamed("id", "rep"), "rep", "left").filter("copies > 1 or component is not null")
    named = keep(named.select("n", "f", "g", F.coalesce("component", "rep").alias("component_id")))
    out = sets.select("doc_id", "n", "f", "g").join(sized(named), ["n", "f", "g"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _member_sets(docs: DataFrame, groups: DataFrame, words: int) -> DataFrame:
    """doc_id, group, total (documents in the group), band of sizes, set: of the documents that have a group."""
    joined = docs.join(sized(groups).withColumnsRenamed({"id": "doc_id", "component": "group"}), "doc_id").select("doc_id", "text", "group")

    def sets(batches):
        for b, texts in _sliced(batches, 1, 128):
            found = shingle_sets(texts, words)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(s) for s in found], pa.int64()), pa.array([signed(s) for s in found], pa.list_(pa.int64()))], names=["doc_id", "group", "n", "set"])

    # Equal rows have equal sets, and only the first of a class is in a group.
    found = keep(joined.mapInArrow(sets, "doc_id bigint, group bigint, n bigint, set array<bigint>"))
    totals = found.groupBy("group").agg(F.count("*").alias("total"))
    return found.join(sized(keep(totals)), "group")


def _search(members: DataFrame, percent: int, first: bool) -> DataFrame:
    """Edges (u, v) of spanning forests of the links that block pairs hold.

    Small groups are one block. In large ones a block has documents of one band of sizes (only neighbouring bands can
    link) and, by `rest`, only ones that are in the group's largest component or only others. First round: each block
    with itself and with the first block of its band and of the next. Later: all pairs of blocks but those of two blocks
    of the largest component.
    """
    width = math.log(100 / percent) * 1.02
    m = members.withColumn("small", F.col("total") <= 2 * BLOCK)
    if not first:
        m = m.filter("not small")
    m = m.withColumn("band", F.when(F.col("small"), 0).otherwise(F.floor(F.log(F.col("n")) / width)).cast("int"))
    per = keep(m.groupBy("group", "band", "rest").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    nxt = per.select("group", (F.col("band") - 1).alias("band"), F.col("rest").alias("rest2"), F.col("blocks").alias("blocks2"))
    prv = per.select("group", (F.col("band") + 1).alias("band"), F.col("rest").alias("rest2"), F.col("blocks").alias("blocks2"))
    own = per.select("group", "band", F.col("rest").alias("rest2"), F.col("blocks").alias("blocks2"))
    # What a block meets: (step, rest, blocks) of the same band and both neighbours.
    meets = own.withColumn("step", F.lit(0)).unionByName(nxt.withColumn("step", F.lit(1))).unionByName(prv.withColumn("step", F.lit(-1)))
    met = keep(meets.groupBy("group", "band").agg(F.collect_list(F.struct("step", "rest2", "blocks2")).alias("met")))
    m = m.join(sized(per), ["group", "band", "rest"]).join(sized(met), ["group", "band"])
    m = m.withColumn("k", F.when(F.col("small"), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).cast("int"))
    m = m.select("*", F.explode("met").alias("other")).filter(F.col("rest") | F.col("other.rest2") | F.lit(first))
    m = m.withColumn("k2", F.explode(F.sequence(F.lit(0), F.col("other.blocks2") - 1)))
    # A block's name is one number: compared as structs, names make the code of this stage nearly twice as long.
    number = lambda band, rest, k: F.shiftleft(band.cast("long"), 33) + F.shiftleft(rest.cast("long"), 32) + k
    me = number(F.col("band"), F.col("rest").cast("int"), F.col("k"))
    you = number(F.col("band") + F.col("other.step"), F.col("other.rest2").cast("int"), F.col("k2"))
    m = m.withColumn("me", me).withColumn("you", you).withColumn("side", F.when(F.col("me") == F.col("you"), 0).when(F.col("me") < F.col("you"), 1).otherwise(2))
    if first:
        m = m.filter("small or side = 0 or k = 0 or k2 = 0")
    m = m.filter("not small or side = 0")
    task = F.xxhash64("group", F.least("me", "you"), F.greatest("me", "you"))
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = m.select(task.alias("task"), "side", "doc_id", "set").repartition(parts, "task").sortWithinPartitions("task", "side")

    def search(batches):
        key, sides, u, v = None, {}, [], []

        def done():
            left, right = sides.get(0) or sides.get(1) or [], None if 0 in sides else sides.get(2, [])
            ids = [d for d, _ in left + (right or [])]
            for i, j in block_links([s for _, s in left], None if right is None else [s for _, s in right], percent):
                u.append(ids[i])
                v.append(ids[j])

        for batch in batches:
            tasks, side, ids = (batch.column(c).to_pylist() for c in range(3))
            sets = batch.column(3)
            for i, (t, d, x) in enumerate(zip(tasks, side, ids, strict=True)):
                if t != key:
                    if key is not None:
                        done()
                    key, sides = t, {}
                sides.setdefault(d, []).append((x, sets[i].values.to_numpy(zero_copy_only=False).view(np.uint64)))
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
                u, v = [], []
            # Views of the batch would keep it in memory.
            sides = {d: [(x, s.copy()) for x, s in xs] for d, xs in sides.items()}
        if key is not None:
            done()
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return dealt.mapInArrow(search, "u bigint, v bigint")


def _candidates(posted: DataFrame, percent: int) -> DataFrame:
    """Kept edges (u, v) whose components hold together all documents that may be linked.

    posted: doc_id, n, posted (shingles in the common order), parity.
    """
    t = percent / 100

    def chain(batches):
        """Of long lists inside this task, only the first document goes on, with edges to the others."""
        for batch in batches:
            ids, ns = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            per = batch.column(2).value_lengths().to_numpy()
            tokens = batch.column(2).flatten().to_numpy()
            own = np.repeat(np.arange(batch.num_rows), per)
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(per) - per, per)
            order = np.argsort(tokens, kind="stable")
            tokens, own, place = tokens[order], own[order], place[order]
            start = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
            length = np.diff(np.concatenate((start, [len(tokens)])))
            stay = np.ones(len(tokens), bool)
            pairs = defaultdict(set)
            for k in np.flatnonzero(length >= LONG):
                part = own[start[k] : start[k] + length[k]]
                stay[start[k] + 1 : start[k] + length[k]] = False
                pairs[int(part[0])].update(part[1:].tolist())
            long_ = np.repeat(length >= LONG, length)
            a = np.array([x for x, ys in pairs.items() for _ in ys], np.int64)
            b = np.array([y for ys in pairs.values() for y in ys], np.int64)
            none = np.zeros(len(a), np.int64)
            cols = [
                np.concatenate((tokens[stay], none)),
                np.concatenate((ids[own[stay]], ids[a])),
                # Size and place share a number; negative: of a list that is long already.
                np.concatenate(((ns[own[stay]] << 31 | place[stay]) * np.where(long_[stay], -1, 1), none)),
                np.concatenate((np.full(stay.sum(), -1), ids[b])),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["token", "id", "at", "other"])

    lists = posted.select("doc_id", "n", "posted").mapInArrow(chain, "token bigint, id bigint, at bigint, other bigint")

    def pair(batches):
        """Lists, in order of token: pairs that may link from short ones, a chain from long ones."""
        rest = None
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            if rest is not None:
                cols = [np.concatenate((r, c)) for r, c in zip(rest, cols, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left")) if len(cols[0]) else 0
            rest = [c[cut:] for c in cols]
            if len(rest[0]) > 50_000:
                # A very long list: what has come is chained, and its last document stands for it in what follows.
                cut, rest = len(cols[0]), [c[-1:].copy() for c in cols]
                rest[2] = -np.abs(rest[2])
            if cut:
                yield from emit([c[:cut] for c in cols])
        if rest is not None and len(rest[0]):
            yield from emit(rest)

    def emit(cols):
        token, ids, at, other = cols
        edges = [(ids[other >= 0], other[other >= 0], True)]
        ok = other < 0
        token, ids, at = token[ok], ids[ok], at[ok]
        if len(token):
            start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            length = np.diff(np.concatenate((start, [len(token)])))
            several = np.repeat(length > 1, length)
            token, ids, at = token[several], ids[several], at[several]
            length = length[length > 1]
        if len(token):
            start = np.cumsum(length) - length
            run = np.repeat(np.arange(len(start)), length)
            chained = (length >= LONG) | np.logical_or.reduceat(at < 0, start)
            ns, place = np.abs(at) >> 31, np.abs(at) & (2**31 - 1)
            # The smaller of two documents meets the other in a shorter prefix.
            short = ns - np.ceil(2 * t / (1 + t) * ns - 1e-9).astype(np.int64) + 1
            k = np.flatnonzero(chained[run[1:]] & (run[1:] == run[:-1]))
            edges.append((ids[start[run[k]]], ids[k + 1], True))
            for d in range(1, LONG):
                k = np.flatnonzero((run[d:] == run[:-d]) & ~chained[run[d:]]) if len(run) > d else np.zeros(0, np.int64)
                if not len(k):
                    break
                a, b = np.where(ns[k] <= ns[k + d], k, k + d), np.where(ns[k] <= ns[k + d], k + d, k)
                need = np.ceil(t / (1 + t) * (ns[a] + ns[b]) - 1e-9)
                possible = np.minimum(ns[a] - place[a], ns[b] - place[b]) + np.minimum(place[a], place[b])
                fits = (ns[a] >= t * ns[b] - 1e-9) & (place[a] < short[a]) & (possible >= need)
                edges.append((ids[a[fits]], ids[b[fits]], False))
        for chained in (True, False):
            u, v = (np.concatenate([e[x] for e in edges if e[2] == chained] or [np.zeros(0, np.int64)]) for x in (0, 1))
            if len(u):
                both = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v))), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(np.full(both.shape[1], chained))], names=["u", "v", "chained"])

    parts = int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rows that are already edges go anywhere.
    spread = F.when(F.col("other") < 0, F.col("token")).otherwise(F.xxhash64("id", "other"))
    dealt = lists.repartition(parts, spread).sortWithinPartitions("token", "id")
    edges = keep(dealt.mapInArrow(pair, "u bigint, v bigint, chained boolean").groupBy("u", "v").agg(F.max("chained").alias("chained")))
    bits = lambda c: posted.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}"))
    both = edges.filter("not chained").join(bits("u"), "u").join(bits("v"), "v").select("u", "v", "n_u", "p_u", "n_v", "p_v")

    def near(batches):
        for b in batches:
            n = b.column(2).to_numpy() + b.column(4).to_numpy()
            differ = np.zeros(len(n), np.int64)
            for k, (p, q) in enumerate(zip(b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True)):
                size = min(len(p), len(q))
                differ[k] = np.bitwise_count(_folded(np.frombuffer(p, np.uint8), size) ^ _folded(np.frombuffer(q, np.uint8), size)).sum()
            ok = pa.array(differ <= n - 2 * np.ceil(t / (1 + t) * n - 1e-9))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["u", "v"])

    chained = keep(_refine(edges.filter("chained").select("u", "v"), posted.select("doc_id", "n", "parity"), t))
    out = keep(chained.union(both.mapInArrow(near, "u bigint, v bigint")))
    drop(edges, chained)
    return out


def _refine(chained: DataFrame, bits: DataFrame, t: float) -> DataFrame:
    """Edges (u, v) that hold together those documents of chained lists whose sizes and parity bits allow a link.

    What the chains hold together may be large and mostly unalike. Its documents meet in pairs of blocks with nothing but
    size and parity (a bit a shingle); a pair of blocks returns a spanning forest, at most one edge per document.
    """
    groups = components(chained)
    m = bits.distinct().join(sized(groups).withColumnsRenamed({"id": "doc_id", "component": "group"}), "doc_id")
    band = F.floor(F.log(F.col("n")) / (math.log(1 / t) * 1.02)).cast("int")
    m = keep(m.select("doc_id", "n", "parity", "group", band.alias("band")))
    # Blocks have documents of one band of sizes and meet those of their own band and of the next one.
    blocks = keep(m.groupBy("group", "band").agg(F.ceil(F.count("*") / WIDE).cast("int").alias("blocks")))
    near_by = lambda step: blocks.select("group", (F.col("band") - step).alias("band"), F.lit(step).alias("step"), F.col("blocks").alias("blocks2"))
    met = keep(near_by(0).unionByName(near_by(1)).unionByName(near_by(-1)).groupBy("group", "band").agg(F.collect_list(F.struct("step", "blocks2")).alias("met")))
    m = m.join(sized(blocks), ["group", "band"]).join(sized(met), ["group", "band"]).withColumn("k", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    m = m.withColumn("o", F.explode("met")).withColumn("k2", F.explode(F.sequence(F.lit(0), F.col("o.blocks2") - 1)))
    number = lambda band, k: F.shiftleft(band.cast("long"), 40) + k
    m = m.withColumn("me", number(F.col("band"), F.col("k"))).withColumn("you", number(F.col("band") + F.col("o.step"), F.col("k2")))
    m = m.select("group", F.least("me", "you").alias("a"), F.greatest("me", "you").alias("b"), "doc_id", "n", "parity")
    parts = int(bits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = m.repartition(parts, "group", "a", "b").sortWithinPartitions("group", "a", "b", "doc_id")

    def near(batches):
        for table in tables_by_key(batches, ["group", "a", "b"]):
            ids, n = table.column("doc_id").to_numpy(), table.column("n").to_numpy()
            raw = [np.frombuffer(x, np.uint8) for x in table.column("parity").to_pylist()]
            sizes = np.minimum([len(x) for x in raw], FOLD)
            root = np.arange(len(ids))
            for size in np.unique(sizes):
                # Documents of this many bytes against those of as many or more.
                other = np.flatnonzero(sizes >= size)
                signs = 1 - 2 * np.unpackbits(np.stack([_folded(raw[k], size) for k in other]), axis=1).astype(np.float32)
                own = np.flatnonzero(sizes[other] == size)
                for x in range(0, len(own), 512):
                    part = own[x : x + 512]
                    total = n[other[part], None] + n[None, other]
                    ok = (8 * size - signs[part] @ signs.T) / 2 <= total - 2 * np.ceil(t / (1 + t) * total - 1e-9)
                    ok &= (n[other[part], None] >= t * n[None, other] - 1e-9) & (n[None, other] >= t * n[other[part], None] - 1e-9)
                    i, j = np.nonzero(ok)
                    root = join_roots(root, other[part[i]], other[j])
            some = np.flatnonzero(root != np.arange(len(ids)))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]])], names=["u", "v"])

    return dealt.mapInArrow(near, "u bigint, v bigint")
