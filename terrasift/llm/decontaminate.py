"""Benchmark decontamination: the benchmark's word windows as a broadcast hash set, scanned over the training texts.

Windows are `n` consecutive words of an item; an item of fewer words, but not none, is one window. The set goes to the
tasks only while it is below ``MAX_WINDOWS`` windows and ``MAX_BYTES`` bytes of text; a larger benchmark is dealt into
slices by item, each below the bound, and the texts are scanned once for each slice, one slice after the other: only one
set is ever held (sorted arrays, made once and sent as they are), and of each scan only what texts with hits have is written. Every hash hit is verified on the words
themselves.
"""

from __future__ import annotations

import math
import re
import string
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasift.llm.store import keep, sized, small_batches
from terrasift.llm.textops import ALNUM, CODES, LOWER, prefix, stretch, texts_of, word_hashes

MAX_WINDOWS, MAX_BYTES = 2_000_000, 64 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FOLD = bytes(LOWER)
#: Bits of the number of bytes of a filter of hashes.
_FILTER = 19
_UPPER = string.ascii_uppercase


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.translate(_FOLD))


#: Bytes of items' text that are cut into words together.
_GROUP = 1 << 20


class WindowSet:
    """Windows of items (id, text), for look-up: sorted hashes and the place of each one's first word, 12 bytes a window, and the
    items' text with the ends of its words, some 8 bytes a word more."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.ids, self.n = [str(k) if k is not None else "" for k, _ in items], n
        text, start, end, count = [], [], [], []
        found: dict[int, list] = {}
        at = words = 0
        for own in _groups([t for _, t in items]):
            body = b" ".join([*own, b""]).translate(_FOLD)
            data = np.frombuffer(body, np.uint8)
            edge = np.diff(np.concatenate(([False], ALNUM[data], [False])).astype(np.int8))
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            cuts = np.searchsorted(first, np.cumsum([0, *(len(t) + 1 for t in own)]))
            sums = prefix(stretch(prefix(CODES[data]), first, last))
            place, size = np.arange(len(first)), np.repeat(np.diff(cuts), np.diff(cuts))
            into = place - np.repeat(cuts[:-1], np.diff(cuts))
            for m in np.unique(np.minimum(size, n)).tolist():
                begin = place[(into + n <= size) if m == n else (size == m) & (into == 0)]
                found.setdefault(m, []).append((stretch(sums, begin, begin + m), (begin + words).astype(np.int32)))
            text.append(body)
            start.append((first + at).astype(np.int32))
            end.append((last + at).astype(np.int32))
            count.append(np.diff(cuts))
            at, words = at + len(body), words + len(first)
        self.text = b"".join(text)
        self.start, self.end = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (start, end))
        #: The first word of each item, and one past the last one's.
        self.items = np.concatenate(([0], np.cumsum(np.concatenate(count)))) if count else np.zeros(1, np.int64)
        self.keys, self.at, self.bits = {}, {}, {}
        for m, parts in found.items():
            h, w = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.keys[m], self.at[m] = h[order], w[order]
            self.bits[m] = np.zeros(1 << _FILTER, np.uint8)
            np.bitwise_or.at(self.bits[m], (h >> np.uint64(64 - _FILTER - 3)).astype(np.int64) >> 3, np.uint8(1) << ((h >> np.uint64(64 - _FILTER - 3)) & np.uint64(7)).astype(np.uint8))

    def nbytes(self) -> int:
        return len(self.text) + sum(x.nbytes for x in (self.start, self.end, self.items, *self.keys.values(), *self.at.values(), *self.bits.values()))

    def _words(self, at: int, m: int) -> list[bytes]:
        return [self.text[a:b] for a, b in zip(self.start[at : at + m].tolist(), self.end[at : at + m].tolist(), strict=True)]

    def scan(self, texts: list[bytes]) -> list[tuple[int, np.ndarray, list[str]]]:
        """For each text: its number of words, whether each is hit (empty if none is), ids of items with hits."""
        hashes, at = word_hashes(texts, ALNUM)
        sums, found = prefix(hashes), defaultdict(list)
        for m, keys in self.keys.items():
            if len(hashes) < m:
                continue
            start = np.arange(len(hashes) - m + 1)
            h = stretch(sums, start, start + m)
            top = h >> np.uint64(64 - _FILTER - 3)
            maybe = np.flatnonzero(self.bits[m][(top >> np.uint64(3)).astype(np.int64)] >> (top & np.uint64(7)).astype(np.uint8) & 1)
            low, high = np.searchsorted(keys, h[maybe], "left"), np.searchsorted(keys, h[maybe], "right")
            doc = np.searchsorted(at, maybe, "right") - 1
            ok = (low < high) & (maybe + m <= at[doc + 1])
            for d, s, a, b in zip(doc[ok].tolist(), maybe[ok].tolist(), low[ok].tolist(), high[ok].tolist(), strict=True):
                found[d].append((m, s - int(at[d]), a, b))
        out = []
        for d in range(len(texts)):
            n, ids, hit = int(at[d + 1] - at[d]), set(), np.zeros(0, bool)
            if d in found:
                words, hit = words_of(texts[d]), np.zeros(n, bool)
                for m, s, a, b in found[d]:
                    for w in self.at[m][a:b].tolist():
                        if words[s : s + m] == self._words(w, m):
                            hit[s : s + m] = True
                            ids.add(self.ids[int(np.searchsorted(self.items, w, "right")) - 1])
            out.append((n, hit, sorted(ids)))
        return out


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    own, size = [], 0
    for t in texts:
        if own and size + len(t) > _GROUP:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t)
    if own:
        yield own


def _slices(benchmark: DataFrame, n: int, text: str, key: str) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """The number of slices that keeps each below the bounds, and the slices' items; one slice is held at a time."""
    items = benchmark.select(F.col(f"`{key}`").cast("string").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    # A window starts at a word, and a word and its gap take two bytes at least.
    count = max(1, math.ceil(size[0] / MAX_BYTES), math.ceil(size[0] / 2 / MAX_WINDOWS))
    own = lambda k: items if count == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k)
    return count, ([(r.id, r.text.encode()) for r in own(k).collect()] for k in range(count))


_HITS = "n_words bigint, hits binary, items array<string>"


def _scanned(docs: DataFrame, part: list[tuple[str, bytes]], n: int) -> tuple[DataFrame, Broadcast]:
    """doc columns with text -> also n_words, hits (a bit for each word; empty if none), items; and what was sent to the tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(WindowSet(part, n))

    def scan(batches):
        windows = shared.value
        for batch in batches:
            for x in range(0, batch.num_rows, 256):
                b = batch.slice(x, 256)
                got = windows.scan(texts_of(b.column(b.schema.get_field_index("text"))))
                cols = [pa.array([g[0] for g in got], pa.int64()), pa.array([np.packbits(g[1]).tobytes() for g in got], pa.binary()), pa.array([g[2] for g in got], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "n_words", "hits", "items"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(scan, f"{fields}, {_HITS}"), shared


def _by_slices(docs: DataFrame, parts, n: int) -> DataFrame:
    """docs (row, text) with n_words, hits, items, scanned once for each slice of the benchmark.

    Hits depend on the text alone, so those of a text are kept once, by two hashes of it, and joined back at the end.
    """
    two = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2")]
    found = None
    for part in parts:
        scanned, shared = _scanned(docs.select("text"), part, n)
        own = keep(scanned.filter(F.octet_length("hits") > 0).select(*two, "hits", "items"))
        shared.destroy()
        found = own if found is None else found.unionByName(own)
    # A slice has the same hits for equal texts, so there are no more different ones than slices.
    merged = keep(found.groupBy("h1", "h2").agg(_either(F.collect_set("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")))
    words = F.regexp_count(F.translate(F.coalesce("text", F.lit("")), _UPPER, _UPPER.lower()), F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"))
    out = docs.select("*", *two).join(sized(merged), ["h1", "h2"], "left")
    return out.select("row", "text", words.cast("long").alias("n_words"), F.coalesce("hits", F.lit(b"")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def find_hits(documents: DataFrame, benchmark: DataFrame, n: int = 13, text: str = "text", key: str = "item_id") -> DataFrame:
    """documents with struct column `contamination`: n_words, n_hit, items (sorted ids), contaminated, hits (bits of words).

    A word is hit inside any occurrence of a window; contaminated means n_hit > 0 and 20 * n_hit >= n_words. Null texts
    have no words; texts of any length are read whole. All columns stay as they are, whatever their names; an empty
    benchmark hits nothing, an empty table gives an empty result, repeated rows are judged alike. Items without words have
    no window; null ids read as ''.
    """
    small_batches(documents)
    # The other columns travel in one struct, so that none of their names can clash.
    others = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in documents.columns if c != text))
    docs = documents.select(others.alias("row"), F.col(f"`{text}`").alias("text"))
    count, parts = _slices(benchmark, n, text, key)
    out = _scanned(docs, next(parts), n)[0] if count == 1 else _by_slices(docs, parts, n)
    n_hit = F.coalesce(_bits(F.col("hits")), F.lit(0)).cast("long")
    out = out.withColumn("n_hit", n_hit)
    about = F.struct("n_words", "n_hit", F.array_sort("items").alias("items"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "hits")
    return out.select(*(F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in documents.columns), about.alias("contamination"))


@F.pandas_udf(T.BinaryType())
def _either(hits: pd.Series) -> pd.Series:
    """Bit fields of equal length laid over each other."""
    return pd.Series([np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in xs]).tobytes() for xs in hits])


def _bits(hits):
    """The number of ones of a binary column, from its hexadecimal digits."""
    digits = F.hex(hits)
    count = F.lit(0)
    for ones, chars in ((1, "1248"), (2, "3569AC"), (3, "7BDE"), (4, "F")):
        count = count + ones * (F.length(digits) - F.length(F.translate(digits, chars, "")))
    return count


def remove(documents: DataFrame, benchmark: DataFrame, n: int = 13, text: str = "text", key: str = "item_id", spans: bool = False) -> DataFrame:
    """documents without the contaminated ones; with spans, contaminated ones stay but lose their hit words and what is between."""
    found = find_hits(documents, benchmark, n, text, key)
    if not spans:
        return found.filter(~F.col("contamination.contaminated")).drop("contamination")
    cut = F.when(F.col("contamination.contaminated"), _cut(F.col(f"`{text}`"), F.col("contamination.hits"))).otherwise(F.col(f"`{text}`"))
    return found.withColumn(text, cut).drop("contamination")


@F.pandas_udf(T.StringType())
def _cut(texts, hits):
    out = []
    for t, h in zip(texts, hits, strict=True):
        body = (t or "").encode()
        spans = [m.span() for m in _WORD.finditer(body.translate(_FOLD))]
        hit = np.unpackbits(np.frombuffer(h or b"", np.uint8))[: len(spans)].astype(bool)
        left, at, i = [], 0, 0
        while i < len(hit):
            if hit[i]:
                j = i
                while j + 1 < len(hit) and hit[j + 1]:
                    j += 1
                left.append(body[at : spans[i][0]])
                at, i = spans[j][1], j
            i += 1
        out.append((b"".join(left) + body[at:]).decode())
    return pd.Series(out)
