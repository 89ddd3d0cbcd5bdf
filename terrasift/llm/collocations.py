"""Phrase collocation mining with position bitmaps.

The texts of a language are dealt into shards of a bounded number of words. In a shard every word has a compressed bitmap of
its positions: chunks of 8 positions, only those with a bit set; a position is left free where a piece ends, so that no
phrase crosses it. A phrase's bitmap (of its last words' places) shifted by one and combined with the bitmaps of the words
in the same chunks by AND is the bitmaps of the phrases that are one word longer; popcounts are their frequencies in the
shard. Phrases are extended depth first, some ten thousand chunks of first words at a time, and popcounts are summed
over the shards.

Three passes keep what is summed small: the first sums pairs, the second longer phrases of which every pair is frequent over
all shards (no phrase is more frequent than a pair in it), both by hashes; the third sums the phrases that are left by their
words. A filter of fixed size tells which these are; it may let others pass, which then turn out rare.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasift.llm.store import drop, keep, sized, small_batches
from terrasift.llm.textops import BASE, CHUNK, CODES, LOWER, _pieces, mix, prefix, stretch, texts_of

#: Words of a shard, and chunks of bitmaps that are extended together.
SHARD, BATCH = 1 << 18, 1 << 14
#: Bits of the filter of frequent phrases (32 MB), the only thing that goes to all tasks. The fuller it is, the less it prunes.
FILTER = 1 << 28
#: Parts that a language's ranking is made from.
PARTS = 64

_SPACE, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_WORD = _KIND == 0


class _Stream:
    """The words of one language as they come, and whether a piece ends before each."""

    def __init__(self):
        self.parts, self.size = [], 0
        self.words, self.breaks, self.count, self.broken = [], [], 0, True

    def add(self, text: bytes) -> None:
        for part in _pieces(text, _WORD):
            if self.parts and self.size + len(part) > CHUNK:
                self.split()
            self.parts.append(part)
            self.size += len(part)
        self.parts.append(b"\n")

    def split(self) -> None:
        data = LOWER[np.frombuffer(b"".join(self.parts), np.uint8)]
        self.parts, self.size = [], 0
        kind = _KIND[data]
        word = np.zeros(len(data) + 2, np.int8)
        word[1:-1] = kind == 0
        edge = np.diff(word)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        ended = np.concatenate(([0], np.cumsum(kind == _BREAK)))
        if not len(start):
            self.broken |= bool(ended[-1])
            return
        before = ended[start] > np.concatenate(([0], ended[end[:-1]]))
        before[0] |= self.broken
        self.broken = bool(ended[-1] > ended[end[-1]])
        offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
        self.words.append(pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[kind == 0])))
        self.breaks.append(before)
        self.count += len(start)

    def shards(self, ahead: int, last: bool = False):
        """(words to start from, positions as places in the vocabulary with -1 where a piece ends, vocabulary), as many as are full.

        Behind the words to start from come `ahead` more, which phrases may reach into."""
        if last and self.parts:
            self.split()
        while self.count >= SHARD + ahead or last and self.count:
            words, breaks = pa.chunked_array(self.words).combine_chunks(), np.concatenate(self.breaks)
            own = min(SHARD, self.count)
            found = words.slice(0, own + ahead).dictionary_encode()
            at = np.arange(len(found)) + np.cumsum(breaks[: len(found)])
            places = np.full(int(at[-1]) + 1, -1, np.int32)
            places[at] = found.indices.to_numpy()
            yield own, int(at[own - 1]) + 1, places, found.dictionary
            self.words, self.breaks, self.count = [words.slice(own)], [breaks[own:]], self.count - own


#: The gap where places take two bytes, and the largest vocabulary for these.
_SHORT = 65535
_SHARD = "lang string, words bigint, own bigint, places binary, vocabulary array<string>"


def shards_of(documents: DataFrame, text: str, lang: str, longest: int) -> DataFrame:
    """Kept table of shards; null languages are `und`, null texts empty."""
    rows = documents.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))

    def deal(batches):
        streams: dict[str, _Stream] = {}

        def made(last=False):
            for name, stream in streams.items():
                for words, own, places, vocabulary in stream.shards(longest - 1, last):
                    short = places if len(vocabulary) > _SHORT else np.where(places < 0, _SHORT, places).astype(np.uint16)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([words]), pa.array([own]), pa.array([short.tobytes()], pa.binary()), pa.array([vocabulary.cast(pa.string())], pa.list_(pa.string()))], names=[x.split()[0] for x in _SHARD.split(", ")])

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                if body:
                    streams.setdefault(name, _Stream()).add(body)
            yield from made()
        yield from made(True)

    return keep(rows.mapInArrow(deal, _SHARD))


class Bitmaps:
    """The compressed position bitmaps of a shard's words."""

    def __init__(self, places: np.ndarray, own: int, size: int):
        self.size, self.chunks = size, (len(places) >> 3) + 2
        at = np.flatnonzero(places >= 0)
        word, chunk, mask = self._packed(places[at].astype(np.int64), at)
        # All words by chunk, for the AND; those to start from by word.
        order = np.argsort(chunk, kind="stable")
        self.word, self.mask = word[order], mask[order]
        self.first = np.searchsorted(chunk[order], np.arange(self.chunks + 1))
        at = at[at < own]
        self.roots = self._packed(places[at].astype(np.int64), at)

    def _packed(self, word: np.ndarray, at: np.ndarray):
        return self._joined(word * self.chunks + (at >> 3), np.uint8(1) << (at & 7).astype(np.uint8))

    def _joined(self, key: np.ndarray, mask: np.ndarray):
        """(node, chunk, mask) by node and chunk of bits with keys node * chunks + chunk, in any order."""
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        key = key[new]
        return key // self.chunks, key % self.chunks, np.bitwise_or.reduceat(mask[order], new) if len(new) else mask

    def batches(self):
        """The first words' (phrases, phrase of each chunk, chunk, mask), some at a time."""
        word, chunk, mask = self.roots
        a = 0
        while a < len(word):
            b = min(a + BATCH, len(word))
            b = int(np.searchsorted(word, word[b - 1], "right"))  # a word's chunks stay together
            own, node = np.unique(word[a:b], return_inverse=True)
            yield own[:, None], node, chunk[a:b], mask[a:b]
            a = b

    def extend(self, phrases: np.ndarray, node: np.ndarray, chunk: np.ndarray, mask: np.ndarray, passes: Callable[[np.ndarray], np.ndarray] | None = None):
        """The same of all phrases that are one word longer, or of those that pass."""
        moved = mask.astype(np.uint16) << 1
        low, high = (moved & 255).astype(np.uint8), (moved >> 8).astype(np.uint8)
        stay, over = np.flatnonzero(low), np.flatnonzero(high)
        node, chunk, mask = np.concatenate((node[stay], node[over])), np.concatenate((chunk[stay], chunk[over] + 1)), np.concatenate((low[stay], high[over]))
        count = self.first[chunk + 1] - self.first[chunk]
        k = np.repeat(np.arange(len(chunk)), count)
        other = np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count) + self.first[chunk][k]
        both = self.mask[other] & mask[k]
        hit = np.flatnonzero(both)
        k, word, both = k[hit], self.word[other[hit]], both[hit]
        longer, chunk, both = self._joined((node[k] * self.size + word) * self.chunks + chunk[k], both)
        own, node = np.unique(longer, return_inverse=True)
        phrases = np.concatenate((phrases[own // self.size], (own % self.size)[:, None]), 1)
        if passes is not None:
            ok = passes(phrases)
            stay = ok[node]
            phrases, node, chunk, both = phrases[ok], (np.cumsum(ok) - 1)[node[stay]], chunk[stay], both[stay]
        return phrases, node, chunk, both


def popcounts(nodes: int, node: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.bincount(node, np.bitwise_count(mask), nodes).astype(np.int64)


def _opened(batch: pa.RecordBatch):
    """(language, vocabulary, bitmaps) of each row of a batch of shards, one at a time."""
    for i in range(batch.num_rows):
        get = lambda n, i=i: batch.column(batch.schema.get_field_index(n))[i]
        vocabulary = get("vocabulary").values
        places = np.frombuffer(get("places").as_buffer(), np.uint16 if len(vocabulary) <= _SHORT else np.int32)
        places = places if len(vocabulary) > _SHORT else np.where(places == _SHORT, -1, places.astype(np.int32))
        yield get("lang").as_py(), vocabulary, Bitmaps(places, get("own").as_py(), len(vocabulary))
        # What a shard took goes back before the next one; the executor's memory is shared with its other workers.
        pa.default_memory_pool().release_unused()


def _said(vocabulary: pa.Array, phrases: np.ndarray) -> pa.Array:
    words = [vocabulary.take(pa.array(phrases[:, k])) for k in range(phrases.shape[1])]
    return pc.binary_join_element_wise(*words, " ") if len(words) > 1 else words[0]


def _hashes(words: pa.Array, lang: str) -> np.ndarray:
    """Hashes of the words of a language."""
    data = pa.chunked_array([words]).cast(pa.large_binary()).combine_chunks()
    _, offsets, values = data.buffers()
    ends = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1]
    text = np.frombuffer(values, np.uint8)[ends[0] : ends[-1]] if len(data) and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return mix(stretch(prefix(CODES[text]), ends[:-1] - ends[0], ends[1:] - ends[0]) ^ np.uint64(zlib.crc32(lang.encode())))


def _phrase_hashes(hashes: np.ndarray, phrases: np.ndarray) -> np.ndarray:
    h = np.full(len(phrases), phrases.shape[1], np.uint64)
    for k in range(phrases.shape[1]):
        h = mix(h * np.uint64(BASE) + hashes[phrases[:, k]])
    return h & np.uint64((1 << 32) - 1)


def _hashed(sizes: tuple[int, ...], bits: Broadcast | None = None):
    """Shards -> hashes (32 bits) and frequencies of their phrases of the given sizes; with bits only of those of which every pair
    passes the filter."""

    def run(batches):
        for batch in batches:
            for lang, vocabulary, bitmaps in _opened(batch):
                hashes = _hashes(vocabulary, lang)
                passes = bits and (lambda phrases, hashes=hashes: _passes(bits.value, _phrase_hashes(hashes, phrases[:, -2:])))
                for level in bitmaps.batches():
                    for size in range(2, max(sizes) + 1):
                        level = bitmaps.extend(*level, passes)
                        if not len(level[0]):
                            break
                        if size in sizes:
                            h = _phrase_hashes(hashes, level[0]).astype(np.uint32).view(np.int32)
                            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(popcounts(len(h), *level[1::2]))], names=["h", "f"])

    return run


def _filter_of(hashes: DataFrame) -> np.ndarray:
    """A filter of FILTER bits (bytes, each bit a hash): whatever the number of hashes, all of them pass."""
    part = 1 << 19  # bits that are made together

    def made(batches):
        for _, group in itertools.groupby((x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), lambda x: x[0]):
            bits, at = np.zeros(part, np.uint8), -1
            for at, own in group:
                bits[own] = 1
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], names=["at", "bits"])

    place = F.pmod(F.col("h").cast("long"), F.lit(FILTER))
    rows = hashes.select(F.floor(place / part).cast("long").alias("at"), F.pmod(place, F.lit(part)).cast("long").alias("own"))
    rows = rows.repartition("at").sortWithinPartitions("at").mapInArrow(made, "at bigint, bits binary")
    out = np.zeros(FILTER // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r.at * part // 8 : (r.at + 1) * part // 8] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return out


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes % np.uint64(FILTER)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


_COUNTS = "lang string, phrase string, size int, f bigint"


def _count_rows(lang: str, vocabulary: pa.Array, phrases: np.ndarray, node: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
    n = len(phrases)
    size = pa.repeat(pa.scalar(phrases.shape[1], pa.int32()), n)
    return pa.RecordBatch.from_arrays([pa.repeat(lang, n), _said(vocabulary, phrases), size, pa.array(popcounts(n, node, mask))], names=[x.split()[0] for x in _COUNTS.split(", ")])


def _words(batches):
    """Shards -> frequencies of their words, those of some shards of a task together."""
    pending: dict[str, list] = {}
    size = 0

    def made():
        for lang, parts in pending.items():
            words, counts = zip(*parts, strict=True)
            t = pa.table({"phrase": pa.chunked_array(words), "f": pa.chunked_array(counts)}).group_by("phrase").aggregate([("f", "sum")]).combine_chunks()
            for b in t.to_batches(max_chunksize=1 << 16):
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, n), b.column("phrase"), pa.repeat(pa.scalar(1, pa.int32()), n), b.column("f_sum")], names=[x.split()[0] for x in _COUNTS.split(", ")])
        pending.clear()

    for batch in batches:
        for lang, vocabulary, bitmaps in _opened(batch):
            for phrases, node, _, mask in bitmaps.batches():
                pending.setdefault(lang, []).append((_said(vocabulary, phrases), pa.array(popcounts(len(phrases), node, mask))))
                size += len(phrases)
            if size > 2 * SHARD:
                yield from made()
                size = 0
    yield from made()


def _phrases(longest: int, bits: Broadcast):
    """Shards -> frequencies of phrases of two words or more that pass the filter."""

    def run(batches):
        for batch in batches:
            for lang, vocabulary, bitmaps in _opened(batch):
                hashes = _hashes(vocabulary, lang)
                passes = lambda phrases, hashes=hashes: _passes(bits.value, _phrase_hashes(hashes, phrases))
                for level in bitmaps.batches():
                    for _ in range(2, longest + 1):
                        level = bitmaps.extend(*level, passes)
                        if not len(level[0]):
                            break
                        yield _count_rows(lang, vocabulary, level[0], *level[1::2])

    return run


def frequencies(documents: DataFrame, least: int = 30, longest: int = 4, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Kept tables: (lang, phrase, size, f) of all phrases of 2 to `longest` words that occur at least `least` times and of
    the words in them, and (lang, n), the number of all words of each language.

    Whole texts count, and every occurrence; phrases stay within pieces and texts. Hashes only tell which pairs to count:
    what is counted is told apart by its words.
    """
    small_batches(documents)
    spark = documents.sparkSession
    shards = shards_of(documents, text, lang, longest)
    words = keep(shards.groupBy("lang").agg(F.sum("words").alias("n")))
    opened = shards.drop("words")

    def frequent(counts: DataFrame, *by: str) -> DataFrame:
        return keep(counts.groupBy(*by).agg(F.sum("f").alias("f")).filter(F.col("f") >= least))

    pairs = frequent(opened.mapInArrow(_hashed((2,)), "h int, f bigint"), "h")
    bits = _filter_of(pairs.select("h"))
    if longest > 2:
        sent = spark.sparkContext.broadcast(bits)
        more = frequent(opened.mapInArrow(_hashed(tuple(range(3, longest + 1)), sent), "h int, f bigint"), "h")
        sent.destroy()
        bits = bits | _filter_of(more.select("h"))
        drop(more)
    sent = spark.sparkContext.broadcast(bits)
    long = frequent(opened.mapInArrow(_phrases(longest, sent), _COUNTS), "lang", "phrase", "size")
    sent.destroy()
    inside = keep(long.select("lang", F.explode(F.split("phrase", " ")).alias("phrase")).distinct())
    short = frequent(opened.mapInArrow(_words, _COUNTS), "lang", "phrase", "size")
    short = keep(short.join(sized(inside), ["lang", "phrase"], "left_semi"))
    every = keep(short.select(*long.columns).unionByName(long))
    drop(shards, pairs, long, inside, short)
    return every, words


def scored(freq: DataFrame, scale: int = 2_000_000) -> DataFrame:
    """(lang, phrase, size, a, k, l, r, score) of all phrases of two words or more of a kept table of frequencies, cut in two
    where the score is lowest (then at the smallest k)."""
    words = F.split("phrase", " ")
    cuts = freq.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cuts = cuts.withColumn("first", part(F.lit(1), F.col("k"))).withColumn("rest", part(F.col("k") + 1, F.col("size") - F.col("k"))).drop("words")
    for name, f in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(sized(freq).select("lang", F.col("phrase").alias(name), F.col("f").alias(f)), ["lang", name])
    # Decimals, as products and sums may pass 64 bits.
    score = F.expr(f"(cast(a as decimal(20,0)) * cast({scale} as decimal(10,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "size", "a", "cut.k", "cut.l", "cut.r", "cut.score")


def uncovered(candidates: DataFrame, percent: int = 80) -> DataFrame:
    """candidates (lang, phrase, size, a, ...) without those that lie inside a longer one of at least that share of their frequency."""
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda at: F.array_join(F.slice(words, at, n), " "))))
    longer = candidates.filter("size > 2").select("lang", F.col("a").alias("most"), F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    kept = candidates.join(longer, ["lang", "phrase"], "left")
    return kept.filter(F.col("most").isNull() | (100 * F.col("most").cast("decimal(20,0)") < percent * F.col("a").cast("decimal(20,0)"))).drop("most")


def mine(documents: DataFrame, top: int = 2000, least: int = 30, longest: int = 4, text: str = "text", lang: str = "lang") -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score, by score and frequency (descending), then the phrase.

    Null languages are `und`, null and empty texts have no words, texts of any length are read whole; equal rows count as
    often as they are given. Only the named columns are read; an empty table, or one without frequent phrases, gives an
    empty one.
    """
    freq, words = frequencies(documents, least, longest, text, lang)
    found = keep(scored(freq))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each part first, so that no task ranks a whole language.
    parts = uncovered(found).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    best = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
