"""Exact search for repeated windows: a depth-limited most-significant-digit radix sort of suffixes.

A text is a sequence of tokens: its bytes (``BYTES``), by which repeated windows are removed, or its lower-cased words
(``WORDS``), by which passages are found that documents share.

Two suffixes matter only as far as their first ``length`` tokens agree, so they are ordered by digits of growing reach
and a group of one is dropped after each digit. To sort all suffixes of a large corpus would move many times its size;
each window of ``length`` tokens is therefore represented by one anchor, the least hash of its strings of ``gram`` tokens
(a choice made from the window's content alone, so equal windows have equal anchors at equal places):

1. first digit: the anchor's own tokens. Anchors whose digit occurs once are done: no window of theirs repeats;
2. the whole reach of the anchor, all windows that hold it. Where that repeats, all of them repeat;
3. windows of the rest go in cells of ``CELL`` neighbours. The tokens common to a cell's windows are the next digit (once:
   none repeats), the tokens under any of them the whole cell (repeated: all repeat);
4. cells still open are ordered to full depth, window by window. Equal groups are the repeated windows.

Groups are only counted (with partial sums before each shuffle) and the repeated digits joined back, so no task ever
holds a group, however large. Digits are 64-bit hashes paired with the anchor's, 128 bits together.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.store import drop, keep, sized, small_batches
from terrasift.llm.textops import CHUNK, CODES, SPACED, prefix, signed, sliding_min, stretch, texts_of, word_hashes

CELL = 20
_LOW = (1 << 20) - 1


class Tokens(NamedTuple):
    """What texts consist of: how many make up a first digit, texts as arrays of tokens, and tokens as 64-bit codes."""

    gram: int
    sequences: Callable[[list[bytes]], list[np.ndarray]]
    codes: Callable[[np.ndarray], np.ndarray]


def _words(texts: list[bytes]) -> list[np.ndarray]:
    hashes, at = word_hashes(texts, SPACED)
    return [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


BYTES = Tokens(32, lambda texts: [np.frombuffer(t, np.uint8) for t in texts], lambda x: CODES[x])
WORDS = Tokens(8, _words, lambda x: x)


def _segments(text: np.ndarray, length: int):
    """(start of the windows, end of the windows, offset of the tokens, tokens): long texts in parts that hold what their
    windows' anchors reach."""
    n, step = len(text) - length + 1, CHUNK // 2
    for a in range(0, n, step):
        b = min(a + step, n)
        lo = max(0, a - length)
        yield a, b, lo, text[lo : b + 2 * length]


def _anchors(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, kind: Tokens):
    """Anchors of the windows of texts that lie one after another in data; first and last: each token's text's ends."""
    p = prefix(kind.codes(data))
    at = np.arange(len(data) - kind.gram + 1)
    gram = stretch(p, at, at + kind.gram)
    chosen = (sliding_min((gram & ~np.uint64(_LOW)) | at.astype(np.uint64), length - kind.gram + 1) & np.uint64(_LOW)).astype(np.int64)
    start = np.arange(len(chosen))
    whole = last[start] >= start + length
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (first[start[1:]] != first[start[:-1]]) | ~whole[:-1]
    begin = np.flatnonzero(new & whole)
    if not len(begin):
        return None
    bounds = np.flatnonzero(np.diff(np.concatenate((whole & ~new, [False])).astype(np.int8)) == -1)
    ends = begin.copy()
    k = np.searchsorted(begin, bounds, "right") - 1
    ends[k] = bounds
    pos = chosen[begin]
    lo = np.maximum(pos - (length - kind.gram), first[pos])
    hi = np.minimum(pos + length, last[pos])
    reach = stretch(p, lo, hi) ^ ((pos - lo).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return pos, pos - ends, pos - begin, gram[pos], reach


def _chunks(texts: list[np.ndarray], length: int):
    """Yield (rows, starts, data, first, last, window ends): short texts together, long ones in parts."""
    rows, parts, size = [], [], 0

    def joined():
        sizes = np.array([len(x) for x in parts])
        ends = np.cumsum(sizes)
        return np.array(rows), ends - sizes, np.concatenate(parts), np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)

    for i, text in enumerate(texts):
        if length <= len(text) <= CHUNK:
            if parts and size + len(text) > CHUNK:
                yield joined()
                rows, parts, size = [], [], 0
            rows.append(i)
            parts.append(text)
            size += len(text)
    if parts:
        yield joined()


def anchors_of(texts: list[np.ndarray], length: int, kind: Tokens = BYTES) -> dict[str, np.ndarray]:
    """Columns row, pos, jlo, jhi, gram, reach for all anchors; jlo to jhi: how far before pos its windows start."""
    out = []
    for rows, starts, data, first, last in _chunks(texts, length):
        got = _anchors(data, first, last, length, kind)
        if got:
            k = np.searchsorted(starts, got[0], "right") - 1
            out.append((rows[k], got[0] - starts[k], *got[1:]))
    for i, text in enumerate(texts):
        if len(text) > CHUNK and len(text) >= length:
            found = []
            for a, b, lo, part in _segments(text, length):
                got = _anchors(part, np.zeros(len(part), np.int64), np.full(len(part), len(part)), length, kind)
                if got:
                    pos, jlo, jhi, gram, reach = got
                    jlo, jhi = np.maximum(jlo, pos + lo - (b - 1)), np.minimum(jhi, pos + lo - a)
                    ok = jlo <= jhi
                    found.append(((pos + lo)[ok], jlo[ok], jhi[ok], gram[ok], reach[ok]))
            # An anchor whose windows lie in several segments was found in each, but is one place.
            pos, jlo, jhi, gram, reach = (np.concatenate(x) for x in zip(*found, strict=True))
            begin = np.flatnonzero(np.diff(pos, prepend=-1))
            out.append((np.full(len(begin), i), pos[begin], np.minimum.reduceat(jlo, begin), np.maximum.reduceat(jhi, begin), gram[begin], reach[begin]))
    names = ("row", "pos", "jlo", "jhi", "gram", "reach")
    if not out:
        return {n: np.zeros(0, np.uint64 if n in ("gram", "reach") else np.int64) for n in names}
    return {n: np.concatenate(x) for n, x in zip(names, zip(*out, strict=True), strict=True)}


def _cells(text: np.ndarray, pos: np.ndarray, jlo: np.ndarray, jhi: np.ndarray, length: int, width: int, kind: Tokens):
    """For cells of `width` windows: their anchor's place and first digit, their own place, and the two digits.

    A cell is cut at the text's ends. A long text is worked on in parts, each with what its cells reach."""
    if len(text) <= CHUNK:
        return _cells_of(text, 0, len(text), pos, jlo, jhi, length, width, kind)
    found = []
    for a in range(0, len(text), CHUNK // 2):
        own = (pos >= a) & (pos < a + CHUNK // 2)
        if own.any():
            lo = max(0, a - length)
            found.append(_cells_of(text[lo : a + CHUNK // 2 + 2 * length], lo, len(text), pos[own], jlo[own], jhi[own], length, width, kind))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _cells_of(text: np.ndarray, lo: int, total: int, pos: np.ndarray, jlo: np.ndarray, jhi: np.ndarray, length: int, width: int, kind: Tokens):
    """text: the tokens from place lo on of a text of `total` tokens."""
    p = prefix(kind.codes(text))
    first, count = jlo // width, jhi // width - jlo // width + 1
    k = np.repeat(np.arange(len(pos)), count)
    cell = first[k] + np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
    low, high = cell * width, np.minimum(cell * width + width - 1, length - kind.gram)
    j1, j0 = np.minimum(high, pos[k]), np.maximum(low, length - (total - pos[k]))
    ok = j0 <= j1
    k, cell, low, high, j0, j1 = k[ok], cell[ok], low[ok], high[ok], j0[ok], j1[ok]
    at = pos[k]
    a, b = at - j1, at - j0
    # The common tokens are those of the uncut cell: any window of it has them, so once means none of its windows repeats.
    core = stretch(p, at - low - lo, at - high + length - lo) ^ (cell.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    whole = stretch(p, a - lo, b + length - lo) ^ ((j0 * 1024 + j1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return at, stretch(p, at - lo, at - lo + kind.gram), a, b, core, whole


def _listed(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (doc_id, rk, text) that have items, with their anchors: pos, jlo and jhi packed into one number each."""
    packed = (F.col("pos") * 1024 + F.col("jlo")) * 1024 + F.col("jhi")
    by_doc = keep(items.groupBy("doc_id", "rk").agg(F.collect_set(packed).alias("items")))
    joined = docs.join(sized(by_doc).withColumnsRenamed({"doc_id": "_d", "rk": "_r"}), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("rk") == F.col("_r")))
    return joined.select("doc_id", "rk", "text", "items")


def repeated_spans(documents: DataFrame, length: int = 400, text: str = "text", key: str = "doc_id", kind: Tokens = BYTES, across: bool = False) -> DataFrame:
    """Spans (doc_id, rk, lo, hi; they overlap) of tokens in windows of `length` tokens that start at another place too or,
    with across, in another document.

    rk tells rows of one key apart by their text; equal rows share it and, as all occurrences are treated alike, their
    spans. Texts that are null or shorter than `length` have none; an empty table gives an empty one. Texts of any length
    are read whole, in parts.
    """
    small_batches(documents)
    if length < 2 * kind.gram or length - kind.gram >= 1024:
        raise ValueError(f"length must be from {2 * kind.gram} to {1023 + kind.gram}")
    docs = _docs(documents, text, key)
    # Equal rows of one document are one document, others are told apart by rk.
    repeated = (F.min("rk") != F.max("rk")) if across else (F.count("*") > 1)

    def several_of(items: DataFrame, *digits: str) -> DataFrame:
        return items.groupBy(*digits).agg(repeated.alias("c")).filter("c").drop("c")

    def sample_of(items: DataFrame, digits: list[str], member: list[str], *more) -> DataFrame:
        """One member of each group; two, of different documents, if these count."""
        ends = [F.min(F.struct("rk", *member)), F.max(F.struct("rk", *member))][: 2 if across else 1]
        rows = items.groupBy(*digits).agg(F.array(*ends).alias("m"), *more)
        return rows.withColumn("m", F.explode("m"))

    def first_digits(batches):
        for batch in batches:
            texts = texts_of(batch.column(2))
            for x in range(0, len(texts), 512):
                own = kind.sequences(texts[x : x + 512])
                c = anchors_of(own, length, kind)
                take = pa.array(c["row"] + x)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(c["pos"], pa.int64()), pa.array(c["jlo"], pa.int32()), pa.array(c["jhi"], pa.int32()), pa.array(signed(c["gram"])), pa.array(signed(c["reach"])), pa.array(np.array([len(t) for t in own], np.int64)[c["row"]])], names=["doc_id", "rk", "pos", "jlo", "jhi", "g", "u", "n"])

    anchors = keep(docs.mapInArrow(first_digits, f"doc_id {dict(docs.dtypes)['doc_id']}, rk bigint, pos bigint, jlo int, jhi int, g bigint, u bigint, n bigint"))
    # Repeated digits are written before they are joined back: a join of two tables can be split where a digit is frequent.
    several = keep(several_of(anchors, "g"))
    held = keep(anchors.join(several, "g", "left_semi"))
    drop(anchors)
    same = keep(several_of(held, "g", "u").withColumn("full", F.lit(True)))
    told = keep(held.join(same, ["g", "u"], "left"))
    drop(held, several, same)
    spans = [told.filter("full").select("doc_id", "rk", F.greatest(F.col("pos") - (length - kind.gram), F.lit(0)).alias("lo"), F.least(F.col("pos") + length, F.col("n")).alias("hi"))]

    id_type = dict(docs.dtypes)["doc_id"]
    # Beside the open ones, one member of each group that is settled counts on, as their windows may equal its windows.
    asked = told.filter("full is null").select("doc_id", "rk", "pos", "jlo", "jhi", "g")
    settled = keep(sample_of(told.filter("full"), ["g", "u"], ["doc_id", "pos"], F.min("jlo").alias("jlo"), F.max("jhi").alias("jhi")))
    settled = settled.join(keep(asked.select("g").distinct()), "g", "left_semi")
    asked = asked.unionByName(settled.select("m.doc_id", "m.rk", "m.pos", "jlo", "jhi", "g"))
    for width in (CELL, 1):

        def digits(batches, width=width):
            names = ["doc_id", "rk", "pos", "g", "a", "b", "core", "whole"]
            for batch in batches:
                rows, cols, size = [], [], 0
                for i in range(batch.num_rows):
                    [body] = kind.sequences(texts_of(batch.column(2).slice(i, 1)))
                    items = batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                    pos, gram, a, z, core, whole = _cells(body, items >> 20, items >> 10 & 1023, items & 1023, length, width, kind)
                    rows.append(np.full(len(pos), i))
                    cols.append((pos, signed(gram), a, z, signed(core), signed(whole)))
                    size += len(pos)
                    if size > 50_000 or i == batch.num_rows - 1:
                        take = pa.array(np.concatenate(rows))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(np.concatenate(c)) for c in zip(*cols, strict=True))], names=names)
                        rows, cols, size = [], [], 0

        cells = keep(_listed(docs, asked).mapInArrow(digits, f"doc_id {id_type}, rk bigint, pos bigint, g bigint, a bigint, b bigint, core bigint, whole bigint"))
        core = keep(several_of(cells, "g", "core"))
        if width == 1:
            spans.append(cells.join(core, ["g", "core"], "left_semi").select("doc_id", "rk", F.col("a").alias("lo"), (F.col("b") + length).alias("hi")))
            break
        open_ = keep(cells.join(core, ["g", "core"], "left_semi"))
        drop(cells, core)
        whole = keep(several_of(open_, "g", "whole").withColumn("full", F.lit(True)))
        cells = keep(open_.join(whole, ["g", "whole"], "left"))
        drop(open_, whole)
        spans.append(cells.filter("full").select("doc_id", "rk", F.col("a").alias("lo"), (F.col("b") + length).alias("hi")))
        still = cells.filter("full is null")
        settled = keep(sample_of(cells.filter("full"), ["g", "core", "whole"], ["doc_id", "pos", "a", "b"]))
        settled = settled.join(keep(still.select("g", "core").distinct()), ["g", "core"], "left_semi").select("m.*", "g").select("doc_id", "rk", "pos", "a", "b", "g")
        asked = still.select("doc_id", "rk", "pos", "a", "b", "g").unionByName(settled).select("doc_id", "rk", "pos", (F.col("pos") - F.col("b")).alias("jlo"), (F.col("pos") - F.col("a")).alias("jhi"), "g")
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


def _docs(documents: DataFrame, text: str, key: str) -> DataFrame:
    return documents.select(F.col(f"`{key}`").alias("doc_id"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("rk"), F.col(f"`{text}`").alias("text"))


def merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans; runs that touch are one."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate(([True], lo[1:] > hi[:-1]))
    return lo[new], hi[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(lo) - 1]))]


def merged_spans(spans: DataFrame) -> DataFrame:
    """Kept table (_d, _r, runs) of the maximal runs [lo, hi, lo, hi, ...] of each document's spans."""
    packed = spans.groupBy(F.col("doc_id").alias("_d"), F.col("rk").alias("_r")).agg(F.collect_set(F.col("lo") * 4096 + F.col("hi") - F.col("lo")).alias("spans"))

    def runs(batches):
        for b in batches:
            merged = []
            for own in b.column(2):
                own = own.values.to_numpy(zero_copy_only=False)
                merged.append(np.stack(merge(own >> 12, (own >> 12) + (own & 4095)), 1).ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(merged, pa.list_(pa.int64()))], names=["_d", "_r", "runs"])

    return keep(packed.mapInArrow(runs, f"_d {dict(packed.dtypes)['_d']}, _r bigint, runs array<bigint>"))


def dedup(documents: DataFrame, length: int = 400, text: str = "text", key: str = "doc_id", words: int | None = None) -> DataFrame:
    """One row per document: doc_id, kept_text binary (the bytes left), spans array<struct<lo, hi>> of what was removed, n_bytes,
    n_shared_words: how many of its words are in a window of `words` words that another document has too (null without words).

    A null text counts as empty. Rows are never dropped; repeated rows come back as often as they were given, and all copies
    of a window are treated alike, so there are no ties. Only the key and the text are read, whatever else there is; an
    empty table gives an empty one.
    """
    small_batches(documents)
    docs = _docs(documents, text, key)
    by_doc = merged_spans(repeated_spans(documents, length, text, key)).withColumn("shared", F.lit(None).cast("array<bigint>"))
    if words:
        shared = merged_spans(repeated_spans(documents, words, text, key, WORDS, across=True)).withColumnsRenamed({"runs": "shared", "_d": "_e", "_r": "_s"})
        both = by_doc.drop("shared").join(shared, F.col("_d").eqNullSafe(F.col("_e")) & (F.col("_r") == F.col("_s")), "full")
        by_doc = both.select(F.coalesce("_d", "_e").alias("_d"), F.coalesce("_r", "_s").alias("_r"), "runs", "shared")
    covered = F.aggregate("shared", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("lo")), lambda a, x: F.struct(F.when(a.lo < 0, a.n).otherwise(a.n + x - a.lo).alias("n"), F.when(a.lo < 0, x).otherwise(F.lit(-1).cast("long")).alias("lo")), lambda a: a.n)
    by_doc = keep(by_doc.select("_d", "_r", "runs", covered.alias("n_shared")))
    joined = docs.join(sized(by_doc), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("rk") == F.col("_r")), "left")
    joined = joined.select("doc_id", "text", "runs", F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared") if words else F.lit(None).cast("long").alias("n_shared"))
    span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def cut(batches):
        for batch in batches:
            for x in range(0, batch.num_rows, 256):
                b = batch.slice(x, 256)
                kept, cuts, sizes = [], [], []
                for i, body in enumerate(texts_of(b.column(1))):
                    own = b.column(2)[i].values.to_numpy(zero_copy_only=False) if b.column(2)[i].is_valid else np.zeros(0, np.int64)
                    lo, hi = own[::2], own[1::2]
                    at, left = 0, []
                    for s, e in zip(lo, hi, strict=True):
                        left.append(body[at:s])
                        at = e
                    kept.append(b"".join(left) + body[at:])
                    cuts.append([{"lo": int(s), "hi": int(e)} for s, e in zip(lo, hi, strict=True)])
                    sizes.append(len(body))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), pa.array(cuts, span), pa.array(sizes, pa.int64()), b.column(3)], names=["doc_id", "kept_text", "spans", "n_bytes", "n_shared_words"])

    return joined.mapInArrow(cut, f"doc_id {dict(docs.dtypes)['doc_id']}, kept_text binary, spans array<struct<lo: bigint, hi: bigint>>, n_bytes bigint, n_shared_words bigint")
