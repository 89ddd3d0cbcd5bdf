"""Vectorised hashing of bytes and words: numpy over chunks of many texts at once.

A prefix sum of byte codes times powers of an odd base, modulo 2**64, gives the hash of any stretch in O(1). Codes are
random 64-bit numbers and every result passes a mixing step, so that equal hashes mean equal strings but for chances of
about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 19
_rng = np.random.default_rng(20260101)
CODES = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def powers(n: int, base: int = BASE) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 4096)
        have = np.full(size, base % 2**64, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def inverse_powers(n: int) -> np.ndarray:
    return powers(n, pow(BASE, -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def prefix(values: np.ndarray) -> np.ndarray:
    """p with p[b] - p[a] the weighted sum of values[a:b]."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def stretch(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [a, b) under the prefix sums p; lengths are mixed in."""
    return mix((p[b] - p[a]) * inverse_powers(len(p))[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    n = len(a)
    full = np.full(-(-n // w) * w, np.iinfo(a.dtype).max, a.dtype)
    full[:n] = a
    rows = full.reshape(-1, w)
    left = np.minimum.accumulate(rows, 1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _pieces(text: bytes, word: np.ndarray):
    """Parts of at most CHUNK bytes, cut only between words (a longer word stays whole)."""
    at = 0
    while len(text) - at > CHUNK:
        seen = np.frombuffer(text, np.uint8, CHUNK, at)
        gaps = np.flatnonzero(~word[LOWER[seen]])
        if len(gaps):
            end = at + int(gaps[-1]) + 1
        else:
            rest = np.frombuffer(text, np.uint8, -1, at + CHUNK)
            gap = np.flatnonzero(~word[LOWER[rest]])
            end = at + CHUNK + (int(gap[0]) + 1 if len(gap) else len(rest))
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: list[bytes], word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, and offsets: the words of text i are hashes[offsets[i]:offsets[i + 1]]."""
    counts, found, parts, owners, size = np.zeros(len(texts) + 1, np.int64), [], [], [], 0

    def flush() -> None:
        data = LOWER[np.frombuffer(b" ".join(parts), np.uint8)]
        isword = np.zeros(len(data) + 2, np.int8)
        isword[1:-1] = word[data]
        edge = np.diff(isword)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        found.append(stretch(prefix(CODES[data]), start, end))
        ends = np.cumsum([len(x) + 1 for x in parts])
        per_part = np.diff(np.searchsorted(start, np.concatenate(([0], ends))))
        np.add.at(counts, np.array(owners) + 1, per_part)
        parts.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for part in _pieces(text, word):
            if parts and size + len(part) > CHUNK:
                flush()
                size = 0
            parts.append(part)
            owners.append(i)
            size += len(part) + 1
    if parts:
        flush()
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.cumsum(counts)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive word hashes (of one text)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    p, at = prefix(words), np.arange(len(words) - n + 1)
    return stretch(p, at, at + n)


def texts_of(column) -> list[bytes]:
    """UTF-8 of an Arrow string column; null is empty."""
    return [x or b"" for x in column.cast("binary").to_pylist()]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
