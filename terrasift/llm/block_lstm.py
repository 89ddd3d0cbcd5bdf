"""A bidirectional LSTM in numpy that labels each block of a page as main text or not."""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np

from terrasift.llm.html_blocks import Block

PATH_DIM, WORD_DIM, EXTRA, HIDDEN = 192, 96, 8, 16
DIM = PATH_DIM + WORD_DIM + EXTRA
WEIGHTS = Path(__file__).with_name("block_lstm.npz")


class _Hashes(dict):
    """Places of strings, remembered."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        place = self[word] = zlib.crc32(word.lower().encode()) % self.dim
        return place


_words, _paths = _Hashes(WORD_DIM), _Hashes(PATH_DIM)


def features(pages: list[list[Block]]) -> np.ndarray:
    """A row per block, pages one after another: hashed path tokens (the last ones count more), hashed words as shares,
    and sizes, share of links, sentence ends, heading, place."""
    flat = [b for p in pages for b in p]
    n = len(flat)
    out = np.zeros((n, DIM), np.float32)
    words, rows, sizes = [], [], np.zeros(n)
    seen: dict[tuple[str, ...], np.ndarray] = {}
    for i, b in enumerate(flat):
        own = b.text.split(" ")
        sizes[i] = len(own)
        words.extend([_words[w] for w in own])
        if b.path not in seen:
            v = np.zeros(PATH_DIM, np.float32)
            for t in b.path:
                v[_paths[t]] = 1
            seen[b.path] = v
        out[i, :PATH_DIM] = seen[b.path]
        out[i, PATH_DIM + WORD_DIM :] = (0, 0, b.linked / max(1, len(b.text)), min(1.0, (b.text.count(". ") + b.text.endswith(".")) / 3), bool(b.path) and b.path[-1] in ("h1", "h2", "h3", "h4"), 0, len(b.path) / 10, 1)
    if n:
        rows = np.repeat(np.arange(n), sizes.astype(int))
        counts = np.bincount(rows * WORD_DIM + np.array(words, np.int64), minlength=n * WORD_DIM).reshape(n, WORD_DIM)
        out[:, PATH_DIM : PATH_DIM + WORD_DIM] = counts / np.maximum(sizes, 4)[:, None]
        out[:, PATH_DIM + WORD_DIM] = np.log1p(sizes) / 5
        out[:, PATH_DIM + WORD_DIM + 1] = sizes < 4
        ends = np.cumsum([len(p) for p in pages])
        place = np.arange(n) - np.repeat(ends - [len(p) for p in pages], [len(p) for p in pages])
        out[:, PATH_DIM + WORD_DIM + 5] = place / np.repeat([max(1, len(p)) for p in pages], [len(p) for p in pages])
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """params: for each direction Wx (DIM, 4H), Wh (H, 4H), b (4H); then Wo (2H,), bo. Gates in order i, f, o, g."""

    def __init__(self, params: dict[str, np.ndarray] | None = None, seed: int = 0):
        if params is None:
            r, h = np.random.default_rng(seed), HIDDEN
            params = {}
            for d in "fb":
                params[f"Wx{d}"] = r.standard_normal((DIM, 4 * h)) * 0.08
                params[f"Wh{d}"] = r.standard_normal((h, 4 * h)) * 0.15
                params[f"b{d}"] = np.concatenate((np.zeros(h), np.ones(h), np.zeros(2 * h)))
            params["Wo"], params["bo"] = r.standard_normal(2 * h) * 0.2, np.zeros(1)
        self.p = {k: np.asarray(v, np.float32) for k, v in params.items()}

    @classmethod
    def load(cls, path: Path = WEIGHTS) -> BlockLabeller:
        with np.load(path) as z:
            return cls({k: z[k].astype(np.float32) for k in z.files})

    def save(self, path: Path = WEIGHTS) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.p.items()})

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (T, B, H) of one direction over x (T, B, 4H, inputs already projected)."""
        steps, size, h = len(x), x.shape[1], HIDDEN
        out = np.zeros((steps, size, h), np.float32)
        hid, cell = np.zeros((size, h), np.float32), np.zeros((size, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = x[t] + hid @ self.p[f"Wh{d}"]
            g = np.empty_like(z)
            g[:, : 3 * h] = _sigmoid(z[:, : 3 * h])
            g[:, 3 * h :] = np.tanh(z[:, 3 * h :])
            new = g[:, h : 2 * h] * cell + g[:, :h] * g[:, 3 * h :]
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, g, cell, new, hid))
            cell = np.where(m, new, cell)
            hid = np.where(m, g[:, 2 * h : 3 * h] * np.tanh(new), hid)
            out[t] = hid
        return out

    def _padded(self, x: np.ndarray, lengths: np.ndarray):
        steps, size = int(lengths.max()), len(lengths)
        mask = np.arange(steps)[:, None] < lengths[None, :]
        b = np.repeat(np.arange(size), lengths)
        t = np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return steps, size, mask, t, b

    def logits(self, pages: list[list[Block]], cells: int = 16_384) -> list[np.ndarray]:
        """Log odds of each block of each page; pages of like length are run together, `cells` block places at a time."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            top = len(pages[order[-1]])
            take = max(1, cells // top)
            group, order = order[-take:], order[:-take]
            chosen = [pages[i] for i in group]
            scores = self._forward(features(chosen), np.array([len(p) for p in chosen]))
            at = 0
            for i, p in zip(group, chosen, strict=True):
                out[i] = scores[at : at + len(p)]
                at += len(p)
        return out

    def _forward(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        steps, size, mask, t, b = self._padded(x, lengths)
        score = np.full(len(x), self.p["bo"][0], np.float32)
        for k, d in enumerate("fb"):
            z = np.zeros((steps, size, 4 * HIDDEN), np.float32)
            z[t, b] = x @ self.p[f"Wx{d}"] + self.p[f"b{d}"]
            score += self._run(z, mask, d)[t, b] @ self.p["Wo"][k * HIDDEN : (k + 1) * HIDDEN]
        return score

    def gradients(self, x: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean logistic loss over blocks and its gradients, by back-propagation through time."""
        steps, size, mask, t, b = self._padded(x, lengths)
        h, kept, hidden = HIDDEN, {}, {}
        score = np.full(len(x), self.p["bo"][0], np.float32)
        for k, d in enumerate("fb"):
            z = np.zeros((steps, size, 4 * h), np.float32)
            z[t, b] = x @ self.p[f"Wx{d}"] + self.p[f"b{d}"]
            kept[d] = []
            hidden[d] = self._run(z, mask, d, kept[d])[t, b]
            score += hidden[d] @ self.p["Wo"][k * h : (k + 1) * h]
        prob = _sigmoid(score)
        loss = float(-np.mean(np.where(labels, np.log(prob + 1e-9), np.log(1 - prob + 1e-9))))
        error = (prob - labels) / len(x)
        grad = {"bo": np.array([error.sum()]), "Wo": np.concatenate([hidden[d].T @ error for d in "fb"])}
        for k, d in enumerate("fb"):
            out = np.zeros((steps, size, h), np.float32)
            out[t, b] = error[:, None] * self.p["Wo"][k * h : (k + 1) * h]
            dh, dc = np.zeros((size, h), np.float32), np.zeros((size, h), np.float32)
            dz = np.zeros((steps, size, 4 * h), np.float32)
            gwh = np.zeros_like(self.p[f"Wh{d}"])
            for s, g, before, new, hid in reversed(kept[d]):
                m = mask[s][:, None]
                dh = dh + out[s]
                tanh = np.tanh(new)
                here, dcell = np.where(m, dh, 0), np.where(m, dc, 0)
                dnew = dcell + here * g[:, 2 * h : 3 * h] * (1 - tanh**2)
                i, f, o, c = (g[:, q * h : (q + 1) * h] for q in range(4))
                step = np.concatenate((dnew * c * i * (1 - i), dnew * before * f * (1 - f), here * tanh * o * (1 - o), dnew * i * (1 - c**2)), axis=1)
                dz[s] = step
                gwh += hid.T @ step
                dh = np.where(m, step @ self.p[f"Wh{d}"].T, dh)
                dc = np.where(m, dnew * f, dc)
            flat = dz[t, b]
            grad |= {f"Wh{d}": gwh, f"Wx{d}": x.T @ flat, f"b{d}": flat.sum(0)}
        return loss, grad
