"""Drainage of a bounded elevation grid in numpy: filled surface, receivers, accumulation, basins.

Grids of any size are tables of cells: see operators.raster, which has the same rules.
"""

from __future__ import annotations

import heapq

import numpy as np

#: The least step of a filled surface towards its outlet, and the height of cells without one.
STEP, NONE = 1e-4, -1e6
AROUND = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]


def raised(z: np.ndarray, level: np.ndarray, step: float = STEP) -> np.ndarray:
    """The least surface that lies nowhere under z and from each cell of which one can go down to a place with a level.

    level: heights that water leaves at, inf elsewhere; they count as given. Cells are taken in order of height; one that is
    reached from a cell as high or higher comes to lie a step above it."""
    out, heap = level.copy(), []
    done = np.isfinite(level)
    rows, cols = z.shape
    for r, c in np.argwhere(done).tolist():
        heap.append((out[r, c], r, c))
    heapq.heapify(heap)
    while heap:
        now, r, c = heapq.heappop(heap)
        if now > out[r, c]:
            continue
        for dr, dc in AROUND:
            y, x = r + dr, c + dc
            if 0 <= y < rows and 0 <= x < cols:
                new = z[y, x] if z[y, x] > now else now + step
                if new < out[y, x]:
                    out[y, x] = new
                    heapq.heappush(heap, (new, y, x))
    return out


def filled(z: np.ndarray, step: float = STEP) -> np.ndarray:
    """z with its sinks raised to where they spill over; water leaves at the grid's edge, cells without height lie lowest."""
    z = np.where(np.isnan(z), NONE, z)
    level = np.full(z.shape, np.inf)
    for edge in (np.s_[0], np.s_[-1], np.s_[:, 0], np.s_[:, -1]):
        level[edge] = z[edge]
    return raised(z, level, step)


def receivers(z: np.ndarray) -> np.ndarray:
    """For each cell the place (row by row) of its neighbour of steepest descent, the first of equal ones; -1 for none."""
    best, to = np.zeros(z.shape), np.full(z.shape, -1)
    p = np.pad(z, 1, constant_values=np.inf)
    at = np.pad(np.arange(z.size).reshape(z.shape), 1, constant_values=-1)
    for dr, dc in AROUND:
        near = (slice(1 + dr, 1 + dr + z.shape[0]), slice(1 + dc, 1 + dc + z.shape[1]))
        drop = (z - p[near]) / np.hypot(dr, dc)
        more = drop > best
        best[more], to[more] = drop[more], at[near][more]
    return to.ravel()


class Flow:
    def __init__(self, z: np.ndarray):
        self.shape = z.shape
        surface = filled(z)
        self.to = receivers(surface)
        #: Cells from the lowest to the highest: a receiver comes before what flows to it.
        self.order = np.argsort(surface, axis=None, kind="stable")
        acc = np.ones(z.size)
        for i in self.order[::-1].tolist():
            if self.to[i] >= 0:
                acc[self.to[i]] += acc[i]
        #: Cells that drain through each cell, itself included.
        self.accumulation = acc.reshape(z.shape)

    def snap(self, r: int, c: int, n: int) -> tuple[int, int]:
        """The cell of greatest accumulation within n rows and columns, the first of equal ones."""
        r0, c0 = max(0, r - n), max(0, c - n)
        near = self.accumulation[r0 : r + n + 1, c0 : c + n + 1]
        y, x = np.unravel_index(np.argmax(near), near.shape)
        return r0 + int(y), c0 + int(x)

    def basin(self, r: int, c: int) -> np.ndarray:
        """The cells that drain to a cell, itself included."""
        out = np.zeros(self.to.size, bool)
        out[r * self.shape[1] + c] = True
        for i in self.order.tolist():
            if self.to[i] >= 0 and out[self.to[i]]:
                out[i] = True
        return out.reshape(self.shape)
