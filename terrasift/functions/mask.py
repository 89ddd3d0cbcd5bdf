"""Colour masks of bounded images in numpy: the rule language of predicates.color_rule, opening, closing and least parts.

Cells touch by their sides; beyond the image there is nothing, so opening and closing wear at its edge. Images of any size
are tables of cells: see operators.georeference.
"""

from __future__ import annotations

import ast
import operator

import numpy as np

_OPERATORS = {
    ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne,
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.BitAnd: np.logical_and, ast.BitOr: np.logical_or, ast.And: np.logical_and, ast.Or: np.logical_or,
    ast.USub: operator.neg, ast.Not: np.logical_not, ast.Invert: np.logical_not,
}


def hsv(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue from 0 to 360, saturation and value from 0 to 100."""
    r, g, b = np.moveaxis(rgb.astype(float), -1, 0)
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    span = top - low
    safe = np.where(span == 0, 1, span)
    hue = np.select([span == 0, top == r, top == g], [0.0, ((g - b) / safe) % 6, (b - r) / safe + 2], (r - g) / safe + 4) * 60
    return hue, np.where(top == 0, 0, span / np.where(top == 0, 1, top) * 100), top / 255 * 100


def rule(rgb: np.ndarray, text: str) -> np.ndarray:
    """Where the boolean expression over R, G, B, H, S, V and abs() holds; anything else in it is an error."""
    names = dict(zip("RGBHSV", (*np.moveaxis(rgb.astype(float), -1, 0), *hsv(rgb)), strict=True))

    def value(n):
        match n:
            case ast.Expression():
                return value(n.body)
            case ast.Name(id=name) if name in names:
                return names[name]
            case ast.Constant(value=int() | float() as v) if not isinstance(v, bool):
                return float(v)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _OPERATORS:
                return _OPERATORS[type(op)](value(a), value(b))
            case ast.UnaryOp(op=op, operand=a) if type(op) in _OPERATORS:
                return _OPERATORS[type(op)](value(a))
            case ast.BoolOp(op=op, values=parts):
                return np.logical_and.reduce([value(p) for p in parts]) if isinstance(op, ast.And) else np.logical_or.reduce([value(p) for p in parts])
            case ast.Compare(left=a, ops=ops, comparators=rest) if all(type(o) in _OPERATORS for o in ops):
                sides = [value(x) for x in (a, *rest)]
                return np.logical_and.reduce([_OPERATORS[type(o)](x, y) for o, x, y in zip(ops, sides[:-1], sides[1:], strict=True)])
            case ast.Call(func=ast.Name(id="abs"), args=[a], keywords=[]):
                return np.abs(value(a))
        raise ValueError(f"not allowed in a colour rule: {ast.dump(n)[:60]}")

    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as e:
        raise ValueError(f"not a colour rule: {text}") from e
    return np.broadcast_to(np.asarray(value(tree), bool), rgb.shape[:2]).copy()


def _moved(m: np.ndarray, empty):
    """The cells above, below, left and right of each."""
    p = np.pad(m, 1, constant_values=empty)
    return p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]


def dilate(m: np.ndarray, n: int) -> np.ndarray:
    for _ in range(n):
        m = np.logical_or.reduce((m, *_moved(m, False)))
    return m


def erode(m: np.ndarray, n: int) -> np.ndarray:
    for _ in range(n):
        m = np.logical_and.reduce((m, *_moved(m, False)))
    return m


def label(m: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """For each cell of the mask the number of the first cell (row by row) of its part, elsewhere -1."""
    none = m.size
    now = np.where(m, np.arange(m.size).reshape(m.shape), none)
    while True:
        near = [now, *_moved(now, none)]
        if diagonal:
            p = np.pad(now, 1, constant_values=none)
            near += [p[:-2, :-2], p[:-2, 2:], p[2:, :-2], p[2:, 2:]]
        low = np.where(m, np.minimum.reduce(near), none)
        # What a cell points to may know a lower one.
        low = np.where(m, np.minimum(low, np.append(low.ravel(), none)[low]), none)
        if (low == now).all():
            return np.where(m, now, -1)
        now = low


def colour_mask(rgb: np.ndarray, text: str, include: list | None = None, exclude: list | None = None, open_px: int = 0, close_px: int = 0, least: int = 1) -> np.ndarray:
    """Cells where the rule holds, inside one box and outside others (x0, y0, x1, y1), opened, closed, small parts left out."""
    m = rule(rgb, text)
    if include:
        x0, y0, x1, y1 = map(int, include)
        inside = np.zeros_like(m)
        inside[y0:y1, x0:x1] = True
        m &= inside
    for x0, y0, x1, y1 in exclude or []:
        m[int(y0) : int(y1), int(x0) : int(x1)] = False
    m = dilate(erode(m, open_px), open_px)
    m = erode(dilate(m, close_px), close_px)
    if least > 1 and m.any():
        part = label(m)
        kinds, counts = np.unique(part[m], return_counts=True)
        m &= np.isin(part, kinds[counts >= least])
    return m


def edges(part: np.ndarray, r0: int = 0, c0: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sides of cells (part: numbers, -1 for none) at which another part or none begins: part, (x0, y0, x1, y1) with the cell on
    the left, and whether the side lies on the array's own edge. Sides in line are one where they are inside the array."""
    p = np.pad(part, 1, constant_values=-1)
    found = []
    # Below, right, above, left of the cell: its neighbour, the first end of the side, the way along it.
    for dr, dc, x, y, dx, dy in ((-1, 0, 0, 0, 1, 0), (0, 1, 1, 0, 0, 1), (1, 0, 1, 1, -1, 0), (0, -1, 0, 1, 0, -1)):
        r, c = np.nonzero((part >= 0) & (p[1 + dr : p.shape[0] - 1 + dr, 1 + dc : p.shape[1] - 1 + dc] != part))
        if not len(r):
            continue
        own, rim = part[r, c], (r + dr < 0) | (r + dr >= part.shape[0]) | (c + dc < 0) | (c + dc >= part.shape[1])
        along, line = (c, r) if dx else (r, c)
        order = np.lexsort((along, line, own, rim))
        own, rim, r, c, along, line = (v[order] for v in (own, rim, r, c, along, line))
        new = np.ones(len(own), bool)
        new[1:] = rim[1:] | (own[1:] != own[:-1]) | (line[1:] != line[:-1]) | (along[1:] != along[:-1] + 1) | (rim[1:] != rim[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(own)) - 1
        if dx + dy < 0:
            first, last = last, first
        sides = np.stack((c[first] + x, r[first] + y, c[last] + x + dx, r[last] + y + dy), 1) + np.array([c0, r0, c0, r0])
        found.append((own[first], sides, rim[first]))
    if not found:
        return np.zeros(0, int), np.zeros((0, 4), int), np.zeros(0, bool)
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def rings(sides: np.ndarray) -> list[list[np.ndarray]]:
    """Polygons (closed rings, the outer one first) of a part's sides, the part on their left: no ring meets a point twice, and
    outer rings run against the clock where y points up."""
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x0, y0, x1, y1 in sides.tolist():
        after.setdefault((x0, y0), []).append((x1, y1))
    outer, holes = [], []
    while after:
        start = at = next(iter(after))
        path, way = [], (0, 0)
        while True:
            ways = after[at]
            # Where two parts of the mask touch in a point, the walk stays with the cell that it goes round: it turns left.
            k = max(range(len(ways)), key=lambda k: way[0] * (ways[k][1] - at[1]) - way[1] * (ways[k][0] - at[0]))
            to = ways.pop(k)
            if not ways:
                del after[at]
            step = (np.sign(to[0] - at[0]), np.sign(to[1] - at[1]))
            if step != way:
                path.append(at)
            at, way = to, step
            if at == start and at not in after:
                break
        # A point passed twice closes a ring of its own.
        seen: dict[tuple[int, int], int] = {}
        stack: list[tuple[int, int]] = []
        for point in [*path, start]:
            if point in seen:
                k = seen[point]
                loop = stack[k:]
                for q in stack[k + 1 :]:
                    del seen[q]
                del stack[k + 1 :]
                ring = _straight(np.array([*loop, point], float))
                (outer if area(ring) > 0 else holes).append(ring)
            else:
                seen[point] = len(stack)
                stack.append(point)
    polygons = [[ring] for ring in outer]
    for hole in holes:
        polygons[_around(hole, outer)].append(hole)
    return polygons


def area(ring: np.ndarray) -> float:
    """Of a closed ring; less than 0 where it runs with the clock."""
    return float((ring[:-1, 0] * ring[1:, 1] - ring[1:, 0] * ring[:-1, 1]).sum()) / 2


def _straight(ring: np.ndarray) -> np.ndarray:
    """A closed ring without points in the middle of a side."""
    p = ring[:-1]
    corner = (np.sign(p - np.roll(p, 1, 0)) != np.sign(np.roll(p, -1, 0) - p)).any(1)
    p = p[corner]
    return np.concatenate((p, p[:1]))


def _around(hole: np.ndarray, outer: list[np.ndarray]) -> int:
    """The smallest outer ring that holds the cell to the left of the hole's first side."""
    if len(outer) == 1:
        return 0
    (x0, y0), (x1, y1) = hole[:2]
    dx, dy = np.sign(x1 - x0), np.sign(y1 - y0)
    x, y = x0 + (dx - dy) / 2, y0 + (dx + dy) / 2
    found = []
    for k, ring in enumerate(outer):
        a, b = ring[:-1], ring[1:]
        up = (a[:, 0] == b[:, 0]) & (a[:, 0] > x) & ((a[:, 1] > y) != (b[:, 1] > y))
        if up.sum() % 2:
            found.append((area(ring), k))
    return min(found)[1]


def polygons(m: np.ndarray) -> list[list[np.ndarray]]:
    """The mask's cells as polygons: parts whose cells touch by their sides, x to the right and y with the rows."""
    part, sides, _ = edges(np.unique(label(m), return_inverse=True)[1].reshape(m.shape) - (0 if m.all() else 1))
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    return [p for own in np.split(sides[order], cuts) if len(own) for p in rings(own)]
