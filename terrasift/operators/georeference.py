"""Georeferencing beyond the affine fit: similarity and projective fits per figure, colour masks with components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.functions import geometry as G
from terrasift.functions import mask as masks

FIT = "figure string, kind string, params array<double>, rms double, max_error double, n int, check_rms double"


def similarity(uv: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """x = a u + b v + c, y = b u - a v + d: turn and scale of pixels that count downwards. At least two points."""
    u, v = uv.T
    one, zero = np.ones(len(u)), np.zeros(len(u))
    m = np.concatenate((np.stack((u, v, one, zero), 1), np.stack((-v, u, zero, one), 1)))
    return np.linalg.lstsq(m, np.concatenate(xy.T), rcond=None)[0]


def projective(uv: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Nine numbers of a homography by the singular vector of the normalised equations. At least four points."""

    def unit(p):
        c = p.mean(0)
        s = np.sqrt(2) / max(np.hypot(*(p - c).T).mean(), 1e-12)
        return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    a, b = unit(uv), unit(xy)
    p = (a @ np.column_stack((uv, np.ones(len(uv)))).T).T
    q = (b @ np.column_stack((xy, np.ones(len(xy)))).T).T
    rows = [r for (u, v, w), (x, y, _) in zip(p, q, strict=True) for r in ((u, v, w, 0, 0, 0, -x * u, -x * v, -x * w), (0, 0, 0, u, v, w, -y * u, -y * v, -y * w))]
    h = np.linalg.inv(b) @ np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3) @ a
    return (h / h[2, 2]).ravel()


def apply(kind: str, params: np.ndarray, uv: np.ndarray) -> np.ndarray:
    u, v = uv.T
    if kind == "similarity":
        a, b, c, d = params
        return np.stack((a * u + b * v + c, b * u - a * v + d), 1)
    if kind == "affine":
        ax, bx, cx, ay, by, cy = params
        return np.stack((ax + bx * u + cx * v, ay + by * u + cy * v), 1)
    h = np.asarray(params).reshape(3, 3)
    w = (h @ np.column_stack((uv, np.ones(len(uv)))).T).T
    return w[:, :2] / w[:, 2:]


_FITS: dict[str, tuple[int, Callable]] = {
    "similarity": (2, lambda uv, xy: similarity(uv * (1, 1), xy)),
    "affine": (3, lambda uv, xy: np.concatenate([np.linalg.lstsq(np.column_stack((np.ones(len(uv)), uv)), k, rcond=None)[0] for k in xy.T])),
    "projective": (4, projective),
}


def fit(points: DataFrame, kind: str) -> DataFrame:
    """A fit per figure from control points, errors at check points. points: figure, u, v, x, y, check. Too few controls give null
    parameters. A figure has few points and is one task's group."""
    least, solve = _FITS[kind]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        c, k = f[~f["check"]], f[f["check"]]
        row = {"figure": f["figure"].iloc[0], "kind": kind, "params": None, "rms": None, "max_error": None, "n": len(c), "check_rms": None}
        if len(c) >= least:
            params = solve(c[["u", "v"]].to_numpy(float), c[["x", "y"]].to_numpy(float))
            error = lambda g: np.hypot(*(apply(kind, params, g[["u", "v"]].to_numpy(float)) - g[["x", "y"]].to_numpy(float)).T)
            e = error(c)
            row |= {"params": params.tolist(), "rms": float(np.sqrt((e**2).mean())), "max_error": float(e.max()), "check_rms": float(np.sqrt((error(k) ** 2).mean())) if len(k) else None}
        return pd.DataFrame([row])

    return points.groupBy("figure").applyInPandas(run, FIT)


#: Cells along the side of a square of an image that one task labels at once.
TILE = 128


def _diamond(n: int) -> Column:
    return F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in range(-n, n + 1) for dc in range(-n, n + 1) if abs(dr) + abs(dc) <= n))


def dilate(cells: DataFrame, n: int, images: DataFrame) -> DataFrame:
    """image, r, c of all cells of the image (images: image, rows, cols) within n steps along rows and columns of a cell."""
    near = cells.select("image", "r", "c", F.explode(_diamond(n)).alias("s")).select("image", (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c")).distinct()
    return near.join(images, "image").filter("r >= 0 and c >= 0 and r < rows and c < cols").select("image", "r", "c")


def erode(cells: DataFrame, n: int) -> DataFrame:
    """image, r, c of cells of which all within n steps are there too; beyond an image there are none."""
    sent = cells.select("image", "r", "c", F.explode(_diamond(n)).alias("s")).select("image", (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"))
    return sent.groupBy("image", "r", "c").agg(F.count("*").alias("n")).filter(F.col("n") == 2 * n * (n + 1) + 1).select("image", "r", "c")


def cleaned(cells: DataFrame, images: DataFrame, open_px: int = 0, close_px: int = 0) -> DataFrame:
    """A mask opened, then closed."""
    if open_px:
        cells = dilate(erode(cells, open_px), open_px, images)
    return erode(dilate(cells, close_px, images), close_px) if close_px else cells


def components(mask: DataFrame, keep: Callable[[DataFrame], DataFrame], least: int = 1, diagonal: bool = True) -> DataFrame:
    """image, r, c, part of mask cells (image, r, c) in components of at least `least` cells; part is the least (r, c) of the
    component as r * 2**32 + c. Cells touch by their sides and, with diagonal, by their corners.

    Each square of TILE cells is labelled in a task of its own. What touches across the edges of squares are links between
    labels; along these the least label spreads, and jumps to what that one knows, until nothing changes: as many rounds as
    the logarithm of the longest chain of squares. keep(df) writes a round.
    """

    def label(f: pd.DataFrame) -> pd.DataFrame:
        r, c = f["r"].to_numpy(), f["c"].to_numpy()
        here = np.zeros((TILE, TILE), bool)
        here[r % TILE, c % TILE] = True
        first = masks.label(here, diagonal)[r % TILE, c % TILE]
        base = (r // TILE * TILE + first // TILE) << 32 | (c // TILE * TILE + first % TILE)
        return f[["image", "r", "c"]].assign(own=base)

    kind = dict(mask.dtypes)["image"]
    cells = mask.select("image", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct()
    tile = [F.floor(F.col("r") / TILE).alias("_r"), F.floor(F.col("c") / TILE).alias("_c")]
    own = keep(cells.groupBy("image", *tile).applyInPandas(label, f"image {kind}, r long, c long, own long"))
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if diagonal else [])]
    far = own.select("image", "r", "c", "own", F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in steps))).alias("s"))
    far = far.select("image", (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"), F.col("r").alias("r0"), F.col("c").alias("c0"), F.col("own").alias("u"))
    across = (F.floor(F.col("r") / TILE) != F.floor(F.col("r0") / TILE)) | (F.floor(F.col("c") / TILE) != F.floor(F.col("c0") / TILE))
    links = far.filter(across).join(own, ["image", "r", "c"]).select("image", "u", F.col("own").alias("v"))
    links = keep(links.union(links.select("image", F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    named = keep(links.select("image", "u").distinct().withColumn("part", F.col("u")))
    while not links.isEmpty():
        near = links.join(named.select("image", F.col("u").alias("v"), "part"), ["image", "v"]).groupBy("image", "u").agg(F.min("part").alias("low"))
        step = named.join(near, ["image", "u"]).select("image", "u", "part", F.least("part", "low").alias("to"))
        known = named.select("image", F.col("u").alias("to"), F.col("part").alias("far"))
        after = keep(step.join(known, ["image", "to"]).select("image", "u", F.least("to", "far").alias("new"), (F.least("to", "far") != F.col("part")).alias("moved")))
        named = after.select("image", "u", F.col("new").alias("part"))
        if after.filter("moved").isEmpty():
            break
    labelled = own.join(named.withColumnRenamed("u", "own"), ["image", "own"], "left").select("image", "r", "c", F.coalesce("part", "own").alias("part"))
    if least <= 1:
        return labelled
    big = labelled.groupBy("image", "part").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return labelled.join(big.select("image", "part"), ["image", "part"], "left_semi").select("image", "r", "c", "part")


def outlines(parts: DataFrame) -> DataFrame:
    """image, part, x0, y0, x1, y1: the sides of labelled cells (image, r, c, part) where their part ends, the part on the left
    (x to the right, y with the rows). Each square of TILE cells finds its own; those on the edge of a square go where the
    next one has them too."""

    def sides(f: pd.DataFrame) -> pd.DataFrame:
        r, c = f["r"].to_numpy(), f["c"].to_numpy()
        names, own = np.unique(f["part"].to_numpy(), return_inverse=True)
        here = np.full((TILE, TILE), -1)
        here[r % TILE, c % TILE] = own
        part, at, _ = masks.edges(here, int(r[0]) // TILE * TILE, int(c[0]) // TILE * TILE)
        return pd.DataFrame({"image": f["image"].iloc[0], "part": names[part], **{k: at[:, i] for i, k in enumerate(("x0", "y0", "x1", "y1"))}})

    kind = dict(parts.dtypes)["image"]
    tile = [F.floor(F.col("r") / TILE).alias("_r"), F.floor(F.col("c") / TILE).alias("_c")]
    found = parts.groupBy("image", *tile).applyInPandas(sides, f"image {kind}, part long, x0 long, y0 long, x1 long, y1 long")
    line = [F.least("x0", "x1").alias("_x"), F.least("y0", "y1").alias("_y"), (F.col("x0") == F.col("x1")).alias("_up")]
    once = found.groupBy("image", "part", *line).agg(F.count("*").alias("n"), F.first(F.struct("x0", "y0", "x1", "y1")).alias("side"))
    return once.filter("n = 1").select("image", "part", "side.*")


def mask_polygons(parts: DataFrame, transform: tuple[float, float, float, float, float, float] = (0, 1, 0, 0, 0, 1)) -> DataFrame:
    """image, part, n (cells), rings, geom: each part as one valid WKB geometry, outer rings with their holes, through the six
    numbers of an affine transform. A part's outline, not its cells, is gathered; it is the unit of the result. A part whose
    cells touch by corners only has several outer rings."""
    x0, dx, rx, y0, ry, dy = transform

    def link(f: pd.DataFrame) -> pd.DataFrame:
        found = masks.rings(f[["x0", "y0", "x1", "y1"]].to_numpy())
        n = round(sum(masks.area(ring) for p in found for ring in p))
        moved = [[np.stack((x0 + dx * ring[:, 0] + rx * ring[:, 1], y0 + ry * ring[:, 0] + dy * ring[:, 1]), 1) for ring in p] for p in found]
        return pd.DataFrame([(f["image"].iloc[0], f["part"].iloc[0], n, sum(map(len, found)), G.to_wkb(("polygon", moved)))], columns=["image", "part", "n", "rings", "geom"])

    return outlines(parts).groupBy("image", "part").applyInPandas(link, f"image {dict(parts.dtypes)['image']}, part long, n long, rings long, geom binary")
