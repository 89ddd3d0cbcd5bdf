import numpy as np
import pytest

from terrasift.functions import expressions as X
from terrasift.functions import flow, mask
from terrasift.functions import geometry as G
from terrasift.operators import raster


def slow_filled(z):
    """Raise cells to what their lowest neighbour asks for until nothing changes."""
    out = np.full(z.shape, np.inf)
    for r, c in np.ndindex(z.shape):
        if r in (0, z.shape[0] - 1) or c in (0, z.shape[1] - 1):
            out[r, c] = z[r, c]
    while True:
        before = out.copy()
        for r, c in np.ndindex(z.shape):
            for dr, dc in flow.AROUND:
                if 0 <= r + dr < z.shape[0] and 0 <= c + dc < z.shape[1]:
                    low = out[r + dr, c + dc]
                    out[r, c] = min(out[r, c], z[r, c] if z[r, c] > low else low + flow.STEP)
        if (out == before).all():
            return out


def steepest(z, r, c):
    best, to = 0.0, None
    for dr, dc in flow.AROUND:
        y, x = r + dr, c + dc
        if 0 <= y < z.shape[0] and 0 <= x < z.shape[1] and (z[r, c] - z[y, x]) / np.hypot(dr, dc) > best:
            best, to = (z[r, c] - z[y, x]) / np.hypot(dr, dc), (y, x)
    return to


def valley(seed, n=24):
    r = np.random.default_rng(seed)
    y, x = np.indices((n, n))
    z = 100 + y * 0.4 + abs(x - n // 2 + 3 * np.sin(y / 4)) * 1.2 + r.normal(0, 1.5, (n, n))
    return np.round(z, 1)


@pytest.mark.parametrize("seed", range(5))
def test_against_walking_down(seed):
    z = valley(seed)
    f = flow.Flow(z)
    surface = slow_filled(z)
    assert (flow.filled(z) == surface).all()
    through, ends = np.zeros(z.shape), {}
    for r, c in np.ndindex(z.shape):
        at, path = (r, c), []
        while at:
            path.append(at)
            through[at] += 1
            at = steepest(surface, *at)
        ends[r, c] = set(path)
    assert (f.accumulation == through).all()
    place = f.snap(3, 12, 4)
    window = through[0:8, 8:17]
    assert through[place] == window.max()
    basin = f.basin(*place)
    assert basin.sum() == through[place] and all(basin[k] == (place in ends[k]) for k in ends)
    # The expression has the outline of the same cells.
    dem = X.Dem(z, 50.0, 70.0, 10.0)
    shape = X.Context(dems={"dem": dem}).geom({"watershed": {"pour_point": [50 + 125, 70 + 35], "snap_m": 40}})
    assert G.area(shape) == pytest.approx(100 * basin.sum())
    assert (dem.inside(shape) == basin).all()


def test_cells_without_height_lie_lowest():
    z = np.full((6, 6), 5.0)
    z[2, 2] = np.nan
    z[0, 3] = np.nan
    surface = flow.filled(z)
    assert surface[0, 3] == flow.NONE and surface[2, 2] > 5
    f = flow.Flow(z)
    assert f.to[1 * 6 + 3] == 3 and f.to[3] == -1


@pytest.mark.parametrize("seed", range(60))
def test_outlines(seed):
    r = np.random.default_rng(seed)
    m = r.random(r.integers(1, 14, 2)) < r.random()
    shapes = mask.polygons(m)
    y, x = np.indices(m.shape) + 0.5
    assert (G.area(("polygon", shapes)) if shapes else 0) == pytest.approx(m.sum())
    if shapes:
        assert (G.contains(("polygon", shapes), np.stack((x, y), -1).reshape(-1, 2)).reshape(m.shape) == m).all()
    for p in shapes:
        for k, ring in enumerate(p):
            # Closed, no point twice, corners only, the outer ring against the clock and holes with it.
            assert (ring[0] == ring[-1]).all() and len(set(map(tuple, ring.tolist()))) == len(ring) - 1
            step = np.sign(np.diff(ring, axis=0))
            assert (step != np.roll(step, 1, 0)).any(1).all()
            assert (mask.area(ring) > 0) == (k == 0)
    assert len(shapes) == len(np.unique(mask.label(m)[m]))


def test_outlines_that_touch_themselves():
    ring = np.array([[1, 1, 1, 0], [1, 0, 1, 0], [1, 1, 0, 1], [0, 0, 1, 1]], bool)
    assert [len(p) for p in mask.polygons(ring)] == [1 + 1, 1]
    two = np.ones((4, 4), bool)
    two[1, 1] = two[2, 2] = False
    assert [len(p) for p in mask.polygons(two)] == [3]


def test_squares_against_one_flood(spark):
    """A basin that spills through many squares, and holes in the raster."""
    r = np.random.default_rng(7)
    z = np.round(50 - 0.4 * np.minimum.outer(np.arange(46), np.arange(38)) + r.normal(0, 4, (46, 38)), 1)
    z[10:30, 8:30] -= 40
    gone = r.random(z.shape) < 0.004
    rows = [(name, int(a), int(b), float(z[a, b])) for name in ("x", "y") for a, b in np.argwhere(~gone if name == "y" else z < 1e9)]
    df = spark.createDataFrame(rows, "raster string, r int, c int, z double")
    keep = lambda d: spark.createDataFrame(d.collect(), d.schema)
    filled = keep(raster.fill(df, keep, side=8))
    got = {name: np.full(z.shape, np.nan) for name in "xy"}
    for x in filled.collect():
        got[x.raster][x.r, x.c] = x.z
    assert (got["x"] == flow.filled(z)).all()
    # Where cells are missing water leaves.
    level = np.full(z.shape, np.inf)
    p = np.pad(~gone, 1)
    for dr, dc in flow.AROUND:
        out = ~p[1 + dr : 47 + dr, 1 + dc : 39 + dc]
        level[out] = z[out]
    want = flow.raised(np.where(gone, np.inf, z), np.where(gone, np.inf, level))
    assert (got["y"][~gone] == want[~gone]).all() and np.isnan(got["y"][gone]).all()
    f = flow.Flow(z)
    tree = keep(raster.receivers(filled.filter("raster = 'x'")))
    through = raster.accumulate(tree, keep)
    assert all(f.accumulation[x.r, x.c] == x.through for x in through.collect())
    points = spark.createDataFrame([("x", "a", 20, 20), ("x", "b", 0, 0), ("x", "c", 45, 37)], "raster string, point string, r long, c long")
    assert {x.point: (x.r, x.c) for x in raster.snap(through, points, 6).collect()} == {"a": f.snap(20, 20, 6), "b": f.snap(0, 0, 6), "c": f.snap(45, 37, 6)}
