"""Masks, pictures and polygons beside lines against worked examples."""

import struct
import zlib

import numpy as np
import pytest

from terrasift.functions import geometry as G
from terrasift.functions import mask
from terrasift.operators import georeference
from terrasift.sources import connectors, tiles


def picture(pixels: np.ndarray, filters: list[int]) -> bytes:
    """An RGB picture as a PNG file with the given filter for each row."""
    h, w, d = pixels.shape
    p = np.zeros((h + 1, w + 1, d), int)
    p[1:, 1:] = pixels
    rows = b""
    for y, kind in zip(range(1, h + 1), filters, strict=True):
        line = []
        for x in range(1, w + 1):
            a, b, c = p[y, x - 1], p[y - 1, x], p[y - 1, x - 1]
            paeth = [min(((abs(i + j - k - s), n), s) for n, s in enumerate((i, j, k)))[1] for i, j, k in zip(a, b, c, strict=True)]
            line.append((p[y, x] - [0 * a, a, b, (a + b) // 2, np.array(paeth)][kind]) & 255)
        rows += bytes([kind]) + np.array(line, np.uint8).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_pictures_of_all_filters():
    pixels = np.random.default_rng(1).integers(0, 256, (10, 7, 3))
    data = picture(pixels, [0, 1, 2, 3, 4] * 2)
    assert (tiles.png(data) == pixels).all()
    for wrong in (b"GIF89a", data[:40] + bytes([data[40] ^ 1]) + data[41:]):
        with pytest.raises(ValueError):
            tiles.png(wrong)


def test_mosaic(spark):
    whole = np.random.default_rng(2).integers(0, 256, (30, 50, 3))

    def fetch(t):
        x0, y0, x1, y1 = (round(v / 2) for v in t["bbox"])
        return picture(whole[30 - y1 : 30 - y0, x0:x1], [2] * t["height"])

    got = tiles.image(spark, (0, 0, 100, 60), 2, fetch, most=20).collect()
    assert len(got) == 1500 and all((whole[r.r, r.c] == (r.R, r.G, r.B)).all() for r in got)


def test_terrain_tiles():
    level, found = tiles.terrain_tiles(9.0, 47.0, 9.5, 47.4, 90)
    assert 0 < len(found) <= 16 and level > 5
    deep = tiles.terrain_tiles(9.0, 47.0, 9.001, 47.001, 0.001)
    assert deep[0] == tiles.DEEPEST
    assert tiles.terrain_tiles(-180, -80, 180, 80, 1)[0] <= 2
    with pytest.raises(ValueError):
        tiles.terrain_tiles(0, 80, 1, 89, 10)


def test_colour_masks():
    rgb = np.zeros((9, 12, 3), np.uint8)
    rgb[1:5, 1:6] = (250, 10, 10)
    rgb[3, 3] = 0
    rgb[7, 9] = (250, 10, 10)
    m = mask.colour_mask(rgb, "R > 200 and abs(G - B) < 5 and (H < 10 or H > 350) and S > 50")
    assert m.sum() == 20
    assert mask.colour_mask(rgb, "R > 200", close_px=1, least=2).sum() == 20
    assert mask.colour_mask(rgb, "R > 200", least=2).sum() == 19
    assert mask.colour_mask(rgb, "R > 200", include=[0, 0, 4, 9], exclude=[[0, 0, 2, 9]]).sum() == 7
    assert mask.colour_mask(rgb, "R > 200", open_px=1).sum() == 9
    for wrong in ("__import__('os')", "R >", "X > 1", "R.real > 1"):
        with pytest.raises(ValueError):
            mask.rule(rgb, wrong)


@pytest.mark.parametrize("diagonal", [True, False])
def test_components_over_squares(spark, monkeypatch, diagonal):
    monkeypatch.setattr(georeference, "TILE", 4)
    here = np.random.default_rng(5).random((23, 19)) < 0.45
    df = spark.createDataFrame([("i", int(r), int(c)) for r, c in zip(*np.nonzero(here), strict=True)], "image string, r long, c long")
    keep = lambda d: spark.createDataFrame(d.collect(), d.schema)
    want = mask.label(here, diagonal)
    # TILE is read by the tasks too: only the driver's part can be changed here, so labels come from squares of the usual size.
    monkeypatch.undo()
    got = {(r.r, r.c): r.part for r in georeference.components(df, keep, diagonal=diagonal).collect()}
    assert got == {(int(r), int(c)): int(want[r, c] // 19) << 32 | int(want[r, c] % 19) for r, c in zip(*np.nonzero(here), strict=True)}


def test_components_of_a_snake_over_many_squares(spark):
    cells = [(r, c) for r in range(0, 400, 2) for c in range(300)] + [(r + 1, 299 if r % 4 == 0 else 0) for r in range(0, 398, 2)]
    df = spark.createDataFrame([("i", r, c) for r, c in cells], "image string, r long, c long")
    keep = lambda d: spark.createDataFrame(d.toPandas(), d.schema)
    parts = georeference.components(df, keep)
    assert parts.select("part").distinct().count() == 1 and parts.count() == len(cells)
    assert georeference.mask_polygons(parts).first().n == len(cells)


def test_sides_of_lines():
    bent = np.array([[0, 0], [10, 0], [10, 10]], float)
    assert G.area(G.half_plane(bent, "left", 2)) == pytest.approx(36)
    assert G.area(G.half_plane(bent[::-1], "right", 2)) == pytest.approx(36)
    assert G.area(G.half_plane(bent, "right", 2)) == pytest.approx(40 + np.pi, rel=0.01)
    assert G.area(G.half_plane(bent[:2], "north", 5)) == pytest.approx(100) and G.area(G.half_plane(bent[:2], "north", 5, 0)) == pytest.approx(50)
    with pytest.raises(ValueError):
        G.half_plane(bent, "up", 1)
    e, n = G.utm(11.0, 47.0, 32)
    assert abs(e - 652_000) < 1_000 and abs(n - 5_207_000) < 1_500


def test_spellings():
    assert {"mühlbach", "muehlbach", "mühlb"} <= connectors.spellings_of(" Mühlbach")
    assert {"rhein", "rhain"} == connectors.spellings_of("Rhein")
    assert connectors.spellings_of("  ") == set()
