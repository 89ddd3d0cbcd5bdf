"""Images and terrain by tiles: which tiles an area needs, and their pixels as rows.

Tiles are reached through a `fetch` function (request dict -> bytes of a PNG file) that the caller gives, a task each. A
mosaic is the union of the tiles' rows, so it is never held by one task.
"""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from terrasift.sources.connectors import coverage_tiles

PIXEL = "r bigint, c bigint, R int, G int, B int"
#: Width in metres of a pixel at the equator on the lowest level (tiles of 512 pixels), the deepest level, and the
#: latitude where the tiles end.
PIXEL_M, DEEPEST, LIMIT = 78271.51696, 14, 85.05112878


def png(data: bytes) -> np.ndarray:
    """Rows of 8-bit grey, RGB or RGBA pixels of a PNG file without interlacing, as (rows, columns, 3); others are an error."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, head, body = 8, None, []
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("a chunk is damaged")
        head = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head
        body += [part] if kind == b"IDAT" else []
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (0, 2, 6) or head[6]:
        raise ValueError("this kind of PNG file is not read")
    width, height, depth = head[0], head[1], {0: 1, 2: 3, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * depth)
    out = np.zeros((height + 1, width + 1, depth), np.uint8)
    for y in range(height):
        kind, line, above = raw[y, 0], raw[y, 1:].reshape(width, depth), out[y, 1:]
        if kind == 0:
            out[y + 1, 1:] = line
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(line, 0, dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            out[y + 1, 1:] = line + above
        else:
            for x in range(width):
                a, b, c = (v.astype(int) for v in (out[y + 1, x], out[y, x + 1], out[y, x]))
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    away = np.abs(np.stack((b - c, a - c, a + b - 2 * c)))
                    guess = np.choose(away.argmin(0), (a, b, c))
                out[y + 1, x + 1] = (line[x] + guess) & 255
    pixels = out[1:, 1:]
    return np.repeat(pixels, 3, 2) if depth == 1 else pixels[..., :3]


def image(spark: SparkSession, bbox: tuple[float, float, float, float], size: float, fetch: Callable[[dict], bytes], request: dict | None = None, most: int = 4000) -> DataFrame:
    """Pixels (r from the north, c, R, G, B) of an area, in tiles of at most `most` pixels a side; a tile whose picture has not
    the size that was asked for is an error."""
    x0, _, _, y1 = bbox
    tiles = [{**(request or {}), "bbox": list(b), "width": round((b[2] - b[0]) / size), "height": round((b[3] - b[1]) / size)} for b in coverage_tiles(*bbox, size, most)]
    plan = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(tiles)], "i int, request string").repartition(len(tiles), "i")

    def run(frames):
        for f in frames:
            for text in f["request"]:
                t = json.loads(text)
                rgb = png(fetch(t))
                if rgb.shape[:2] != (t["height"], t["width"]):
                    raise ValueError(f"a picture of {rgb.shape[1]} x {rgb.shape[0]} pixels for {t['width']} x {t['height']}")
                r, c = np.indices(rgb.shape[:2]).reshape(2, -1)
                flat = rgb.reshape(-1, 3).astype(np.int32)
                yield pd.DataFrame({"r": r + round((y1 - t["bbox"][3]) / size), "c": c + round((t["bbox"][0] - x0) / size), "R": flat[:, 0], "G": flat[:, 1], "B": flat[:, 2]})

    return plan.mapInPandas(run, PIXEL)


def terrain_tiles(west: float, south: float, east: float, north: float, step: float, most: int = 16) -> tuple[int, list[tuple[int, int]]]:
    """(level, tiles (x, y)) whose pixels are about `step` metres wide, or wider where that would be more than `most` tiles."""
    if not (-180 <= west < east <= 180 and -LIMIT <= south < north <= LIMIT):
        raise ValueError("no such area, or beyond the latitudes that have tiles")
    level = math.ceil(math.log2(PIXEL_M * math.cos(math.radians((south + north) / 2)) / step))
    for z in range(max(0, min(DEEPEST, level)), -1, -1):
        n = 2**z
        place = lambda v: min(max(math.floor(v * n), 0), n - 1)  # noqa: B023, E731
        down = lambda lat: (1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2
        xs, ys = ((place(a), place(b)) for a, b in (((west + 180) / 360, (east + 180) / 360), (down(north), down(south))))
        if (xs[1] - xs[0] + 1) * (ys[1] - ys[0] + 1) <= most:
            return z, [(x, y) for x in range(xs[0], xs[1] + 1) for y in range(ys[0], ys[1] + 1)]
    return 0, [(0, 0)]
