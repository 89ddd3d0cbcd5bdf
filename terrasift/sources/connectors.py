"""Layers and rasters from files and services.

Services are reached through a `fetch` function (request dict -> parsed JSON) that the caller gives; each range, page or tile
is a task's, so they load in parallel and a lost task fetches its own again. Tests use a local function.
"""

from __future__ import annotations

import hashlib
import json
import math
import sqlite3
import struct
from collections.abc import Callable
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.functions import geometry as G
from terrasift.sources import services

FEATURE = "attrs map<string,string>, geom binary, x0 double, y0 double, x1 double, y1 double"


def _feature(attrs: dict, g: G.Geometry | None) -> tuple:
    own = {str(k): None if v is None else v if isinstance(v, str) else json.dumps(v) for k, v in attrs.items()}
    return (own, G.to_wkb(g), *(G.bounds(g) if g and g[1] else (None,) * 4))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["attrs", "geom", "x0", "y0", "x1", "y1"])


# Files ---------------------------------------------------------------------------------------------------------------


def read_geopackage(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """A layer of GeoPackage files: attributes as text, geometry as WKB, and its box for filters. A missing layer is an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(frames):
        for f in frames:
            for p, content in zip(f["path"], f["content"], strict=True):
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                found = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
                if found is None:
                    raise LookupError(f"{p} has no layer {layer}")
                quoted = layer.replace('"', '""')
                cur = db.execute(f'SELECT * FROM "{quoted}"')
                names, out = [d[0] for d in cur.description], []
                for r in cur:
                    attrs = dict(zip(names, r, strict=True))
                    blob = attrs.pop(found[0])
                    # Header: magic, version, flags, reference system, then a box whose size the flags tell.
                    skip = 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7] if blob else 0
                    out.append(_feature(attrs, G.from_wkb(blob[skip:]) if blob else None))
                yield _frame(out)

    return files.mapInPandas(rows, FEATURE)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON files (whole collections, or one feature a line)."""
    text = spark.read.text(path, wholetext=True)

    def rows(frames):
        for f in frames:
            for value in f["value"]:
                try:
                    docs = [json.loads(value)]
                except ValueError:
                    docs = [json.loads(x) for x in value.splitlines() if x.strip()]
                out = []
                for d in docs:
                    for x in d["features"] if d.get("type") == "FeatureCollection" else [d]:
                        out.append(_feature(x.get("properties") or {}, from_geojson(x.get("geometry"))))
                yield _frame(out)

    return text.mapInPandas(rows, FEATURE)


def from_geojson(g: dict | None) -> G.Geometry | None:
    if not g:
        return None
    kind, c = g["type"], g["coordinates"]
    flat = lambda p: np.asarray(p, float)[..., :2]
    many = kind.startswith("Multi")
    if kind.endswith("Point"):
        return "point", [flat(p) for p in (c if many else [c])]
    if kind.endswith("LineString"):
        return "line", [flat(x) for x in (c if many else [c])]
    return "polygon", [[flat(r) for r in p] for p in (c if many else [c])]


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """raster, r, c, x, y, z of ESRI ASCII grids: r counts from the south, x and y are cell centres; no-data cells and values
    outside -1000 to 9000 are left out."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("raster"), "value")

    def cells(frames):
        for f in frames:
            for name, value in zip(f["raster"], f["value"], strict=True):
                words = value.split()
                head = {words[i].lower(): float(words[i + 1]) for i in range(0, 12, 2) if not words[i].lstrip("-").replace(".", "").isdigit()}
                rows, cols, size = int(head["nrows"]), int(head["ncols"]), head["cellsize"]
                z = np.array(words[2 * len(head) :], float).reshape(rows, cols)[::-1]
                r, c = np.nonzero((z != head.get("nodata_value", -9999)) & (z >= -1000) & (z <= 9000))
                yield pd.DataFrame({"raster": name.rpartition("/")[2], "r": r, "c": c, "x": head["xllcorner"] + (c + 0.5) * size, "y": head["yllcorner"] + (r + 0.5) * size, "z": z[r, c]})

    return files.mapInPandas(cells, "raster string, r bigint, c bigint, x double, y double, z double")


def clip(features: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Features whose box meets the given one; on Parquet this reaches the scan."""
    return features.filter((F.col("x1") >= x0) & (F.col("x0") <= x1) & (F.col("y1") >= y0) & (F.col("y0") <= y1))


# Services ------------------------------------------------------------------------------------------------------------


def esri_polygon(rings: list) -> G.Geometry:
    """Rings that turn clockwise are outer ones; others are holes of the outer one that holds their first point."""
    rings = [np.asarray(r, float)[:, :2] for r in rings]
    parts = [[r] for r in rings if G.ring_area(r) < 0] or [[rings[0]]]
    for r in rings:
        if G.ring_area(r) >= 0 and not any(r is p[0] for p in parts):
            next((p for p in parts if G.contains(("polygon", [[p[0]]]), r[:1])[0]), parts[0]).append(r)
    return "polygon", parts


def _esri(answer: dict) -> list[tuple]:
    out = []
    for f in answer.get("features", []):
        g = f.get("geometry") or {}
        shape = esri_polygon(g["rings"]) if "rings" in g else ("line", [np.asarray(p, float)[:, :2] for p in g["paths"]]) if "paths" in g else ("point", [np.array([g["x"], g["y"]])]) if "x" in g else None
        out.append(_feature(f.get("attributes") or {}, shape))
    return out


def arcgis(spark: SparkSession, url: str, fetch: Callable[[dict], dict], where: str = "1=1", bbox: tuple | None = None, batch: int = 500, key: str = "OBJECTID") -> DataFrame:
    """A feature layer by ranges of ids, a task each; the conditions are left to the server."""
    return services.load(spark, FEATURE, *services.ranged(url, fetch, _esri, where, bbox, batch, key))


def wfs(spark: SparkSession, url: str, layer: str, fetch: Callable[[dict], dict], bbox: tuple | None = None, page: int = 5000) -> DataFrame:
    """A feature service by pages, a task each."""
    parse = lambda a: [_feature(x.get("properties") or {}, from_geojson(x.get("geometry"))) for x in a.get("features", [])]
    return services.load(spark, FEATURE, *services.paged(url, layer, fetch, parse, bbox, page))


def coverage_tiles(x0: float, y0: float, x1: float, y1: float, size: float, most: int) -> list[tuple[float, float, float, float]]:
    """Boxes of at most `most` cells a side that cover an area in whole cells."""
    step = size * most
    nx, ny = (max(1, math.ceil((b - a) / step - 1e-9)) for a, b in ((x0, x1), (y0, y1)))
    return [(x0 + i * step, y0 + j * step, min(x0 + (i + 1) * step, x1), min(y0 + (j + 1) * step, y1)) for j in range(ny) for i in range(nx)]


def route_tags(tags: Column | str) -> Column:
    """The layer of a map feature by its tags (a map column); null for none. The first that applies."""
    t = F.col(tags) if isinstance(tags, str) else tags
    has = lambda k, *v: F.try_element_at(t, F.lit(k)).isin(*v) if v else F.try_element_at(t, F.lit(k)).isNotNull()
    return (
        F.when(F.coalesce(has("bridge") & ~has("bridge", "no"), F.lit(False)), "bridges")
        .when(F.coalesce(has("waterway", "river", "stream", "canal", "ditch", "drain"), F.lit(False)), "streams")
        .when(has("highway"), "roads")
        .when(has("railway"), "railways")
        .when(has("building"), "buildings")
        .when(has("place"), "places")
    )


# Bounded acquisition ---------------------------------------------------------------------------------------------------


def like_literal(text: str) -> str:
    """The text as a literal within a LIKE pattern."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("'", "''")


# Spellings that stand for each other.
SPELLINGS = [("ei", "ai"), ("ai", "ei"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("ae", "ä"), ("oe", "ö"), ("ue", "ü")]


def spellings_of(term: str) -> set[str]:
    """A name in lower case, with each exchange of spellings made or not, and for names of more than six letters their stem."""
    own = term.strip().lower()
    out = {own} if own else set()
    for a, b in SPELLINGS:
        out |= {s.replace(a, b) for s in out}
    return out | ({own[: max(5, len(own) - 4)]} if len(own) > 6 else set())


def locate(gazetteer: DataFrame, terms: list[str], name: str = "name", most: int = 50) -> DataFrame:
    """Rows whose name holds any of the terms or their spellings, whatever the case; the feature is a list of 50."""
    spellings = sorted(set().union(*map(spellings_of, terms)))
    if not spellings:
        return gazetteer.limit(0)
    hit = F.exists(F.array(*(F.lit(s) for s in spellings)), lambda s: F.contains(F.lower(F.col(name)), s))
    return gazetteer.filter(hit).orderBy(name).limit(most)


class Budget:
    """Requests, bytes and hosts that an acquisition may use; going beyond is an error before anything is fetched."""

    def __init__(self, hosts: set[str], requests: int = 50, size: int = 200 << 20):
        self.hosts, self.requests, self.size = hosts, requests, size

    def spend(self, url: str, size: int = 0) -> None:
        if urlsplit(url).hostname not in self.hosts:
            raise PermissionError(f"not an allowed host: {url}")
        self.requests -= 1
        self.size -= size
        if self.requests < 0 or self.size < 0:
            raise PermissionError("the acquisition's budget is spent")


def cache_key(request: dict) -> str:
    """The same for requests that differ only in the order of their fields."""
    return hashlib.sha256(json.dumps(request, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def presets(items: list[dict], load: Callable[[dict], int]) -> list[dict]:
    """Each item loaded; a failure is recorded and the rest goes on."""
    out = []
    for i in items:
        try:
            out.append({**i, "state": "ok", "rows": load(i)})
        except Exception as e:  # noqa: BLE001
            out.append({**i, "state": "failed", "error": f"{type(e).__name__}: {e}"})
    return out


def utm(lon: Column, lat: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """Easting and northing in metres on the WGS 84 ellipsoid, by the series to the third order; built-in functions only."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3)
    c = 2 * math.sqrt(n) / (1 + n)
    p, d = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    atanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    t = F.sinh(atanh(F.sin(p)) - c * atanh(c * F.sin(p)))
    xi, eta = F.atan2(t, F.cos(d)), atanh(F.sin(d) / F.sqrt(1 + t * t))
    e, m = eta, xi
    for j, k in enumerate(alpha, 1):
        e = e + k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        m = m + k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * a * e, 0.9996 * a * m + (0 if north else 10_000_000)


def geopackage_blob(g: G.Geometry) -> bytes:
    """A geometry as GeoPackage stores it, without a box."""
    return b"GP" + struct.pack("<BBi", 0, 1, 0) + G.to_wkb(g)

