import json
import re
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.functions import geometry as G
from terrasift.sources import connectors as C


def test_geopackage_geojson_grid(spark, tmp_path):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('streams', 'geom')")
    db.execute("CREATE TABLE streams (fid INTEGER, NAME TEXT, geom BLOB)")
    db.execute("INSERT INTO streams VALUES (1, 'Sei', ?), (2, NULL, NULL)", (C.geopackage_blob(G.from_wkt("LINESTRING (0 0, 3 4)")),))
    db.commit()
    (tmp_path / "a.gpkg").write_bytes(db.serialize())
    rows = C.read_geopackage(spark, str(tmp_path / "a.gpkg"), "streams").orderBy("x0").collect()
    assert [(r.attrs["NAME"], r.x1, r.y1) for r in rows] == [(None, None, None), ("Sei", 3.0, 4.0)]
    with pytest.raises(Exception, match="no layer"):
        C.read_geopackage(spark, str(tmp_path / "a.gpkg"), "none").collect()
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": 1}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]]]}}]}))
    f = C.read_geojson(spark, str(tmp_path / "b.geojson"))
    assert G.area(G.from_wkb(f.first().geom)) == 2 and C.clip(f, 5, 5, 6, 6).count() == 0 and C.clip(f, 1, 1, 6, 6).count() == 1
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 5\nNODATA_value -9999\n1 2\n3 -9999\n")
    cells = {(r.r, r.c): (r.x, r.y, r.z) for r in C.read_ascii_grid(spark, str(tmp_path / "g.asc")).collect()}
    assert cells == {(1, 0): (12.5, 27.5, 1.0), (1, 1): (17.5, 27.5, 2.0), (0, 0): (12.5, 22.5, 3.0)}


def test_services(spark):
    def fetch(r):
        if r.get("outStatistics"):
            assert r["where"] == "a = 1"
            return {"features": [{"attributes": {"min": 1, "max": 20, "count": 7}}]}
        if r.get("resultType") == "hits":
            return {"numberMatched": 5}
        if "startIndex" in r:
            ids = range(r["startIndex"], min(5, r["startIndex"] + r["count"]))
            return {"features": [{"properties": {"id": i}, "geometry": {"type": "Point", "coordinates": [i, i]}} for i in ids]}
        square = lambda a, b: [[a, a], [a, b], [b, b], [b, a], [a, a]]
        a, b = map(int, re.fullmatch(r"\(a = 1\) AND OBJECTID >= (\d+) AND OBJECTID < (\d+)", r["where"]).groups())
        own = [i for i in (1, 2, 3, 4, 5, 6, 20) if a <= i < b]
        return {"features": [{"attributes": {"id": i}, "geometry": {"rings": [square(0, 10), square(2, 4)[::-1]]}} for i in own[r["resultOffset"] :][:2]], "exceededTransferLimit": len(own) > r["resultOffset"] + 2}

    layer = C.arcgis(spark, "http://x", fetch, "a = 1", batch=3)
    a = layer.collect()
    # Seven ids from 1 to 20 in three ranges; answers of two features at most.
    assert layer.rdd.getNumPartitions() == 3 and sorted(int(r.attrs["id"]) for r in a) == [1, 2, 3, 4, 5, 6, 20] and {G.area(G.from_wkb(r.geom)) for r in a} == {96.0}
    w = C.wfs(spark, "http://x", "l", fetch, page=2).collect()
    assert sorted(r.attrs["id"] for r in w) == ["0", "1", "2", "3", "4"]
    tiles = C.coverage_tiles(0, 0, 25, 10, 1, 10)
    assert len(tiles) == 3 and tiles[-1] == (20, 0, 25, 10)


def test_tags_names_budget(spark):
    df = spark.createDataFrame([({"bridge": "yes", "highway": "x"},), ({"waterway": "river"},), ({"bridge": "no", "highway": "x"},), ({"x": "y"},)], "tags map<string,string>")
    assert [r[0] for r in df.select(C.route_tags("tags")).collect()] == ["bridges", "streams", "roads", None]
    names = spark.createDataFrame([("Steinbach",), ("Stainbach",), ("Murg",)], "name string")
    assert [r.name for r in C.locate(names, ["STEIN"]).collect()] == ["Stainbach", "Steinbach"] and C.locate(names, [" "]).count() == 0
    assert C.like_literal("5%_'") == "5\\%\\_''"
    b = C.Budget({"ok.example"}, requests=1)
    b.spend("https://ok.example/a")
    for url in ("https://ok.example/b", "https://other.example/"):
        with pytest.raises(PermissionError):
            b.spend(url)
    assert C.cache_key({"a": 1, "b": 2}) == C.cache_key({"b": 2, "a": 1})
    got = C.presets([{"n": 1}, {"n": 0}], lambda i: 1 // i["n"])
    assert [g["state"] for g in got] == ["ok", "failed"]


def test_utm(spark):
    e, n = C.utm(F.lit(9.0), F.lit(0.0), 32)
    assert np.allclose(spark.range(1).select(e, n).first()[:], (500000, 0), atol=1e-6)
    e, n = C.utm(F.lit(11.4), F.lit(47.27), 32)
    east, north = spark.range(1).select(e, n).first()[:]
    assert abs(east - 681500) < 700 and abs(north - 5238000) < 2500
