"""Readers and connectors over files made of the driver tables, in the shared folder, and over services that answer from one."""

from __future__ import annotations

import io
import json
import re
import sqlite3
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasift.functions import geometry as G
from terrasift.plans.registry import query, table
from terrasift.plans.spatial import _CELLS, _PTS, _boxes, _cells
from terrasift.shared import shared_dir
from terrasift.sources import connectors, readers, sinks

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _docx(i: int, text: str) -> bytes:
    """Two paragraphs and a table of two rows, the second with a table in its cell."""
    p = lambda t: f"<w:p><w:r><w:t>{escape(t)}</w:t></w:r></w:p>"
    inner = f"<w:tbl><w:tr><w:tc>{p(f'inner {i}')}</w:tc></w:tr></w:tbl>"
    body = p(text) + p(" ") + p("second\t part") + f"<w:tbl><w:tr><w:tc>{p(f'cell {i}')}</w:tc></w:tr><w:tr><w:tc>{p('')}{inner}</w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {_W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def _docx_files(i: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([_docx(a, b or "") for a, b in zip(i, text, strict=True)], dtype=object)


def _reports(spark, sf_dir) -> str:
    """A folder with a word processing file and a text file for each item, and files of another kind."""
    b, folder = table(spark, sf_dir, "benchmark"), shared_dir(spark)
    named = lambda kind, content: b.select(F.concat(F.lit("r"), "item_id", F.lit(kind)).alias("name"), content.alias("content"))
    text = F.encode(F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("\n ")), F.lit("\n")), "UTF-8")
    files = named(".docx", _docx_files("item_id", "text")).union(named(".txt", text)).union(named(".md", text)).union(named("/below.txt", text))
    sinks.write_files(files, folder)
    return folder


_CLEAN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_CHUNKS = f"""c AS (SELECT item_id, 'r' || item_id || '.docx' AS f, unnest([{{'i': 1, 'p': 1, 't': NULL, 'x': {_CLEAN}}}, {{'i': 2, 'p': 3, 't': NULL, 'x': 'second part'}}, {{'i': 3, 'p': NULL, 't': '1', 'x': 'cell ' || item_id}}, {{'i': 4, 'p': NULL, 't': '1.2.1.1', 'x': 'inner ' || item_id}}], recursive := true) FROM benchmark
  UNION ALL SELECT item_id, 'r' || item_id || '.txt', 1, NULL, NULL, {_CLEAN} FROM benchmark)"""


@query(f"WITH {_CHUNKS} SELECT f || '#' || i AS chunk_id, f AS filename, p AS paragraph, t AS table_path, x AS text FROM c")
def report_chunks(spark, sf_dir):
    """Paragraphs and cells of word processing files and whole text files; other kinds and folders below are left out."""
    return readers.read_reports(spark, _reports(spark, sf_dir), ("docx", "txt")).select("chunk_id", "filename", "paragraph", "table_path", "text")


@query(f"WITH {_CHUNKS} SELECT f AS document_id, CASE WHEN t IS NULL THEN '1' ELSE f || '#' || i END AS page_key, string_agg(x, chr(10) ORDER BY i) AS text FROM c GROUP BY ALL")
def report_pages(spark, sf_dir):
    """Chunks put together by page, cells of tables by themselves."""
    chunks = readers.read_reports(spark, _reports(spark, sf_dir), ("docx", "txt"))
    paged = chunks.withColumn("page", F.when(F.col("table_path").isNull(), 1))
    return readers.pages_from_chunks(paged).select("document_id", "page_key", "text")


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS seg_id, c_mktsegment AS event, c_name || ' ' AS process, CASE WHEN c_custkey % 2 = 0 THEN 'a;b' ELSE '' END AS category, CAST(c_nationkey AS VARCHAR) AS note FROM customer WHERE lower(c_mktsegment) = 'building'
""")
def segment_table(spark, sf_dir):
    """A table with tabs and headers that only hold the names; the rows of one event."""
    c, folder = table(spark, sf_dir, "customer"), shared_dir(spark)
    out = c.select(F.col("c_custkey").alias("Segment No"), F.col("c_mktsegment").alias("Event"), F.concat("c_name", F.lit(" ")).alias("The Process"), F.when(F.col("c_custkey") % 2 == 0, "a;b").alias("Generalized Category"), F.col("c_nationkey").alias("Note"))
    out.write.option("header", True).option("sep", "\t").option("ignoreTrailingWhiteSpace", False).csv(folder)
    found = readers.choose_event(readers.read_segment_table(spark, folder), "BUILDING")
    return found.select("seg_id", "event", "process", "category", F.col("extra")["Note"].alias("note"))


@query("SELECT c_mktsegment AS event, min(c_custkey) AS pos FROM customer GROUP BY c_mktsegment")
def table_events(spark, sf_dir):
    return readers.table_events(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("event"), "c_custkey"), "c_custkey")


@query("SELECT n_name AS English, upper(n_name) AS German FROM nation")
def glossary_file(spark, sf_dir):
    """A glossary with a byte order mark, its header and number of rows checked."""
    folder = shared_dir(spark)
    line = F.concat(F.lit('"'), "n_name", F.lit('","'), F.upper("n_name"), F.lit('"\n'))
    body = table(spark, sf_dir, "nation").agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("lines"))
    sinks.write_files(body.select(F.lit("g.csv").alias("name"), F.encode(F.concat(F.lit("\ufeffEnglish,German\n"), "lines"), "UTF-8").alias("content")), folder)
    return readers.read_glossary(spark, f"{folder}/g.csv", ("English", "German"), 25)


@query("SELECT event_type AS stage, count(*) AS n, sum(event_id % 4) AS attempts, max(ts) AS last FROM events WHERE event_id % 10 <> 3 GROUP BY event_type")
def timing_log(spark, sf_dir):
    """A log of JSON lines of which some are cut off."""
    e, folder = table(spark, sf_dir, "events"), shared_dir(spark)
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"), F.col("event_type").alias("stage"), (F.col("event_id") % 4).alias("attempt")))
    e.select(F.when(F.col("event_id") % 10 == 3, F.substr(line, F.lit(1), F.length(line) - 5)).otherwise(line).alias("value")).write.text(folder)
    log = readers.read_timings(spark, folder)
    return log.groupBy("stage").agg(F.count("*").alias("n"), F.sum("attempt").alias("attempts"), F.max("ts").alias("last"))


@query("SELECT 's' || s_suppkey AS run, CASE WHEN s_suppkey % 2 = 0 THEN 'done' ELSE 'running' END AS status, s_name AS created_at FROM supplier WHERE s_suppkey % 7 <> 0")
def run_manifests(spark, sf_dir):
    """A manifest for each run; broken ones are left out."""
    k, folder = F.col("s_suppkey"), shared_dir(spark)
    text = F.to_json(F.struct(F.when(k % 2 == 0, "done").otherwise("running").alias("status"), F.col("s_name").alias("created_at")))
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k, F.lit("/manifest.json")).alias("name"), F.encode(F.when(k % 7 == 0, "{broken").otherwise(text), "UTF-8").alias("content"))
    sinks.write_files(files, folder)
    return readers.read_manifests(spark, folder).select("run", "status", "created_at")


@query("SELECT p_partkey AS id, p_name AS name FROM part UNION ALL SELECT -1, 'none'")
def artifact_file(spark, sf_dir):
    """One artifact of many rows, and the default of one that is missing."""
    rows, folder = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), shared_dir(spark)
    rows.write.json(f"{folder}/there")
    there = spark.read.schema("id long, name string").json(f"{folder}/there")
    sinks.write_text(spark, f"{folder}/one.json", json.dumps({"id": -1, "name": "none"}, indent=1))
    one = readers.read_artifact(spark, f"{folder}/one.json", "id long, name string", [(0, "wrong")])
    none = readers.read_artifact(spark, f"{folder}/missing.json", "id long, name string", [])
    return there.union(one).union(none)


@query(f"WITH {_PTS} SELECT CAST(vec_id AS VARCHAR) AS name, x AS x0, y AS y0, x + w AS x1, y + w AS y1, w * w AS area FROM p WHERE x + w >= 0 AND x <= 100 AND y + w >= 0 AND y <= 100")
def geojson_layer(spark, sf_dir):
    """Boxes written as GeoJSON and read back, cut to an area by their boxes."""
    from terrasift.functions import geometry

    folder = shared_dir(spark)
    sinks.write_geojson(_boxes(spark, sf_dir).select("vec_id", geometry.st_box("x0", "y0", "x1", "y1").alias("geom")), folder)
    f = connectors.clip(connectors.read_geojson(spark, folder), 0, 0, 100, 100)
    return f.select(F.col("attrs")["vec_id"].alias("name"), "x0", "y0", "x1", "y1", F.round(geometry.st_area("geom"), 6).alias("area"))


@F.pandas_udf(T.BinaryType())
def _geopackage(ids: pd.Series, geoms: pd.Series) -> bytes:
    """Grouped: a GeoPackage file of a group's features."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('boxes', 'shape')")
    db.execute("CREATE TABLE boxes (fid INTEGER, shape BLOB)")
    db.executemany("INSERT INTO boxes VALUES (?, ?)", [(int(i), connectors.geopackage_blob(G.from_wkb(g))) for i, g in zip(ids, geoms, strict=True)])
    db.commit()
    return db.serialize()


@query(f"WITH {_PTS} SELECT CAST(vec_id AS VARCHAR) AS fid, x AS x0, y AS y0, x + w AS x1, y + w AS y1 FROM p")
def geopackage_layer(spark, sf_dir):
    """Boxes in GeoPackage files, one for each last digit of their ids."""
    from terrasift.functions import geometry

    folder = shared_dir(spark)
    b = _boxes(spark, sf_dir).select("vec_id", geometry.st_box("x0", "y0", "x1", "y1").alias("g"))
    files = b.groupBy((F.col("vec_id") % 10).alias("k")).agg(_geopackage("vec_id", "g").alias("content"))
    sinks.write_files(files.select(F.concat(F.lit("f"), "k", F.lit(".gpkg")).alias("name"), "content"), folder)
    return connectors.read_geopackage(spark, folder, "boxes").select(F.col("attrs")["fid"].alias("fid"), "x0", "y0", "x1", "y1")


@query(f"WITH {_CELLS} SELECT r, c, 1000 + (c + 0.5) * 10 AS x, 500 + (r + 0.5) * 10 AS y, z FROM cells WHERE z < 40")
def ascii_grid(spark, sf_dir):
    """A raster written as ASCII grids, one for each twenty rows, and read back; cells without a value are left out."""
    folder, r, c = shared_dir(spark), F.col("r"), F.col("c")
    value = F.when(F.col("z") < 40, F.col("z")).otherwise(-9999.0)
    strips = _cells(spark, sf_dir).groupBy(F.floor(r / 20).alias("k")).agg(F.map_from_entries(F.collect_list(F.struct(((19 - r % 20) * 60 + c).cast("int"), value))).alias("m"))
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1199)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(-9999.0)).cast("string")), " ")
    head = F.concat(F.lit("ncols 60\nnrows 20\nxllcorner 1000\nyllcorner "), (500 + F.col("k") * 200).cast("string"), F.lit("\ncellsize 10\nNODATA_value -9999\n"))
    sinks.write_files(strips.select(F.concat(F.col("k").cast("string"), F.lit(".asc")).alias("name"), F.encode(F.concat(head, body), "UTF-8").alias("content")), folder)
    first = F.split_part("raster", F.lit("."), F.lit(1)).cast("long") * 20
    return connectors.read_ascii_grid(spark, folder).select((first + r).alias("r"), "c", "x", "y", "z")


@query("SELECT 'nation' AS layer, count(*) AS n FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def package_layers(spark, sf_dir):
    """A package written and read back by its manifest."""
    folder = shared_dir(spark)
    names = ("nation", "orders", "part")
    sinks.export_package({n: table(spark, sf_dir, n) for n in names}, folder, dict(zip(names, ("catchment", "streams", "dem"), strict=True)))
    out = None
    for n, df in sinks.import_package(spark, folder).items():
        one = df.agg(F.lit(n).alias("layer"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


class _Server:
    """A feature service over a table that was written to the shared folder: features as JSON lines, a file for each hundred ids."""

    def __init__(self, folder: str, low: int, high: int, count: int):
        self.folder, self.low, self.high, self.count = folder, low, high, count

    def _lines(self, first: int, last: int) -> list[dict]:
        """Features with ids from first up to, but without, last."""
        store, root = fs.FileSystem.from_uri(self.folder)
        found = []
        for page in range(first // 100, (last - 1) // 100 + 1):
            for info in store.get_file_info(fs.FileSelector(f"{root}/page={page}", allow_not_found=True)):
                if info.base_name.startswith("part-"):
                    with store.open_input_stream(info.path) as f:
                        found += [json.loads(x) for x in f.read().decode().splitlines()]
        return sorted((x for x in found if first <= x["id"] < last), key=lambda x: x["id"])

    def __call__(self, request: dict) -> dict:
        if "outStatistics" in request:
            return {"features": [{"attributes": {"min": self.low, "max": self.high, "count": self.count}}]}
        if request.get("resultType") == "hits":
            return {"numberMatched": self.count}
        if "where" in request:
            first, last = map(int, re.findall("[<>]=? ([0-9]+)", request["where"]))
            own = self._lines(first, last)[request["resultOffset"] :]
            box = lambda i, w: [[i, 0], [i, 2], [i + w, 2], [i + w, 0], [i, 0]]
            return {"features": [{"attributes": x, "geometry": {"rings": [box(x["id"], x["width"])]}} for x in own[:60]], "exceededTransferLimit": len(own) > 60}
        # Keys run from 0 on, so that a place is an id.
        own = self._lines(request["startIndex"], request["startIndex"] + request["count"])
        return {"features": [{"properties": x, "geometry": {"type": "Point", "coordinates": [x["id"], -x["id"]]}} for x in own]}


@query("""
SELECT c_name AS name, CAST(c_custkey AS DOUBLE) AS x0, 0.0 AS y0, c_custkey + c_nationkey + 1.0 AS x1, 2.0 AS y1 FROM customer
UNION ALL SELECT c_name, c_custkey, -c_custkey, c_custkey, -c_custkey FROM customer
""")
def service_features(spark, sf_dir):
    """The customers behind two services, read by ranges of ids and by pages."""
    rows = table(spark, sf_dir, "customer").select(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_nationkey") + 1).alias("width"))).alias("value"), F.floor(F.col("c_custkey") / 100).alias("page"))
    folder = shared_dir(spark)
    rows.repartition("page").write.partitionBy("page").text(folder)
    about = table(spark, sf_dir, "customer").agg(F.min("c_custkey"), F.max("c_custkey"), F.count("*")).first()
    server = _Server(folder, *about)
    a = connectors.arcgis(spark, "https://host/layer", server, batch=250, key="c_custkey")
    b = connectors.wfs(spark, "https://host/wfs", "layer", server, page=100)
    return a.unionByName(b).select(F.col("attrs")["name"].alias("name"), "x0", "y0", "x1", "y1")


@query("""
SELECT s_suppkey, name FROM (SELECT s_suppkey, list_extract(['Mühlbach', 'Muehlbach', 'Steinbach', 'Stainbach', 'Große Ache', 'Grosse Ache', 'Müller', 'Rhein'], s_suppkey % 8 + 1) || ' ' || s_suppkey AS name FROM supplier)
WHERE regexp_matches(lower(name), 'm(ü|ue)hl|st(ei|ai)nbach|stein|gro(ß|ss)e') AND NOT contains(name, 'Müller')
""")
def place_lookup(spark, sf_dir):
    """Names in any of their spellings."""
    names = F.array(*(F.lit(x) for x in ("Mühlbach", "Muehlbach", "Steinbach", "Stainbach", "Große Ache", "Grosse Ache", "Müller", "Rhein")))
    g = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.element_at(names, (F.col("s_suppkey") % 8 + 1).cast("int")), F.lit(" "), F.col("s_suppkey").cast("string")).alias("name"))
    return connectors.locate(g, ["mühl", "Steinbach", "GROSSE", "große"], most=100_000)


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'bridges' WHEN o_orderkey % 6 = 1 THEN 'streams' WHEN o_orderkey % 6 IN (2, 3) THEN 'roads' WHEN o_orderkey % 6 = 4 THEN 'buildings' END AS layer FROM orders
""")
def routed_tags(spark, sf_dir):
    """Map features by their tags."""
    k, m = F.col("o_orderkey") % 6, lambda *kv: F.create_map(*(F.lit(x) for x in kv))
    tags = F.when(k == 0, m("bridge", "yes", "highway", "track")).when(k == 1, m("waterway", "stream")).when(k == 2, m("highway", "path", "bridge", "no")).when(k == 3, m("highway", "path")).when(k == 4, m("building", "yes")).otherwise(m("natural", "tree"))
    return table(spark, sf_dir, "orders").select("o_orderkey", connectors.route_tags(tags).alias("layer"))


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def json_export(spark, sf_dir):
    """Rows written as JSON lines and read back."""
    rows, folder = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), shared_dir(spark)
    sinks.write_json(rows, folder)
    return spark.read.schema(rows.schema).json(folder)


@query("SELECT s_name, CASE WHEN s_suppkey % 5 = 0 THEN 'a, \"quoted\" one' ELSE 'plain' END AS note, s_suppkey FROM supplier")
def csv_export(spark, sf_dir):
    """Chosen columns in their order as CSV with a header, values with commas and quotes among them."""
    note = F.when(F.col("s_suppkey") % 5 == 0, 'a, "quoted" one').otherwise("plain")
    rows, folder = table(spark, sf_dir, "supplier").withColumn("note", note), shared_dir(spark)
    sinks.write_csv(rows, folder, ["s_name", "note", "s_suppkey"])
    back = spark.read.option("header", True).option("escape", "\\").csv(folder)
    return back.select("s_name", "note", F.col("s_suppkey").cast("long").alias("s_suppkey"))


@query("""
SELECT form, o_orderkey AS segment, o_orderstatus AS event, o_orderpriority AS process, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'c' || o_custkey % 4 END AS generalized_category
FROM orders, (VALUES ('json'), ('csv')) t(form)
""")
def final_export(spark, sf_dir):
    """Final rows in both forms, under the version that the newest evaluation allows."""
    k, folder = F.col("o_orderkey"), shared_dir(spark)
    category = F.when(k % 3 != 0, F.concat(F.lit("c"), (F.col("o_custkey") % 4).cast("string")))
    rows = table(spark, sf_dir, "orders").select(k.alias("segment"), F.col("o_orderstatus").alias("event"), F.col("o_orderpriority").alias("process"), category.alias("generalized_category"), F.lit("x").alias("interaction_type"), F.lit("y").alias("sediment_transport_phase"))
    passed = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("revision"), F.when(F.col("n_nationkey") == 7, "fail").otherwise("pass").alias("status"))
    version = sinks.export_final(rows, passed, folder)
    names = ["segment", "event", "process", "generalized_category"]
    one = spark.read.schema("segment bigint, event string, process string, generalized_category string").json(f"{version}/final_rows.json").select(F.lit("json").alias("form"), *names)
    two = spark.read.option("header", True).csv(f"{version}/final_rows.csv").select(F.lit("csv").alias("form"), F.col("segment").cast("long").alias("segment"), *names[1:])
    return one.unionByName(two)


@query(f"WITH {_PTS}, b AS (SELECT vec_id, x, y, w FROM p WHERE vec_id % 7 <> 0) SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS fid_, '[' || vec_id || ',' || label || ']' AS tags FROM b JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id)")
def numbered_layer(spark, sf_dir):
    """Rows that have a geometry, numbered by their ids, lists as JSON."""
    from terrasift.functions import geometry

    labels = table(spark, sf_dir, "embeddings").select("vec_id", F.array("vec_id", F.col("label").cast("long")).alias("tags"))
    shape = F.when(F.col("vec_id") % 7 != 0, geometry.st_box("x0", "y0", "x1", "y1"))
    rows = _boxes(spark, sf_dir).select("vec_id", shape.alias("geom")).join(labels, "vec_id")
    return sinks.layer(rows, order="vec_id").select("vec_id", F.col("fid_").cast("long").alias("fid_"), "tags")


@F.pandas_udf(T.BinaryType())
def _zipped(names: pd.Series, texts: pd.Series) -> pd.Series:
    out = []
    for own, bodies in zip(names, texts, strict=True):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for name, body in zip(own, bodies, strict=True):
                z.writestr(name, body)
        out.append(data.getvalue())
    return pd.Series(out)


@query("SELECT 'n' || s_nationkey || '.zip' AS bundle, 'runs/' || s_suppkey || '.json' AS name, '{\"name\":\"' || s_name || '\"}' AS content FROM supplier")
def bundle_entries(spark, sf_dir):
    """Suppliers zipped by nation, and the entries of all bundles."""
    folder = shared_dir(spark)
    name = F.concat(F.lit("runs/"), F.col("s_suppkey").cast("string"), F.lit(".json"))
    entry = F.struct(name.alias("name"), F.to_json(F.struct(F.col("s_name").alias("name"))).alias("text"))
    own = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    files = own.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(".zip")).alias("name"), _zipped("e.name", "e.text").alias("content"))
    sinks.write_files(files, folder)
    return readers.read_bundle(spark, folder).select(F.substring_index("bundle", "/", -1).alias("bundle"), "name", F.decode("content", "UTF-8").alias("content"))


@query("SELECT DISTINCT l_orderkey AS run, l_partkey % 3 AS part FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey % 3 = l_partkey % 3)")
def imported_runs(spark, sf_dir):
    """Runs that are not there yet, each once, however often they come."""
    there = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), (F.col("o_custkey") % 3).alias("part"))
    coming = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), (F.col("l_partkey") % 3).alias("part"))
    return readers.import_new(there, coming, ["run", "part"])


@query("""
SELECT doc, level, title, page, place FROM (
  SELECT r_name AS doc, 1 AS level, r_name AS title, r_regionkey AS page, [r_regionkey] AS place FROM region
  UNION ALL SELECT r_name, 2, n_name, n_nationkey, [r_regionkey, n_nationkey] FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT r_name, 3, s_name, s_suppkey, [r_regionkey, n_nationkey, s_suppkey] FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey)
""")
def flat_outline(spark, sf_dir):
    """Regions, their nations and these nations' suppliers as an outline of three levels."""
    r, n, s = (table(spark, sf_dir, x) for x in ("region", "nation", "supplier"))
    node = lambda c, k: F.concat(F.lit(c), F.col(k).cast("string"))
    doc = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    top = r.select(F.col("r_name").alias("doc"), node("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").alias("pos"), F.col("r_name").alias("title"), F.col("r_regionkey").alias("page"))
    mid = doc.select(F.col("r_name"), node("n", "n_nationkey"), node("r", "n_regionkey"), F.col("n_nationkey"), F.col("n_name"), F.col("n_nationkey"))
    low = s.join(doc, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("r_name"), node("s", "s_suppkey"), node("n", "n_nationkey"), F.col("s_suppkey"), F.col("s_name"), F.col("s_suppkey"))
    return readers.flatten_outline(top.union(mid).union(low))
