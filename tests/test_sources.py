import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from terrasift.functions import geometry as G
from terrasift.operators import extract
from terrasift.sources import readers, sinks
from terrasift.streaming import timings

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_reports_and_pages(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    (tmp_path / "a.docx").write_bytes(docx(p("First  one") + f"<w:tbl><w:tr><w:tc>{p('cell')}<w:tbl><w:tr><w:tc>{p('inner')}</w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>" + p(" ")))
    (tmp_path / "b.txt").write_bytes("﻿Some\n text ".encode())
    (tmp_path / "c.md").write_text("no")
    rows = readers.read_reports(spark, str(tmp_path)).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.paragraph, r.table_path, r.text) for r in rows] == [("a.docx#1", 1, None, "First one"), ("a.docx#2", None, "1", "cell"), ("a.docx#3", None, "1.1.1.1", "inner"), ("b.txt#1", None, None, "Some text")]
    pages = readers.pages_from_chunks(readers.read_reports(spark, str(tmp_path)))
    assert pages.count() == 4
    with pytest.raises(FileNotFoundError):
        (tmp_path / "empty").mkdir()
        readers.discover(spark, str(tmp_path / "empty"))


def test_segment_table_and_glossary(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("Segment\tEvent\tProcess\tGeneralized Category\tNote\n1\tA\tflow \tX\tn\n2\ta\tslide\n")
    t = readers.read_segment_table(spark, str(tmp_path / "t.tsv"))
    assert [(r.seg_id, r.process, r.category, r.extra) for r in t.orderBy("seg_id").collect()] == [("1", "flow ", "X", {"Note": "n"}), ("2", "slide", "", {"Note": ""})]
    assert readers.choose_event(t, "A").count() == 2
    (tmp_path / "d.csv").write_text("Segment,Event,Process\n1,a,b\n1,a,b\n")
    with pytest.raises(ValueError, match="repeated"):
        readers.read_segment_table(spark, str(tmp_path / "d.csv"))
    (tmp_path / "g.csv").write_text("﻿English,German\nflow,Fluss\n")
    assert readers.read_glossary(spark, str(tmp_path / "g.csv"), ("English", "German"), 1).count() == 1
    with pytest.raises(ValueError):
        readers.read_glossary(spark, str(tmp_path / "g.csv"), ("English",))


def test_logs_manifests_bundles(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/t.jsonl").write_text('{"ts":"2024-01-01T00:00:00Z","stage":"a","attempt":1}\n{"ts":"2024-01-01T00:00:01Z","sta')
    assert readers.read_timings(spark, str(tmp_path / "log")).count() == 1
    for run, text in (("r1", '{"status":"done"}'), ("r2", "{broken")):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "manifest.json").write_text(text)
    assert [(r.run, r.status) for r in readers.read_manifests(spark, str(tmp_path / "runs")).collect()] == [("r1", "done")]
    for name, inner in (("ok.zip", "a/b.csv"), ("bad.zip", "../x")):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr(inner, "x,y")
    assert [r.name for r in readers.read_bundle(spark, str(tmp_path / "ok.zip")).collect()] == ["a/b.csv"]
    with pytest.raises(Exception, match="unsafe"):
        readers.read_bundle(spark, str(tmp_path / "bad.zip")).collect()


def test_outline_and_logos(spark):
    rows = [("d", 1, None, 0, "A", 1), ("d", 2, 1, 0, "A1", 2), ("d", 3, 1, 1, "A2", 3), ("d", 4, 2, 0, "A11", 2), ("d", 5, None, 1, "B", 9)]
    out = readers.flatten_outline(spark.createDataFrame(rows, "doc string, node int, parent int, pos int, title string, page int")).orderBy("doc", "place").collect()
    assert [(r.level, r.title) for r in out] == [(1, "A"), (2, "A1"), (3, "A11"), (2, "A2"), (1, "B")]
    im = spark.createDataFrame([("d", p, "logo") for p in range(4)] + [("d", 1, "fig")], "doc string, page int, digest string")
    assert [r.digest for r in readers.logo_filter(im).collect()] == ["fig"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "e", "p", "c", "i", "s", "x")], "segment int, event string, process string, generalized_category string, interaction_type string, sediment_transport_phase string, more string")
    ev = spark.createDataFrame([(1, "pass"), (2, "fail")], "revision int, status string")
    with pytest.raises(PermissionError):
        sinks.export_final(rows, ev, str(tmp_path / "out"))
    version = sinks.export_final(rows, ev.filter("revision = 1"), str(tmp_path / "out"))
    assert json.loads((tmp_path / "out/manifest.json").read_text())["revision"] == 1
    assert spark.read.option("header", True).csv(f"{version}/final_rows.csv").columns == list(sinks.EXPORT)
    sinks.append_timing(spark, str(tmp_path / "timing"), stage="a", attempt=1, elapsed_seconds=0.5)
    sinks.append_timing(spark, str(tmp_path / "timing"), stage="b", attempt=2, elapsed_seconds=1.5)
    assert readers.read_timings(spark, str(tmp_path / "timing")).agg(F.sum("elapsed_seconds")).first()[0] == 2.0
    shapes = spark.createDataFrame([(3, bytearray(G.to_wkb(G.box(0, 0, 1, 1))), [1]), (1, bytearray(G.to_wkb(G.from_wkt("POINT (1 2)"))), [2]), (2, None, [3])], "id int, geom binary, tags array<int>")
    lay = sinks.layer(shapes, order="id")
    assert [(r.id, r.fid_, r.tags) for r in lay.orderBy("id").collect()] == [(1, 0, "[2]"), (3, 1, "[1]")]
    sinks.write_geojson(shapes, str(tmp_path / "g"))
    kinds = sorted(str(json.loads(r.value)["geometry"] and json.loads(r.value)["geometry"]["type"]) for r in spark.read.text(str(tmp_path / "g")).collect())
    assert kinds == ["None", "Point", "Polygon"]
    with pytest.raises(ValueError):
        sinks.export_package({"a": lay}, str(tmp_path / "pkg"), {"a": "streams"})
    sinks.export_package({"a": lay, "b": lay, "c": lay}, str(tmp_path / "pkg"), {"a": "streams", "b": "catchment", "c": "dem"})
    assert set(sinks.import_package(spark, str(tmp_path / "pkg"))) == {"a", "b", "c"}


def test_extractors(spark):
    df = spark.createDataFrame([(1, "Bank erosion"), (2, "nothing"), (3, None)], "id int, text string")
    log = extract.call(df, "id", "text", extract.RuleExtractor(extract.PROCESS_RULES), extract.one_of(("Erosion",)), attempts=2)
    got = {r.key: (r.answer, r.attempts) for r in extract.accepted(log).collect()}
    assert got == {"1": ("Erosion", 1), "2": (None, 2), "3": (None, 2)}
    tr = extract.call(df, "id", "text", extract.GlossaryTranslator({"erosion": "Abtrag"}), lambda x: None)
    assert {r.key: r.answer for r in extract.accepted(tr).collect()}["1"] == "Bank Abtrag"
    b = spark.createDataFrame([("d", 1, "A", 0.9), ("d", 1, "a ", 0.7), ("d", 2, "B", 0.9), ("d", 2, "C", 0.8), ("d", 3, "E", 0.5)], "doc string, page int, title string, confidence double")
    assert {r.page: (r.title, r.state) for r in extract.resolve_boundaries(b).collect()} == {1: ("A", "accepted"), 2: ("B", "review"), 3: ("E", "review")}


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    spark.range(50).selectExpr("timestamp_seconds(1700000000 + id * 30) AS ts", "'a' AS stage", "cast(id % 3 + 1 AS int) AS attempt", "if(id % 4 = 0, 'fail', 'pass') AS outcome", "cast(null AS string) AS error", "0.5D AS retry_delay_seconds").repartition(3).write.json(str(src))
    q = timings.windowed_counts(timings.log_stream(spark, str(src))).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("attempts"), F.sum("requests")).first()[:] == (50, 17)
