import pytest
from pyspark.sql import functions as F

from terrasift.functions import predicates as P
from terrasift.functions import text as T
from terrasift.operators import chains, citations, folds, georeference, metrics, quality, raster, scoring, spatial, state


def test_strict_contracts_fail_loudly(spark):
    seg = spark.createDataFrame([(1, 1, [("c1", "q"), ("c9", "q")])], "segment int, causal_order int, evidence array<struct<chunk_id:string, quote:string>>")
    chunks = spark.createDataFrame([("c1", "f")], "chunk_id string, file string")
    with pytest.raises(Exception, match="no such chunk"):
        citations.evidence_rows(seg, chunks).collect()
    assert [r.state for r in citations.evidence_rows(seg, chunks, strict=False).orderBy("i").collect()] == ["found", "missing"]
    rows = spark.createDataFrame([("d", 1, 5), ("d", 2, 50)], "doc string, pos int, size bigint")
    with pytest.raises(Exception, match="larger than a batch"):
        folds.pack(rows, 10).collect()
    parts = spark.createDataFrame([("x", 0, 3, "abc"), ("x", 4, 5, "d")], "chunk_id string, char_start int, char_end int, text string")
    with pytest.raises(Exception, match="do not join up"):
        folds.rejoin(parts).collect()
    df = spark.range(3)
    for bad in (dict(ids=[9], id_column="id"), dict(conditions={"id": {"gt": 99}})):
        with pytest.raises(LookupError):
            P.select(df, **bad)
    with pytest.raises(ValueError):
        P.where("id", {"a": 1, "b": 2})


def test_predicates_on_nulls(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    count = lambda c: df.filter(P.where("x", c)).count()
    assert [count(c) for c in ("a", {"ne": "a"}, {"not_in": ["b"]}, {"in": ["a"]}, {"isnull": True}, {"regex": "A"}, {"contains": ""})] == [1, 1, 2, 1, 1, 1, 1]


def test_quote_pages_views(spark):
    pages = spark.createDataFrame([("d", 1, "The de­bris flow came down fast and buried the road"), ("d", 2, "to the old mill near the river."), ("d", 3, "Nothing here but Old  words")], "doc string, page int, text string")
    q = spark.createDataFrame([(1, "d", "the debris flow came down fast", 3), (2, "d", "buried the road to the old mill", None), (3, "d", "old WORDS", 3), (4, "d", "not there at all in any page", 1)], "quote_id int, doc string, quote string, hint int")
    got = {r.quote_id: (r.page, r.view, r.page_hint_ok) for r in citations.quote_pages(q, pages).collect()}
    assert got == {1: (1, 2, False), 2: (1, 3, False), 3: (3, 1, True)}


def test_text_udfs(spark):
    df = spark.createDataFrame([("He said “the  Dam” broke. aaa", "the dam"), ("x“a”b and xa“b", "xab"), ("one two three four", "two thre four"), (None, None)], "t string, q string")
    rows = df.select(T.restore_quote("t", "q").alias("r"), T.quote_match("t", "q").alias("m"), T.closest_passage("t", "q").alias("c")).collect()
    assert rows[0].m.state == "exact" and (rows[0].m.begin, rows[0].m.end) == (9, 17)
    assert rows[1].r is None and rows[3].m.state == "unmatched" and rows[3].c.passage is None
    assert rows[2].c.passage == "two three four" and rows[2].c.ratio > 0.9
    aa = spark.createDataFrame([("aaaa", "aa")], "t string, q string").select(T.quote_match("t", "q").alias("m")).first().m
    assert (aa.state, aa["count"]) == ("repeated", 3)
    n = spark.createDataFrame([("Straße Ångström (Nord)",), ("Ｆｕｌｌ",)], "x string").select(T.full_norm("x").alias("n"), T.clean_name("x").alias("c")).collect()
    assert n[0].n == "strasse angstroem nord" and n[1].n == "full" and n[0].c == "Straße Ångström"
    j = spark.createDataFrame([("Here: ```json\n{\"a\": 1} \n``` bye",), ("no json",), ("{\"a\": ",)], "x string").select(T.parse_json("x", "a int").alias("j")).collect()
    assert [r.j and r.j.a for r in j] == [1, None, None]
    s = spark.createDataFrame([("é" * 200,), ("short",)], "x string").select(T.shape_text("x").alias("s")).collect()
    assert len(s[0].s.encode()) <= 254 and s[0].s.endswith("…") and s[1].s == "short"


def test_chain_operators(spark):
    schema = "chain int, segment bigint, causal_order bigint, predecessors array<bigint>, event string, process string, evidence array<string>"
    df = spark.createDataFrame([(1, 4, 1, [], "Flood", "rain", ["a"]), (1, 7, 2, [4], "flood ", "RAIN", ["b", "a"]), (1, 9, 3, [4, 7], "Slide", "x", ["c"])], schema)
    got = {r.segment: (r.event, r.evidence, r.predecessors) for r in chains.consolidate(df).collect()}
    assert got == {1: ("Flood", ["a", "b"], []), 2: ("Slide", ["c"], [1])}
    bad = spark.createDataFrame([(1, 1, 1, [2, 2], "e", "p", []), (1, 2, 3, [8], "e", "p", [])], schema)
    assert {(r.segment, r.code) for r in chains.chain_issues(bad).collect()} == {(1, "predecessor_not_earlier"), (1, "duplicate_predecessor"), (2, "not_contiguous"), (2, "unknown_predecessor")}
    moved, audit = chains.move(df, spark.createDataFrame([(1, 9, 1)], "chain int, segment bigint, to bigint"))
    assert [r.segment for r in moved.orderBy("causal_order").collect()] == [9, 4, 7] and audit.count() == 3


def test_scores_votes_and_state(spark):
    box = "model string, segment int, x0 double, y0 double, x1 double, y1 double"
    refs = spark.createDataFrame([("a", 1, 0.0, 0.0, 10.0, 10.0), ("b", 1, 5.0, 0.0, 15.0, 10.0), ("c", 1, 100.0, 100.0, 110.0, 110.0)], box)
    assert scoring.coverage_area(refs, 2).first().area == 50 and scoring.coverage_area(refs, 1).first().area == 250
    s = scoring.score(spark.createDataFrame([("m", 1, 5.0, 0.0, 10.0, 10.0)], box), refs).first()
    assert (s.precision, s.recall, s.iou, s.scale, s.score) == (1, 1, 1, 1, 1)
    v = spark.createDataFrame([("d", 3, 0), ("d", 2, 1), ("d", 2, 2), ("e", 5, 0)], "doc string, v int, pos int")
    assert {r.doc: r.v for r in metrics.mode_vote(v, "doc", "v", "pos", 0.3).collect()} == {"d": 2, "e": 0}
    done = spark.createDataFrame([(1, "x"), (2, "old")], "k int, f string")
    todo = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, f string")
    assert sorted(r.k for r in state.resume(todo, done, "k", "f").collect()) == [2, 3]
    diff = quality.compare_tables(spark.createDataFrame([(1, 1.0), (2, None)], "k int, v double"), spark.createDataFrame([(1, 1.00005), (2, 3.0), (3, 1.0)], "k int, v double"), "k", ["v"], 1e-3)
    assert {(r.k, r.field) for r in diff.collect()} == {(2, "v"), (3, "row")}


def test_rasters_and_fits(spark):
    cells = spark.createDataFrame([("d", r, c, float(abs(c - 2) + (4 - r) * 0.1 + (5 if (r, c) == (2, 2) else 0))) for r in range(5) for c in range(5)], "raster string, r bigint, c bigint, z double")
    keep = lambda d: spark.createDataFrame(d.collect(), d.schema)
    tree = raster.receivers(raster.fill(cells, keep))
    out = raster.watershed(keep(tree), keep(tree.filter("to_r is null").select("raster", "r", "c", F.lit("o").alias("outlet"))), keep)
    assert out.count() == 25
    pts = [("f", float(u), float(v), 3 + 2.0 * u - v, 1 + 0.5 * u + v, False) for u, v in ((0, 0), (4, 0), (0, 4), (4, 4))] + [("f", 2.0, 2.0, 5.0, 4.0, True)]
    df = spark.createDataFrame(pts, "figure string, u double, v double, x double, y double, check boolean")
    for kind in ("affine", "projective"):
        r = georeference.fit(df, kind).first()
        assert r.rms < 1e-6 and r.check_rms < 1e-6 and r.n == 4
    assert georeference.fit(df.limit(1), "affine").first().params is None
    line = raster.affine_fit(df.filter("u = v"), ["figure"]).first()
    assert line.bx is None and line.n == 3


def test_chainage_beyond_anchors(spark):
    anchors = spark.createDataFrame([("l", 0.0, 10.0), ("l", 10.0, 40.0)], "line string, value double, at double")
    st = spark.createDataFrame([("l", v) for v in (-2.0, 0.0, 5.0, 10.0, 11.0)], "line string, value double")
    assert sorted((r.value, r.distance) for r in spatial.chainage_lookup(st, anchors, unit=2.0).collect()) == [(-2.0, 6.0), (0.0, 10.0), (5.0, 25.0), (10.0, 40.0), (11.0, 42.0)]


def test_mask_components(spark):
    mask = spark.createDataFrame([("i", r, c) for r, c in ((0, 0), (0, 1), (1, 2), (5, 5), (2, 3), (2, 0))], "image string, r bigint, c bigint")
    keep = lambda d: spark.createDataFrame(d.collect(), d.schema)
    got = {(r.r, r.c): r.part for r in georeference.components(mask, keep, 2).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (1, 2): 0, (2, 3): 0}
