"""Queries against their SQL over small tables with the rows that larger ones turned out to have."""

import random
import tracemalloc

import duckdb
import pyarrow as pa
import pytest

from terrasift.functions.text import page_tokens
from terrasift.operators import links
from terrasift.operators.placements import sites
from terrasift.plans import registry
from terrasift.shared import written
from tests.oracle import compare


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / "w" / name))
    next((folder / "w" / name).glob("*.parquet")).rename(folder / f"{name}.parquet")


def same(spark, folder, name):
    return compare(spark, str(folder), registry.queries()[name], registry.oracle_sql()[name])


def test_headings_with_numbers_or_leaders(spark, tmp_path):
    heads = ["Floods", "5 Floods", "2.1. Floods", "+1 Floods", "IV. Floods", "Floods ..... 12", "Floods   12", "  Floods\n ", "Debris flow", "Debris flow", "", " Debris flow", "Slope"]
    pages = [(n, f"https://h{n % 2}.org/p", f"<p><h1>{h}</h1><h1>second</h1>") for n, h in enumerate(heads + heads[:5], 1)]
    put(spark, tmp_path, "pages", [*pages, (90, None, "<h1>Slope</h1>"), (91, "https://h1.org/", None), (92, "https://h1.org/", "no heading")], "page_id long, url string, html string")
    assert same(spark, tmp_path, "toc_resolve") == ""


def test_headings_of_all_pages_are_resolved(spark, tmp_path):
    heads = {1: "Floods", 2: "Introduction", 3: "5 Floods", 4: "Floods ..... 12", 5: "Landslides", 10: "2.1. Cliffs", 15: "IV. Slope", 16: "Twice", 20: "Twice", 21: "Blank \u2028"}
    put(spark, tmp_path, "pages", [*((n, "https://h.org/p", f"<h1>{h}</h1>") for n, h in heads.items()), (25, "https://h.org/p", None)], "page_id long, url string, html string")
    assert same(spark, tmp_path, "toc_resolve") == ""
    want = {("h.org", h.lower(), None if h == "Twice" else n) for n, h in heads.items()} | {("h.org", None, None)}
    assert {tuple(x) for x in registry.queries()["toc_resolve"](spark, str(tmp_path)).select("doc", "title_key", "page").collect()} == want


def test_signed_zeros_of_places(spark, tmp_path):
    put(spark, tmp_path, "embeddings", [(n, [-0.0002 if n < 16 else 0.031, 0.017 if n < 8 else -0.0001, 0.006 * (n - 9)], n) for n in range(24)], "vec_id long, embedding array<float>, label int")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = {r[:2]: str(r[2:]) for r in db.execute(f"SELECT vec_id, op, value, wrong FROM ({registry.oracle_sql()['geometry_operators']})").fetchall()}
    got = {tuple(r)[:2]: str(tuple(r)[2:]) for r in registry.queries()["geometry_operators"](spark, str(tmp_path)).select("vec_id", "op", "value", "wrong").collect()}
    assert sum("-0.0" in v for v in want.values()) >= 10
    assert {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v} == {} and got.keys() == want.keys()


@pytest.mark.parametrize("small", [0, 1000])
def test_sites_of_long_chains_and_copies(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(links, "SMALL", small)
    r = random.Random(small)
    # A snake of 300 boxes with its ids mixed up, each with a copy; two models on half of it, a gap after that; one box without a place.
    ids = r.sample(range(10_000), 601)
    at = [(4.5 * (n + (n >= 150)), 0.0) for n in range(300)] * 2
    rows = [(i, n % 2 if n % 300 < 150 else 5, x, y, x + 3, y + 3) for n, (i, (x, y)) in enumerate(zip(ids[:600], at, strict=True))]
    rounds = []

    def keep(df):
        rounds.append(1)
        return written(df)

    boxes = spark.createDataFrame([*rows, (ids[600], 1, None, None, None, None)], "box long, model long, x0 double, y0 double, x1 double, y1 double").repartition(5)
    got = {tuple(x) for x in sites(boxes, 1.0, 2, keep).collect()}
    left = [row[0] for n, row in enumerate(rows) if n % 300 < 150]
    assert got == {(i, min(left)) for i in left}
    assert len(rounds) <= 6


def test_links_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(links, "SMALL", 0)
    monkeypatch.setattr(links, "HELD", 3)
    r = random.Random(7)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(90)] + [(n, n + 1) for n in range(1000, 1080)]
    root = {n: n for e in edges for n in e}
    while any(root[u] != root[v] for u, v in edges):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    r.shuffle(edges)
    got = links.least_reached(spark.createDataFrame(edges, "u long, v long").repartition(6), written).collect()
    assert {tuple(x) for x in got} == {(n, least) for n, least in root.items() if n != least} and len(got) == len({x[0] for x in got})


def test_token_offsets_of_many_words_in_bounded_memory(spark, tmp_path):
    odd = ["", None, "a", " ", "Straße_1 é 12½ x-y", "ÉTÉ\n\t'The' 你好 the", "end "]
    put(spark, tmp_path, "documents", list(enumerate(odd * 20)), "doc_id long, text string")
    assert same(spark, tmp_path, "token_offsets") == ""
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20
    for t, found in zip(odd, page_tokens.func(pa.array(odd)).to_pylist(), strict=True):
        assert (found is None) == (t is None) and all(t[x["begin"] : x["end"]].lower() == x["token"] for x in found or [])
    # As a batch of the tasks: words are not all Python objects at a time.
    batch = pa.array(["The river of stones " * 2000] * 100)
    tracemalloc.start()
    got = page_tokens.func(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 100 and got[7].as_py()[1] == {"token": "river", "begin": 4, "end": 9}
    assert peak < 120 << 20
