import numpy as np

import corpus_pipeline as P
from tests.llm import test_decontaminate, test_jaccard_join, test_line_dedup, test_packing
from terrasift.llm import language_id

COLUMNS = {"doc_id", "text", "lang", "source", "n_chars"}


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(docs)
    rows = {r.doc_id: r.text for r in docs.collect()}
    want = {d: t for d, t in rows.items() if (p := model.predict(t))[0] != "und" and p[1] >= P.MARGIN and model.gain(t) >= P.GAIN}
    one = P.language_stage(spark, docs, sf)
    assert set(one.columns) == COLUMNS and {r.doc_id: r.text for r in one.collect()} == want

    found = test_line_dedup.brute(list(want.items()))
    want = {d: t for d, (t, _, removed) in found.items() if not removed or t.strip(" ")}
    two = P.line_stage(spark, one, sf)
    got = {r.doc_id: r.text for r in two.collect()}
    assert set(two.columns) == COLUMNS and got == want
    assert all(r.n_chars == len(r.text) for r in two.collect())

    want = {d: want[d] for d, (_, c) in test_jaccard_join.brute(list(want.items())).items() if c == d}
    three = P.near_duplicate_stage(spark, two, sf)
    assert set(three.columns) == COLUMNS and {r.doc_id: r.text for r in three.collect()} == want

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {d for d, (_, _, _, c) in test_decontaminate.brute(list(want.items()), items).items() if c}
    four = P.decontamination_stage(spark, three, sf)
    kept = {r.doc_id: r.text for r in four.collect()}
    assert set(four.columns) == COLUMNS and kept == {d: t for d, t in want.items() if d not in bad}

    five = {r.doc_id: r for r in P.run(spark, sf).collect()}
    assert set(five) == set(kept)
    assert all(r.n_tokens == len(kept[d].split()) for d, r in five.items())
    lengths, counts = np.unique([r.n_tokens for r in five.values()], return_counts=True)
    assert sum(r.padding for r in five.values()) == test_packing.exact(lengths, counts, 8)


def test_null_and_empty_rows_pass_through(spark, sf):
    df = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "123", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert set(out.columns) == COLUMNS
        out.collect()
        assert stage(spark, df.limit(0), sf).count() == 0
    assert P.STAGES[-1][1](spark, df, sf).count() == 3
