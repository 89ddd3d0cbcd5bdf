import random

import pytest

from terrasift.functions.text import text_key
from terrasift.operators import citations as C


def brute(quotes, pages):
    """For each quotation the first of all pages in all three views."""
    out = set()
    by_doc = {}
    for doc, page, key in sorted(pages):
        by_doc.setdefault(doc, []).append((page, key))
    for quote_id, doc, q, hint in quotes:
        found = []
        own = by_doc.get(doc, [])
        for k, (page, key) in enumerate(own):
            views = [key, key.replace("­", ""), f"{key} {own[k + 1][1]}" if k + 1 < len(own) else key]
            found += [(v, page != hint, page) for v, text in enumerate(views, 1) if q and q in text]
        if found:
            v, _, page = min(found)
            out.add((quote_id, doc, page, v, page == hint))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quotations_against_all_pages(spark, seed):
    r = random.Random(seed)
    vocabulary = ["river", "flood", "the", "the", "of", "Ort­schaft", "straße", "in", "1987", "debris", "a"]
    pages = [(d, p, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 5, 12, 40])))) for d in "xy" for p in range(0, 60, 2)]
    quotes = []
    for k in range(160):
        d, at = r.choice("xy"), r.randrange(29)
        words = " ".join(t for dd, _, t in pages if dd == d).split() if k % 3 else " ".join(t for _, _, t in pages[at : at + 2]).split()
        a = r.randrange(max(1, len(words) - 3))
        text = " ".join(words[a : a + r.randint(1, 14)])
        cut = text[r.randint(0, 2) : len(text) - r.randint(0, 2)] if k % 4 == 0 else text
        quotes.append((f"q{k}", d, cut.replace("­", "") if k % 5 == 0 else cut, r.choice([None, 2 * at])))
    quotes += [("nowhere", "x", "these words are on no page at all", 1), ("empty", "x", "", 1), ("null", "x", None, 1), ("other", "z", "the of the of the of the", 0)]
    p = spark.createDataFrame([*pages, ("z", 0, None)], "doc string, page int, text string")
    q = spark.createDataFrame(quotes, "quote_id string, doc string, quote string, hint int")
    keyed = [(x.doc, x.page, x.k or "") for x in p.select("doc", "page", text_key("text").alias("k")).collect()]
    asked = [(x.quote_id, x.doc, x.k, x.hint) for x in q.select("quote_id", "doc", text_key("quote").alias("k"), "hint").collect()]
    got = {(x.quote_id, x.doc, x.page, x.view, x.page_hint_ok) for x in C.quote_pages(q, p).collect()}
    assert got == brute(asked, keyed)
    assert {v for *_, v, _ in got} == {1, 2, 3} and len(got) > 80


def test_titles_are_not_looked_up_in_tables_of_contents(spark):
    pages = spark.createDataFrame([("a", 1, "floods", True), ("a", 2, "floods", False), ("a", 3, "slope", True), ("a", 4, "cliffs", False), ("a", 5, "cliffs", False), ("b", 6, "slope", False)], "doc string, page long, heading_key string, is_toc boolean")
    got = C.toc_pages(pages.select("doc", pages.heading_key.alias("title_key")).distinct(), pages).collect()
    assert {tuple(x) for x in got} == {("a", "floods", 2), ("a", "slope", None), ("a", "cliffs", None), ("b", "slope", 6)}
