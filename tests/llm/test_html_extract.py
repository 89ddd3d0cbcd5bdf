import re
from html import unescape

import numpy as np

from terrasift.llm import html_extract, html_train
from terrasift.llm.block_lstm import BlockLabeller, features
from terrasift.llm.html_blocks import blocks
from terrasift.llm.queries import QUERIES


def test_blocks_of_odd_markup():
    page = "stray &lt;x&gt;<p>a\n <b>b</b><br>c<p>d&nbsp;e<!-- <p>no --><script>if (a<b) '</p>'</script><ul><li>1<li>2</ul></div><td>t</td><p title='a>b'>q</p>r<"
    assert [b.text for b in blocks(page)] == ["stray <x>", "a b c", "d e", "1", "2", "t", "q", "r<"]
    assert blocks(None) == blocks("") == blocks("<script>x") == []
    assert blocks('<div class="mainNav side-bar" id=x><a href=#>ab</a>c')[0] == blocks('<div class="mainNav side-bar" id=x><a href=#>ab</a>c')[0]
    assert blocks('<div class="mainNav side-bar"><a href=#>ab</a>c')[0].path == ("div", ".main", ".nav", ".side", ".bar")
    assert [b.text for b in blocks("<p>a <math><mi>x</mi></math> <svg><text>y</text></svg><object>z</object><canvas> w</canvas></p><noscript>n</noscript><p>b<iframe>i</iframe>")] == ["a x yz w", "n", "b", "i"]
    assert len(blocks("<div>" * 3000 + "deep")[0].path) == 32


def test_gradients_by_differences():
    pages, labels = html_train.made(5, 4)
    model = BlockLabeller(seed=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, n, y = features(pages).astype(float), np.array([len(p) for p in pages]), np.array([v for ys in labels for v in ys], float)
    _, grad = model.gradients(x, n, y)
    r = np.random.default_rng(0)
    for k in ("Wxf", "Whf", "bb", "Wo", "Whb"):
        at = tuple(r.integers(0, s) for s in model.p[k].shape)
        old, eps = model.p[k][at], 1e-3
        model.p[k][at] = old + eps
        up = model.gradients(x, n, y)[0]
        model.p[k][at] = old - eps
        down = model.gradients(x, n, y)[0]
        model.p[k][at] = old
        assert abs((up - down) / (2 * eps) - grad[k][at]) < 2e-4 + 0.05 * abs(grad[k][at])


def test_held_out_accuracy():
    assert html_train.accuracy(html_extract.labeller(), seed=4242, n=300) > 0.99


def test_pages_against_their_article_element(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op6_html_extraction"](spark, sf).collect()}
    assert len(got) == len(rows)
    same = 0
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(p for p in parts if p)
        same += got[r.page_id].text == want
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    assert same >= 0.98 * len(rows)


def test_embedded_elements_and_notices():
    words = "One sentence of text stands here. Another one follows it, and a third."
    page = f"<body><noscript>Please enable JavaScript</noscript><nav><a href=#>Home</a></nav><article><h1>Title</h1><p>{words} <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><p>{words}</p><p><svg><text>Drawn words</text></svg> {words}</p></article><footer>Imprint</footer></body>"
    assert html_extract.main_texts([page]) == [["Title", f"{words} x=1", words, f"Drawn words {words}"]]


def test_null_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "<article><h1>T</h1><p>One sentence of text. Another one follows here.</p></article>", "c")], "page_id long, html string, text string")
    got = {r.page_id: (r.text, r.main.text) for r in html_extract.extract(df).collect()}
    assert got == {1: ("a", ""), 2: ("b", ""), 3: ("c", "T\nOne sentence of text. Another one follows here.")}
    assert html_extract.extract(df.limit(0)).count() == 0
