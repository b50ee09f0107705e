import html
import re

import numpy as np
import pytest

from conftest import TABLES
from veritable.llm import html_extraction as X
from veritable.llm.html_blocks import blocks


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{TABLES}/pages.parquet")


@pytest.fixture(scope="module")
def labeller(pages):
    return X.trained(X.sample_texts(pages))


def test_gradient_agrees_with_differences():
    page = blocks("<nav><a>x y</a></nav><article><h1>a b</h1><p>c d e</p></article>")
    small = blocks("<p>only one</p>")
    batch = X.Batch([X.features(page), X.features(small)])
    y = np.array([[0, 1, 1], [1, 0, 0]], np.float32)
    model = X.Labeller()
    model.weights = {k: w.astype(np.float64) for k, w in model.weights.items()}
    rng = np.random.default_rng(0)

    def loss():
        states = np.concatenate([model._run(side, model._given(side, batch), batch.mask)[0] for side in "fb"], axis=2)
        p = model._sure(batch, states)
        return -(np.where(y > 0, np.log(p), np.log(1 - p)) * batch.mask).sum() / batch.mask.sum()

    grads = model.gradient(batch, y)
    for name in ("hf", "hb", "xf", "xb", "bf", "o", "s", "d"):
        where = tuple(rng.integers(0, n) for n in model.weights[name].shape) if name[0] != "x" else (int(rng.choice(np.flatnonzero(grads[name].any(axis=1)))), 3)
        kept = model.weights[name][where]
        model.weights[name][where] = kept + 1e-2
        up = loss()
        model.weights[name][where] = kept - 1e-2
        down = loss()
        model.weights[name][where] = kept
        assert abs((up - down) / 2e-2 - grads[name][where]) < 2e-3, name


def test_held_out_layouts(pages, labeller):
    composer = X.Composer(X.sample_texts(pages), seed=77)
    found = [blocks(composer.page()) for _ in range(200)]
    hits = [b.marked == bool(k) for page, keep in zip(found, labeller.keep(found)) for b, k in zip(page, keep)]
    assert np.mean(hits) > 0.97


def test_pages_against_their_article(spark, pages, labeller):
    def article(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inner)).split())

    rows = {r.page_id: r for r in X.extract(pages, labeller=labeller).collect()}
    source = {r.page_id: r for r in pages.collect()}
    assert set(rows) == set(source)
    assert all(r.n_chars == len(r.text) and r.url == source[i].url for i, r in rows.items())
    assert np.mean([rows[i].text == article(source[i].html) for i in source]) > 0.97


@pytest.mark.parametrize("page, texts", [
    ("<p>a<b>b</b>c &amp; d<br>e\n f</p>", ["abc & d e f"]), ("<p>one<p>two", ["one", "two"]), ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]),
    ("<script>var a='<p>no</p>';</script><style>p{}</style>yes", ["yes"]), ("<title>t</title><head><meta></head><body>x", ["x"]),
    ("a <!-- <p>no</p> --> b", ["a b"]), ("<p title='a>b'>x</p>", ["x"]), ("1 < 2 &lt; 3", ["1 < 2 < 3"]), ("<div", ["<div"]), ("", []), (None, []),
    ("<html><head><title>t</title><meta><body><p>x", ["x"]), ("<head><style>a</style><p>x</p>", ["x"]), ("a<!-->b<!-- no -->c<!-- no --!>d", ["abcd"]),
    ("<P CLASS=a>x</P><DIV>y", ["x", "y"]), ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
    ("<select><option>no</select>yes", ["yes"]), ("<ul><li>a<ul><li>b</ul><li>c</ul>d", ["a", "b", "c", "d"]),
    ("a<svg><text>shown</text><path d=\"M 1\"/></svg>b", ["a", "shown", "b"]), ("a<svg class=i><path/></svg> b", ["a b"]), ("</p></div>x</b>", ["x"]), ("<textarea><p>no</textarea>yes", ["yes"]), ("<script>open", []),
])
def test_blocks(page, texts):
    assert [b.text for b in blocks(page)] == texts


def test_odd_rows(spark, labeller):
    long_page = "<article>" + "<p>some words in a long page</p>" * 3000 + "</article>"
    rows = [(1, None, None, "c"), (1, None, None, "c"), (None, "u", "", "c"), (2, "v", long_page, None), (3, "w", "no markup at all", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = X.extract(pages, labeller=labeller).collect()
    assert len(out) == 5 and [r.text for r in out if r.page_id == 1] == ["", ""]
    assert next(r for r in out if r.page_id == 2).text == " ".join(["some words in a long page"] * 3000)
    assert X.extract(pages.limit(0), labeller=labeller).collect() == []


@pytest.mark.parametrize("page, texts", [
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", ["so x=2 holds"]), ("<p>a<math/>b</p><p>c</p>", ["ab", "c"]),
    ("<noscript><p>whole body</p></noscript>", ["whole body"]), ("<p>a<noscript>b</noscript>c</p>", ["a", "b", "c"]),
    ("a<xmp><b>x</b> &amp; y</xmp>b", ["a", "<b>x</b> &amp; y", "b"]), ("<xmp>open <p>", ["open <p>"]), ("<object data=x><p>instead</p></object>z", ["instead", "z"]),
    ("<head><noscript><style>a</style>no</noscript></head><body>x", ["x"]), ("<iframe src=x></iframe>a<video><p>no player</p></video>b", ["a", "no player", "b"]),
])
def test_text_of_all_other_elements_is_in_a_block(page, texts):
    assert [b.text for b in blocks(page)] == texts


def test_formulas_listings_and_bodies_of_an_article_are_kept(spark, labeller):
    words = "a long sentence of the article that goes on for a while, with some words more."
    body = f"<h1>the heading</h1><p>{words} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {words}</p><xmp>{words} a &lt; b</xmp><p>{words}</p>"
    menu = "<nav class=menu><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>"
    pages = [(1, "u", f"<html><body>{menu}<article>{body}</article></body></html>"), (2, "u", f"<html><body>{menu}<noscript><article>{body}</article></noscript></body></html>")]
    want = f"the heading {words} x=2 {words} {words} a &lt; b {words}"
    rows = X.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), labeller=labeller).collect()
    assert [r.text for r in rows] == [want, want]


@pytest.mark.parametrize("page, count", [
    ("<a " * 330_000, 1), ("<![CDATA[" * 110_000, 1), ("<![CDATA[" * 110_000 + ">", 0), ("<b>" * 150_000 + "</i>" * 150_000 + "x", 1),
    ("<i><div>" + "<b>" * 120_000 + "</i>" * 120_000 + "x", 1), ("<div>x" * 170_000, 170_000), ("<div class='a b'><b>x" * 50_000, 50_000),
    ("<a \"'>" * 160_000, None), ("<!-- " * 200_000, 0), ("<p>x<li>y" * 100_000, 200_000), ("<table><tr><td>z" * 60_000, 60_000), ("<script>" * 120_000, 0),
])
def test_time_and_memory_grow_with_the_page_only(page, count):
    import time
    import tracemalloc

    start = time.process_time()
    found = blocks(page)
    if found:
        X.features(found)
    assert time.process_time() - start < 5
    assert count is None or len(found) == count
    tracemalloc.start()
    kept = blocks(page[: len(page) // 4])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 * len(page) + 1_000_000 and kept is not None


def test_slots_of_a_path_are_those_of_all_its_tags():
    """Shared sets of outer tags give what the whole path gives."""
    import zlib

    page = "<html><body class='Main page'><div id=a><p class='lead x'>one</p><ul><li>two<b>three</b></li></ul></div>four<section><div><div id=a>five"
    for block in blocks(page):
        path, node = [], block.path
        while node.depth:
            path.insert(0, (node.tag, node.names))
            node = node.outer
        tokens = {f"t:{t}" for t, _ in path} | {f"n:{w}" for _, ws in path for w in ws}
        for k, (t, ws) in enumerate([x for x in path if x[0] in X.BLOCK][-3:][::-1]):
            tokens |= {f"{k}:{t}", *(f"{k}:{w}" for w in ws)}
        tokens.add("/".join(t for t, _ in path[-2:]))
        assert X._path_slots(block.path) == tuple(sorted({zlib.crc32(t.encode()) % X.PATH_FEATURES for t in tokens}))


def test_the_sample_is_of_distinct_pages(spark):
    rows = [(f"<p>page {i}</p>",) for i in range(50)]
    once = spark.createDataFrame(rows, "html string")
    hot = spark.createDataFrame(rows + [rows[7]] * 900 + [(None,)] * 900, "html string").repartition(7)
    assert sorted(X.sample_texts(once, sample_pages=20)) == sorted(X.sample_texts(hot, sample_pages=20)) and len(X.sample_texts(hot, sample_pages=20)) == 20
    assert X.sample_texts(once.limit(0)) == []
