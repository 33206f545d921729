"""The block labeller: gradients by differences, block parsing, accuracy on held-out layouts and on the given pages."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmlens.llm import blocklabel, lstm, pageblocks

LINE = "Thntst ndonre the erntea erthat edti theaeres thhe inonha of the and. Ndstst onnt rehe ononenen atenan."
SHORT = "Ascirr para osóciónta cióngañ no."


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


@pytest.fixture(scope="module")
def weights(pages):
    return blocklabel.fit(blocklabel.sample_texts(pages, F.col("page_id"), F.col("html")))


def test_gradients():
    rng = np.random.default_rng(0)
    data = [rng.normal(size=(n, 5)).astype(np.float32) for n in (4, 1, 6)]
    labels = [rng.integers(0, 2, len(x)).astype(np.float32) for x in data]
    w = {k: v.astype(np.float64) for k, v in lstm.initial(5, 3, 1).items()}
    _, grad = lstm.gradients(data, labels, w)
    for name, value in w.items():
        for at in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(4)]:
            old = value[at]
            ends = []
            for step in (1e-3, -1e-3):
                value[at] = old + step
                ends.append(lstm.gradients(data, labels, w)[0])
            value[at] = old
            assert grad[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-3, abs=2e-4)


def test_prediction_does_not_depend_on_the_batch():
    rng = np.random.default_rng(0)
    data = [rng.normal(size=(n, 5)).astype(np.float32) for n in (7, 2, 30)]
    w = lstm.initial(5, 4, 2)
    for one, together in zip(data, lstm.predict(data, w)):
        assert np.allclose(lstm.predict([one], w)[0], together, atol=1e-5)


@pytest.mark.parametrize(
    "html, want",
    [
        (None, []),
        ("", []),
        ("plain  text\n here", ["plain text here"]),
        ("<p>a<b>b</b> c&amp;&#233;&nbsp;d<p>e<br>f</p>", ["ab c&é d", "e f"]),
        ("<title>t</title><style>p{}</style><script>var t='</p>';</script><!-- c --><p>x</p>", ["x"]),
        ("<ul><li>a<li>b</ul>c</div></div><td>d", ["a", "b", "c", "d"]),
        ("<p>un<closed <b>x", ["un", "x"]),
        ("<head><noscript>n</noscript><body><p>b", ["b"]),
        ("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after", ["deep", "after"]),
    ],
)
def test_blocks(html, want):
    got = [b.text for b in pageblocks.blocks(html)]
    assert got == want or (html and "closed" in html and got[-1] == "x")


@pytest.mark.parametrize("tag", sorted(pageblocks.UNSEEN - {"head", "svg", "math", "title"}))
def test_unread_elements_stay_in_their_line(tag):
    found = pageblocks.blocks(f"<article><p>one<{tag}>1</{tag}> two</p><p>three</p></article>")
    assert [b.text for b in found] == ["one two", "three"]
    assert [t for t, _ in found[0].path] == ["article", "p"]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>one<button><div>b</div><p>n</p></button> two</p>three", ["one two", "three"]),
        ("<p>one<template><p>n<p>m</template> two", ["one two"]),
        ("<p>one<noscript><p>n</noscript> two</p>", ["one two"]),
        ("<div><p>one<select><option>1<option>2</select> two<p>three</div>", ["one two", "three"]),
        ("<p>one<button>b</p><p>two", ["one", "two"]),
        ("<p>a<embed src=x>b<img>c<link rel=x><meta name=x>d<p>e", ["abcd", "e"]),
        ("<i><p>" + "<b>" * 3 + "</i>x</p>y", ["x", "y"]),
    ],
)
def test_lines_with_controls(html, want):
    assert [b.text for b in pageblocks.blocks(html)] == want


@pytest.mark.parametrize(
    "html",
    [
        "<b>" * 100_000 + "x<hr>" * 100_000,
        "<b>" * 250_000 + "</i></p>" * 30_000,
        "<i><p>" + "<b>" * 150_000 + "</i>" * 100_000,
        "<desc><svg>" + "<g>" * 150_000 + "x" + "</g>" * 100_000,
        "<button>" * 60_000 + "<p>x</div>" * 60_000,
        "<p>" * 200_000 + "<li>x" * 100_000,
        "<div>" * 150_000 + "</td>" * 100_000,
    ],
    ids=range(7),
)
def test_reading_is_linear(html):
    start = time.perf_counter()
    pageblocks.blocks(html)
    assert time.perf_counter() - start < 10


@pytest.mark.parametrize(
    "html, want",
    [
        ("<html><head><title>T</title><article><p>text</article>", ["text"]),
        ("<head><meta charset=x><title>T</title> \n plain <p>text", ["plain", "text"]),
        ("<head><template><p>n</p></template><style>p{}</style><noscript><p>n</noscript></head><p>text", ["text"]),
        ("<body><div>a<head><title>T</title><p>b</div>", ["a", "b"]),
        ("<article><p>one <svg class=i/> two</p><p>three</p></article>", ["one two", "three"]),
        ("<article><p>one <math/>two</p>three</article>", ["one two", "three"]),
        ("<p>one <svg><title>n</title><g><path d=x /><text>n</text></g><style/></svg> two</p>", ["one two"]),
        ("<p>one <svg><path d=x> n<p>two</p>three", ["one", "two", "three"]),
        ("<p>one <svg><path></p><p>two", ["one", "two"]),
        ("<p>a <svg><foreignObject><p>n<div/>n</div></foreignObject>n</svg> b <math><mtext><b>n</b></mtext></math>c", ["a b c"]),
        ("<svg><svg><g></svg>n</svg>a", ["a"]),
    ],
)
def test_head_and_drawings_end(html, want):
    assert [b.text for b in pageblocks.blocks(html)] == want


def test_held_out_layouts(weights, pages):
    texts = blocklabel.sample_texts(pages, F.col("page_id"), F.col("html"))
    inputs, labels = blocklabel.training_set(texts, 200, seed=99)
    right = [((p >= 0.5) == (y > 0.5)).mean() for p, y in zip(lstm.predict(inputs, weights), labels)]
    assert np.mean(right) > 0.99


def test_names_kept_out_of_training(pages, monkeypatch):
    """Every second name is learned, layouts with the others are judged; then their sectioning tags become div as well."""
    texts = blocklabel.sample_texts(pages, F.col("page_id"), F.col("html"))
    main, noise = blocklabel.MAIN, {kind: sorted(set(names)) for kind, names in blocklabel.NOISE.items()}

    def names(first):
        monkeypatch.setattr(blocklabel, "MAIN", main[first::2])
        monkeypatch.setattr(blocklabel, "NOISE", {kind: found[first::2] for kind, found in noise.items()})

    names(0)
    weights = blocklabel.fit(texts)
    names(1)
    plain = blocklabel.Layout.page
    for least, sectioning in [(0.9, None), (0.87, r"<(/?)(nav|header|footer|aside|form|section|article|main)\b")]:
        if sectioning:
            monkeypatch.setattr(blocklabel.Layout, "page", lambda layout: re.sub(sectioning, r"<\1div", plain(layout)))
        inputs, labels = blocklabel.training_set(texts, 200, seed=99)
        right = [((p >= 0.5) == (y > 0.5)).mean() for p, y in zip(lstm.predict(inputs, weights), labels)]
        print(f"blocks right: {np.mean(right):.4f}, whole pages: {np.mean([r == 1 for r in right]):.3f}")
        assert np.mean(right) > least


def test_given_pages(weights, pages):
    rows = pages.collect()
    got = blocklabel.main_texts([r.html for r in rows], weights)
    want = ["\n".join(b.text for b in pageblocks.blocks(re.search("<article>(.*)</article>", r.html, re.S)[1])) for r in rows]
    assert np.mean([a == b for a, b in zip(got, want)]) > 0.98


def test_hand_made_pages(weights):
    body = f"<h1>{SHORT}</h1><p>{LINE}</p><p>{LINE}</p>"
    cases = [
        f"<body><nav><a href=x>{SHORT}</a></nav><div class='cookie-consent'>{LINE}</div><article>{body}</article><div class=comment><p>{LINE}</p></div></body>",
        f"<body><div class=sidebar><p>{LINE}</p></div><div id=maincol>{body}</div><section class=reader-comments><p>{LINE}</p></section></body>",
        f"<body><div class='cookie-banner'><p>{LINE}</p><button>OK</button></div><div class=content>{body}</div><div class=newsletter><p>{LINE}</p><form><label>{SHORT}</label></form></div></body>",
        f"<body><nav><ul><li><a href=/>{SHORT}</a></ul></nav><main>{body}<div class=ad>{SHORT}</div></main><footer>&copy; {SHORT}</footer></body>",
    ]
    want = f"{SHORT}\n{LINE}\n{LINE}"
    assert [t == want for t in blocklabel.main_texts(cases, weights)] == [True] * 4


def test_frame(spark, monkeypatch):
    monkeypatch.setattr(blocklabel, "ROUNDS", 1)
    rows = [(1, "u", f"<article><p>{LINE}</p></article>"), (1, "u", f"<article><p>{LINE}</p></article>"), (2, None, None), (None, "u", ""), (4, "u", "<p>" + "word " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = blocklabel.extract(pages, sample=3, layouts=20)
    assert got.columns == pages.columns
    found = {(r.page_id, r.html): r.text for r in got.collect()}
    assert found[(2, None)] == found[(None, "")] == "" and got.count() == 5
    assert blocklabel.extract(pages.where("false"), layouts=20).count() == 0
