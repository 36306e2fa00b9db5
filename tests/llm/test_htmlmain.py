import random
import re
from html import unescape

import numpy as np
import pytest

from gridspark.llm import htmlmain
from gridspark.llm.queries import QUERIES

PAGES = "page_id long, url string, html string, text string"


@pytest.fixture(scope="module")
def net():
    return htmlmain.trained()


def article(html):
    """The article of the tables' pages, by patterns that hold for these alone."""
    inside = re.search(r"<article>(.*)</article>", html, re.DOTALL)[1]
    parts = re.split(r"</?(?:p|h1|h2|ul|li|div)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", inside)))
    return "\n".join(t for p in parts if (t := " ".join(unescape(p).split())))


def test_every_page_of_the_table(spark, tiny):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    got = QUERIES["op10_html_extraction"](spark, tiny).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == article(pages[r["page_id"]])
        assert r["n_chars"] == len(r["text"])


def test_held_out_layouts(net):
    rng = random.Random(77)
    wrong = total = 0
    for _ in range(200):
        blocks, labels = htmlmain.layout(rng)
        if blocks:
            wrong += int(((net.label([htmlmain.vectors(blocks)])[0] > 0.5) != (labels > 0.5)).sum())
            total += len(blocks)
    assert wrong <= 0.01 * total


def test_gradients_against_differences():
    net = htmlmain.Labeller(np.random.default_rng(0))
    net.weights = [w.astype(np.float32) for w in net.weights]
    rng = random.Random(1)
    pages, labels = zip(*[(htmlmain.vectors(b), y) for b, y in (htmlmain.layout(rng) for _ in range(3)) if b], strict=True)
    truth = np.concatenate(labels)

    def loss():
        p = np.clip(np.concatenate(net.label(list(pages))).astype(float), 1e-7, 1 - 1e-7)
        return -np.mean(truth * np.log(p) + (1 - truth) * np.log(1 - p))

    grads = net.gradients(list(pages), truth)
    for w, g in zip(net.weights, grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = w[at], 1e-2
        w[at] = old + step
        up = loss()
        w[at] = old - step
        down = loss()
        w[at] = old
        assert abs((up - down) / (2 * step) - g[at]) <= 0.05 * abs(g[at]) + 1e-4


def test_blocks_and_references():
    html = "<body><p>a&amp;b &nbsp; c<br>d<b>e</b>f<p>g<ul><li>h<li>i &lt;x&gt;</ul><script>var t='</p>';</script><!-- no --><pre>j\n  k</pre><td>l"
    assert [t for _, t, _ in htmlmain.leaves(html)] == ["a&b c def", "g", "h", "i <x>", "j k", "l"]
    assert htmlmain.leaves(None) == [] and htmlmain.leaves("") == []


def test_mixed_page(net):
    text = "The committee met on Monday to talk about the new bridge, which will be built over the river in the coming year."
    html = f"""<html><head><title>T</title></head><body><header class="site-header"><p>My site</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies.</p></div><article><h1>A new bridge</h1><p>{text}</p><div class="ad">Buy now</div><p>{text}</p>
    <section class="comments"><h3>Comments</h3><div><p>Great text, thanks for the post</p></div></section></article><aside class="sidebar"><p>More posts</p></aside>
    <form><label>Email</label><button>Send</button></form><footer>&copy; me</footer></body></html>"""
    assert htmlmain.main_texts(net, [html]) == [f"A new bridge\n{text}\n{text}"]


def test_awkward_and_empty_tables(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<article><p>" + "word " * 60_000, "x"), (3, "u", "<<<>>&&&#xD800;<", None), (3, "u", "<<<>>&&&#xD800;<", None), (4, "u", "<div>" * 3_000 + "deep", None)]
    got = htmlmain.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert (by[1]["text"], by[2]["n_chars"], by[None]["n_chars"]) == ("", 0, 60_000 * 5 - 1)
    assert htmlmain.extract(spark.createDataFrame([], PAGES)).count() == 0


TEXT = "The committee met on Monday to talk about the new bridge, which will be built over the river in the coming year."


@pytest.mark.parametrize(
    "html",
    [
        f'<body class="td-animation"><div class="td-header-wrap"><div class="td-header-menu"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></div></div><div class="td-main"><div class="td-pb-span8"><h1 class="entry-title">A bridge</h1><p>{TEXT}</p><p>{TEXT}</p></div></div></body>',
        f'<body><table><tr><td><a href="/">Home</a><br><a href="/l">Links</a></td><td><h2>A bridge</h2><p>{TEXT}</p><p>{TEXT}</p></td></tr></table></body>',
    ],
)
def test_layouts_that_no_generator_made(net, html):
    text = htmlmain.main_texts(net, [html])[0]
    assert text.count(TEXT) == 2 and "Home" not in text


def test_deep_pages_take_no_more_than_their_length():
    import tracemalloc

    tracemalloc.start()
    blocks = htmlmain.leaves("<div class='a b c'>x" * 20_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(blocks) == 20_000 and peak < 64 << 20


def test_formulas_and_drawings():
    html = "<p>It holds that <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here.<svg><title>icon</title><text>label</text></svg></p>"
    assert [t for _, t, _ in htmlmain.leaves(html)] == ["It holds that x=2 here.label"]
    many = htmlmain.leaves(f'<p class="{" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))}">x')
    assert many[0][0][2] == 201  # every word of an attribute counts


SHORT = "It rained."


@pytest.mark.parametrize(
    ("html", "kept", "gone"),
    [
        (f'<html><body><div id="mw-head"><ul><li><a href="/">Main page</a></li></ul></div><div id="mw-content-text"><table class="infobox"><tr><th>Born</th><td>1901</td></tr></table><h2>Life</h2><p>{TEXT}</p><p>{SHORT}</p></div></body></html>', ["Born", "1901", "Life", TEXT, SHORT], ["Main page"]),
        (f'<html><body><ul class="menu"><li><a href="/">Home</a></li></ul><div id="content">First line of it<br>second line here<br><br>third one.</div><footer>Copyright 2020</footer></body></html>', ["First line of it second line here third one."], ["Home", "Copyright"]),
        (f"<html><body><h1>On the weather of the north</h1><p>{TEXT}</p><p>{SHORT}</p><p>{TEXT}</p></body></html>", ["On the weather of the north", TEXT, SHORT], []),
        (f'<body><header><a href="/">Site</a></header><section id="story"><h1>Big news</h1><div>{TEXT}</div><div>{TEXT}</div></section><div class="comments"><p>great post</p></div></body>', ["Big news", TEXT], ["Site", "great post"]),
        ("<html><body><main><p>Gone fishing.</p></main></body></html>", ["Gone fishing."], []),
        (f'<div><div><a href="/">Home</a> <a href="/a">About</a></div><div><h1>A tale of two rivers</h1><div>{TEXT}</div><div>{TEXT}</div></div></div>', ["A tale of two rivers", TEXT], ["Home"]),
        (f"<p>{TEXT}</p>", [TEXT], []),
    ],
)
def test_hand_written_pages(net, html, kept, gone):
    lines = htmlmain.main_texts(net, [html])[0].split("\n")
    assert all(k in lines for k in kept) and not any(g in line for g in gone for line in lines)
