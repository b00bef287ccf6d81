from __future__ import annotations

import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import webpages
from tessera.llm.trees import BoostedTrees


@pytest.fixture(scope="module")
def model():
    return webpages.trees()


def text(source, model):
    return webpages.main_texts([source], model)[0]


def test_made_up_pages_not_seen_in_training(model):
    r, right, n = random.Random(12345), 0, 200
    for _ in range(n):
        source = webpages.sample_page(r)
        want = "\n".join(t.replace(webpages._MARK, "") for _, t in webpages.Page(source).runs if webpages._MARK in t)
        right += text(source.replace(webpages._MARK, ""), model) == want
    assert right >= 0.93 * n


def test_pages_of_the_table(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in webpages.extract(pages, model).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside.replace("<br>", " "))]
        assert got[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


BODY = "<p>One&nbsp;two &lt;b&gt; &amp; <i>three</i>\n four.</p>"


def test_what_goes(model):
    page = (
        "<html><head><title>T</title><script>var x='<p>no</p>'</script></head><body><header><a href=/>Site</a></header><nav><ul><li><a href=/a>menu</a></li></ul></nav>"
        "<div class='cookie-notice'><p>We use cookies to make this site work better.</p></div><article><h1>Title of it</h1>" + BODY * 3 + "<script>no()</script><!-- no --><style>p{}</style></article>"
        "<section class='comments'><div class='comment'><p>I think that this is wrong in many ways.</p></div></section><aside class=sidebar><p>Related things</p></aside>"
        "<form><label>Name</label><input name=n><button>Send</button></form><footer>&copy; 2024 Site</footer></body></html>"
    )
    assert text(page, model) == "Title of it\n" + "\n".join(["One two <b> & three four."] * 3)


def test_odd_sources(model):
    assert webpages.main_texts(["", " ", "<", "<p", "</p></div>", "<!-- x", "<script>x", "<![CDATA[x]]>", "<a b='>"], model) is not None
    assert text("", model) == ""
    deep = "<div>" * 3000 + "<p>text here</p>"
    assert isinstance(text(deep, model), str)
    long = "<article>" + "<p>word and word again.</p>" * 20_000 + "</article>"
    assert text(f"<html><body>{long}</body></html>", model).count("\n") == 19_999


def test_decoding_keeps_no_block_under_a_dropped_one(model):
    page = webpages.Page("<body><div><p>a</p><p>b</p></div><div><p>c</p></div></body>")
    blocks, _ = webpages.features(page)
    names = {k: (page.name[k], page.parent[k]) for k in blocks.tolist()}
    r = random.Random(0)
    import itertools

    import numpy as np

    for _ in range(60):
        logits = np.array([r.uniform(-3, 3) for _ in names])
        kept = webpages.decode(page, blocks, logits)
        best = max(
            sum(v for k, v, on in zip(names, logits, choice) if on)
            for choice in itertools.product([0, 1], repeat=len(names))
            if all(not on or names[k][1] not in names or choice[list(names).index(names[k][1])] for k, on in zip(names, choice))
        )
        assert all(page.parent[k] in kept for k in kept if k) and abs(sum(v for k, v in zip(names, logits) if k in kept) - best) < 1e-9


def test_tables(spark, model):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (2, None, "", "x"), (None, "v", "<article><h1>A b c</h1><p>Some words that make a sentence.</p></article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = webpages.extract(pages, model)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 4 and got.filter("n_chars = 0").count() == 3
    assert webpages.extract(pages.limit(0), model).count() == 0
    assert got.filter(F.col("page_id").isNull()).first()["text"].startswith("A b c")


def test_trees_learn():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    model = BoostedTrees(trees=30, depth=3).fit(x[:1000], y[:1000])
    assert ((model.logit(x[1000:]) > 0) == (y[1000:] > 0)).mean() > 0.95


PROSE = "The text of this page has several words and sentences. It goes on for a while, so that it is clearly what the page is about."


@pytest.mark.parametrize(
    "page",
    [
        PROSE, f"<p>{PROSE}</p>", f"<body>{PROSE}</body>", f"<div>{PROSE}</div>", f"<p title=\"x>{PROSE}</p>", f"<html><body><p>{PROSE}</p></body></html>",
        f"<ul class=menu><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul>{PROSE}<footer>Copyright us</footer>",
        f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><main><p>{PROSE}</p></main><footer><p>&copy; Somebody</p></footer></body></html>",
        f"<body><table><tr><td><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></td><td><p>{PROSE}</p></td></tr></table></body>",
    ],
)
def test_shapes_that_training_does_not_have(model, page):
    assert text(page, model) == PROSE


def test_mathematics_stays_and_signs_are_text(model):
    assert text(f"<article><p>{PROSE} As <math><mi>x</mi><mo>=</mo><mn>1</mn></math> says.</p></article>", model) == f"{PROSE} As x=1 says."
    assert text(f"<article><p>{PROSE} a < b and <3 c > d</p></article>", model) == f"{PROSE} a < b and <3 c > d"


@pytest.mark.parametrize("piece", ['<p title="x>', "<!", "<select>", "<div>", "<div><li></li>", "</ul>", '<a "', "<", "<li><dd>", "<!--", "<head>", "<td><ul>"])
def test_hostile_pages_take_linear_time(piece):
    times = []
    for n in (4_000, 32_000):
        began = time.perf_counter()
        webpages.Page(piece * n)
        times.append(time.perf_counter() - began)
    assert times[1] < 24 * times[0] + 1.0
