from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest

from edupulse.llm.extraction import _edges, blocks, extract, fit, main_text, minimum_cut

PAGE = """<!DOCTYPE html><html><head><title>Title</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav><!-- ad --><div class="ad">Buy now. It is cheap, they say.</div>
<article><h1>Head &amp; line {n}</h1><p>First  paragraph,\n with <b>bold</b> text&nbsp;and a <a href="x">link</a>. It goes on.<p>Second one&hellip; it ends here.</p>
<aside>An aside, no part of it.</aside><form><label>Mail</label><input name=m><button>Send</button></form><div class="cookie-notice">We use cookies.</div>
<section id="comments"><p>Nice article, I say.</p></section></article><div class="sidebar"><p>Related things.</p></div><footer>&copy; Site</footer></body></html>"""
TEXT = "Head & line {n}\n\nFirst paragraph, with bold text and a link. It goes on.\n\nSecond one… it ends here."


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"u{i}", PAGE.format(n=i), "x") for i in range(40)]
    rows += [(40, None, None, "x"), (None, "u", "", "x"), (42, "u", "<p>Open <b>tags, and &lt;signs&gt; <!-- never closed", "x"), (0, "u0", PAGE.format(n=0), "x"),
             (43, "u", "<article>" + "<div>" * 3000 + "deep text" + "</div>" * 10, "x"), (44, "u", "<article><p>" + "word " * 60_000 + "</article>", "x"), (45, "u", "< 3 and <3 \" ' <a b=\"", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string")


@pytest.mark.parametrize("quote", ["'", '"'])
def test_long_attribute_is_no_text(quote):
    html = f"<article><p>Before it.</p><div class=sidebar data-state={quote}{'a > b ' * 20_000}{quote}>Inside it.</div><p>After it.</p></article>"
    found = blocks(html)
    assert [b.text for b in found] == ["Before it.", "Inside it.", "After it."]


def test_article_text(pages):
    rows = extract(pages).collect()
    assert len(rows) == 47
    got = {(r["page_id"], r["url"]): r for r in rows}
    for i in range(40):
        assert got[i, f"u{i}"]["text"] == TEXT.format(n=i)
    assert got[40, None]["text"] == "" and got[None, "u"]["n_chars"] == 0
    assert got[43, "u"]["text"] == "deep text" and got[44, "u"]["text"] == " ".join(["word"] * 60_000)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_pages_without_telling_elements_go_by_the_classifier(pages):
    weights = fit(pages)
    page = "<body><div><a href=a>Home</a></div><div><a href=b>News</a></div><div><p>" + "</p><p>".join(["A sentence of some length, with commas, that ends. Another follows it."] * 4) + "</p></div></body>"
    text = main_text(page, weights)
    assert text.count("A sentence") == 4 and "Home" not in text and "News" not in text


def test_blocks():
    found = blocks("<p>a<br>b <i>c</i></p>d<ul><li>e<li>f &eacute;</ul><script>no</script><textarea>no</textarea>")
    assert [b.text for b in found] == ["a b c", "d", "e", "f é"]
    assert found[2].node is not found[3].node and found[2].node.parent is found[3].node.parent  # siblings


@pytest.mark.parametrize("unit", ["<div>a {}", "<b>a {}<p>", "<p>a {}</i></x>", "<a href=u><span>a {}<div></div>"])
def test_deep_pages_take_time_in_proportion(unit):
    n = 100_000
    start = time.process_time()
    found = blocks("".join(unit.format(i) for i in range(n)))
    edges = _edges(found)
    assert time.process_time() - start < 30
    assert sum(len(b.text.split()) for b in found) == 2 * n and len(edges) >= len(found) - 1


def test_links_and_open_paragraphs_however_deep():
    found = blocks("<a href=u>" + "<span>" * 9 + "link text" + "</span>" * 9 + "</a> plain<p>" + "<i>" * 20 + "one<p>two")
    assert [(b.text, b.linked) for b in found] == [("link text plain", 9), ("one", 0), ("two", 0)]
    assert found[1].node.parent is None and found[2].node.parent is None


@pytest.mark.parametrize("seed", range(40))
def test_minimum_cut_is_minimal(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 9)
    gain = [rng.choice([-1, 1]) * rng.random() * 2 for _ in range(n)]
    edges = [(i, j, rng.random() * 2) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]

    def cost(label):
        return sum(abs(g) for g, x in zip(gain, label, strict=True) if (g > 0) != x) + sum(w for i, j, w in edges if label[i] != label[j])

    best = min(cost(x) for x in itertools.product([False, True], repeat=n))
    assert np.isclose(cost(minimum_cut(gain, edges)), best)


def test_long_chains(seed=2):
    rng = random.Random(seed)
    n = 3000
    gain = [rng.uniform(-1, 1) for _ in range(n)]
    label = minimum_cut(gain, [(i, i + 1, 1.0) for i in range(n - 1)])
    # The chain's optimum by dynamic programming.
    keep, drop = 0.0, 0.0
    for i, g in enumerate(gain):
        a, b = max(-g, 0), max(g, 0)
        keep, drop = (min(keep, drop + (i > 0)) + a, min(drop, keep + (i > 0)) + b)
    cost = sum(abs(g) for g, x in zip(gain, label, strict=True) if (g > 0) != x) + sum(a != b for a, b in zip(label, label[1:]))  # noqa: B905
    assert np.isclose(cost, min(keep, drop))


def test_nothing(pages):
    assert extract(pages.where("false")).count() == 0
