from __future__ import annotations

import itertools
import re

import numpy as np
import pytest

from titlekit.llm import extract
from titlekit.llm.dom import Page
from titlekit.llm.labelled_pages import BODIES, labelled_pages


@pytest.fixture(scope="module")
def model():
    return extract.fit(labelled_pages())


def test_beliefs_against_all_labellings():
    random = np.random.default_rng(1)
    parent = np.array([-1, 0, 1, 1, 0, -1, 5])
    depth = np.array([0, 1, 2, 2, 1, 0, 1])
    scores, bond = random.normal(0, 2, 7), random.normal(0, 1, (2, 2))
    got, pairs = extract.beliefs(scores, parent, depth, bond)
    weights, ones, both = 0.0, np.zeros(7), np.zeros((7, 2, 2))
    for y in itertools.product((0, 1), repeat=7):
        w = np.exp(scores @ np.array(y) + sum(bond[y[p], y[i]] for i, p in enumerate(parent) if p >= 0))
        weights += w
        ones += w * np.array(y)
        for i, p in enumerate(parent):
            if p >= 0:
                both[i, y[p], y[i]] += w
    assert np.allclose(got, ones / weights) and np.allclose(pairs, both / weights)


def test_held_out_pages(model):
    pages = [Page(p) for p in labelled_pages(seed=77)]
    trees = extract.Trees(pages)
    y = np.concatenate([extract.labels_of(p) for p in pages])
    assert ((model.marginals(trees) > 0.5) == y).mean() > 0.98


def test_given_pages(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    texts = model.texts([r["html"] for r in rows])
    right = 0
    for r, text in zip(rows, texts):
        inside = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        inside = re.sub("<[^>]*>", " ", re.sub(r"</?(?:b|i|em|a)\b[^>]*>", "", inside))
        import html

        right += text == " ".join(html.unescape(inside).split())
    assert right >= 0.99 * len(rows)


def test_comments_and_adverts_go(model):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><div class=logo>Site</div><nav><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul></nav></header>"
        "<div class='cookie-banner'><p>We use cookies. Accept them.</p><button>OK</button></div><article><h1>A title &amp; more</h1><p>First <b>bold</b>\n paragraph,&nbsp;with <a href=/x>a link</a>. It goes on for a while.<p>Second one<br>after a break, long enough to be text."
        "<script>var x = '<p>no</p>';</script><section class='comments'><h3>Comments</h3><div class='comment'><p>I disagree, says a reader.</p></div></section></article>"
        "<aside class='sidebar'><h4>Popular</h4><ul><li><a href=/1>One</a></li></ul></aside><footer>&copy; Site. All rights reserved.</footer></body></html>"
    )
    assert model.texts([page]) == ["A title & more First bold paragraph, with a link. It goes on for a while. Second one after a break, long enough to be text."]


def test_reading_of_broken_pages():
    def text(page):
        read = Page(page)
        return read.text(np.ones(len(read.parent), dtype=bool))

    assert text("a < b &lt; c<!-- gone --><p>d") == "a < b < c d"
    assert text("x<script>if (a<b) {}</script>y<style>z") == "xy"
    assert text("one<a title='two>three'>four</a>") == "onefour"
    assert text("one<a title='never closed>three") == "one"
    assert text("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>") == "a b c d e"
    assert text("<p>a<p>b</p></p><div>c</div></div>d") == "a b c d"
    assert text("</nothing>a<!doctype html><?php echo 1 ?>b") == "ab"
    assert text("<p" * 50000) == "" and text("<div>" * 3000 + "deep") == "deep"
    assert [Page("<ul><li>a<li>b</ul>").tags, Page("<table><tr><td>a<td>b<tr><td>c").tags] == [["html", "ul", "li", "li"], ["html", "table", "tr", "td", "td", "tr", "td"]]
    assert Page("<table><tr><td>a<td>b<tr><td>c").parent == [-1, 0, 1, 2, 2, 1, 5]


def test_tables(spark):
    schema = "page_id bigint, url string, html string, text string, id int, n_chars int"
    long = "<article><h1>T</h1>" + "<p>Some sentence, quite ordinary, in a long page.</p>" * 5000 + "</article>"
    rows = [(1, "u", None, "t", 1, 1), (2, None, "", "t", 1, 1), (None, "u", "<p>x", "t", 1, 1), (3, "u", long, "t", 1, 1), (3, "u", long, "t", 1, 1)]
    got = extract.extracted(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert {len(r["text"].split()) for r in got if r["page_id"] == 3} == {1 + 8 * 5000}
    assert extract.extracted(spark.createDataFrame([], schema)).count() == 0


STORY = "The harbour was quiet that morning, and the boats had not yet left for the open sea."
PARAGRAPH = "<p>" + STORY + " Nobody spoke, since there was little to say about the weather or the catch.</p>"


def comments(n):
    return "<div class='comments'><h3>Comments</h3>" + "".join(f"<div class='comment'><p>I do not agree with number {i}, says a reader.</p></div>" for i in range(n)) + "</div>"


def plain(part):
    return " ".join(re.sub("<[^>]*>", " ", part).split())


@pytest.mark.parametrize("around", [("", ""), ("<nav><ul><li><a href=/>Home</a><li><a href=/b>About</a></ul></nav>", "<footer>&copy; Site. All rights reserved.</footer>")])
def test_pages_without_telling_tags(model, around):
    """Few or many paragraphs in a plain block, with any number of comments beside or inside."""
    cases = []
    for n in (1, 2, 4):
        body = f"<div class=x><h1>A heading here</h1>{PARAGRAPH * n}</div>"
        cases += [(body + (comments(c) if c else ""), body) for c in (0, 1, 3, 8, 20)]
    main = f"<main>{PARAGRAPH}</main>"
    cases += [(main, main), (main + comments(1), main), (f"<main>{PARAGRAPH}{comments(1)}</main>", main)]
    part = f"<article><h1>Title of it</h1>{PARAGRAPH}<section><h2>A part</h2><div>{STORY}</div></section>{PARAGRAPH}</article>"
    cases.append((part, part))
    for page, want in cases:
        assert model.texts([f"<html><head><title>t</title></head><body>{around[0]}{page}{around[1]}</body></html>"]) == [plain(want)], page


@pytest.mark.parametrize("start", range(4))
def test_held_out_layouts(start):
    """Blocks of layouts that the model has not seen at all."""
    away = BODIES[start::4]
    model = extract.fit(labelled_pages(bodies=tuple(b for b in BODIES if b not in away)))
    pages = [Page(p) for p in labelled_pages(seed=9, bodies=away)]
    trees = extract.Trees(pages)
    y = np.concatenate([extract.labels_of(p) for p in pages])
    size = np.concatenate([[sum(map(len, own)) for own in p.own] for p in pages])
    right = (model.marginals(trees) > 0.5) == y
    assert right.mean() > 0.9 and (right * size).sum() > 0.95 * size.sum()


def test_parts_without_an_end(model):
    head, tail = f"<article><h1>Title of it</h1>{PARAGRAPH}", f"{PARAGRAPH}</article>"
    want = plain(head + tail)
    for odd in ("<svg>", "<svg><path d='M0'>", "<template>", "<noembed>", "<svg><path/></svg>", "<template><p>never shown</p></template>", "<svg><foreignObject><p>drawn</p></foreignObject></svg>", "<svg><svg></svg>drawn</svg>"):
        assert model.texts([f"<body>{head}{odd}{tail}</body>"]) == [want], odd
    assert model.texts([f"<body>{head}<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p><xmp>a < b</xmp>{tail}</body>"]) == [plain(head) + " so x=1 holds a < b " + plain(tail)]


def test_many_unclosed_parts_are_read_in_linear_time():
    page = Page("<template>" * 20000 + "<noembed>" * 20000 + "text")
    assert page.text(np.ones(len(page.parent), dtype=bool)) == "text"
    page = Page("<svg><p>a</p>" * 20000)
    assert page.text(np.ones(len(page.parent), dtype=bool)) == "a " * 19999 + "a"
