from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from decoyscope.llm import html_content as html


@pytest.fixture(scope="module")
def model():
    return html.fitted(list(html.built_pages(html.BUILT_PAGES)))


def test_marginals_equal_enumeration():
    chance = np.random.default_rng(3)
    for size in (1, 2, 5, 9):
        parent = np.array([-1] + [int(chance.integers(0, k)) for k in range(1, size)])
        level = np.zeros(size, dtype=int)
        for k in range(1, size):
            level[k] = level[parent[k]] + 1
        kind = chance.integers(0, 2, size)
        emission, edges = chance.normal(size=size), chance.normal(size=(2, 2, 2))
        weights = np.zeros((size, 2))
        for labels in itertools.product((0, 1), repeat=size):
            if labels[0]:
                continue
            total = sum(emission[k] * labels[k] for k in range(1, size)) + sum(edges[kind[k], labels[parent[k]], labels[k]] for k in range(1, size))
            for k in range(size):
                weights[k, labels[k]] += np.exp(total)
        want = weights[:, 1] / weights.sum(axis=1)
        assert np.allclose(html.marginals(parent, level, kind, emission, edges), want, atol=1e-9)


def test_pages_without_their_template(model):
    article = "<h1>A title here</h1><p>First &amp; best paragraph,\n of some   length, with <b>bold</b> words.</p><p>Short one.<p>Unclosed paragraph follows here, at length<br>and ends."
    want = "A title here\n\nFirst & best paragraph, of some length, with bold words.\n\nShort one.\n\nUnclosed paragraph follows here, at length and ends."
    menu = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
    rest = (
        '<aside class="sidebar"><h3>Related</h3><ul><li><a href=x>Other story</a></li></ul></aside><div class="comments"><div class="comment"><p>Nice text, I liked it, '
        'thanks.</p></div></div><form><label>Mail</label><input><button>Send</button></form><div class="cookie-notice">We use cookies, as everyone does, to serve you.</div>'
        "<footer>&copy; 2024 us</footer><script>var a = '<p>no</p>';</script><!-- <p>hidden</p> -->"
    )
    for frame in ("<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', '<section id="story">{}</section>'):
        page = f"<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style></head><body><header><a href=/>Site</a></header>{menu}{frame.format(article)}{rest}</body></html>"
        assert html.texts([page], model)[0] == [want], frame


def test_held_out_built_pages(model):
    right = wrong = missed = 0
    for page, labels in html.built_pages(150, seed=1234):
        found = html.marginals(
            np.array([-1, *page.parent[1:]]), np.array(page.level), np.array(page.kinds), np.array([model.emission(f) for f in page.features]), model.edges
        )
        for k, text in enumerate(page.texts):
            if text is not None:
                right += labels[k] == (found[k] >= 0.5)
                wrong += labels[k] < (found[k] >= 0.5)
                missed += labels[k] > (found[k] >= 0.5)
    assert right / (right + wrong + missed) > 0.95


@pytest.mark.parametrize("page", [
    None, "", "   ", "plain words", "<", "<p", "<p class='x", "</p></div>", "<script>never closed", "<!-- open", "&#0;&#xD800;&amp", "<p>" * 3000 + "x", "<div>" * 3000 + "x" + "</div>" * 9,
    "<a <b <c", '<p title="a>b">x</p>', "<ul><li>a<li>b</ul>", "<table><tr><td>a<td>b<tr><td>c</table>", "\x00<p>\x00</p>", "<p>" + "long " * 200_000,
])
def test_odd_pages_give_a_text(model, page):
    found, chances = html.texts([page, "<article><p>Fine, it is.</p></article>"], model)
    assert isinstance(found[0], str) and found[1] == "Fine, it is." and len(chances) == 2


def test_extract_keeps_rows_and_columns(spark):
    pages = [(1, "u", "<article><p>Text one, well.</p></article>", 5), (1, "u", "<article><p>Text one, well.</p></article>", 5), (None, None, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text int").repartition(2)
    found = html.extract(df, html.train(df))
    assert sorted((r.page_id or 0, r.text) for r in found.collect()) == [(0, ""), (1, "Text one, well."), (1, "Text one, well.")]
    assert html.extract(df.where("false"), html.train(df.where("false"))).count() == 0
    assert found.columns == ["page_id", "url", "html", "text", "marginals"]


def test_template_pages_of_the_test_table(spark, model):
    """The corpus' own markup names its article: what is extracted is that article's blocks."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for row in html.extract(pages, model).where(F.col("html").contains("<article>")).collect():
        inside = row.html.split("<article>")[1].split("</article>")[0]
        tree = html.parse(inside)
        assert row.text == "\n\n".join(text for text in tree.texts if text is not None)
