"""Hidden elements: which are, and where they end."""

import itertools
import random

import pytest

from quorumlake.llm.html_extract import Block, blocks, extract, extracted, label, min_cut, train


def said(page):
    return [b.text for b in blocks(page)]


@pytest.mark.parametrize("attrs", ['href="/the-hidden-cost"', 'title="Hidden gems"', 'data-hidden="false"', "data-x='a hidden b'", "href=/a-hidden-b", 'title="style=display:none"', 'aria-hidden="false"', 'x-style="display:none"'])
def test_shown(attrs):
    assert said(f"<p>One <a {attrs}>two</a> three</p><p {attrs}>four</p>") == ["One two three", "four"]


@pytest.mark.parametrize("attrs", ["hidden", 'hidden=""', "HIDDEN", 'class="x" hidden', 'class="x"hidden', 'aria-hidden="true"', 'style="color:red; display: none"', "style=display:none"])
def test_hidden(attrs):
    assert said(f"<p>One</p><div {attrs}>two <div>three</div> four</div><p>five</p>") == ["One", "five"]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p hidden>a<p>b<p>c", ["b", "c"]),
        ("<ul><li hidden>a<li>b</ul><p>c</p>", ["b", "c"]),
        ("<ul><li hidden>a<ul><li>x<li>y</ul><li>b</ul><p>c", ["b", "c"]),
        ("<div><p hidden>a</div><p>c</p>", ["c"]),
        ("<table><tr><td hidden>a<td>b<tr><td>c</table>d", ["b", "c", "d"]),
        ("<dl><dt hidden>a<dd>b</dl>c", ["b", "c"]),
        ("<div hidden><p>a<p>b</div>c", ["c"]),
        ("<div hidden><script>'</div>'</script>a</div>c", ["c"]),
        ("<svg><g><svg></svg></g></svg>c", ["c"]),
        ("<select><option>a<option>b</select>c", ["c"]),
    ],
)
def test_end_of_hidden(page, want):
    assert said(page) == want


def content(page):
    return extract(page)


PROSE = "This is a whole sentence of an article, with many plain words in it, and it goes on for quite a while before it ends."


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "share-this", "layout", "header-image"])
def test_class_names_that_only_hold_a_word(name):
    assert content(f'<div class="{name}"><p>{PROSE}</p></div>') == PROSE
    assert content(f'<article class="post {name}"><p>{PROSE}</p></article>') == PROSE


@pytest.mark.parametrize("name", ["sidebar", "site-footer", "nav-bar", "comment-list", "cookieNotice", "related-posts", "ad", "ad-1", "newsletter"])
def test_class_names_of_other_parts(name):
    assert content(f'<article><p>{PROSE}</p><p>{PROSE}</p></article><div class="{name}">Read this too</div>') == f"{PROSE}\n{PROSE}"
    assert content(f'<article><p>{PROSE}</p><div class="{name}">Buy now</div><p>{PROSE}</p></article>') == f"{PROSE}\n{PROSE}"


def test_article_tag_outweighs_its_class():
    assert content(f'<article class="share"><p>{PROSE}</p></article>') == PROSE


def test_formulas_and_objects_stay():
    assert content(f"<article><p>{PROSE} <math><mi>x</mi></math></p><object><p>{PROSE}</p></object></article>") == f"{PROSE} x\n{PROSE}"


def test_neighbours_overrule_marks():
    sure = (6.0,) + (0.0,) * 8
    assert label([Block("a b.", 0, "p", m, 1, 2) for m in (1, -1, 1)], sure) == [True, True, True]
    assert label([Block("a b.", 0, "p", m, 1, 2) for m in (-1, -1, -1)], sure) == [False, False, False]
    assert label([Block("a b.", 0, "p", m, 1, 2) for m in (-1, 1, -1)], tuple(-x for x in sure)) == [False, False, False]
    assert label([Block("a b.", 0, "p", 1, 1, 2)], tuple(-x for x in sure)) == [True]


def test_cut_is_the_least_one():
    rnd = random.Random(4)
    for _ in range(200):
        n = rnd.randint(1, 8)
        odds = [rnd.choice((-1, 1)) * rnd.random() * 4 for _ in range(n)]
        edges = [(a, b, rnd.random() * 3) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.5]
        cost = lambda x: sum(abs(o) for o, k in zip(odds, x, strict=True) if (o > 0) != k) + sum(w for a, b, w in edges if x[a] != x[b])  # noqa: E731, B023
        assert cost(min_cut(odds, edges)) <= min(map(cost, itertools.product((False, True), repeat=n))) + 1e-6


def test_odd_pages(spark):
    page = f"<article><p>{PROSE}</p></article>"
    rows = [(1, "u", page, 7), (1, "u", page, 7), (2, None, None, None), (3, "v", "", 0), (None, "w", "plain &amp; bare", 1), (4, "x", "<p>" + (PROSE + "<p>") * 20_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = extracted(pages, train(pages)).collect()
    assert sorted((str(r.page_id), r.url or "", r.n_chars == len(r.text)) for r in got) == sorted((str(a), b or "", True) for a, b, _, _ in rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == PROSE and by[2] == by[3] == "" and by[4] == "\n".join([PROSE] * 20_000)
    empty = spark.createDataFrame([], pages.schema)
    assert train(empty) and extracted(empty).collect() == []
