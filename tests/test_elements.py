"""The element table against a plain tree, and the readers on it on pages with nested and unclosed elements."""

import random
from xml.etree import ElementTree

from quorumlake.operators import elements as E


def page(spark, *html):
    return spark.createDataFrame([(k, h, "2020-01-02") for k, h in enumerate(html)], "page_id long, html string, date string")


def grown(rnd, depth=0):
    tag = rnd.choice(["div", "section", "ul", "span", "b", "article"])
    inner = "".join(rnd.choice([" x ", f"w{rnd.randint(0, 99)}", "&amp;", grown(rnd, depth + 1) if depth < 6 else ""]) for _ in range(rnd.randint(0, 5)))
    return f"<{tag} id='i{rnd.randint(0, 9)}'>{inner}</{tag}>"


def test_random_pages_equal_a_tree(spark):
    rnd = random.Random(7)
    sources = [f"<body>{grown(rnd)}{grown(rnd)}</body>" for _ in range(60)]
    got = {}
    for r in E.elements(page(spark, *sources), around=("b", "div")).collect():
        got.setdefault(r.page_id, {})[r.node] = r
    for k, source in enumerate(sources):
        tree = ElementTree.fromstring(source)
        order = list(tree.iter())
        number = {id(e): n for n, e in enumerate(order)}
        parent = {id(c): number[id(e)] for e in order for c in e}
        assert len(order) == len(got[k])
        for e in order:
            r = got[k][number[id(e)]]
            assert (r.tag, r.text, r.attrs) == (e.tag, "".join(e.itertext()), e.attrib)
            assert r.last == number[id(list(e.iter())[-1])] and r.parent == parent.get(id(e), -1)
            if e.tag in ("b", "div"):
                assert r.around == [n for n, o in enumerate(order) if o is not e and any(x is e for x in o.iter())]
            else:
                assert r.around is None


def shape(html):
    nodes, pieces = E.parsed(html)
    return [(n[0], nodes[n[2]][0] if n[2] >= 0 else None, "".join(pieces[n[4] : n[5]])) for n in nodes]


def test_missing_and_stray_end_tags():
    assert shape("<ul><li>a<li>b<ul><li>c</ul>d</ul>e") == [("ul", None, "abcd"), ("li", "ul", "a"), ("li", "ul", "bcd"), ("ul", "li", "c"), ("li", "ul", "c")]
    assert shape("<table><tr><td>a<td>b<table><tr><td>c</table>d<tr><td>e</table>") == [("table", None, "abcde"), ("tr", "table", "abcd"), ("td", "tr", "a"), ("td", "tr", "bcd"), ("table", "td", "c"), ("tr", "table", "c"), ("td", "tr", "c"), ("tr", "table", "e"), ("td", "tr", "e")]
    assert shape("<p>a<p>b<div>c</p></span>d</div>") == [("p", None, "a"), ("p", None, "b"), ("div", None, "cd")]
    assert shape("<td><p>x</tr></table>y") == [("td", None, "xy"), ("p", "td", "xy")]
    assert shape("<b>1<br/>2<img>3") == [("b", None, "123"), ("br", "b", ""), ("img", "b", "")]
    assert shape(None) == shape("no tags &amp; no elements") == []
    deep = shape("<div>" * 2000 + "x")
    assert len(deep) == 2000 and deep[0][2] == "x" and all(d[1] == "div" for d in deep[1:])


def test_plain_tags_are_read_as_the_parser_reads_them():
    rnd = random.Random(11)
    parts = ["<p>", "</p>", "<DIV id='A b'>", "</div >", "<a HREF=\"/x?y=1\" class='c' id=\"\">", "</a>", "<li>", "</ul>", "<ul\n>", "<td>", "<tr>", "</table>", "<table>", "<h1>", "</H1>", "<br>", "<title>a &lt; b</title>", "<script>var a = 'x &amp; y';</script>", "<style></style>", "<!doctype html>", "w &amp; x", "&am", " 3 &#39; ", "&", "\u00a0y"]
    odd = ["<!-- <p> -->", "<br/>", "<a href=/x>", "<a b>", "<a c='1 &amp; 2'>", "a < b", "</>", "<script>if (a < b) '</p>';</script>", "<textarea><p>", "<title>a<b></title>", "<p", "</p x>", "<x-y>", "<?php ?>"]
    plain = 0
    for k in range(4000):
        html = "".join(rnd.choice(parts if k % 2 or rnd.random() < 0.95 else odd) for _ in range(rnd.randint(0, 14)))
        page = E._Page(frozenset(("script",)))
        page.feed(html)
        page.close()
        page._close(0)
        nodes, pieces = E.parsed(html, frozenset(("script",)))
        told = lambda nodes, pieces: [(*n[:4], "".join(pieces[n[4] : n[5]])) for n in nodes]
        assert told(nodes, pieces) == told(page.nodes, page.pieces), html
        plain += E._read_plain(E._Page(frozenset()), html)
    assert plain > 2000
    assert E.parsed("x" * 3_000_000 + "<p")[0] == []


def test_votes_of_a_plain_table(spark):
    html = "<html><body><h3>Bill 12 second reading</h3><table><tr><td>Yeas: 5</td><td>Nays: 2</td></tr></table></body></html>"
    divisions, votes = E.contained_votes(page(spark, html, None, "", "<div>Yeas 0 Nays 0</div>"), "ab", 31, 1, "2026-04-07")
    assert [tuple(r) for r in divisions.collect()] == [(0, "ab-31-1-2020-01-02-1", 1, "2020-01-02", "Bill 12 second reading", 5, 2, "Carried")]
    assert votes.collect() == []


def test_votes_inside_nested_boxes(spark):
    html = """<section><h2>Motion</h2><p>On May 4, 2021</p><div>
      <table><tr><th>Ayes 2<td>A. Roy<td>B.  Lee<td>A. ROY</tr><tr><th>Contre 3<td>C. Ng<td>no</table></div></section>
      <article>Pour: 1 Contre: 1</article><article>Pour: 1 Contre: 1</article>"""
    divisions, votes = E.contained_votes(page(spark, html).withColumn("date", E.F.lit("")), "qc", 43, 2, "2026-04-07")
    got = [tuple(r)[2:] for r in divisions.orderBy("number").collect()]
    assert got[0][2].startswith("MotionOn May 4, 2021")
    assert [(g[0], g[1], g[3], g[4], g[5]) for g in got] == [(1, "2021-05-04", 2, 3, "Negatived"), (2, "2026-04-07", 2, 3, "Negatived"), (3, "2026-04-07", 1, 1, "Carried")]
    assert got[1][2] == "On May 4, 2021" and got[2][2] == "Pour: 1 Contre: 1"
    named = {(r.id[-1], r.name, r.vote) for r in votes.collect()}
    inner = {("A. Roy", "Yea"), ("B. Lee", "Yea"), ("C. Ng", "Nay")}
    assert {n[1:] for n in named if n[0] == "2"} == inner
    assert {n[1:] for n in named if n[0] == "1"} == inner | {("On May 4, 2021", "Yea")}


BILL = """<html><body>
  <div class="bill-latest-activity">2nd Reading — April 3, 2024</div>
  <div class="bill-type">Government Bill</div>
  <h2 id="SecondReading">Second Reading</h2>
  <p>April 3, 2024</p>
  <div class="bill-profile-sponsor">Sponsored by <a href="/Members/en/123006">Jane Doe</a></div>
  <a href="/DocumentViewer/en/45-1/bill/C-47/first-reading">View Bill Text</a></body></html>"""


def test_bill_details(spark):
    bare = "<div class='bill-latest-activity'>1st Reading</div><div class='bill-type'>Government Bill</div><h2 id='FirstReading'>First Reading</h2>"
    pages = spark.createDataFrame([("45-1-c-47", BILL), ("45-1-s-1", bare), ("45-1-c-2", None), ("45-1-c-3", "<p>gone")], "bill_id string, html string")
    details, stages = E.bill_pages(pages, "https://h")
    got = {r.bill_id: tuple(r)[1:] for r in details.collect()}
    assert got["45-1-c-47"] == ("2nd Reading — April 3, 2024", "2nd_reading", "123006", "Government Bill", "", "https://h/DocumentViewer/en/45-1/bill/C-47/first-reading")
    assert got["45-1-s-1"] == ("1st Reading", "1st_reading", "", "Government Bill", "", "")
    assert got["45-1-c-2"] == got["45-1-c-3"] == ("",) * 6
    assert sorted(map(tuple, stages.collect())) == [("45-1-c-47", "2nd_reading", 1, "2024-04-03"), ("45-1-s-1", "1st_reading", 1, "")]
    assert E.elements(pages.limit(0), "bill_id").collect() == []
