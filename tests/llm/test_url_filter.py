"""The URL filter against plain lookups: its SQL, cascades of several levels and segments, and odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quorumlake.llm import url_filter
from quorumlake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
ODD = [
    (1, None), (1, None), (2, ""), (3, "no scheme/de/x"), (4, "http://"), (5, "HTTPS://A.Example.ORG/es/1?q=/de/#f"), (6, "http://example.org/en/12"), (7, "http://x.com/de/"), (8, "http://xcom/de/1"),
    (9, "http://com/fr/"), (10, "http://org"), (11, "http://org/"), (12, "http://casino-win.example.net/x"), (13, "http://a.casino.example.net"), (14, "http://b.example.net/casino-win"), (15, "http://ÄB.spam.org#/es/"), (16, "http://h/a://b/c"), (17, "http://x.net/\nde?\n"), (None, "ftp://user@SPAM.x:80/p"),
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    name = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    rest = rest[end:]
    return name, rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def plain(url, rules, listed):
    name, way = split(url)
    fits = [r for r in rules if (name == r[1] or name.endswith("." + r[1])) and way.startswith(r[2])]
    labels = name.split(".")
    own = {".".join(labels[k:]) for k in range(max(1, len(labels) - 1))} | {name + way} if name else set()
    rule = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return name, way, rule and rule[1] + rule[2], rule[0] if rule else "block" if own & listed else "allow"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, u, k, "t") for k, (i, u) in enumerate(ODD)], "page_id long, url string, key int, `a.b` string").coalesce(2)


def test_query_equals_its_sql(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/pages.parquet")
    for path in (SF, str(tmp_path)):
        frame = QUERIES["op13_url_filter"](spark, path)
        db = duckdb.connect()
        db.sql(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet{'' if path == SF else '/*.parquet'}'")
        want = db.sql(ORACLES["op13_url_filter"])
        assert want.columns == frame.columns
        got = sorted(map(tuple, frame.collect()), key=repr)
        assert got == sorted(want.fetchall(), key=repr)
        assert {r[4] for r in got if r[3] is None} == {"allow", "block"}


@pytest.mark.parametrize("bits", [url_filter.LITERAL_BITS, 2048])
def test_cascade_is_exact(spark, bits, monkeypatch):
    monkeypatch.setattr(url_filter, "FIRST_BITS", 64)
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://h', id % 50, '.example.com/', id % 2500) AS url")
    every = url_filter.universe(pages, F.lit(True)).select("key")
    listed = every.where("crc32(key) % 9 = 0").unionByName(spark.createDataFrame([("elsewhere.com",), (None,)], "key string"))
    known = {r.key for r in listed.collect()}
    found = url_filter.cascade(url_filter.universe(pages, listed), bits)
    assert len(found.levels) > 2 and (found.segments > 1) == (bits == 2048)
    got = url_filter.judge(pages, url_filter.RULES, listed, bits).collect()
    urls = {r.page_id: r.url for r in pages.collect()}
    assert len(got) == 3000 and all((r.host, r.path, r.rule, r.verdict) == plain(urls[r.page_id], url_filter.RULES, known) for r in got)


def test_odd_rows(spark, odd):
    listed = spark.createDataFrame([("example.net",), ("h",), ("x.net/\nde",), ("h/a:",)], "key string")
    out = url_filter.judge(odd, url_filter.RULES, listed)
    assert out.columns == [*odd.columns, "host", "path", "rule", "verdict"]
    known = {r.key for r in listed.collect()}
    got = out.collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got if r.page_id) == sorted(((i, *plain(u, url_filter.RULES, known)) for i, u in ODD if i), key=lambda r: (r[0], r[1]))
    assert len(got) == len(ODD)
    assert {r.verdict for r in url_filter.judge(odd, [], listed.limit(0)).collect()} == {"allow"}
    assert url_filter.judge(odd.limit(0), url_filter.RULES, listed).collect() == []
