"""Periodic runs against brute force over all periods, the query's edit, and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quorumlake.llm import repeats
from quorumlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if n >= max(24, 3 * q) and not any(w[i : j + q - g] == w[i + g : j + q] for g in range(1, q) if q % g == 0):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, edit=True):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(w)
    if edit and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = (None,) * 4
    for s, n, q in found:
        if best[0] is None or n * best[2] > best[1] * q:
            best = (s, n, q, 1000 * n // q)
    told = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, sha(told), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 20_000]
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(got[i] == expected(i, t) for i, t in docs)
    assert sum(r[1] > 0 for r in got.values()) > 10


@pytest.mark.parametrize("alphabet", [1, 2, 3, 9])
def test_runs_of_random_texts(alphabet):
    rnd = random.Random(alphabet)
    texts = []
    for _ in range(250):
        w = []
        for _ in range(rnd.randint(1, 8)):
            part = [rnd.randrange(alphabet) for _ in range(rnd.randint(1, 20))] * rnd.choice((1, 1, 4, 9))
            w += part[: len(part) - rnd.randint(0, 3)]
        texts.append(w)
    hashes = np.array([x * 7919 + 1 for w in texts for x in w], np.uint64)
    places = repeats.stretches(hashes, np.cumsum([0, *map(len, texts)]))
    for w, own in zip(texts, places, strict=True):
        want = brute(w)
        assert repeats.runs(w) == want
        assert sorted((a + s, n, q) for a, b in own for s, n, q in repeats.runs(w[a:b])) == want


def test_odd_rows(spark):
    line = "\n".join(["the same line of nine words stands here again"] * 5)
    rnd = random.Random(2)
    long = " ".join(rnd.choices("abcdefghij", k=300_000)) + " end" * 200_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, line), (4, line), (None, "la " * 23), (None, "la " * 24), (5, "x\x1cy\x85z " * 30), (6, "A a " * 40), (7, long)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, `n_runs` int")
    got = sorted((tuple(r) for r in repeats.periodic_runs(docs).collect()), key=repr)
    assert [r for r in got if r[0] != 7] == sorted((expected(i, t, edit=False) for i, t in rows[:-1]), key=repr)
    big = next(r for r in got if r[0] == 7)
    assert big[4] == 1 and big[3] == 200_000
    cut = repeats.collapsed(docs)
    assert cut.columns == docs.columns
    texts = {r.n_runs: r.text for r in cut.collect()}
    assert [texts[k] for k in range(4)] == [None, "", " \t\n", "the same line of nine words stands here again"]
    assert texts[6] == "la" and texts[5] == "la " * 23 and texts[8] == "A a"
    assert repeats.periodic_runs(docs.limit(0)).collect() == [] == repeats.collapsed(docs.limit(0)).collect()
