"""Cells of sketches, and likenesses against plain sets."""

import random
import re

from pyspark.sql import functions as F

from quorumlake.llm import fingerprints


def test_a_digest_is_hashed_once_not_for_each_cell(spark):
    entries = "array(named_struct('k', 11L, 's', 1, 'h', 5L), named_struct('k', 12L, 's', -1, 'h', 6L), named_struct('k', 13L, 's', 1, 'h', 7L), named_struct('k', 13L, 's', -1, 'h', 7L))"
    cells = spark.range(1).select(F.expr(fingerprints._difference(entries, 8))).first()[0]
    assert sum(c.c for c in cells) == 0 and {c.h for c in cells} <= {5, 6, 5 ^ 6} and {5, 6} & {c.h for c in cells}
    assert len({c.i for c in cells}) == len(cells) <= 6


def test_likeness_is_that_of_the_sets(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choices("abcdefghijklm", k=9)) for _ in range(300)]
    texts = ["", "one", "\n".join(base), "\n".join(base[:280] + ["x y"] * 9), "\n".join(base[150:] + base[:20]), None, "\n".join(rnd.choices("abcdefgh", k=40)), "\n".join(rnd.sample(base, 7))]
    texts += ["\n".join(str(rnd.random()) for _ in range(k)) for k in (5, 6, 11, 12, 13, 17, 600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = lambda t: set(re.findall(r"[^ \t\r\n\x0b\f]+(?:[ \t\r\x0b\f]+[^ \t\r\n\x0b\f]+){0,7}", t))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for r in fingerprints.compared(docs, 4).collect():
        text, following = texts[r.doc_id] or "", texts[(r.doc_id + 1) % len(texts)] or ""
        edited = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        assert abs(r.near_edited - like(cut(text), cut(edited))) < 1e-12
        assert abs(r.near_next - like(cut(text), cut(following))) < 1e-12
