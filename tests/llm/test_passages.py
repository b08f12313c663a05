"""Passages against a brute-force search for runs of 50 words."""

import random
import re

import pytest

from quorumlake.llm import passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def maker(seed):
    rnd = random.Random(seed)
    return rnd, lambda n: " ".join("".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(3, 9))) for _ in range(n))


def uncovered(docs, rows, n=50):
    """(document, word) in a run of n words that a smaller document has, without a row that covers it; and how many are in such runs."""
    first, need = {}, set()
    for d in sorted(docs):
        w = WORD.findall(docs[d])
        for k in range(len(w) - n + 1):
            if first.setdefault(tuple(w[k : k + n]), d) != d:
                need.update((d, j) for j in range(k, k + n))
    have = {(r.doc_id, j) for r in rows for j in range(r.start_word, r.end_word)}
    return need - have, len(need)


def found(spark, docs):
    rows = passages.passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    for r in rows:
        u, v = WORD.findall(docs[r.doc_id])[r.start_word : r.end_word], WORD.findall(docs[r.ref_doc_id])[r.ref_start : r.ref_end]
        assert r.ref_doc_id < r.doc_id and len(u) == r.n_words >= 50 and (r.identity < 1 or u == v)
    return rows


def test_passages_of_lines_that_many_documents_have(spark):
    rnd, words = maker(5)
    lines = [words(12) for _ in range(100)]
    docs = {i: " ".join(rnd.choices(lines, k=40)) for i in range(500)}
    for i in range(30):
        passage = " ".join(rnd.sample(lines, 5))
        for d in (500 + i, 600 + i):
            docs[d] = f"{words(30)} {passage} {words(30)}"
    missing, n = uncovered(docs, found(spark, docs))
    assert n >= 30 * 60 and not missing


def test_copies_of_a_passage_inside_a_document(spark):
    rnd, words = maker(7)
    passage, phrase = words(70), words(3)

    def edited():
        w = passage.split()
        for k in range(rnd.randint(0, 13), len(w), 14):
            w[k] = "edit"
        return " ".join(w)

    docs = {0: f"{words(40)} {passage} {words(40)}", 1: f"{words(20)} {passage} {words(100)} {passage} {words(20)}"}
    docs |= {2: " ".join([phrase] * 400), 3: f"{words(20)} {' '.join([phrase] * 500)}", 4: "same " * 700, 5: f"{words(9)} {'same ' * 1600}"}
    docs[6] = f"{words(20)} {edited()} {words(100)} {edited()} {words(20)}"
    rows = found(spark, docs)
    missing, n = uncovered(docs, rows)
    assert n > 3000 and not missing
    assert len(rows) < 200  # in proportion to the words, not to place by place
    fuzzy = [r for r in rows if (r.doc_id, r.ref_doc_id) == (6, 0)]
    assert any(r.start_word < 90 for r in fuzzy) and any(r.end_word > 190 for r in fuzzy)


def edited_pairs(common, every, kind):
    """Documents with 40 pairs of a passage of 120 words and its edited copy, and where the copies are."""
    rnd, words = maker(11)
    lines = [words(12) for _ in range(100)]
    docs = {i: " ".join(rnd.choices(lines, k=40)) for i in range(500)} if common else {}
    truth = {}
    for i in range(40):
        passage = (" ".join(rnd.sample(lines, 10)) if common else words(120)).split()
        copy = [x for k, w in enumerate(passage) for x in ([w] if k % every != every // 2 else {"other": [f"edit{k}"], "more": [w, f"edit{k}"], "less": []}[kind])]
        docs[1000 + i] = f"{words(60)} {' '.join(passage)} {words(60)}"
        docs[2000 + i] = f"{words(60)} {' '.join(copy)} {words(60)}"
        truth[2000 + i] = (1000 + i, 60, 60 + len(copy))
    return docs, truth


@pytest.mark.parametrize(("common", "every", "kind", "least"), [(False, 8, "other", 0.95), (False, 8, "more", 0.85), (False, 8, "less", 0.8), (False, 12, "less", 0.9), (True, 20, "other", 0.95), (True, 20, "less", 0.9), (True, 12, "other", 0.6)])
def test_recall_of_edited_passages(spark, common, every, kind, least):
    """The share of the copies' words that rows with their own partner cover; wrong words at the ends stay few."""
    docs, truth = edited_pairs(common, every, kind)
    rows = found(spark, docs)
    have = {(r.doc_id, j) for r in rows for j in range(r.start_word, r.end_word) if truth.get(r.doc_id, (None,))[0] == r.ref_doc_id}
    want = {(d, j) for d, (_, a, b) in truth.items() for j in range(a, b)}
    print(common, every, kind, len(have & want) / len(want))
    assert len(have & want) >= least * len(want)
    assert len(have - want) <= 0.02 * len(want)
