"""Every operator on nulls, repeated ids, a text of 5 MB, extra columns with the operators' own names, and empty tables."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from quorumlake.llm import fingerprints, mixing, near_dedup, packing, passages, quality, sharding

NAMES = ["_id", "_gone", "_spans", "_n", "_hash", "_times", "_own", "_gap", "_h", "_size", "_text", "_row", "a.b", "size", "part"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{x}` int" for x in NAMES)


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(3, 9))) for _ in range(n))


BIG = 1152921504606846977
TEXTS = [
    (1, prose(1, 90)),
    (5, prose(2, 90)),
    (5, prose(1, 90)),
    (5, prose(2, 90)),
    (BIG, prose(3, 60) + " " + prose(2, 90)),
    (None, prose(4, 70)),
    (None, None),
    (7, None),
    (8, ""),
    (9, " \n"),
    (10, prose(6, 30) + "\n" + prose(6, 30)),
    (11, prose(7, 700_000)[:5_000_000]),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None if k % 3 else "s", len(t or ""), *range(k, k + len(NAMES))) for k, (i, t) in enumerate(TEXTS)], SCHEMA).cache()


def extras(rows):
    return Counter((r.doc_id, *(r[x] for x in NAMES)) for r in rows)


def test_filters_and_stages_keep_columns(spark, docs):
    whole = extras(docs.collect())
    model = quality.Model()
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and extras(kept.collect()) <= whole
    one = near_dedup.keep(docs)
    assert one.columns == docs.columns
    left = Counter((r.doc_id, r.text) for r in one.collect())
    want = Counter({(1, TEXTS[0][1]): 1, (5, TEXTS[1][1]): 1, (BIG, TEXTS[4][1]): 1, (None, TEXTS[5][1]): 1, (None, None): 1, (7, None): 1, (8, ""): 1, (9, " \n"): 1, TEXTS[10]: 1, TEXTS[11]: 1})
    assert left == want
    cut = passages.stage(spark, docs, "")
    assert cut.columns == docs.columns and extras(cut.collect()) == whole
    words = Counter(w for r in cut.collect() for w in (r.text or "").split())
    assert all(words[w] == 1 for w in set(prose(1, 90).split()) - set(prose(7, 700_000).split()) if prose(1, 90).split().count(w) == 1)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and set(extras(mixed.collect())) <= set(whole)


def test_tables_of_results(spark, docs):
    ids = Counter(i for i, _ in TEXTS)
    assert Counter(r.doc_id for r in sharding.shard(docs).collect()) == ids
    assert Counter(r.doc_id for r in fingerprints.compared(docs).collect()) == ids
    assert Counter(r.doc_id for r in near_dedup.classes(docs, words=3, percent=85).collect()) == ids
    scored = quality.score(docs, quality.Model()).collect()
    assert Counter(r.doc_id for r in scored) == ids and all(r["a.b"] is not None for r in scored)
    assert {r.doc_id for r in packing.pack(docs).collect()} == set(ids)
    assert {r.ref_doc_id for r in passages.passages(docs).collect()} <= set(ids)


def test_empty(spark, docs):
    none = docs.limit(0)
    for rows in (near_dedup.keep(none), passages.stage(spark, none, ""), mixing.mix(none), packing.pack(none), sharding.shard(none), fingerprints.compared(none), quality.keep(none, quality.Model())):
        assert rows.collect() == []


def test_run(spark, docs, tmp_path):
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    got = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in got} <= {i for i, _ in TEXTS} and max(r.length for r in got) <= 2048
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.run(spark, path).collect() == []


