"""Texts that spell special tokens, damaged stores, and names that clash with the operators' own."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quorumlake.llm import language, token_store
from quorumlake.llm._tokens import encoder

TEXTS = ["plain words", "an end <|endoftext|> and <|startoftext|>more", None, "", "<|endoftext|>", "<|endoftext", "é <|ENDOFTEXT|> x", "last one."]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys(file):
    path = public_tokenizers.path(file)
    coder = Tokenizer.from_file(path)
    for texts in (TEXTS, TEXTS[:1], TEXTS[4:5], [None, ""]):
        ids, n = encoder(path).ids(texts)
        want = [coder.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    docs = spark.createDataFrame([(k, f"{TEXTS[k % 8]} {k} " * 3) for k in range(300)], "doc_id long, text string")
    path = f"{tmp_path_factory.mktemp('store')}/s"
    known = token_store.RUN_TOKENS, token_store.FOLD
    token_store.RUN_TOKENS, token_store.FOLD = 256, 4
    yield docs, token_store.write(docs, path)
    token_store.RUN_TOKENS, token_store.FOLD = known


def test_ids_and_levels(spark, store):
    docs, path = store
    digests = {r.doc_id: r for r in token_store.read_digests(spark, path).collect()}
    ids = {r.doc_id: r for r in token_store.read_ids(spark, path).collect()}
    coder, start = Tokenizer.from_file(token_store.TOKENIZER), 0
    for r in docs.orderBy("doc_id").collect():
        want = np.array([*coder.encode(r.text, add_special_tokens=False).ids, token_store.END], "<u4")
        assert bytes(ids[r.doc_id].ids) == want.tobytes() and digests[r.doc_id].ids_crc32 == zlib.crc32(want.tobytes())
        assert ids[r.doc_id].start == digests[r.doc_id].start == start
        start += len(want)
    levels = [spark.read.parquet(f"{path}/manifest/level={k}") for k in range(4)]
    counts = [x.count() for x in levels]
    assert counts[0] > 16 and counts[-1] == 1 and counts == sorted(counts, reverse=True)
    assert all(x.agg(F.sum("n_docs")).first()[0] == 300 for x in levels)


@pytest.mark.parametrize("part", ["recipes", "manifest/level=0", "manifest/level=3", "raw/kind=chunk"])
def test_damage_is_found(spark, store, tmp_path, part):
    docs, path = store
    for name in ("recipes", *(f"manifest/level={k}" for k in range(4)), "raw/kind=chunk"):
        rows = spark.read.parquet(f"{path}/{name}")
        if name == part:
            if part == "recipes":
                rows = rows.withColumn("root", F.when(F.col("doc_id") == 7, F.unhex(F.lit("00" * 32))).otherwise(F.col("root")))
            elif part == "raw/kind=chunk":
                other = rows.select("payload").limit(1).first()[0]
                rows = rows.withColumn("payload", F.lit(bytes(other)))
            else:
                rows = rows.withColumn("n_docs", F.col("n_docs") + 1)
        rows.write.parquet(f"{tmp_path}/s/{name}")
    with pytest.raises(Exception, match="hash|hold|missing"):
        token_store.read_digests(spark, f"{tmp_path}/s").collect()


def test_empty_store(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, start int")
    path = token_store.write(docs, f"{tmp_path}/s")
    assert token_store.read_digests(spark, path).collect() == [] == token_store.read_ids(spark, path).collect()


def test_language_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "ein Wort und noch eins", "de", "x", 1), (1, "ein Wort und noch eins", "de", "x", 2), (4, None, "en", "y", 3), (5, "a word and another", "en", "y", 4), (None, "12 %", None, None, 5)], "doc_id long, text string, lang string, `a.b` string, Score int")
    model = language.train(docs)
    out = language.identify(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "a.b", "lang_pred", "score"]
    got = [(r.doc_id, r["a.b"], r.lang_pred) for r in out.collect()]
    assert (4, "y", "und") in got and (None, None, "und") in got and len(got) == 5 and got[0] == got[1]
    assert language.identify(docs.limit(0), model).collect() == []
