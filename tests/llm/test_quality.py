"""The heads of the quality model where one label is rare."""

import random

from quorumlake.llm import quality

SF = "/root/testdata/sf0.001"


def test_heads_on_small_table(spark):
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert model.good_fit and model.toxic_fit


def test_head_of_a_rare_label(spark):
    rnd = random.Random(3)
    plain = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(300)]
    docs, labels = [], []
    for i in range(3000):
        toxic, good = int(i % 100 == 7), int(i % 2)
        text = rnd.choices(plain, k=60) + ["zzfoul"] * (3 * toxic) + ["wellput"] * (3 * good)
        rnd.shuffle(text)
        docs.append((i, " ".join(text)))
        labels.append((i, good, toxic))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), fit_rows=300)
    got = {r.doc_id: r for r in quality.score(df, model).collect()}
    bad = {i for i, _, toxic in labels if toxic}
    assert sum(got[i].p_toxic >= 0.5 for i in bad) >= 0.9 * len(bad)
    assert sum(got[i].p_toxic >= 0.5 for i in got if i not in bad) <= 0.01 * len(got)
    assert sum((got[i].p_good >= 0.5) == good for i, good, _ in labels) >= 0.95 * len(got)
