"""No counts of tokens, of which a class has many, go through the driver."""

from quorumlake.llm import near_dedup
from quorumlake.llm._store import staged


def test_token_counts_are_shuffled(spark, monkeypatch):
    plans = {}

    def kept(df, name, **options):
        plans.setdefault(name, df._jdf.queryExecution().sparkPlan().toString())
        return staged(df, name, **options)

    monkeypatch.setattr(near_dedup, "staged", kept)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 2 + k) % 90}" for k in range(60))) for i in range(60)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dedup.classes(docs, words=3, percent=99).collect()}
    assert found == {i: i - i % 2 for i in range(60)}
    joins = [line for line in plans["postings"].splitlines() if "Join [tok#" in line]
    assert len(joins) == 3  # with the lists' lengths, and twice below it with the counts
    assert all("SortMergeJoin" in line for line in joins[1:])
