"""Near-dedup of tables where ids repeat."""

import random

from quorumlake.llm import near_dedup


def test_rows_of_one_id_with_different_texts(spark):
    rnd = random.Random(11)
    a, b, c, d = ([("".join(rnd.choices("abcdefghijklmnop", k=6))) for _ in range(80)] for _ in range(4))
    near, a, b, c, d = (" ".join(x) for x in (a[:79] + ["edit"], a, b, c, d))
    rows = [(1, a), (2, near), (2, b), (3, c), (3, d), (3, d), (4, c), (5, ""), (None, a), (None, a)]
    kept = near_dedup.keep(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, a), (2, b), (3, c), (3, d), (5, ""), (None, a), (None, a)], key=str)
