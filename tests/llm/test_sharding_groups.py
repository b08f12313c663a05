"""Sharding: groups of equal texts, large groups, and columns with the operator's own names."""

from collections import Counter, defaultdict

from quorumlake.llm import sharding

DOCS = "doc_id long, text string"


def totals(rows):
    out = Counter()
    for r in rows:
        out[r.shard] += len((r.text or "").encode()) + 1
    return out


def test_small_groups_stay_whole(spark):
    docs = [(20 * g + k, f"{g} " + "x" * 200) for g in range(1000) for k in range(20)]  # a group is 0.8 % of a share
    rows = sharding.shard(spark.createDataFrame(docs, DOCS)).collect()
    of = defaultdict(set)
    for r in rows:
        of[r.text].add(r.shard)
    assert all(len(x) == 1 for x in of.values())
    sizes = totals(rows)
    assert max(sizes.values()) - min(sizes.values()) <= 0.025 * sum(sizes.values()) / 8


def test_large_groups_are_split_for_equal_bytes(spark):
    docs = [(40 * g + k, f"{g} " + "x" * 200) for g in range(25) for k in range(40)]
    docs += [(5000 + k, "y" * 300) for k in range(1000)]  # a third of all rows and more
    rows = sharding.shard(spark.createDataFrame(docs, DOCS)).collect()
    sizes = totals(rows)
    share = sum(sizes.values()) / 8
    assert len(sizes) == 8 and all(abs(x - share) <= 0.025 * share for x in sizes.values())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_odd_rows_and_names(spark):
    docs = [(None, None, 1, 2, 3, 4), (7, "", 1, 2, 3, 4), (7, "", 1, 2, 3, 4), (None, "a", 5, 6, 7, 8), (9, "b" * 5_000_000, 5, 6, 7, 8)]
    rows = sharding.shard(spark.createDataFrame(docs, DOCS + ", _gap int, _h int, _size int, `a.b` int"), 2).collect()
    assert sorted((str(r.doc_id), r._gap, r._h, r._size, r["a.b"]) for r in rows) == sorted((str(i), *x) for i, _, *x in docs)
    assert sorted((r.shard, r.slot) for r in rows)[0] == (0, 0)
    assert sharding.shard(spark.createDataFrame([], DOCS)).collect() == []
