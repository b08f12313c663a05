"""Whitening against a dense eigendecomposition, its range finder on falling spectra, and odd rows."""

import numpy as np
import pytest

from quorumlake.llm import whitening
from quorumlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows, components=16):
    """{(vec_id, component): (n, deviation, whitened, explained)} up to sign, by numpy on whole numbers."""
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows], object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), object)
    n, sums = len(fit), fit.sum(0)
    a = ((fit * n - sums) / n).astype(float)
    cov = a.T @ a / n
    values, found = np.linalg.eigh(cov)
    values, found = values[::-1][:components], found[:, ::-1][:, :components]
    out = {}
    for (i, _), r in zip(rows, x, strict=True):
        d = r * n - sums
        w = (d / n).astype(float) @ found / np.sqrt(values)
        for k in range(len(values)):
            out.setdefault((i, k + 1), []).append((n, int((d * d).sum()), w[k], values[k] / np.trace(cov)))
    return out


def agrees(got, want):
    assert len(got) == sum(map(len, want.values()))
    signs = {}
    for r in got:
        n, deviation, w, share = want[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.explained - share) <= 1e-9 * share and r.identity_error < 1e-9
        if abs(w) > 1e-3:
            signs.setdefault(r.component, set()).add(np.sign(w) == np.sign(r.whitened))
        assert abs(abs(r.whitened) - abs(w)) < 1e-8
    assert all(len(s) == 1 for s in signs.values())


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    agrees(QUERIES["op11_whitening"](spark, SF).collect(), plain(rows))


def test_odd_rows(spark):
    rnd = np.random.default_rng(3)
    rows = [(k, [float(c) for c in rnd.normal(0, 3, 5)]) for k in range(40)]
    rows += [(100, rows[0][1]), (100, rows[0][1]), (None, rows[1][1]), (101, None), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, [float("inf")] * 5), (105, [1.0] * 4), (106, [])]
    docs = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, x int")
    got = whitening.whitened(docs).collect()
    small = [(i, [float(np.float32(c)) for c in v]) for i, v in rows[:-6]]
    agrees(got, plain(small))
    assert max(r.component for r in got) == 5
    for none in (docs.limit(0), docs.where("vec_id = 101"), docs.where("vec_id = 0")):
        assert whitening.whitened(none).collect() == []


@pytest.mark.parametrize(("decay", "expanded"), [(0.2, False), (1.0, True)])
def test_range_finder(spark, decay, expanded):
    rnd = np.random.default_rng(4)
    x = np.floor(rnd.normal(0, 1e6, (300, 60)) * decay ** np.minimum(np.arange(60), 24)).astype(int)
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>")
    model = whitening.fit(rows, 4, oversample=8)
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:4]
    assert model.expanded == expanded and np.allclose(model.values, values, rtol=1e-10) and model.identity_error < 1e-9
    assert model.passes == (whitening.PASSES + 2 if expanded else model.passes) and model.passes > 1


def test_many_partitions_add_up_in_rounds(spark):
    rows = spark.range(0, 1000, 1, 70).selectExpr("array(id, id * id % 97, id % 13) AS x")
    got = whitening.fit(rows)
    x = np.array([[i, i * i % 97, i % 13] for i in range(1000)])
    assert np.allclose(got.values, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]) and got.n == 1000


def test_wide_sums():
    x = np.array([[1 << 44, 3], [(1 << 44) + 4, 5]])
    sums = np.array([(1 << 45) + 4, 8], object)
    assert (whitening.centred(x, 2, sums) == [[-2, -1], [2, 1]]).all()
    assert (whitening.centred(x, 1 << 40, sums * (1 << 39)) == [[-2, -1], [2, 1]]).all()
