"""Every query of the registry against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import altered
from quorumlake.plans import registry

SF = Path("/root/testdata/sf0.001")


def rows(names, found):
    plain = lambda x: repr(round(x, 9)) if isinstance(x, float) else str(x)
    return sorted(tuple(plain(x) for x in r) for r in found)


@pytest.fixture(scope="module", params=["given", "altered"])
def tables(request, tmp_path_factory):
    """(path, connection): the given tables, or a set with other keys, thinned rows, nulls and ties."""
    path = SF
    if request.param == "altered":
        path = tmp_path_factory.mktemp("altered")
        altered.write(SF, path)
    con = duckdb.connect()
    for f in path.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return str(path), con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, tables, name):
    path, db = tables
    df = registry.QUERIES[name](spark, path)
    want = db.sql(registry.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    assert rows(cols, df.select(*cols).collect()) == rows(cols, want.select(*[f'"{c}"' for c in cols]).fetchall())


def test_entry_without_corpus_operators(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(registry.QUERIES) <= set(e.queries())
