"""Queries against their SQL on rows that the smallest tables don't have."""

from pathlib import Path

import duckdb
import pytest

from quorumlake.plans import registry

SF = Path("/root/testdata/sf0.001")

# One order with two lines: members 570 (Nay) and 579 (Yea); of their names in letters the first two are the same.
MEMBERS = {
    "supplier": "SELECT * REPLACE (CASE WHEN s_suppkey = 1 THEN 570 ELSE 579 END::{s_suppkey} AS s_suppkey, 3::{s_nationkey} AS s_nationkey) FROM supplier WHERE s_suppkey IN (1, 2)",
    "lineitem": "SELECT * REPLACE (7::{l_orderkey} AS l_orderkey, CASE WHEN l_suppkey = 1 THEN 570 ELSE 579 END::{l_suppkey} AS l_suppkey, CASE WHEN l_suppkey = 1 THEN 'R' ELSE 'A' END AS l_returnflag) FROM lineitem WHERE l_suppkey IN (1, 2) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) = 1",
}


def against_sql(spark, tmp_path, name, changed):
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        kinds = {c[0]: c[1] for c in con.sql(f"DESCRIBE SELECT * FROM '{f}'").fetchall()}
        sql = changed.get(f.stem, f"SELECT * FROM {f.stem}")
        for column, kind in kinds.items():
            sql = sql.replace("{" + column + "}", kind)
        con.execute(f"COPY (WITH {f.stem} AS (SELECT * FROM '{f}') {sql}) TO '{tmp_path / f.name}' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{tmp_path / f.name}'")
    got, want = registry.QUERIES[name](spark, str(tmp_path)), con.sql(registry.ORACLES[name])
    return sorted(map(tuple, got.select(*want.columns).collect())), sorted(want.fetchall())


def test_names_alike_of_members_stored_and_not(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "journals_ingested", MEMBERS)
    assert got == want == [("7-NATION_3", "579", "Yea")]


@pytest.mark.parametrize("name", ["schedules_in_french", "schedules_with_exceptions", "schedules_from_opening", "bill_details", "bill_detail_stages", "journals_with_titles", "journals_for_against", "journals_in_columns", "journals_recorded"])
def test_rows_are_dealt_over_tasks(spark, name):
    made = registry.QUERIES[name](spark, str(SF))
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()


def test_words_of_a_schedule_are_split_once_a_half(spark):
    plan = registry.QUERIES["schedules_in_french"](spark, str(SF))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("split(") <= 6
