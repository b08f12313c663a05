"""Plans whose work or memory a task doesn't grow faster than the tables."""

from pathlib import Path

import pytest

from quorumlake.operators.resolve import resolve
from quorumlake.plans import registry

SF = str(Path("/root/testdata/sf0.001"))
DEALT = ["upper_detail_pages", "upper_index_pages", "vote_index_pages", "vote_detail_pages", "two_column_pages", "panel_pages", "dotted_reports", "session_options", "resolved_sessions", "vote_agreement", "sitting_weekdays", "printed_days"]


def plan(made, kind="optimizedPlan"):
    return getattr(made._jdf.queryExecution(), kind)().toString()


@pytest.mark.parametrize("name", DEALT)
def test_rows_are_dealt_over_tasks(spark, name):
    assert "REPARTITION_BY_NUM" in plan(registry.QUERIES[name](spark, SF), "executedPlan")


@pytest.mark.parametrize(("name", "part", "most"), [("upper_detail_pages", "sc-vote-details-table", 2), ("vote_detail_pages", "<tr\\b", 1), ("two_column_pages", "<tr\\b", 1), ("upper_index_pages", "vote-web-title-link\\b", 1), ("panel_pages", "nom(?:", 2)])
def test_a_piece_of_a_page_is_cut_once(spark, name, part, most):
    assert 0 < plan(registry.QUERIES[name](spark, SF)).count(part) <= most


@pytest.mark.parametrize("name", ["session_options", "resolved_sessions"])
def test_a_page_is_parsed_once(spark, name):
    assert plan(registry.QUERIES[name](spark, SF)).count("MapInArrow") == 1


def test_days_are_counted_after_the_exceptions(spark):
    made = plan(registry.QUERIES["sitting_weekdays"](spark, SF), "executedPlan")
    assert "BroadcastHashJoin" in made and made.count("Exchange hashpartitioning(id#") == 1


@pytest.mark.parametrize("name", ["contained_votes", "contained_divisions"])
def test_elements_are_joined_with_nothing(spark, name):
    made = plan(registry.QUERIES[name](spark, SF))
    assert made.count("MapInArrow") == 1 and "Join" not in made[: made.index("MapInArrow")]


def most_joined(node):
    """The most rows that a join in a plan that has run gave."""
    rows = node.metrics().get("numOutputRows").get().value() if "Join" in node.nodeName() else 0
    return max([rows, *(most_joined(node.children().apply(k)) for k in range(node.children().size()))])


def test_names_that_start_alike_meet_no_members_of_that_start(spark):
    many = 400
    members = spark.range(many).selectExpr("id", "concat('Ann Leeson', translate(id, '0123456789', 'abcdefghij')) AS name", "'X' AS province", "'' AS riding", "date'2000-01-01' AS term_start", "CASE WHEN id % 2 = 0 THEN date'2001-01-01' END AS term_end")
    names = spark.range(many).selectExpr("id AS name_id", "concat('Bob Leeson', translate(id, '0123456789', 'abcdefghij'), 'x') AS name", "'x' AS province", "date'2001-01-02' AS date")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = resolve(names, members)
        got = {r.name_id: (r.member_id, r.rule) for r in made.collect()}
        assert most_joined(made._jdf.queryExecution().executedPlan()) <= 4 * many
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # members in term on that day are the odd ones; a name fits the one that it begins with, unless longer numbers of such begin so
    assert got[101] == (101, 9) and got[399] == (399, 9)
    assert got[1] == (None, None) and got[100] == (None, None)
