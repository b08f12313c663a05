"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import views as V

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The day that session status is asked for, and the member whose listings are shown.
AS_OF = "1998-03-02"
MEMBER, OTHER = 7, 8


#: Tasks that the rows of one split of a table's files are dealt over.
SHARE = 16


def spread(rows: DataFrame, *by: str, like: DataFrame | None = None) -> DataFrame:
    """Rows dealt over all tasks of a shuffle, by the columns if any: for few bytes with much work each, which a small file or AQE leaves to one task.

    like: a scan whose splits, as they get more, make the tasks more, so that a task's rows don't grow with the table.
    """
    spark = rows.sparkSession
    grown = 0 if like is None else SHARE * like.rdd.getNumPartitions()
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, grown), *by)


def votes_by_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members' votes, a division's in one task: what groups or joins them by division shuffles nothing again."""
    lines = V.vote_lines(spark, sf_dir)
    return V.member_votes(spark, sf_dir, spread(lines, "division_id", like=lines))


def query(name: str, sql: str | None = None):
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = f"WITH {V.SQL.strip()}\n{sql.strip()}"
        return run

    return add
