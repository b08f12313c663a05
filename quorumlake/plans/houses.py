"""Queries of representatives by address and of single houses' vote pages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views as V
from ..operators import extract as X
from ..operators import representatives as R
from .catalog import query, spread, votes_by_division

_REPS = """, reps AS (SELECT id::VARCHAR AS rep_id, id // 7 AS lookup_id, id % 7 AS position, CASE WHEN id % 5 = 0 THEN 'Nobody' WHEN id % 3 = 0 THEN upper(name) ELSE ' ' || name END AS name,
  CASE WHEN id % 13 = 0 THEN ' ' WHEN id % 4 = 1 THEN lower(left(riding, length(riding) - 1)) ELSE riding END AS district,
  CASE id % 6 WHEN 0 THEN 'MP' WHEN 1 THEN 'mp' WHEN 2 THEN 'MPP' WHEN 3 THEN 'MLA (X)' WHEN 4 THEN 'Mayor' ELSE 'Member of the Legislative Assembly of X' END AS office, CASE WHEN id % 17 = 0 THEN 'L' || id ELSE '' END AS local_id FROM members)"""


def _reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A representative for every member, some under other names, ridings' beginnings or no district."""
    i, name, riding = F.col("id"), F.col("name"), F.col("riding")
    offices = F.array(*[F.lit(x) for x in ("MP", "mp", "MPP", "MLA (X)", "Mayor", "Member of the Legislative Assembly of X")])
    return V.members(spark, sf_dir).select(
        i.cast("string").alias("rep_id"), F.floor(i / 7).alias("lookup_id"), (i % 7).alias("position"), F.when(i % 5 == 0, "Nobody").when(i % 3 == 0, F.upper(name)).otherwise(F.concat(F.lit(" "), name)).alias("name"),
        F.when(i % 13 == 0, " ").when(i % 4 == 1, F.lower(F.left(riding, F.length(riding) - 1))).otherwise(riding).alias("district"),
        F.element_at(offices, (i % 6 + 1).cast("int")).alias("office"), F.when(i % 17 == 0, F.concat(F.lit("L"), i.cast("string"))).otherwise("").alias("local_id"),
    )


@query(
    "representative_members",
    f"""{_REPS}, fits AS (SELECT r.rep_id, m.id, m.name, lower(trim(m.name)) = lower(trim(r.name)) AS named, m.government_level = CASE WHEN lower(r.office) = 'mp' THEN 'federal' ELSE 'provincial' END AS leveled
      FROM reps r JOIN members m ON trim(r.district) <> '' AND contains(lower(m.riding), lower(trim(r.district)))),
    best AS (SELECT rep_id, arg_min(id, (name, id::VARCHAR)) FILTER (named) AS anyone, arg_min(id, (name, id::VARCHAR)) FILTER (named AND leveled) AS exact, arg_min(id, (name, id::VARCHAR)) FILTER (leveled) AS first FROM fits GROUP BY 1)
    SELECT rep_id, coalesce(nullif(local_id, ''), CASE WHEN lower(office) = 'mp' THEN anyone::VARCHAR END, '') AS local_id,
      coalesce(nullif(local_id, ''), CASE WHEN lower(office) = 'mp' THEN anyone::VARCHAR END, exact::VARCHAR, first::VARCHAR, anyone::VARCHAR, '') AS member_id FROM reps LEFT JOIN best USING (rep_id)""",
)
def representative_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.member_ids(_reps(spark, sf_dir), V.members(spark, sf_dir).withColumn("id", F.col("id").cast("string"))).select("rep_id", "local_id", "member_id")


@query(
    "riding_lookups",
    f"""{_REPS}, told AS (SELECT *, trim(district) = '' AS bare, lower(office) = 'mp' AS federal, office IN ('MPP', 'MLA (X)', 'Member of the Legislative Assembly of X') AS provincial FROM reps)
    SELECT lookup_id, arg_min(rep_id, (bare, CASE WHEN bare THEN -position ELSE position END)) FILTER (federal) AS federal, arg_min(rep_id, (bare, CASE WHEN bare THEN -position ELSE position END)) FILTER (provincial) AS provincial FROM told GROUP BY 1""",
)
def riding_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lookups(_reps(spark, sf_dir).withColumn("district", F.trim("district")))


@query(
    "office_provinces",
    "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Quebec' END WHEN c_custkey % 2 = 0 THEN 'Nova Scotia' ELSE 'Yukon' END AS province FROM customer",
)
def office_provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth customer has no province in the constituency's office, and every third one in none."""
    c = F.col("c_custkey")
    office = lambda kind, postal: F.struct(F.lit(kind).alias("type"), postal.alias("postal"))
    near = F.when(c % 5 == 0, F.lit("1 Main St, ONE MBX")).when(c % 2 == 0, F.lit("PEN\nHalifax NS  B3J 1A1 ON")).otherwise(F.lit("Whitehorse YT"))
    far = F.when(c % 3 == 0, F.lit(None).cast("string")).otherwise("Hull QC K1A 0A6")
    offices = F.array(office("legislature", far), office("constituency", near), office("constituency", F.lit(None).cast("string")))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", R.office_province(offices).alias("province"))


_SIDES = """, n AS (SELECT division_id, member_id, vote, 'Ann-' || member_id || ' O''Lee' AS name FROM member_votes WHERE vote <> 'Paired' AND member_id % 7 <> 0),
  sides AS (SELECT division_id, list_sort(list(name) FILTER (vote = 'Yea')) AS yea_names, list_sort(list(name) FILTER (vote = 'Nay')) AS nay_names FROM n GROUP BY 1)"""


def _sides(spark: SparkSession, sf_dir: str, piece) -> DataFrame:
    """division_id, yea, nay: sorted pieces of either side's votes (bounded by the members of one division), and how many there are."""
    v = votes_by_division(spark, sf_dir).where("vote <> 'Paired'").withColumn("name", F.concat(F.lit("Ann-"), F.col("member_id").cast("string"), F.lit(" O'Lee")))
    return v.groupBy("division_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("vote") == x, piece))).alias(x.lower()) for x in ("Yea", "Nay")])


@query(
    "two_column_pages",
    f"""{_SIDES} SELECT division_id AS page_id, 1 AS number, coalesce(len(yea_names), 0)::INT AS yeas, coalesce(len(nay_names), 0)::INT AS nays, coalesce(yea_names, []) AS yea_names, coalesce(nay_names, []) AS nay_names,
      CASE WHEN coalesce(len(nay_names), 0) > coalesce(len(yea_names), 0) THEN 'Negatived' ELSE 'Carried' END AS result FROM sides""",
)
def two_column_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of the two sides among an empty one and one with other heads; every seventh member's cell is blank."""
    m = F.col("member_id")
    s = _sides(spark, sf_dir, F.when(m % 7 == 0, F.lit("&nbsp; ")).otherwise(F.regexp_replace("name", "'", "&#39;")))
    row = lambda a, b: F.concat(F.lit("<tr><td> <b>"), F.coalesce(a, F.lit("")), F.lit("</b></td><TD>"), F.coalesce(b, F.lit("")), F.lit("</td></tr>"))
    rows = F.array_join(F.zip_with("yea", "nay", row), "\n")
    head = "<table><thead><tr><th>{}</th><th class='n'> Nays</th></tr></thead><tbody>"
    html = F.concat(F.lit(head.format("Ayes") + "<tr><td>X</td><td>Y</td></tr></tbody></table>" + head.format(" yeas ") + "<tr><td>Solo</td></tr></tbody></table>" + head.format("<i>YEAS</i>")), rows, F.lit("</tbody></table>"))
    return X.two_column_votes(s.select(F.col("division_id").alias("page_id"), html.alias("html")))


@query(
    "panel_pages",
    f"""{_SIDES} SELECT division_id AS page_id, CASE WHEN division_id % 4 = 0 THEN 0 ELSE (division_id % 90)::INT END AS yeas, (division_id % 70)::INT AS nays, coalesce(yea_names, []) AS yea_names, coalesce(nay_names, []) AS nay_names FROM sides""",
)
def panel_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third member has no span of the name alone, every fifth stands there twice, every seventh not at all; every fourth page lacks a count."""
    m, d = F.col("member_id"), F.col("division_id")
    one = F.when(m % 3 == 0, F.concat(F.lit('<li class="depute x">'), F.regexp_replace("name", " ", "&nbsp;<b></b> "), F.lit("</li>"))).otherwise(F.concat(F.lit("<li class='depute'><span class='nom'> "), "name", F.lit("</span> (<i>Riding</i>)</li>")))
    twice = F.concat(F.lit("<li class='depute'><span class='nom'>"), F.upper("name"), F.lit("</span></li>"))
    s = _sides(spark, sf_dir, F.when(m % 7 != 0, F.struct("name", F.when(m % 5 == 0, F.concat(one, twice)).otherwise(one).alias("li"))))
    side = lambda c, name: F.concat(F.lit(f'<div id="ctl00_Centre_{name}" class="p"><ul>'), F.array_join(F.col(f"{c}.li"), "\n"), F.lit("</ul></div>"))
    count = lambda name, n: F.concat(F.lit(f'<input type="hidden" id="{name}" value=" '), n.cast("string"), F.lit('"/>'))
    html = F.concat(F.when(d % 4 == 0, "").otherwise(count("nbPour", d % 90)), count("nbContre", d % 70), side("yea", "pnlPour"), side("nay", "pnlContre"), F.lit('<div id="ctl00_Centre_pnlAbstention"><li class="depute">Away</li></div>'))
    return X.panel_votes(s.where(F.size("yea") + F.size("nay") > 0).select(d.alias("page_id"), html.alias("html")))


@query(
    "dotted_reports",
    """SELECT id AS text_id, 1 AS number, (1 + id % 40)::INT AS yeas, (id % 30)::INT AS nays, CASE WHEN id % 30 > 1 + id % 40 THEN 'Negatived' ELSE 'Carried' END AS result, ['Lee-' || id, 'Roy'] AS yea_names, CASE WHEN id % 4 = 0 THEN [] ELSE ['Fox'] END AS nay_names FROM divisions UNION ALL
    SELECT id, 2, 0, 3, 'Negatived', ['Ng'], ['Day', 'O''Hara'] FROM divisions WHERE id % 3 = 0""",
)
def dotted_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A division, one that counts nobody and in every third text another one."""
    i, k = F.col("id"), F.col("id").cast("string")
    first = F.concat(F.lit("On division:\nAYE\n Lee-"), k, F.lit(", Roy; Mr. roy Roy ......... "), (1 + i % 40).cast("string"), F.lit("\nNAY "), F.when(i % 4 == 0, "none").otherwise("(Fox)"), F.lit(" .... "), (i % 30).cast("string"))
    rest = F.when(i % 3 == 0, "\nAYE Ng...0\nNAY Day The O'Hara.\n....3").otherwise("\nAYE Ng 4 NAY Fox .. 2")
    return X.dotted_votes(spread(V.divisions(spark, sf_dir).select("id"), "id").select(i.alias("text_id"), F.concat(first, F.lit("\nAYE A ....0 NAY B ....0"), rest).alias("text")))
