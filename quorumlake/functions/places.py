"""Provinces, chambers, levels and stages.

The tables are fixed values: codes, names and labels that results must use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Id prefix, stored chamber and name of each legislature.
LEGISLATURES = [
    ("ab", "alberta", "Alberta"),
    ("bc", "british_columbia", "British Columbia"),
    ("mb", "manitoba", "Manitoba"),
    ("nb", "new_brunswick", "New Brunswick"),
    ("nl", "newfoundland_labrador", "Newfoundland and Labrador"),
    ("ns", "nova_scotia", "Nova Scotia"),
    ("on", "ontario", "Ontario"),
    ("pe", "pei", "Prince Edward Island"),
    ("qc", "quebec", "Quebec"),
    ("sk", "saskatchewan", "Saskatchewan"),
]
# Abbreviations that a province filter accepts.
ABBREVIATIONS = {
    "AB": "Alberta", "BC": "British Columbia", "MB": "Manitoba", "NB": "New Brunswick", "NL": "Newfoundland and Labrador",
    "NS": "Nova Scotia", "NT": "Northwest Territories", "NWT": "Northwest Territories", "NU": "Nunavut", "ON": "Ontario",
    "PE": "Prince Edward Island", "PEI": "Prince Edward Island", "QC": "Quebec", "SK": "Saskatchewan", "YT": "Yukon",
}
# Display order and labels of the stages.
STAGES = [("1st_reading", "1st"), ("2nd_reading", "2nd"), ("committee", "Cmte"), ("report_stage", "Report"), ("3rd_reading", "3rd"), ("senate", "Senate"), ("royal_assent", "Assent")]
# Order of the stages in a timeline; others come last.
TIMELINE = ["1st_reading", "2nd_reading", "committee", "3rd_reading", "royal_assent"]
FEDERAL = ("commons", "senate")


def lookup(table: dict[str, str], key: Column) -> Column:
    """The table's value for key, null where there is none; one literal map, whatever the table's size."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def expand_province(value: Column) -> Column:
    return F.coalesce(lookup(ABBREVIATIONS, F.upper(F.trim(value))), F.trim(value))


def bill_province(chamber: Column, bill_id: Column) -> Column:
    """Name of the legislature by chamber, else by id prefix; '' for federal bills."""
    out = F
    for code, stored, name in LEGISLATURES:
        out = out.when((chamber == stored) | F.lower(bill_id).startswith(f"{code}-"), F.lit(name))
    return out.otherwise(F.lit(""))


def is_provincial(chamber: Column, bill_id: Column) -> Column:
    """Three-valued: null where the chamber is null and the id decides nothing."""
    by_id = F.lower(bill_id).rlike("^(" + "|".join(code for code, _, _ in LEGISLATURES) + ")-")
    return (~chamber.isin(*FEDERAL) & (chamber != "")) | by_id


def level_label(chamber: Column, bill_id: Column) -> Column:
    """Presentation's rule: a federal chamber wins, else the id prefix alone decides."""
    plain = F.lower(F.trim(F.coalesce(chamber, F.lit(""))))
    by_id = F.lower(F.trim(bill_id)).rlike("^(" + "|".join(code for code, _, _ in LEGISLATURES) + ")-")
    return F.when(~plain.isin(*FEDERAL) & by_id, F.lit("Provincial")).otherwise(F.lit("Federal"))


def _titled(key: Column) -> Column:
    """Underscores to spaces, the first letter of each word raised."""
    words = F.filter(F.split(F.translate(key, "_", " "), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


def chamber_label(chamber: Column) -> Column:
    known = {"commons": "House of Commons", "senate": "Senate"} | {stored: name for _, stored, name in LEGISLATURES}
    return F.coalesce(lookup(known, chamber), _titled(chamber))


def stage_label(stage: Column) -> Column:
    return F.coalesce(lookup({k: f"{v} Reading" for k, v in STAGES}, stage), _titled(stage))


def stage_index(stage: Column) -> Column:
    """Place in the display order from 0, -1 for others."""
    return F.coalesce(F.array_position(F.array(*[F.lit(k) for k, _ in STAGES]), stage) - 1, F.lit(-1)).cast("int")


def jurisdiction_key(province: Column) -> Column:
    table = {}
    for abbreviation, name in ABBREVIATIONS.items():
        code = {"NWT": "NT", "PEI": "PE"}.get(abbreviation, abbreviation)
        table |= {abbreviation: f"provincial-{code}", name.upper(): f"provincial-{code}"}
    table["QUÉBEC"] = "provincial-QC"
    table.pop("NWT")
    return F.coalesce(lookup(table, F.upper(F.trim(province))), F.lit(""))


def status_text(status: Column) -> Column:
    plain = F.trim(status)
    return F.when(plain == "in_session", "in session").when(plain == "on_break", "on break").otherwise("status unavailable")
