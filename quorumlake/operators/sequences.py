"""Operators whose result depends on what was kept before: folds over sorted arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def apart(places: Column, least: int) -> Column:
    """Of ascending places those at least `least` beyond the last one kept."""
    zero = F.array().cast("array<bigint>")
    return F.aggregate(F.array_sort(places.cast("array<bigint>")), zero, lambda kept, x: F.when((F.size(kept) == 0) | (x - F.try_element_at(kept, F.lit(-1)) >= least), F.array_append(kept, x)).otherwise(kept))


def overlap_years(a_first: Column, a_last: Column, b_first: Column, b_last: Column) -> Column:
    return F.greatest(F.least(a_last, b_last) - F.greatest(a_first, b_first) + 1, F.lit(0))


def best_term(terms: Column, first: Column, last: Column) -> Column:
    """Of array<struct<name, first, last>> the name with the largest overlap with first..last; the earlier one of equals, null without any."""
    scored = F.transform(terms, lambda t, i: F.struct(overlap_years(t["first"], t["last"], first, last).alias("o"), (-i).alias("i"), t["name"].alias("name")))
    best = F.array_max(F.filter(scored, lambda t: t["o"] > 0))
    return best["name"]


def sections(text: Column, heading: str) -> Column:
    """The parts of a text that begin at each match of a heading; what stands before the first is left out."""
    parts = F.split(F.regexp_replace(text, f"({heading})", "\u0001$1"), "\u0001")
    return F.when(F.size(parts) > 1, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))
