"""Detectors on fetched pages and texts, and small rules of sessions and charts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# What announces a division in one house's events, and the words of a link that ran out.
OUTCOMES = ("carried on the following division", "lost on the following division", "negatived on the following division")
EXPIRED = ("error retrieving file", "link is expired")
EXPIRING_HOST = r"^[a-z][a-z0-9+.-]*://(?:docs\.assembly\.pe\.ca(?:[/?#]|$)|127\.0\.0\.1|localhost)"


def retryable(status: Column) -> Column:
    return (status == 429) | (status >= 500)


def outcome_line(text: Column) -> Column:
    """Whether a line is one of the fixed announcements, a colon at its end aside."""
    return F.lower(F.regexp_replace(T.collapse(text), r":$", "")).isin(*OUTCOMES)


def outcome_within(text: Column) -> Column:
    return F.lower(T.collapse(text)).contains("on the following division")


def link_expired(url: Column, status: Column, body: Column) -> Column:
    """Whether a download's failure says that its link ran out."""
    said = [F.lower(body).contains(x) for x in EXPIRED]
    path = F.regexp_extract(F.lower(url), r"^[^:]*://[^/?#]*([^?#]*)", 1)
    return (status == 500) & F.lower(url).rlike(EXPIRING_HOST) & path.contains("/download/dms") & said[0] & said[1]


def any_sign(body: Column, signs: tuple[str, ...]) -> Column:
    """Whether a page holds one of the signs of a robot check."""
    return F.exists(F.array(*[F.lit(s.lower()) for s in signs]), lambda s: F.lower(body).contains(s))


def valid_choice(value: Column, known: Column) -> Column:
    return (value == "") | F.array_contains(known, value)


def sessions_to_read(current: Column, backwards: Column) -> Column:
    """The current session alone, or it and all before it, latest first."""
    return F.when(backwards & (current > 1), F.sequence(current, F.lit(1).cast("int"), F.lit(-1))).otherwise(F.array(current))


def donut(parts: list[Column], radius: float = 40.0) -> Column:
    """array<struct<length, gap, turn>> of a ring's arcs from the top on; empty where the parts sum to nothing."""
    total, around = sum(parts[1:], parts[0]), 2 * math.pi * radius
    before, arcs = F.lit(0), []
    for p in parts:
        arcs.append(F.struct(F.round(p / total * around, 2).alias("length"), F.round(around - p / total * around, 2).alias("gap"), F.round(before / total * 360 - 90, 4).alias("turn")))
        before = before + p
    return F.when(total > 0, F.array(*arcs)).otherwise(F.array().cast("array<struct<length:double,gap:double,turn:double>>"))
