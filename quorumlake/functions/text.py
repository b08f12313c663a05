"""Text: white space, names, votes, summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a normalized name drops.
TITLES = ("hon", "mr", "mrs", "ms", "mme", "mlle", "dr", "kc", "k", "c")
# What counts as each vote, in lower case.
VOTES = {"Yea": ("yea", "yes", "pour", "oui"), "Nay": ("nay", "no", "contre", "non"), "Paired": ("paired", "apparié")}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row, however often and wherever use names it: in branches and lambdas Spark computes an expression anew each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def visible(page: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags, white space collapsed."""
    bare = F.regexp_replace(page, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", " ")
    return collapse(F.regexp_replace(bare, r"(?s)<[^>]*>", " "))


def name_tokens(name: Column) -> Column:
    """Lower-case words of a name without titles; marks are spaces, apostrophes nothing."""
    plain = F.translate(F.translate(F.lower(F.trim(name)), ".,-()", "     "), "'", "")
    return F.filter(F.split(F.trim(plain), r"\s+"), lambda w: ~w.isin(*TITLES) & (w != ""))


def normal_name(name: Column) -> Column:
    return F.array_join(name_tokens(name), " ")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.left(a, i) == F.left(b, i)))).otherwise(F.lit(0))


def vote(raw: Column) -> Column:
    plain, out = F.lower(F.trim(raw)), F
    for value, words in VOTES.items():
        out = out.when(plain.isin(*words), F.lit(value))
    return out.otherwise(F.lit("Abstain"))


def first_title(short: Column, full: Column) -> Column:
    return F.coalesce(F.nullif(short, F.lit("")), F.nullif(full, F.lit("")), F.lit(""))


def last_first(name: Column) -> Column:
    """'Last, First' turned round; others trimmed."""
    return F.trim(F.regexp_replace(F.trim(name), r"^([^,]+),\s*(.+)$", "$2 $1"))


def ordinal(n: Column) -> Column:
    suffix = F.when(F.pmod(n, F.lit(100)).isin(11, 12, 13), F.lit("th")).when(F.pmod(n, F.lit(10)) == 1, F.lit("st")).when(F.pmod(n, F.lit(10)) == 2, F.lit("nd")).when(F.pmod(n, F.lit(10)) == 3, F.lit("rd")).otherwise(F.lit("th"))
    return F.concat(n.cast("string"), suffix)


def percent(part: Column, whole: Column) -> Column:
    """Truncated integer percentage, 0 of nothing."""
    scaled = part.cast("long") * 100
    return F.when(whole > 0, ((scaled - scaled % whole) / whole).cast("long")).otherwise(F.lit(0).cast("long"))


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def head_and_tail(text: Column, limit: int = 150_000, head: int = 120_000, tail: int = 30_000, mark: str = "\n\n[...]\n\n") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(head)), F.lit(mark), F.right(text, F.lit(tail)))).otherwise(text)


# Accented letters of a slug and what stands for them; other letters beyond a-z are dropped.
SLUG_FROM, SLUG_TO = "àâäçèéêëîïôöùûüÿ", "aaaceeeeiioouuuy"


def slug(name: Column) -> Column:
    """Lower-case words joined by hyphens; spaces, hyphens, underscores and apostrophes part words, other characters are dropped."""
    plain = F.translate(F.lower(F.trim(name)), SLUG_FROM, SLUG_TO)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9 _'-]", ""), "[ _'-]+", "-"), F.lit("-"))


def folded(text: Column) -> Column:
    """Letters of western European languages without their accents."""
    return F.translate(text, "ÀÂÄÁÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàâäáãåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy")


def person_name(text: Column) -> Column:
    """Whether a text may be a person's name: a letter first, a lower-case letter, and no word of digits alone."""
    plain = F.trim(text)
    return F.coalesce(plain.rlike(r"^\p{L}") & plain.rlike(r"\p{Ll}") & ~plain.rlike(r"(?:^|\s)\p{Nd}+(?:\s|$)"), F.lit(False))


def vote_token(token: Column) -> Column:
    """A word of a vote list without the marks around it."""
    return F.regexp_replace(F.regexp_replace(token, r"""[.,;:)'"\\]+$""", ""), r"""^[('"]+""", "")


def initial(text: Column) -> Column:
    return F.coalesce(F.nullif(F.left(text, F.lit(1)), F.lit("")), F.lit("?"))


def json_object(text: Column) -> Column:
    """The JSON object in a reply: the reply without code fences, else from its first to its last brace; null if neither parses."""
    plain = F.trim(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", ""))
    inner = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(plain).isNotNull(), plain).when((inner != "") & F.try_parse_json(inner).isNotNull(), inner)


SUMMARY = "one_sentence string, plain_summary string, key_changes array<string>, who_is_affected array<string>, notable_considerations array<string>, estimated_cost string, category string"


def summary(text: Column) -> Column:
    return F.from_json(text, SUMMARY)
