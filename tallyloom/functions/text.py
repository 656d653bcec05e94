"""Text: cleaning, labels, cutting, matching, size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGES = r"(?U)^\s+|\s+$"


def clean(text: Column) -> Column:
    """Text without white space (Unicode's too) at its ends; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _EDGES, "")


def label(text: Column) -> Column:
    """A trimmed, lower-cased label; blank is null."""
    return F.nullif(F.lower(clean(text)), F.lit(""))


def truncate(text: Column, most: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def first_line(text: Column) -> Column:
    return F.element_at(F.split(F.coalesce(text, F.lit("")), r"\R", 2), 1)


def is_blank(text: Column) -> Column:
    return clean(text) == ""


def word_count(text: Column) -> Column:
    """Words between white space; blank text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0)).cast("long")


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    """Whether any of the patterns is found, as one alternation; null is no match."""
    return F.coalesce(text.rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def matching_names(text: Column, rules: dict[str, str]) -> Column:
    """Names of the rules whose pattern is found, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(F.coalesce(text.rlike(p), F.lit(False)), F.lit(n)) for n, p in rules.items()]))


def section(title: str, body: Column, empty: str = "[NONE]") -> Column:
    """A titled section of a prompt or report; a blank body shows as ``empty``."""
    return F.concat(F.lit(f"{title}:\n"), F.coalesce(F.nullif(clean(body), F.lit("")), F.lit(empty)))


def visible_text(markup: Column) -> Column:
    """Text of HTML or Markdown: without comments, scripts, styles, tags, link targets and emphasis; spaces collapsed."""
    steps = [
        (r"(?s)<!--.*?-->", " "),
        (r"(?is)<(script|style)\b.*?</\1\s*>", " "),
        (r"(?s)<[^>]*>", " "),
        (r"!?\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"[*_`~]{1,3}", ""),
        (r"(?m)^\s{0,3}#{1,6}\s+", ""),
        (r"&nbsp;", " "),
        (r"&lt;", "<"),
        (r"&gt;", ">"),
        (r"&quot;", '"'),
        (r"&amp;", "&"),
        (r"(?U)\s+", " "),
    ]
    for pattern, by in steps:
        markup = F.regexp_replace(markup, pattern, by)
    return F.trim(markup)


def occurrences(text: Column, part: Column) -> Column:
    """How often a literal part occurs, without overlaps; an empty part never."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")).otherwise(F.lit(0).cast("long"))


def context(text: Column, start: Column, end: Column, around: int = 70) -> Column:
    """The text around a span (offsets from 0, end exclusive), on one line."""
    lo = F.greatest(start - around, F.lit(0))
    return F.trim(F.regexp_replace(F.substring(text, (lo + 1).cast("int"), (end + around - lo).cast("int")), r"\s+", " "))


def format_p(p: Column) -> Column:
    return F.when(p.isNull(), "n/a").when(p < 0.001, "<0.001").otherwise(F.format_string("%.3f", p))


def format_share(share: Column, digits: int = 1) -> Column:
    return F.when(share.isNull(), "n/a").otherwise(F.format_string(f"%.{digits}f%%", share * 100))
