"""Numbers, booleans, times, identities and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.text import clean


def number(value: Column) -> Column:
    """A finite double, else null."""
    x = value.cast("string").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def positive_integer(value: Column) -> Column:
    """A whole number above 0, else null."""
    x = number(value)
    return F.when((x > 0) & (F.floor(x) == x), x.cast("long"))


def truth(value: Column, words: Sequence[str] = ("true", "1", "yes")) -> Column:
    """Whether a cell says yes; anything else, null too, is no."""
    return F.coalesce(F.lower(clean(value)).isin(*words), F.lit(False))


def percent_change(before: Column, after: Column) -> Column:
    """Null where ``before`` is null or 0."""
    return F.when(before != 0, (after - before) * 100.0 / before)


def magnitude(delta: Column) -> Column:
    """The bucket of an effect size by the usual bounds 0.147, 0.330 and 0.474."""
    d = F.abs(delta)
    return F.when(d < 0.147, "negligible").when(d < 0.330, "small").when(d < 0.474, "medium").when(d.isNotNull(), "large")


def utc(value: Column) -> Column:
    """A timestamp from text; what can't be parsed is null."""
    return F.try_to_timestamp(value.cast("string"))


def iso_week(ts: Column) -> Column:
    """The stratum of a time's ISO year and week, like 2025-W01."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def quarter(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))


def hours_between(begin: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(begin.cast("timestamp"))) / 3.6e9


def years_since(ts: Column, origin: str) -> Column:
    return hours_between(F.to_timestamp(F.lit(origin)), ts) / (24 * 365.25)


def page_address(url: Column) -> Column:
    """A URL to compare by: scheme and host lower-cased, query, fragment and closing slashes gone."""
    bare = F.regexp_replace(clean(url), r"[?#].*$", "")
    bare = F.regexp_replace(bare, r"/+$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    return F.nullif(F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare))), F.lit(""))


def pull_request_address(url: Column) -> Column:
    """owner/repository#number of a pull-request URL, lower-cased; null for other URLs."""
    pattern = r"(?i)^(?:https?://)?(?:www\.)?[^/]+/([^/\s]+)/([^/\s]+)/pulls?/(\d+)(?:[/?#].*)?$"
    owner, name, n = (F.regexp_extract(clean(url), pattern, k) for k in (1, 2, 3))
    return F.when(n != "", F.concat(F.lower(owner), F.lit("/"), F.lower(name), F.lit("#"), n.try_cast("long").cast("string")))


def repository_name(value: Column) -> Column:
    """owner/name, lower-cased, of a full name or an address; null if it is neither."""
    bare = F.regexp_replace(clean(value), r"(?i)^(?:https?://)?(?:www\.|api\.)?[^/\s]+\.[a-z]+/(?:repos/)?", "")
    found = F.regexp_extract(bare, r"^([^/\s]+/[^/\s?#]+)", 1)
    return F.nullif(F.lower(F.regexp_replace(found, r"(?i)\.git$", "")), F.lit(""))


def agreed(*values: Column) -> Column:
    """The one value on which all non-null columns agree; null if there is none or they differ."""
    known = F.array_distinct(F.array_compact(F.array(*values)))
    return F.when(F.size(known) == 1, F.element_at(known, 1))


def order_hash(seed: str, *keys: Column, separator: str = "\0") -> Column:
    """SHA-256 of the seed and the keys as plain text: a fixed random order of rows."""
    return F.sha2(F.concat_ws(separator, F.lit(seed), *[k.cast("string") for k in keys]), 256)


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the named columns in order of their names; null and empty differ."""
    cells = [F.concat(F.lit(c + "="), F.coalesce(F.concat(F.lit("'"), F.col(c).cast("string"), F.lit("'")), F.lit("null"))) for c in sorted(columns)]
    return F.sha2(F.concat_ws("\n", *cells), 256)


def text_list(cell: Column) -> Column:
    """An array of strings from a cell that holds a JSON list, a bracketed list or comma-separated text; blanks go."""
    text = clean(cell)
    parsed = F.from_json(F.when(text.startswith("["), F.replace(text, F.lit("'"), F.lit('"'))), "array<string>")
    loose = F.split(F.regexp_replace(text, r"^[\[({]|[\])}]$", ""), ",")
    every = F.when(parsed.isNotNull(), parsed).otherwise(F.transform(loose, lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")))
    return F.filter(every, lambda x: x.isNotNull() & (F.trim(x) != ""))


def in_domain_order(values: Column, domain: Sequence[str]) -> Column:
    """The domain's members that the array holds, in the domain's order."""
    return F.filter(F.array(*[F.lit(d) for d in domain]), lambda d: F.array_contains(values, d))


def flags_to_text(flags: dict[str, Column], separator: str = "|") -> Column:
    """Names of the flags that hold, joined in their order."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()])), separator)


def text_to_flags(text: Column, names: Sequence[str], separator: str = "|") -> dict[str, Column]:
    parts = F.split(F.coalesce(text, F.lit("")), "\\" + separator)
    return {n: F.array_contains(parts, n) for n in names}


def portable(value: Column, kind: T.DataType) -> Column:
    """A nested value of type ``kind`` as JSON that any reader takes: numbers that aren't finite and missing values are null, fields keep their order; null itself is ""."""
    text = F.to_json(F.struct(_finite(value, kind).alias("v")), {"ignoreNullFields": "false"})
    return F.when(value.isNull(), F.lit("")).otherwise(F.substring(text, F.lit(6), F.length(text) - 6))


def _finite(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _finite(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_finite(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value
