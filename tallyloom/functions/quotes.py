"""Quotes found again in the records that they come from, whatever their emphasis, markup and spacing.

Records are rewritten to plain text with a table that leads back to the
source (``offsets``): without emphasis and code marks and with each run of
white space as one blank; *rendered*, without tags and with entities spelt
out, too. Nothing else may differ: words, numbers, signs and punctuation must
agree.

Many quotes meet many records through an index of word n-grams. A quote is
looked up by its rarest n-gram, and only where that stands in a record of its
scope is the rest compared, in the record's plain text. A quote of one word or
two begins and ends with whole words; longer ones are looked up by words that
aren't at their edges, so that they may begin and end within a word.
"""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.offsets import Places, Step, rewrite, traced
from tallyloom.operators.expect import require_none
from tallyloom.session import Scratch, bound_arrow_batches

#: Marks of emphasis and code, tags that are presentation only, those of them that break a line, entities.
EMPHASIS = r"\*\*|__|`+"
FORMAT_TAGS = "code strong em b i span a li ul ol p div pre br table thead tbody tr td th details summary"
BLOCK_TAGS = "li ul ol p div pre br table thead tbody tr td th details summary"
ENTITY = r"&(?:#[0-9]+|#x[0-9a-f]+|[a-z][a-z0-9]+);"

_ATTRIBUTES = r"""(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*>"""
_INLINE = frozenset(FORMAT_TAGS.split()) - frozenset(BLOCK_TAGS.split())
_SPACE = Step(re.compile(r"\s+"), " ")
_NAME = re.compile(r"</?([a-z][a-z0-9:-]*)", re.I)


def _shown(m: re.Match) -> str:
    """What stands for a piece of markup: the character for entities, nothing for emphasis and tags within a line, a blank for other tags."""
    found = m[0]
    if found[0] == "&":
        return html.unescape(found)
    return " " if found[0] == "<" and _NAME.match(found)[1].lower() not in _INLINE else ""


#: White space as blanks is the last step of each. A document loses all tags, and its comments and scripts first.
PLAIN = (Step(re.compile(EMPHASIS), ""), _SPACE)
RENDERED = (Step(re.compile(rf"</?(?:{FORMAT_TAGS.replace(' ', '|')}){_ATTRIBUTES}|{EMPHASIS}|{ENTITY}", re.I), _shown), _SPACE)
DOCUMENT = (
    Step(re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<![a-z][^>]*>", re.I | re.S), " "),
    Step(re.compile(rf"</?[a-z][a-z0-9:-]*{_ATTRIBUTES}|{EMPHASIS}|{ENTITY}", re.I), _shown),
    _SPACE,
)
#: How a record may be read.
FORMS = {"plain": PLAIN, "rendered": RENDERED, "document": DOCUMENT}


def read_as(text: str, form: str) -> tuple[str, Places]:
    """The text in one of FORMS, and the table that leads its places back to the source."""
    out, log = rewrite(text, FORMS[form])
    return out, traced(len(text), log)


def rendered(texts: DataFrame, key: str, text: str, form: str = "document") -> DataFrame:
    """key, ``rendered`` and ``places``: the pieces of the rendered text as (at, begin, end, same), by where they begin; null texts have neither."""
    bound_arrow_batches(texts.sparkSession)
    rows = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("at", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("same", pa.bool_())]))

    def show(batches):
        for batch in batches:
            read = [None if t is None else read_as(t, form) for t in batch.column(1).to_pylist()]
            pieces = [None if r is None else [dict(zip(("at", "begin", "end", "same"), p, strict=True)) for p in zip(*(x.tolist() for x in (r[1].at, r[1].begin, r[1].end, r[1].same)), strict=True)] for r in read]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r and r[0] for r in read], pa.string()), pa.array(pieces, kind)], names=["key", "rendered", "places"])

    return rows.mapInArrow(show, f"key {rows.schema['key'].dataType.simpleString()}, rendered string, places array<struct<at:int,begin:int,end:int,same:boolean>>")


# Quotes against records --------------------------------------------------------------------------

#: Words of an n-gram of the index.
GRAM = 3
_WORD = re.compile(r"\w+")


def grams(plain: str, whole: bool) -> list[tuple[str, int]]:
    """N-grams of a plain text with where they begin: of a record single words and GRAM words in a row; of a quote (``whole`` false) those that it is looked up by."""
    words = [(m[0], m.start()) for m in _WORD.finditer(plain)]
    row = [(" ".join(w for w, _ in words[k : k + GRAM]), words[k][1]) for k in range(len(words) - GRAM + 1)]
    if whole:
        return words + row
    if len(words) < 3:
        return words
    return row[1:-1] if len(words) >= GRAM + 2 else words[1:-1]


def _read(form: str, whole: bool):
    """Plain text and n-grams of each row: id, scope, source text, plain text and (n-gram, place)."""
    kind = pa.list_(pa.struct([("gram", pa.string()), ("at", pa.int32())]))

    def read(batches):
        for batch in batches:
            plain = [rewrite(t or "", FORMS[form])[0] for t in batch.column(2).to_pylist()]
            plain = plain if whole else [p.strip() for p in plain]
            found = [[{"gram": g, "at": at} for g, at in grams(p, whole)] for p in plain]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(plain, pa.string()), pa.array(found, kind)], names=["id", "scope", "plain", "grams"])

    return read


def _confirm(form: str):
    """The source spellings of quotes at the places where their n-gram stands in a record."""

    def confirm(batches):
        for batch in batches:
            rows = []
            for text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                plain, places = read_as(text or "", form)
                for q in asked:
                    at = q["at"] - q["within"]
                    if at < 0 or not plain.startswith(q["plain"], at):
                        continue
                    lo, hi = (int(x) for x in places.span(at, at + len(q["plain"])))
                    original = text[lo:hi]
                    if rewrite(original, FORMS[form])[0].strip() == q["plain"]:
                        rows.append((q["id"], original))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["id", "original"])

    return confirm


def align_quotes(quotes: DataFrame, records: DataFrame, scope: Sequence[str], quote: str, text: str, form: str = "plain") -> DataFrame:
    """``quotes`` with ``original``, the only spelling in which a quote stands in records of the same ``scope``, ``spellings``, how many there are,
    and ``problem`` where there isn't exactly one: empty, missing or ambiguous. Null scopes match each other.
    """
    spark = quotes.sparkSession
    bound_arrow_batches(spark)
    scratch = Scratch(spark, "quotes")
    by = F.to_json(F.struct(*[F.col(c) for c in scope])) if scope else F.lit("")
    q = scratch.table(quotes.withColumn("__q", F.monotonically_increasing_id()).withColumn("__scope", by), "asked")
    schema = "id long, scope string, plain string, grams array<struct<gram:string,at:int>>"
    asked = scratch.table(q.select("__q", "__scope", F.col(quote).cast("string")).mapInArrow(_read(form, False), schema), "quotes")
    r = scratch.table(records.select(F.monotonically_increasing_id().alias("id"), by.alias("scope"), F.col(text).cast("string").alias("text")), "records")
    # Scope and n-gram travel as one hash; what it takes for equal wrongly doesn't pass the comparison.
    hashed = lambda g: F.xxhash64("scope", g).alias("h")
    index = r.mapInArrow(_read(form, True), schema).select(F.col("id").alias("record"), "scope", F.explode("grams").alias("g")).select("record", hashed("g.gram"), F.col("g.at").alias("place"))
    wanted = asked.select("id", "scope", F.explode("grams").alias("g")).select("id", hashed("g.gram"), F.col("g.at").alias("within"))
    # Only n-grams that some quote has are kept of the index.
    index = scratch.table(index.join(wanted.select("h").distinct(), "h", "left_semi"), "index")
    counts = index.groupBy("h").agg(F.count("*").alias("n"))
    # An n-gram that stands nowhere settles the matter: the quote is missing.
    rarest = wanted.join(counts, "h", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "within")).alias("r"))
    rarest = rarest.filter("r.n > 0").select("id", "r.h", "r.within")
    met = index.join(rarest, "h").join(asked.select("id", F.col("scope").alias("its_scope"), "plain"), "id")
    per_record = met.groupBy("record").agg(F.collect_list(F.struct("id", "its_scope", "plain", "within", F.col("place").alias("at"))).alias("asked"))
    per_record = per_record.join(r.withColumnRenamed("id", "record"), "record").select("text", F.filter("asked", lambda q: q["its_scope"] == F.col("scope")).alias("asked"))
    found = per_record.mapInArrow(_confirm(form), "id long, original string")
    # Quotes without any word (marks only) are few; they are looked for in the records of their scope as they are.
    odd = asked.filter("size(grams) = 0 and plain <> ''").select("id", "scope", "plain")
    bare = odd.join(r, odd["scope"] == r["scope"]).select("text", F.array(F.struct(odd["id"].alias("id"), "plain")).alias("asked")).mapInArrow(_search(form), "id long, original string")
    told = found.unionByName(bare).groupBy("id").agg(F.count_distinct("original").alias("spellings"), F.min("original").alias("original"))
    told = asked.select("id", (F.col("plain") == "").alias("empty")).join(told, "id", "left").select(F.col("id").alias("__q"), "empty", F.coalesce("spellings", F.lit(0)).cast("long").alias("spellings"), "original")
    problem = F.when(F.col("empty"), "empty").when(F.col("spellings") == 0, "missing").when(F.col("spellings") > 1, "ambiguous")
    out = q.join(told, "__q").withColumn("problem", problem).withColumn("original", F.when(F.col("problem").isNull(), F.col("original")))
    return out.select(*[F.col(f"`{c}`") for c in quotes.columns], "original", "spellings", "problem")


def _search(form: str):
    """The source spellings of quotes anywhere in a record, by plain search."""

    def search(batches):
        for batch in batches:
            rows = []
            for text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                plain, places = read_as(text or "", form)
                for q in asked:
                    for m in re.finditer(f"(?={re.escape(q['plain'])})", plain):
                        lo, hi = (int(x) for x in places.span(m.start(), m.start() + len(q["plain"])))
                        rows.append((q["id"], text[lo:hi]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["id", "original"])

    return search


def require_quotes(quotes: DataFrame, records: DataFrame, scope: Sequence[str], quote: str, text: str, form: str = "plain") -> DataFrame:
    """The rows with each quote as it stands in its records; a quote that isn't found in one spelling is an error."""
    aligned = Scratch(quotes.sparkSession, "quotes").table(align_quotes(quotes, records, scope, quote, text, form), "aligned")
    require_none(aligned.filter("problem is not null").select(quote, "problem"), "quotes not found in exactly one spelling")
    return aligned.withColumn(quote, F.col("original")).drop("original", "spellings", "problem")


@F.pandas_udf(T.StringType())
def plain_text(text: pd.Series) -> pd.Series:
    """A column without emphasis and code marks, white space as blanks; null is empty."""
    return text.map(lambda t: rewrite(t or "", PLAIN)[0])
