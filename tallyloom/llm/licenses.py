"""Licence scans by sentence rules.

A text is cut into sentences, at sentence marks (but not that of "v. 2.0")
and blank lines, so that a notice wrapped over lines is one sentence; what isn't known as a whole is
tried line by line, so that a notice without a final mark is found, too. Each
sentence is normalised (letters lower-cased, every run of other characters
one space) and looked up among known licence sentences, which gives an
identifier or nothing. Licence rules, sequences of identifiers, are matched
against a text's identifiers in order; up to ``gap`` other identifiers may
stand between two of a rule's. Rules are tried by rank, and what a rule has
matched is used up, so that a longer rule shadows its parts. Identifiers that
no rule used are reported as unmatched.

Known sentences and rules are tables. A sentence without holes is found by an
equality join; a template, in which ``*`` stands for any words or none, by a
join on its anchor, three words in a row, and its pattern. Rules meet texts
by a join on the rule's first identifier. Spark broadcasts these tables while
they are small and shuffles beyond that. Texts are read once: their candidate
sentences, few, are written and everything else reads those.

DataFrame functions only, no Python. Defined cases: null and empty texts match
nothing (empty strings); repeated sentences count each, a licence found twice
is named once; of several identifiers of one sentence the first in rank is
taken, of several rules likewise; repeated rows are reported each; very long
texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import Scratch

#: Words of a template's anchor, and identifiers that may stand between two of a rule's.
ANCHOR, GAP = 3, 2


def _forms(subjects: str, names: list[str]) -> list[str]:
    """Notices "(this X is) released or licensed under NAME"."""
    lead = ["", *(f"this {s} is " for s in subjects.split())]
    return [f"{a}{b} under {c}" for a, b, c in product(lead, ("released", "licensed"), names)]


#: Identifiers and the normalised sentences that have them; ``*`` stands for any words or none.
SENTENCES: list[tuple[str, list[str]]] = [
    ("apache2", _forms("file work software project", ["the apache license version 2 0", "the apache license version 2 0 the license"])),
    ("apache2_condition", ["you may not use this file except in compliance with the license"]),
    ("apache2_copy", ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at"]),
    ("mit", _forms("file work software project", ["the mit license"])),
    ("mit_grant", ["* permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files *"]),
    ("mit_notice", ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"]),
    ("as_is", ["the software is provided as is without warranty of any kind *", "this software is provided as is without warranty of any kind *", "this software is provided by the copyright holders and contributors as is *"]),
    ("bsd_grant", ["* redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met *"]),
    ("bsd_source", ["* redistributions of source code must retain the above copyright notice *"]),
    ("bsd_binary", ["* redistributions in binary form must reproduce the above copyright notice *"]),
    ("bsd_names", ["* neither the name of * nor the names of its contributors may be used to endorse or promote products *"]),
    ("gpl3", _forms("file work software program", [f"the gnu general public license version 3{x}" for x in ("", " 0", " or later", " or later 0")])),
    ("gpl2", _forms("file work software program", [f"the gnu general public license version 2{x}" for x in ("", " 0", " or later", " or later 0")])),
    *((f"gpl_free_{v}", [f"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {v} *"]) for v in "32"),
    ("gpl_free", ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license *", "you can redistribute it and or modify it under the terms of the gnu general public license *"]),
    ("lgpl_free", ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license *", "you can redistribute it and or modify it under the terms of the gnu lesser general public license *"]),
    *((f"version_{v}", [f"either version {v} of the license *"]) for v in "32"),
    ("gpl_warranty", ["this program is distributed in the hope that it will be useful but without any warranty *"]),
    ("lgpl3", _forms("file work software library", [f"the gnu lesser general public license version 3{x}" for x in ("", " 0", " or later", " or later 0")])),
    ("mpl2", ["this source code form is subject to the terms of the mozilla public license v 2 0"]),
    ("cc_by_nc_4", _forms("file work document", ["cc by nc 4 0", "a creative commons attribution noncommercial 4 0", "cc by nc 4 0 international license", "a creative commons attribution noncommercial 4 0 international license"])),
    ("cc_by_sa_4", _forms("file work document", ["cc by sa 4 0", "a creative commons attribution sharealike 4 0", "cc by sa 4 0 international license", "a creative commons attribution sharealike 4 0 international license"])),
    ("cc_by_4", _forms("file work document", ["cc by 4 0", "a creative commons attribution 4 0", "cc by 4 0 international license", "a creative commons attribution 4 0 international license"])),
    ("cc0", ["* cc0 1 0 universal *", "* dedicated to the public domain *"]),
    ("unlicense", ["this is free and unencumbered software released into the public domain"]),
    ("all_rights", ["* all rights reserved"]),
]

#: Licence and the sequence of sentence identifiers that states it; tried in this order.
RULES = [
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_names", "as_is"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_names"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "as_is"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("MIT", ["mit", "mit_grant", "mit_notice", "as_is"]),
    ("MIT", ["mit_grant", "mit_notice", "as_is"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("Apache-2.0", ["apache2", "apache2_condition", "apache2_copy"]),
    ("Apache-2.0", ["apache2", "apache2_condition"]),
    *((f"GPL-{v}.0", [f"gpl_free_{v}", *more]) for v in "32" for more in (["gpl_warranty"], [])),
    *((f"GPL-{v}.0", ["gpl_free", f"version_{v}", *more]) for v in "32" for more in (["gpl_warranty"], [])),
    ("LGPL-3.0", ["lgpl_free", "version_3"]),
    ("GPL", ["gpl_free", "gpl_warranty"]),
    ("GPL", ["gpl_free"]),
    ("Apache-2.0", ["apache2"]),
    ("MIT", ["mit"]),
    ("GPL-3.0", ["gpl3"]),
    ("GPL-2.0", ["gpl2"]),
    ("LGPL-3.0", ["lgpl3"]),
    ("MPL-2.0", ["mpl2"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_4"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_4"]),
    ("CC-BY-4.0", ["cc_by_4"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
    ("Proprietary", ["all_rights"]),
]

#: Every sentence above holds one of these; a piece without any can't be known, and looking for them is cheap.
STEMS = ("licen", "redistribut", "warrant", "permission", "public domain", "free software", "neither the name", "rights reserved", "cc0", "under cc by", "creative commons", "provided by the copyright holders", "copyright notice")

_CUT = "[.!?;]+[ \\t\\r\\n\\f]+|\\n[ \\t\\r]*[#*/;]*[ \\t\\r]*\\n[ \\t\\r\\n\\f]*"
_LINE = "[\\n\\r]+"
#: A mark that ends an abbreviation before a number ends no sentence.
_SHORT = "\\b(v|ver|vers|no|sec|art)[.][ \\t\\r\\n\\f#*/;]+([0-9])"
#: What may stand for a blank where a text is wrapped, within a comment, too.
_SPACE = "[ \\t\\r\\n\\f#*/;]+"


def sentence_table(spark: SparkSession, sentences: list[tuple[str, list[str]]] = SENTENCES) -> DataFrame:
    """A row for each known sentence: rank, identifier and sentence."""
    return spark.createDataFrame([(k, name, s) for k, (name, forms) in enumerate(sentences) for s in forms], "rank int, identifier string, sentence string")


def rule_table(spark: SparkSession, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """A row for each rule: rank, license and its identifiers in order."""
    return spark.createDataFrame([(k, name, list(ids)) for k, (name, ids) in enumerate(rules)], "rank int, license string, identifiers array<string>")


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def _holds(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def candidate_sentences(docs: DataFrame, scratch: Scratch, stems: tuple[str, ...] | None) -> DataFrame:
    """row, doc_id and the pieces of each text, lower-cased, that may be known; a written table, the only reading of the texts."""
    low = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("low"))
    pieces = F.split(F.regexp_replace("low", _SHORT, "$1.$2"), _CUT)
    if stems:
        # Words by a plain search; stems of several words, which a wrapped text may break, by pattern where their first word stands.
        spread = lambda words: "|".join(w.replace(" ", _SPACE) for w in words)
        several = [s for s in stems if " " in s]
        maybe = _holds(F.col("low"), [s for s in stems if " " not in s])
        if several:
            maybe = maybe | (_holds(F.col("low"), list(dict.fromkeys(s.split(" ")[0] for s in several))) & F.col("low").rlike(spread(several)))
        pieces = F.when(maybe, F.filter(pieces, lambda p: p.rlike(spread(stems)))).otherwise(F.array().cast("array<string>"))
    return scratch.table(low.select(F.monotonically_increasing_id().alias("row"), "doc_id", pieces.alias("pieces")), "pieces")


def identify(pieces: DataFrame, sentences: DataFrame) -> DataFrame:
    """row and its identifiers in order, for rows that have any. ``pieces``: row and pieces; ``sentences`` as ``sentence_table`` gives them."""
    cand = pieces.select("row", F.posexplode("pieces").alias("piece", "raw"))
    lines = cand.filter(F.col("raw").rlike(_LINE)).select("row", "piece", F.posexplode(F.split("raw", _LINE)).alias("line", "raw"))
    tried = cand.select("row", "piece", F.lit(0).alias("line"), _normal(F.col("raw")).alias("sentence")).unionByName(lines.select("row", "piece", (F.col("line") + 1).alias("line"), _normal(F.col("raw")).alias("sentence")))
    tried = tried.filter("sentence <> ''")
    hole = F.contains("sentence", F.lit("*"))
    plain = sentences.filter(~hole)
    exact = tried.join(plain, "sentence").select("row", "piece", "line", "rank", "identifier")
    runs = F.filter(F.transform(F.split("sentence", "\\*"), lambda r: F.split(F.trim(r), " ")), lambda w: F.size(w) >= ANCHOR)
    anchor = F.when(F.size(runs) > 0, F.array_join(F.slice(F.element_at(runs, 1), 1, ANCHOR), " ")).otherwise(F.raise_error(F.concat(F.lit("no three words in a row: "), "sentence")))
    pattern = F.concat(F.lit("^"), F.replace(F.replace("sentence", F.lit("* "), F.lit("(.* )?")), F.lit(" *"), F.lit("( .*)?")), F.lit("$"))
    templates = sentences.filter(hole).select("rank", "identifier", anchor.alias("anchor"), pattern.alias("pattern"))
    # Each word with the next ones; arrays are zipped, so that a long sentence is split a few times and not for every word.
    words = F.split("sentence", " ")
    grams = words
    for k in range(1, ANCHOR):
        grams = F.zip_with(grams, F.slice(words, k + 1, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    grams = F.filter(grams, lambda g: g.isNotNull())
    met = tried.withColumn("anchor", F.explode(F.array_distinct(grams))).join(templates, "anchor").filter("sentence RLIKE pattern").select("row", "piece", "line", "rank", "identifier")
    best = exact.unionByName(met).groupBy("row", "piece", "line").agg(F.min(F.struct("rank", "identifier")).alias("best"))
    # A piece known as a whole isn't tried by lines.
    per_piece = best.groupBy("row", "piece").agg(F.array_sort(F.collect_list(F.struct("line", "best.identifier"))).alias("found"))
    per_piece = per_piece.select("row", "piece", F.when(F.element_at("found", 1)["line"] == 0, F.slice("found", 1, 1)).otherwise(F.col("found")).alias("found"))
    return per_piece.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "found"))), lambda p: p["found"]["identifier"])).alias("ids"))


def _rule_pattern(ids: Column, gap: int) -> Column:
    between = f"((?:[|][^|#]+[|]){{0,{gap}}}?)"
    return F.array_join(F.transform(ids, lambda i: F.concat(F.lit("[|]"), i, F.lit("[|]"))), between)


def match_rules(named: DataFrame, rules: DataFrame, gap: int = GAP) -> DataFrame:
    """row, ids, found licences and unmatched identifiers. ``named``: row and ids; ``rules`` as ``rule_table`` gives them."""
    # Identifiers between two of a rule's stay in the line, by their groups; what is used becomes #.
    keep = F.concat(F.lit("#"), F.array_join(F.transform(F.sequence(F.lit(1), F.size("identifiers")), lambda k: F.when(k < F.size("identifiers"), F.concat(F.lit("$"), k.cast("string"))).otherwise(F.lit(""))), ""))
    known = rules.select("rank", "license", F.element_at("identifiers", 1).alias("first"), _rule_pattern(F.col("identifiers"), gap).alias("pattern"), keep.alias("keep"))
    offered = named.select("row", F.explode(F.array_distinct("ids")).alias("first")).join(known, "first").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "license", "pattern", "keep"))).alias("rules"))
    line = F.array_join(F.transform("ids", lambda s: F.concat(F.lit("|"), s, F.lit("|"))), "")
    start = F.struct(line.alias("left"), F.array().cast("array<string>").alias("found"))

    def use(state: Column, rule: Column) -> Column:
        hit = F.regexp_like(state["left"], rule["pattern"])
        return F.struct(
            F.when(hit, F.regexp_replace(state["left"], rule["pattern"], rule["keep"])).otherwise(state["left"]).alias("left"),
            F.when(hit, F.array_union(state["found"], F.array(rule["license"]))).otherwise(state["found"]).alias("found"),
        )

    none = F.array().cast("array<struct<rank:int,license:string,pattern:string,keep:string>>")
    out = named.join(offered, "row", "left").withColumn("end", F.aggregate(F.coalesce("rules", none), start, use))
    unmatched = F.filter(F.split(F.regexp_replace("end.left", "[|#]+", ","), ","), lambda s: s != "")
    return out.select("row", "ids", F.col("end.found").alias("found"), unmatched.alias("unmatched"))


def scan_licenses(docs: DataFrame, sentences: DataFrame | None = None, rules: DataFrame | None = None, gap: int = GAP, stems: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, sentence identifiers in order, licences by rank of their rules, and identifiers that no rule used; all joined by commas.

    ``stems``: lower-case strings of which every known sentence holds one; without them all sentences are tried. The built-in tables bring their own.
    """
    spark = docs.sparkSession
    stems = STEMS if sentences is None and stems is None else stems
    pieces = candidate_sentences(docs, Scratch(spark, "licenses"), stems)
    found = match_rules(identify(pieces.select("row", "pieces"), sentence_table(spark) if sentences is None else sentences), rule_table(spark) if rules is None else rules, gap)
    out = pieces.select("row", "doc_id").join(found, "row", "left")
    joined = lambda column: F.coalesce(F.array_join(column, ","), F.lit(""))
    return out.select("doc_id", joined("ids").alias("sentences"), joined("found").alias("licenses"), joined("unmatched").alias("unmatched"), F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_licenses"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op4_sql() -> str:
    """The same over DuckDB's documents."""
    cases = []
    for name, forms in SENTENCES:
        plain = [_quoted(f) for f in forms if "*" not in f]
        if plain:
            cases.append(f"WHEN s IN ({', '.join(plain)}) THEN '{name}'")
        cases += [f"WHEN regexp_full_match(s, {_quoted(f.replace('* ', '(.* )?').replace(' *', '( .*)?'))}) THEN '{name}'" for f in forms if "*" in f]
    between = f"((?:[|][^|#]+[|]){{0,{GAP}}}?)"
    levels = "SELECT r, ids, list_reduce(list_prepend('', list_transform(ids, lambda x: '|' || x || '|')), lambda a, b: a || b) AS rest, []::VARCHAR[] AS found FROM ids"
    for name, sequence in RULES:
        pattern = _quoted(between.join(f"[|]{s}[|]" for s in sequence))
        keep = _quoted("#" + "".join(f"\\{k}" for k in range(1, len(sequence))))
        levels = f"SELECT r, ids, regexp_replace(rest, {pattern}, {keep}, 'g') AS rest, CASE WHEN regexp_matches(rest, {pattern}) AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM ({levels})"
    stems = "|".join(STEMS)
    return f"""
    WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS low FROM documents),
    pieces AS (SELECT r, unnest(p) AS raw, generate_subscripts(p, 1) AS piece FROM (SELECT r, list_filter(string_split_regex(regexp_replace(low, {_quoted(_SHORT)}, '\\1.\\2', 'g'), {_quoted(_CUT)}),
      lambda s: regexp_matches(regexp_replace(s, {_quoted(_SPACE)}, ' ', 'g'), '{stems}')) AS p FROM numbered)),
    tried AS (SELECT r, piece, 0 AS line, raw FROM pieces
      UNION ALL SELECT r, piece, generate_subscripts(l, 1), unnest(l) FROM (SELECT r, piece, string_split_regex(raw, {_quoted(_LINE)}) AS l FROM pieces WHERE regexp_matches(raw, {_quoted(_LINE)}))),
    normal AS (SELECT r, piece, line, trim(regexp_replace(raw, '[^a-z0-9]+', ' ', 'g')) AS s FROM tried),
    named AS (SELECT * FROM (SELECT r, piece, line, CASE {' '.join(cases)} ELSE '' END AS id FROM normal) WHERE id <> ''),
    chosen AS (SELECT * FROM named QUALIFY line = 0 OR min(line) OVER (PARTITION BY r, piece) > 0),
    ids AS (SELECT r, list(id ORDER BY piece, line) AS ids FROM chosen GROUP BY r),
    ended AS ({levels})
    SELECT doc_id, coalesce(array_to_string(ids, ','), '') AS sentences, coalesce(array_to_string(found, ','), '') AS licenses,
      coalesce(array_to_string(list_filter(string_split(regexp_replace(rest, '[|#]+', ',', 'g'), ','), lambda s: s <> ''), ','), '') AS unmatched,
      coalesce(len(found), 0)::BIGINT AS n_licenses FROM numbered LEFT JOIN ended USING (r)"""
