"""Merkle manifest of a dataset by parent-preimage paths.

Every row is a leaf, the hash of its values. Within each language leaves
ascend by doc_id, and every ``ARITY`` consecutive nodes have the hash of
their concatenation, the preimage, as parent, until one node, the subroot, is
left; subroots, ordered by language, go on in the same way to the root.

A parent is stored with its preimage. Going down from the root, each parent
gets the preimages of its ancestors, so that a leaf meets its whole path in
one join with its parent. The siblings of a node are its parent's preimage
without the node's own 64 characters; folding another leaf up splices its
hash into their place and hashes, level by level. The way up reads the level
below once, an eighth as many rows each time; the way down is a join of each
level with the one above, at most ``ARITY`` rows a key.

Defined cases: null values count as ``-``; a null doc_id comes first, and
counts as an empty text where rows are chosen for tampering; null languages
are a language of their own, the first; rows of one doc_id are ordered by
their leaf, equal rows stand side by side, each a leaf; an empty table has no
rows and no root; a table of one row has that leaf as its root and the hash of
nothing as its proof; texts are hashed whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.session import Scratch

ARITY = 8
#: Characters of a digest.
DIGEST = 64
#: Of rows by crc32 of doc_id, one in so many is tampered with.
TAMPERED = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<preimage:string,slot:int>>"


def _framed(value: Column) -> Column:
    """A value with its length before it, so that neighbours can't run into each other."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[_framed(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, grp (a key of lang that keeps its order, null first), hash (the leaf) and the leaf of the tampered row (null without tampering). One scan, no shuffle."""
    doc_id, lang, text = F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")
    others = (doc_id, F.col("source").cast("string"), lang, F.col("n_chars").cast("long"))
    chosen = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % TAMPERED == 0
    return docs.select(
        doc_id.alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), lang), F.lit("")).alias("grp"),
        leaf(*others, text).alias("hash"),
        F.when(chosen, leaf(*others, F.translate(text, _UPPER, _LOWER))).alias("tampered"),
    )


def numbered(nodes: DataFrame, scratch: Scratch, order: list[str]) -> DataFrame:
    """``nodes`` with ``at``, their place (from 0) within ``grp`` in the order of ``order``, and ``n``, how many the group has.

    Rows are dealt by ranges over (grp, order, a number of the stored row), so
    neither a large group nor equal rows fall to one task; places within a
    range are joined with how many rows of the group earlier ranges hold.
    """
    kept = scratch.table(nodes.withColumn("row", F.monotonically_increasing_id()), "nodes")
    keys = ["grp", *order, "row"]
    dealt = kept.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = scratch.table(dealt.select(*nodes.columns, F.monotonically_increasing_id().alias("place")), "ranged")
    part = F.shiftright("place", 33)
    held = ranged.groupBy("grp", part.alias("part")).agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    # One row for each range of a group, so no window holds more than there are ranges.
    whole = Window.partitionBy("grp")
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = held.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    out = scratch.table(ranged.withColumn("part", part).join(begins, ["grp", "part"]).select(*nodes.columns, (F.col("place") + F.col("shift")).alias("at"), "n"), "numbered")
    scratch.drop(kept, ranged)
    return out


def _parents(nodes: DataFrame) -> DataFrame:
    """The level above: grp, at, n, preimage and hash."""
    level = nodes.groupBy("grp", F.floor(F.col("at") / ARITY).alias("at"))
    found = level.agg(F.ceil(F.first("n") / ARITY).alias("n"), F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("children"))
    preimage = F.array_join(F.transform("children", lambda c: c["hash"]), "")
    return found.select("grp", "at", "n", preimage.alias("preimage"), F.sha2(preimage, 256).alias("hash"))


def levels(nodes: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """The levels of parents above numbered nodes, lowest first, and each group's top (grp, hash)."""
    above, tops = [], nodes.filter("n = 1").select("grp", "hash")
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        nodes = scratch.table(_parents(nodes.filter("n > 1")), "parents")
        above.append(nodes)
        tops = tops.unionByName(nodes.filter("n = 1").select("grp", "hash"))
        most = -(-most // ARITY)
    return above, tops


def _under(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """``nodes`` with ``path``: their parent's preimage with their slot in it, then the parent's own path; empty for tops."""
    up = parents.select("grp", F.col("at").alias("up"), F.col("preimage").alias("over"), F.col("path").alias("onward"))
    met = nodes.withColumn("up", F.floor(F.col("at") / ARITY)).join(up, ["grp", "up"], "left")
    step = F.array(F.struct(F.col("over").alias("preimage"), (F.col("at") % ARITY).cast("int").alias("slot")))
    path = F.when(F.col("over").isNull(), F.array().cast(_PATH)).otherwise(F.concat(step, "onward"))
    return met.select(*nodes.columns, path.alias("path"))


def paths(nodes: DataFrame, above: list[DataFrame]) -> DataFrame:
    """Numbered ``nodes`` with the path from each to its group's top."""
    chain = [*reversed(above), nodes]
    found = chain[0].withColumn("path", F.array().cast(_PATH))
    for level in chain[1:]:
        found = _under(level, found)
    return found


def siblings(step: Column) -> Column:
    """A step's preimage without the node's own slot."""
    at = step["slot"] * DIGEST
    return F.overlay(step["preimage"], F.lit(""), at + 1, F.lit(DIGEST))


def folded(start: Column, path: Column) -> Column:
    """The top that ``start`` leads to along a path: its hash replaces the node's slot, level by level."""
    return F.aggregate(path, start, lambda h, step: F.sha2(F.overlay(step["preimage"], h, step["slot"] * DIGEST + 1, F.lit(DIGEST)), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (the siblings' digests, from the leaf to the root), folded_root and verified."""
    scratch = Scratch(docs.sparkSession, "merkle")
    nodes = numbered(leaves(docs), scratch, ["doc_id", "hash"])
    above, subroots = levels(nodes, scratch)
    # The second tree has one group; its leaves are the languages' subroots in order.
    tops = numbered(subroots.select(F.col("grp").alias("lang"), "hash", F.lit("").alias("grp")), scratch, ["lang"])
    above_tops, _ = levels(tops, scratch)
    high = paths(tops, above_tops).select(F.col("lang").alias("grp"), F.col("hash").alias("subroot"), folded(F.col("hash"), F.col("path")).alias("root"), F.col("path").alias("rest"))
    # One row a language on the right; AQE splits the left where a language is large.
    whole = paths(nodes, above).join(scratch.table(high, "subroots"), "grp")
    whole = whole.select("doc_id", "hash", "tampered", "subroot", "root", F.concat("path", "rest").alias("path"))
    return whole.select(
        "doc_id",
        F.col("hash").alias("leaf"),
        "subroot",
        "root",
        F.array_join(F.transform("path", siblings), "").alias("proof"),
        folded(F.coalesce("tampered", "hash"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof"), 256).alias("proof_sha256"), "folded_root", "verified")


def op13_sql() -> str:
    framed = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    row = lambda text: "sha256(" + " || ".join(framed(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    up = f"list_transform(range(0, len(hs), {ARITY}), lambda i: sha256(array_to_string(hs[i + 1 : i + {ARITY}], '')))"
    step = lambda k: f"[array_to_string(hs[{k} // {ARITY} * {ARITY} + 1 : {k}], ''), array_to_string(hs[{k} + 2 : {k} // {ARITY} * {ARITY} + {ARITY}], '')]"
    fold = lambda start: f"list_reduce(list_prepend([{start}, ''], path), lambda a, s: [sha256(s[1] || a[1] || s[2]), ''])[1]"
    # crc32, bit by bit: polynomial 0xEDB88320.
    eight = "list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))"
    crc = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda y: ascii(y)::UBIGINT)), lambda c, b: {eight}), 4294967295::UBIGINT)"
    return f"""
    WITH RECURSIVE base AS (
      SELECT doc_id, lang, {row("text")} AS hash,
        CASE WHEN coalesce({crc}, 0) % {TAMPERED} = 0 THEN {row(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS tampered FROM documents),
    lone AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, hash) - 1 AS place FROM base),
    low AS (
      SELECT lang, 0 AS depth, list(hash ORDER BY place) AS hs FROM lone GROUP BY lang
      UNION ALL SELECT lang, depth + 1, {up} FROM low WHERE len(hs) > 1),
    subs AS (SELECT lang, hs[1] AS hash, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM low WHERE len(hs) = 1),
    high AS (
      SELECT 0 AS depth, list(hash ORDER BY place) AS hs FROM subs
      UNION ALL SELECT depth + 1, {up} FROM high WHERE len(hs) > 1),
    steps AS (
      SELECT l.lang, l.place, depth AS step, {step(f"(l.place // CAST(pow({ARITY}, depth) AS BIGINT))")} AS pair
      FROM lone l JOIN low w ON l.lang IS NOT DISTINCT FROM w.lang WHERE len(hs) > 1
      UNION ALL
      SELECT l.lang, l.place, 1000 + depth, {step(f"(s.place // CAST(pow({ARITY}, depth) AS BIGINT))")}
      FROM lone l JOIN subs s ON l.lang IS NOT DISTINCT FROM s.lang JOIN high h ON len(hs) > 1),
    paths AS (
      SELECT l.*, s.hash AS subroot, (SELECT hs[1] FROM high WHERE len(hs) = 1) AS root, coalesce(p.path, CAST([] AS VARCHAR[][])) AS path
      FROM lone l JOIN subs s ON l.lang IS NOT DISTINCT FROM s.lang
      LEFT JOIN (SELECT lang, place, list(pair ORDER BY step) AS path FROM steps GROUP BY lang, place) p ON l.lang IS NOT DISTINCT FROM p.lang AND l.place = p.place)
    SELECT doc_id, hash AS leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[1] || s[2]), '')) AS proof_sha256,
      {fold("coalesce(tampered, hash)")} AS folded_root, {fold("coalesce(tampered, hash)")} = root AS verified FROM paths"""
