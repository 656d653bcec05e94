"""Repeated passages by fixed-block anchors.

A window is ``WINDOW`` consecutive words of one text. Words that lie in a
window whose word sequence also starts anywhere else, in the same text or in
another, are repeated.

The reference is every text cut into blocks of ``BLOCK`` words, of which each
window holds exactly one whole. All blocks are indexed and probed with every
run of ``BLOCK`` words at any place; an anchor is a block that another place
hits. An anchor is extended by all its partners at once instead of by each in
turn: the windows around it are matched by hash with those around the
partners' own anchors (a window's partner holds an anchor of its own within
the same words), and windows matched one after the other join to a maximal
repeat. So no pair of places is ever formed: a passage in a third of all
texts costs what it takes to read it.

Copies of a text are one text that counts as often as it occurs. Blocks and
probes travel as sorted hashes of a range each, combined before they leave
their task, two to four bytes a word; their bits grow with the corpus, and
what they take for a hit wrongly is put right by the windows' hashes (96
bits). Of the windows only those that occur once come back to their text.

Defined cases: null texts have no words; texts shorter than a window keep all
words; a text of which there is a copy loses all its words if it has a
window; repeated rows are copies, whatever their doc_id; white space is
ASCII's, words are compared byte by byte; texts are taken whole; an empty
table gives an empty table; extra columns are ignored (``passages``) or kept
(``drop_repeats``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.bytetext import EXACT, SPACED, mix64, utf8_buffers, words
from tallyloom.session import Scratch, bound_arrow_batches

WINDOW = 35
#: Words of a block: the most of which every window holds a whole one, wherever it starts.
BLOCK = (WINDOW + 1) // 2
#: Words whose probes are combined before they leave their task.
FLUSH = 4 << 20
#: Bytes of text whose probes meet in one range of hashes, and ranges at least.
RANGE_BYTES, LEAST_RANGES = 48 << 20, 64


def _odd(width: int, salt: int) -> np.ndarray:
    return mix64(np.arange(1, width + 1, dtype=np.uint64) + np.uint64(salt << 32)) | np.uint64(1)


def rolling(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A hash of the ``width`` words from each word on; the last ``width - 1`` aren't whole."""
    total = np.zeros(len(hashes), dtype=np.uint64)
    for k, odd in enumerate(_odd(width, salt)[: len(hashes)]):
        total[: len(hashes) - k] += hashes[k:] * odd
    return mix64(total)


def _spaced(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of a column of texts, each word's place in its text, its text, and each text's number of words."""
    data, offsets = utf8_buffers(column)
    hashes, row, _, _ = words(data, offsets, SPACED, EXACT)
    count = np.bincount(row, minlength=len(column))
    begin = np.concatenate(([0], np.cumsum(count)))
    return hashes, np.arange(len(hashes)) - begin[row], row, count


def _combined(values: np.ndarray) -> np.ndarray:
    """Sorted values ``hash << 2 | indexed << 1 | several``, one for each hash: indexed if any is, several if there is more than one or any says so."""
    values = np.sort(values)
    if not len(values):
        return values
    key = values >> np.uint64(2)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    flags = np.bitwise_or.reduceat(values & np.uint64(3), first)
    several = np.diff(np.append(first, len(values))) > 1
    return (key[first] << np.uint64(2)) | flags | several.astype(np.uint64)


def pack(values: np.ndarray) -> bytes:
    """Ascending values as differences, their bytes by significance, without leading zeros."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    planes = steps.view(np.uint8).reshape(-1, 8).T
    used = 8 - int(np.argmax(planes[::-1].any(axis=1))) if planes.any() else 1
    return planes[:used].tobytes()


def unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.zeros((8, n), dtype=np.uint8)
    held = np.frombuffer(packed, dtype=np.uint8).reshape(-1, n)
    planes[: len(held)] = held
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def _probes(bits: int, ranges: int):
    """Every run of BLOCK words of every text that has a window, those at block boundaries marked as indexed, by range of hash."""
    low = bits - (ranges.bit_length() - 1)

    def flushed(parts):
        values = _combined(np.concatenate(parts))
        cut = np.searchsorted(values, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(low + 2))
        rows = [(k, b - a, pack(values[a:b] & np.uint64((1 << (low + 2)) - 1))) for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["range", "n", "packed"])

    def search(batches):
        parts, held = [], 0
        for batch in batches:
            hashes, place, row, count = _spaced(batch.column(0))
            whole = (count[row] >= WINDOW) & (place + BLOCK <= count[row])
            if not whole.any():
                continue
            key = rolling(hashes, BLOCK)[whole] >> np.uint64(64 - bits)
            parts.append((key << np.uint64(2)) | ((place[whole] % BLOCK == 0).astype(np.uint64) << np.uint64(1)))
            held += len(key)
            if held >= FLUSH:
                yield flushed(parts)
                parts, held = [], 0
        if parts:
            yield flushed(parts)

    return search


def _hits(low: int):
    def search(table: pa.Table) -> pa.Table:
        value = np.concatenate([unpack(p, n) for p, n in zip(table["packed"].to_pylist(), table["n"].to_pylist(), strict=True)])
        value = _combined(value)
        value = value[(value & np.uint64(3)) == 3] >> np.uint64(2)
        return pa.table({"h": pa.array((value | (np.uint64(table["range"][0].as_py()) << np.uint64(low))).view(np.int64))})

    return search


def _blocks(bits: int):
    """Hash and number of every block of every text that has a window, each text once a task."""

    def search(batches):
        seen = set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            fresh = [k not in seen and not seen.add(k) for k in keys]
            batch = batch.filter(pa.array(fresh))
            hashes, place, row, count = _spaced(batch.column(2))
            at = np.flatnonzero((count[row] >= WINDOW) & (place + BLOCK <= count[row]) & (place % BLOCK == 0))
            key = (rolling(hashes, BLOCK)[at] >> np.uint64(64 - bits)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), *(c.take(pa.array(row[at])) for c in batch.columns[:2]), pa.array((place[at] // BLOCK).astype(np.int32))], names=["h", "k1", "k2", "block"]
            )

    return search


def _marked(blocks: list[list[int] | None], count: np.ndarray) -> np.ndarray:
    """Which words of the concatenated texts begin a window around an anchor: that which holds the block, whole, starts less than a block before."""
    begin = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(begin[-1] + 1, dtype=np.int64)
    for k, own in enumerate(blocks):
        if own is not None and count[k] >= WINDOW:
            start = np.asarray(own, dtype=np.int64) * BLOCK
            stop = np.minimum(start, count[k] - WINDOW) + 1
            start = np.minimum(np.maximum(start - BLOCK + 1, 0), stop)
            np.add.at(out, begin[k] + start, 1)
            np.add.at(out, begin[k] + stop, -1)
    return np.cumsum(out)[:-1] > 0


def _windows(batches):
    """The windows around anchors: hashes, text and place, and how often the text occurs."""
    for batch in batches:
        hashes, place, row, count = _spaced(batch.column(3))
        at = np.flatnonzero(_marked(batch.column(4).to_pylist(), count))
        second = (rolling(mix64(hashes), WINDOW, 1)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        of = pa.array(row[at])
        yield pa.RecordBatch.from_arrays(
            [pa.array(rolling(hashes, WINDOW)[at].view(np.int64)), pa.array(second), *(c.take(of) for c in batch.columns[:3]), pa.array(place[at].astype(np.int32))], names=["h", "h2", "k1", "k2", "copies", "place"]
        )


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
PASSAGES = "k1 long, k2 long, n_words long, n_removed long, repeats array<struct<start:long,end:long>>, kept string"


def _kept(batches):
    for batch in batches:
        rows = []
        for text, blocks, single in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
            held = text.encode().split()
            n = len(held)
            edge = np.zeros(n + 1, dtype=np.int64)
            start = _marked([blocks], np.array([n]))
            start[np.asarray(single or [], dtype=np.int64)] = False
            start = np.flatnonzero(start)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + WINDOW, -1)
            gone = np.cumsum(edge)[:n] > 0
            turn = np.flatnonzero(np.diff(gone, prepend=False, append=False))
            spans = [{"start": a, "end": b} for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)]
            kept, last = [], 0
            for s in spans:
                kept += held[last : s["start"]]
                last = s["end"]
            rows.append((n, int(gone.sum()), spans, b" ".join(kept + held[last:]).decode()))
        kinds = (pa.int64(), pa.int64(), _SPAN, pa.string())
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=[c.split()[0] for c in PASSAGES.split(", ")])


def _keyed(text: Column) -> list[Column]:
    """Two hashes that together tell texts apart."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def anchors(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """k1, k2 (the text's key) and the numbers of its blocks that occur elsewhere, too."""
    size = docs.agg(F.sum(F.octet_length(_text()))).first()[0] or 0
    ranges = max(LEAST_RANGES, 1 << (size // RANGE_BYTES).bit_length())
    # A block takes 36 bytes at least, so by chance one run in 576 or fewer meets an indexed hash of another one.
    bits = min(60, max(24, size.bit_length() + 4, ranges.bit_length() + 8))
    probes = docs.select(_text().alias("text")).mapInArrow(_probes(bits, ranges), "range int, n int, packed binary")
    hits = scratch.table(probes.groupBy("range").applyInArrow(_hits(bits - (ranges.bit_length() - 1)), "h long"), "hits")
    blocks = docs.select(*_keyed(_text()), _text().alias("text")).mapInArrow(_blocks(bits), "h long, k1 long, k2 long, block int")
    return scratch.table(blocks.join(hits, "h", "left_semi").groupBy("k1", "k2").agg(F.sort_array(F.collect_set("block")).alias("blocks")), "anchors")


def passages(docs: DataFrame) -> DataFrame:
    """For each different text its key, n_words, n_removed, its maximal repeats (in words, end exclusive) and what is kept, joined by blanks."""
    bound_arrow_batches(docs.sparkSession)
    found = anchors(docs, Scratch(docs.sparkSession, "anchors"))
    # Whole texts are shuffled once: both joins below read the same exchange.
    texts = docs.select(*_keyed(_text()), _text().alias("text")).groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    windows = texts.join(found, ["k1", "k2"]).select("k1", "k2", "copies", "text", "blocks").mapInArrow(_windows, "h long, h2 int, k1 long, k2 long, copies long, place int")
    once = windows.groupBy("h", "h2").agg(F.sum("copies").alias("copies"), *[F.bit_xor(c).alias(c) for c in ("k1", "k2", "place")]).filter("copies = 1")
    single = once.groupBy("k1", "k2").agg(F.collect_list("place").alias("single"))
    met = texts.join(found, ["k1", "k2"], "left").join(single, ["k1", "k2"], "left")
    return met.select("k1", "k2", "copies", "text", "blocks", "single").mapInArrow(_kept, PASSAGES)


def _per_row(docs: DataFrame, found: DataFrame, columns: list[Column]) -> DataFrame:
    """``columns`` of each row of ``docs``, with ``found`` of its text. A text's result is small; rows of a frequent one are split by AQE."""
    k1, k2 = _keyed(_text())
    rows = docs.select(k1, k2, *columns)
    return rows.join(found, ["k1", "k2"]).drop("k1", "k2")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """All documents with their columns; repeated passages are gone from ``text``, its words joined by blanks; ``n_chars``, where present, follows. A null text stays null."""
    found = passages(docs).select("k1", "k2", F.struct("n_removed", "kept").alias("_passages"))
    held = _per_row(docs, found, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")])
    changed = F.col("_passages.n_removed") > 0
    text = F.when(changed, F.col("_passages.kept")).otherwise(F.col("_row.text"))
    size = F.when(changed, F.length("_passages.kept").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None
    return held.select(*[text.alias(c) if c == "text" else size.alias(c) if c == "n_chars" else F.col(f"_row.`{c}`") for c in docs.columns])


def op11_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = passages(docs).select("k1", "k2", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return _per_row(docs, found, [F.col("doc_id").cast("long").alias("doc_id")])


def op11_sql() -> str:
    return rf"""
    WITH held AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    starts AS (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS s FROM held WHERE len(ws) >= {WINDOW}),
    keyed AS (SELECT r, s, md5(array_to_string(ws[s : s + {WINDOW - 1}], ' ')) AS k FROM starts),
    twice AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY k) AS c FROM keyed) WHERE c > 1),
    gone AS (SELECT DISTINCT r, s + d AS at_word FROM twice, (SELECT unnest(range(0, {WINDOW})) AS d)),
    lost AS (SELECT r, list(at_word) AS gs FROM gone GROUP BY r),
    kept AS (
      SELECT h.r, string_agg(w.word, ' ' ORDER BY w.n) AS kept
      FROM held h, (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS n FROM held) w
      WHERE h.r = w.r AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.r = w.r AND g.at_word = w.n) GROUP BY h.r)
    SELECT h.doc_id, len(h.ws)::BIGINT AS n_words, coalesce(len(l.gs), 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
    FROM held h LEFT JOIN lost l ON h.r = l.r LEFT JOIN kept k ON h.r = k.r"""
