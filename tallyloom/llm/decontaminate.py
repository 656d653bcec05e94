"""Benchmark decontamination by pigeonhole edit matching.

A test item of ``m`` words may be spelt with up to ``k`` word edits. Cut into
``k + 1`` pieces, at least one piece then stands unchanged in the text, so all
exact piece hits give every candidate window, and Myers' bit-parallel distance
over words verifies each. Any cut into ``k + 1`` pieces will do: pieces are of
nearly equal length unless one of them stands in more than ``SHARED`` items (a
stock phrase). Such an item is cut anew, so that its pieces stand in as few
other items as they can: a stock phrase then is part of a longer piece with
words of the item's own, and a text that has it meets few items.

Texts are read once, whatever the number of items. Items of up to
``broadcast_chars`` characters are broadcast as one Aho-Corasick automaton.
More of them stay a table: texts are tested against a bit table of piece
hashes, those with hits are written with the places of their hits, and pieces,
items and texts meet in joins on the piece's hash, the item and the text.

Defined cases: null or empty texts hit nothing; null or empty items, and items
of fewer than ``min_words`` words, are not searched for (they would be found
by chance; ``min_words=1`` takes all, ``unsearched_items`` names them); an item of five words has no edits, as
its pieces would get too short; of several equally near places of an item in a
text the first is reported; repeated items are reported each; a repeated
document row is reported each time it occurs; case, punctuation and spacing
don't count; a script without spaces is one word. Very long texts are searched
whole. Extra columns are ignored (``find_leaks``) or kept (``drop_leaks``).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import Scratch, bound_arrow_batches

#: Share of an item's words that may be edited.
ERROR_RATE = 0.2
#: A piece has at least so many words: shorter ones hit everywhere.
PIECE_WORDS = 3
#: An item that shares a piece with more items than this is cut elsewhere, in blocks of so many pieces, of so many words at most (twice the mean, if more).
SHARED, BLOCK_PIECES, LONG_PIECE = 4, 64, 24
#: Items shorter than this say nothing about where a text comes from.
MIN_WORDS = 5
#: Characters of items that are broadcast as an automaton; beyond that, pieces are joined by hash.
BROADCAST_CHARS = 8_000_000
#: Bits of the table of piece hashes at least and at most; a fuller table lets more texts through to the join, none less.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
#: Words whose hash a worker keeps; then it starts anew.
KEPT_WORDS = 1_000_000

HIT_NAMES = ["item_id", "distance", "budget", "item_words", "first_word", "last_word"]
HITS = ", ".join(f"{n} long" for n in HIT_NAMES)

_WORD = re.compile(r"\w+")


def split_words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def error_budget(words: int, rate: float = ERROR_RATE, piece_words: int = PIECE_WORDS) -> int:
    """Edits allowed for an item: ``rate`` of its words, fewer where pieces would get too short."""
    return max(0, min(int(words * rate), words // piece_words - 1))


def pieces(words: list[str], budget: int) -> list[tuple[int, list[str]]]:
    """``budget + 1`` consecutive pieces of nearly equal length, with the position of each."""
    return at_cuts(words, equal_cuts(len(words), budget))


def equal_cuts(size: int, budget: int) -> list[int]:
    return [size * i // (budget + 1) for i in range(budget + 2)]


def at_cuts(words: list[str], cuts: list[int]) -> list[tuple[int, list[str]]]:
    return [(lo, words[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _least_shared(common: np.ndarray, size: int, count: int) -> list[int]:
    """The ends of ``count`` pieces of ``size`` words for which the sum of ``common``'s least value within each piece is least; pieces alike in that are of like length."""
    mean = size / count
    longest = min(size - PIECE_WORDS * (count - 1), max(LONG_PIECE, int(2 * mean) + 1))
    lengths = np.arange(PIECE_WORDS, longest + 1)
    starts = np.arange(size + 1)[None, :] - lengths[:, None]
    price = np.full(starts.shape, np.inf)
    low = np.full(size + 1, np.inf)
    for k, length in enumerate(lengths):
        # The least of the runs within the words from each start on.
        n = size - length + 1
        low[:n] = np.minimum(low[:n], common[length - PIECE_WORDS : length - PIECE_WORDS + n])
        price[k, length:] = low[:n] + (length - mean) ** 2 / (1000 + size * size)
    total = np.where(np.arange(size + 1) == 0, 0.0, np.inf)
    chosen = []
    for _ in range(count):
        sums = np.where(starts >= 0, total[starts], np.inf) + price
        best = sums.argmin(axis=0)
        chosen.append(best)
        total = sums[best, np.arange(size + 1)]
    ends, at = [], size
    for best in reversed(chosen):
        ends.append(at)
        at -= int(lengths[best[at]])
    return ends[::-1]


def rare_cuts(common: np.ndarray, size: int, budget: int) -> list[int]:
    """Cuts of an item of ``size`` words into ``budget + 1`` pieces that stand in few items.

    ``common``: how often each run of PIECE_WORDS words stands in all items; a
    piece stands in no more items than the rarest run within it. Long items
    are cut in blocks of BLOCK_PIECES pieces, so the work is linear in their
    length.
    """
    cuts = equal_cuts(size, budget)
    if not budget:
        return cuts
    out = [0]
    for first in range(0, budget + 1, BLOCK_PIECES):
        last = min(first + BLOCK_PIECES, budget + 1)
        lo, hi = cuts[first], cuts[last]
        out += [lo + e for e in _least_shared(common[lo : hi - PIECE_WORDS + 1], hi - lo, last - first)]
    return out


def word_runs(words: list[str]) -> list[str]:
    """The runs of PIECE_WORDS words, one for each place that has one."""
    return [" ".join(words[i : i + PIECE_WORDS]) for i in range(len(words) - PIECE_WORDS + 1)]


def word_masks(words: list[str]) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, word in enumerate(words):
        masks[word] |= 1 << i
    return dict(masks)


def best_end(masks: dict[str, int], size: int, text: list[str], anchored: bool = False) -> tuple[int, int]:
    """Least edits between the item and any stretch of ``text`` that ends at a word, and that end (exclusive).

    ``anchored``: the stretch must begin with the text. One step per word; the
    item's columns are the bits of one integer.
    """
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    least, end = size, 0
    for j, word in enumerate(text, 1):
        equal = masks.get(word, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (~(horizontal | plus) & full)
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = ((up << 1) | (1 if anchored else 0)) & full
        down = (down << 1) & full
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
        if score < least:
            least, end = score, j
    return least, end


@dataclass
class ItemSet:
    """A bounded block of items, ready to search for."""

    automaton: ahocorasick.Automaton
    items: list[tuple[int | None, list[str], int]]

    @classmethod
    def build(cls, rows: list[tuple[int | None, str | None]], rate: float, min_words: int) -> ItemSet:
        items = []
        for item_id, text in rows:
            words = split_words(text)
            if len(words) >= min_words and words:
                items.append((item_id, words, error_budget(len(words), rate)))
        cut = [pieces(words, budget) for _, words, budget in items]
        held = Counter(" ".join(piece) for own in cut for _, piece in own)
        shared = [i for i, own in enumerate(cut) if items[i][2] and any(held[" ".join(piece)] > SHARED for _, piece in own)]
        if shared:
            runs = Counter(run for _, words, _ in items for run in word_runs(words))
            for i in shared:
                _, words, budget = items[i]
                cut[i] = at_cuts(words, rare_cuts(np.array([runs[r] for r in word_runs(words)], dtype=float), len(words), budget))
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, own in enumerate(cut):
            for at, piece in own:
                where[f" {' '.join(piece)} "].append((i, at + len(piece) - 1))
        automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            automaton.add_word(piece, places)
        if where:
            automaton.make_automaton()
        return cls(automaton, items)

    def search(self, text: str | None) -> list[tuple[int | None, int, int, int, int, int]]:
        """Every item within its budget somewhere in ``text``: id, distance, budget, words, first and last word."""
        if not text or not self.items:
            return []
        words = split_words(text)
        line = f" {' '.join(words)} "
        found = list(self.automaton.iter(line))
        if not found:
            return []
        starts, at = [], 1
        for word in words:
            starts.append(at)
            at += len(word) + 1
        diagonals: dict[int, set[int]] = defaultdict(set)
        for end, places in found:
            last = bisect_right(starts, end - 1) - 1
            for item, at_word in places:
                diagonals[item].add(last - at_word)
        return [hit for item, shifts in sorted(diagonals.items()) if (hit := verify(*self.items[item], words, sorted(shifts)))]


def _windows(shifts: list[int], size: int, budget: int, length: int) -> Iterator[tuple[int, int]]:
    """Merged stretches of the text around the hits' diagonals."""
    lo = hi = None
    for shift in shifts:
        a, b = max(0, shift - budget), min(length, shift + size + budget)
        if hi is not None and a <= hi:
            hi = max(hi, b)
            continue
        if hi is not None:
            yield lo, hi
        lo, hi = a, b
    if hi is not None:
        yield lo, hi


def verify(item_id: int | None, pattern: list[str], budget: int, words: list[str], shifts: list[int]) -> tuple[int | None, int, int, int, int, int] | None:
    """The first of an item's nearest places around the diagonals ``shifts``, if within the budget: id, distance, budget, words, first and last word."""
    masks, best = word_masks(pattern), None
    for lo, hi in _windows(shifts, len(pattern), budget, len(words)):
        distance, end = best_end(masks, len(pattern), words[lo:hi])
        if distance <= budget and (best is None or distance < best[0]):
            best = (distance, lo, lo + end)
    if best is None:
        return None
    distance, lo, end = best
    _, length = best_end(word_masks(pattern[::-1]), len(pattern), words[lo:end][::-1], anchored=True)
    return item_id, distance, budget, len(pattern), end - length, end - 1


def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of ``length`` words, from the words' hashes."""
    n = max(0, len(hashes) - length + 1)
    out = np.full(n, length, dtype=np.uint64)
    for k in range(length):
        out = (out ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


_PIECES = "array<struct<hash:long,length:int,at:int>>"


def _piece_rows(words: list[str], cuts: list[int]) -> list[dict[str, int]]:
    hashes = np.array([_word_hash(w) for w in words], dtype=np.uint64)
    return [{"hash": int(run_hashes(hashes[lo:hi], hi - lo)[0]), "length": hi - lo, "at": lo} for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _piece_type() -> pa.DataType:
    return pa.list_(pa.struct([("hash", pa.int64()), ("length", pa.int32()), ("at", pa.int32())]))


def _cut_items(rate: float, min_words: int):
    """Items as rows: item_id, words, budget, and the pieces with hash, length and place."""

    def cut(batches):
        for batch in batches:
            ids, lines, budgets, cuts = [], [], [], []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = split_words(text)
                if len(words) < min_words or not words:
                    continue
                budget = error_budget(len(words), rate)
                ids.append(item_id)
                lines.append(" ".join(words))
                budgets.append(budget)
                cuts.append(_piece_rows(words, equal_cuts(len(words), budget)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.string()), pa.array(budgets, pa.int32()), pa.array(cuts, _piece_type())], names=["item_id", "line", "budget", "pieces"])

    return cut


def _item_runs(batches):
    """item, at and hash of every run of PIECE_WORDS words of items (item, line)."""
    for batch in batches:
        for item, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            runs = run_hashes(np.array([_word_hash(w) for w in line.split(" ")], dtype=np.uint64), PIECE_WORDS)
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(runs), pa.int64()), pa.array(np.arange(len(runs), dtype=np.int32)), pa.array(runs)], names=["item", "at", "run"])


def _recut(batches):
    """Items (item, item_id, line, budget, how common each run is) with pieces that stand in few items."""
    for batch in batches:
        item, ids, lines, budgets, common = (c.to_pylist() for c in batch.columns)
        cuts = []
        for line, budget, n in zip(lines, budgets, common, strict=True):
            words = line.split(" ")
            cuts.append(_piece_rows(words, rare_cuts(np.array(n, dtype=float), len(words), budget)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(cuts, _piece_type())], names=["item", "item_id", "line", "budget", "pieces"])


def _cut_where_rare(cut: DataFrame, scratch: Scratch) -> DataFrame:
    """``cut`` (a written table), the items that share a piece with more than SHARED items cut anew."""
    held = cut.filter("budget > 0").select("item", F.inline("pieces"))
    shared = held.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") > SHARED)
    again = scratch.table(held.join(shared, "hash", "left_semi").select("item").distinct(), "shared")
    if not again.limit(1).count():
        return cut
    runs = scratch.table(cut.select("item", "line").mapInArrow(_item_runs, "item long, at int, run long"), "runs")
    often = runs.groupBy("run").agg(F.count("*").alias("n"))
    known = runs.join(again, "item", "left_semi").join(often, "run").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("runs"))
    anew = cut.join(known, "item").select("item", "item_id", "line", "budget", F.col("runs.n").alias("common")).mapInArrow(_recut, f"item long, item_id long, line string, budget int, pieces {_PIECES}")
    columns = ["item", "item_id", "line", "budget", "pieces"]
    return scratch.table(cut.join(again, "item", "left_anti").select(*columns).unionByName(anew), "recut")


def _mark_texts(table: np.ndarray, lengths: list[int]):
    """The texts with a hit in the bit table: their columns but the text, their words in a line, and hash and place of each hit."""
    hit = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())]))
    bits = np.uint64(len(table) * 64 - 1)

    def mark(batches):
        known: dict[str, int] = {}
        for batch in batches:
            rows, lines, found = [], [], []
            for row, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                words = split_words(text)
                if len(known) > KEPT_WORDS:
                    known.clear()
                for w in set(words) - known.keys():
                    known[w] = _word_hash(w)
                hashes = np.array([known[w] for w in words], dtype=np.uint64)
                own = []
                for length in lengths:
                    runs = run_hashes(hashes, length)
                    spot = runs.view(np.uint64) & bits
                    at = np.flatnonzero(table[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1))
                    own += [{"hash": h, "at": a} for h, a in zip(runs[at].tolist(), at.tolist(), strict=True)]
                if own:
                    rows.append(row)
                    lines.append(" ".join(words))
                    found.append(own)
            kept = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lines, pa.string()), pa.array(found, hit)], names=[*batch.schema.names[:-1], "line", "hits"])

    return mark


def _verify_pairs(batches):
    for batch in batches:
        keys, lines, items, patterns, budgets, shifts = (c.to_pylist() for c in batch.columns)
        out = [(k, *hit) for k, t, i, p, b, s in zip(keys, lines, items, patterns, budgets, shifts, strict=True) if (hit := verify(i, p.split(" "), b, t.split(" "), sorted(s)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*out, strict=True)) or [()] * 7)], names=["key", *HIT_NAMES])


def _joined_leaks(texts: DataFrame, items: DataFrame, rate: float, min_words: int) -> DataFrame:
    """``key`` and the columns of HITS for texts (key, text), by joins on the pieces' hashes."""
    spark = texts.sparkSession
    scratch = Scratch(spark, "decontaminate")
    cut = items.mapInArrow(_cut_items(rate, min_words), f"item_id long, line string, budget int, pieces {_PIECES}")
    cut = _cut_where_rare(scratch.table(cut.withColumn("item", F.monotonically_increasing_id()), "items"), scratch)
    parts = cut.select("item", F.inline("pieces"))
    lengths = sorted(r[0] for r in parts.select("length").distinct().collect())
    # Lengths of pieces are few (they follow from the error rate, LONG_PIECE where stock phrases stand); the bit table has a bounded size.
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * parts.count()).bit_length()))
    words = parts.selectExpr(f"shiftright(hash & {bits - 1}L, 6) AS word", "shiftleft(1L, CAST(hash & 63 AS int)) AS bit")
    table = np.zeros(bits // 64, dtype=np.uint64)
    filled = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table[filled["word"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64).view(np.uint64)
    marked = texts.select("key", "text").mapInArrow(_mark_texts(table, lengths), "key long, line string, hits array<struct<hash:long,at:int>>")
    # Numbered and written once: the numbers tell equal rows apart.
    marked = scratch.table(marked.withColumn("row", F.monotonically_increasing_id()), "marked")
    hits = marked.select("row", F.inline("hits")).withColumnRenamed("at", "text_at")
    pairs = hits.join(parts.select("item", "hash", "at"), "hash").groupBy("row", "item").agg(F.collect_set(F.col("text_at") - F.col("at")).alias("shifts"))
    both = pairs.join(cut.select("item", "item_id", F.col("line").alias("pattern"), "budget"), "item").join(marked.select("row", "key", "line"), "row")
    return both.select("key", "line", "item_id", "pattern", "budget", "shifts").mapInArrow(_verify_pairs, f"key long, {HITS}")


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """item_id and text of the items that have a text, and their characters."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text <> ''")
    return items, items.agg(F.sum(F.length("text"))).first()[0] or 0


def unsearched_items(benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """item_id and words of the items that are too short to be searched for, those without a text too (0 words): what a scan says nothing about."""
    bound_arrow_batches(benchmark.sparkSession)

    def count(batches):
        for batch in batches:
            size = [len(split_words(t)) for t in batch.column(1).to_pylist()]
            short = pa.array([n < max(1, min_words) for n in size], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(short), pa.array(size, pa.int64()).filter(short)], names=["item_id", "words"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "item_id long, words long")


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, min_words: int = MIN_WORDS, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """A row for each document and item found in it: doc_id and the columns of HITS. One scan; texts without a hit are never shuffled."""
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    items, size = _items(benchmark)
    if size > broadcast_chars:
        return _joined_leaks(texts, items, rate, min_words).withColumnRenamed("key", "doc_id")
    known = spark.sparkContext.broadcast(ItemSet.build([(r[0], r[1]) for r in items.collect()], rate, min_words))

    def search(batches):
        items = known.value
        for batch in batches:
            hits = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in items.search(t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*hits, strict=True)) or [()] * 7)], names=["doc_id", *HIT_NAMES])

    return texts.mapInArrow(search, f"doc_id long, {HITS}")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, min_words: int = MIN_WORDS, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """The documents in which no item is found, with all their columns. No shuffle of texts."""
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    items, size = _items(benchmark)
    at = docs.columns.index("text")
    if size > broadcast_chars:
        # Whether a document goes is a matter of its text alone, so equal texts share a key.
        key = F.xxhash64(docs["text"].cast("string"))
        leaks = _joined_leaks(docs.select(key.alias("key"), docs["text"].cast("string").alias("text")), items, rate, min_words).select(F.col("key").alias("__leak")).distinct()
        leaks = Scratch(spark, "decontaminate").table(leaks, "leaks")
        return docs.join(leaks, key == leaks["__leak"], "left_anti")
    known = spark.sparkContext.broadcast(ItemSet.build([(r[0], r[1]) for r in items.collect()], rate, min_words))

    def keep(batches):
        items = known.value
        for batch in batches:
            yield batch.filter(pa.array([not items.search(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
