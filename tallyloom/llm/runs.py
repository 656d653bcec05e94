"""Periodic runs of words by the runs theorem.

A run is a maximal stretch of words in which words a period apart are equal,
at least ``EXPONENT`` (three or more) periods and ``LEAST`` words long. Every run holds a
Lyndon root that is the longest Lyndon word from its place on under one of
two orders of the words, one the reverse of the other; such a word ends
before the next smaller suffix, which is the next smaller value of the
inverse suffix array. So there are at most two candidates for each word. A
candidate's period is its length; it is extended to both sides by the longest
common extensions of its beginning and its end, each a range minimum over
the LCP array, forwards and of the reversed words, by sparse tables.

A batch's documents are worked on together: suffixes compare by document
first, later documents being smaller, so that none of them reaches into
another and each document's last Lyndon words end with it. Candidates whose
root isn't followed by its own first words are put aside before (a run of
three periods holds its root followed by a whole copy, too), and LCP arrays are built for
documents that have candidates left. Words are compared, and ordered, by
64-bit hashes of their bytes.

Defined cases: null texts and texts without words have no runs; a null doc_id
counts as an empty text where planted periods are derived from it; whole
texts are taken, some 300 bytes of memory a word of the longest; equal rows
have equal results; runs are listed by start and period, and of several
longest the first by start, then period, is named; extra columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.bytetext import EXACT, SPACED, utf8_buffers, words
from tallyloom.session import bound_arrow_batches

#: Words and periods that a run spans at least.
LEAST, EXPONENT = 6, 4
#: Words of candidates' roots that are looked at before LCP arrays are built.
LOOK = 4

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


class Suffixes:
    """Ranks of all suffixes of the concatenated documents; ``levels[k]`` ranks their first 2**k words, equal where these are."""

    def __init__(self, letters: np.ndarray, ends: np.ndarray, keep: bool = False) -> None:
        n = len(letters)
        self.ends = ends
        order = np.argsort(letters, kind="stable")
        new = np.concatenate(([True], letters[order][1:] != letters[order][:-1]))
        at = np.arange(n)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, at, 0))
        alone = new & np.concatenate((new[1:], [True]))
        active = order[~alone]
        self.levels, width = [rank.astype(np.int32)] if keep else [], 1
        while len(active):
            onward = active + width
            inside = onward < ends[active]
            key = rank[active] * (n + 1) + np.where(inside, rank[np.minimum(onward, n - 1)] + 1, 0)
            by = np.argsort(key, kind="stable")
            active, key = active[by], key[by]
            old = rank[active]
            at = np.arange(len(active))
            new = np.concatenate(([True], key[1:] != key[:-1]))
            group = np.maximum.accumulate(np.where(np.concatenate(([True], old[1:] != old[:-1])), at, 0))
            rank[active] = old + np.maximum.accumulate(np.where(new, at, 0)) - group
            alone = new & np.concatenate((new[1:], [True]))
            active = active[~alone]
            width *= 2
            if keep:
                self.levels.append(rank.astype(np.int32))
        self.rank = rank

    def lcp(self) -> np.ndarray:
        """At each rank the common words with the suffix ranked before it."""
        n = len(self.rank)
        order = np.empty(n, dtype=np.int64)
        order[self.rank] = np.arange(n)
        a, b = order[1:].copy(), order[:-1].copy()
        common = np.zeros(n, dtype=np.int32)
        for k in range(len(self.levels) - 1, -1, -1):
            level, fits = self.levels[k], (a < n) & (b < n)
            same = fits & (level[np.minimum(a, n - 1)] == level[np.minimum(b, n - 1)])
            common[1:] += np.where(same, 1 << k, 0).astype(np.int32)
            a += np.where(same, 1 << k, 0)
            b += np.where(same, 1 << k, 0)
        return common


class Extensions:
    """Longest common extensions of any two suffixes: minima over ranges of the LCP array, by a sparse table."""

    def __init__(self, letters: np.ndarray, ends: np.ndarray) -> None:
        suffixes = Suffixes(letters, ends, keep=True)
        self.rank, self.table, width = suffixes.rank, [suffixes.lcp()], 1
        while 2 * width <= len(letters):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def at(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For different places ``i`` and ``j``, element by element."""
        low, high = np.minimum(self.rank[i], self.rank[j]) + 1, np.maximum(self.rank[i], self.rank[j]) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(i), dtype=np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << int(k))])
        return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one that holds a smaller value; the length where there is none."""
    out, waiting, v = [len(values)] * len(values), [], values.tolist()
    for i, x in enumerate(v):
        while waiting and v[waiting[-1]] > x:
            out[waiting.pop()] = i
        waiting.append(i)
    return np.array(out, dtype=np.int64)


def _letters(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Words as numbers that compare by document first, the last one smallest, then by ``ids``."""
    doc = np.repeat(np.arange(len(lengths))[::-1], lengths)
    return doc * (int(ids.max(initial=0)) + 1) + ids


def find_runs(hashes: np.ndarray, lengths: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, Runs]:
    """Document, and (start within it, length, period), of every run; ``lengths`` are the documents' words. By document, start and period."""
    if exponent < 3:
        raise ValueError("runs of fewer than three periods needn't hold a root and a whole copy after it")
    lengths = np.asarray(lengths, dtype=np.int64)
    ids = np.unique(hashes, return_inverse=True)[1].astype(np.int64).reshape(-1)
    begins = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    doc = np.repeat(np.arange(len(lengths)), lengths)
    ends = (begins + lengths)[doc]
    none = np.zeros(0, dtype=np.int64)
    if not len(ids):
        return none, (none, none, none)
    found = []
    for order in (ids, ids.max() - ids):
        stop = next_smaller(Suffixes(_letters(order, lengths), ends).rank)
        i = np.flatnonzero((stop < ends) & (np.maximum(least, exponent * (stop - np.arange(len(ids)))) <= lengths[doc]))
        j = stop[i]
        for k in range(LOOK):
            # The root's next copy begins at j: where the root is that long, its words agree, and lie within the document.
            at = np.minimum(j + k, len(ids) - 1)
            kept = (k >= j - i) | ((j + k < ends[i]) & (ids[np.minimum(i + k, len(ids) - 1)] == ids[at]))
            i, j = i[kept], j[kept]
        found.append(np.stack([i, j]))
    i, j = np.concatenate(found, axis=1)
    if not len(i):
        return none, (none, none, none)
    # Only documents with candidates need extensions.
    some = np.zeros(len(lengths), dtype=bool)
    some[doc[i]] = True
    here = some[doc]
    place = np.cumsum(here) - 1
    i, j, kept = place[i], place[j], lengths[some]
    ids, n = ids[here], int(here.sum())
    begins_kept = np.concatenate(([0], np.cumsum(kept)))[:-1]
    which = np.repeat(np.flatnonzero(some), kept)
    ends_kept = np.repeat(begins_kept + kept, kept)
    onward = Extensions(_letters(ids, kept), ends_kept).at(i, j)
    # Backwards: the reversed concatenation, whose documents are reversed in order, too.
    back = kept[::-1]
    ends_back = np.repeat(np.cumsum(back), back)
    reverse = Extensions(_letters(ids[::-1], back), ends_back)
    first = np.repeat(begins_kept, kept)
    backward, inner = np.zeros(len(i), dtype=np.int64), np.flatnonzero(i > first[i])
    backward[inner] = reverse.at(n - i[inner], n - j[inner])
    start, period = i - backward, j - i
    length = j + onward - start
    fits = length >= np.maximum(least, exponent * period)
    rows = np.unique(np.stack([which[i[fits]], (start - first[i])[fits], period[fits], length[fits]]), axis=1)
    return rows[0], (rows[1], rows[3], rows[2])


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a document whose period is planted by its id; null for the others."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at >= a, a + (at - a) % p, at)


def repeated(n: int, runs: Runs) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs[0] + runs[2], 1)
    np.add.at(edge, runs[0] + runs[1], -1)
    return np.cumsum(edge)[:n] > 0


FOUND = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: Bytes of text worked on at once (a longer text is taken whole).
SLICE = 1 << 20


def _search(plant: bool):
    def search(batches):
        for batch in batches:
            data, offsets = utf8_buffers(batch.column(1))
            ids, lo = batch.column(0).to_pylist(), 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, side="right")) - 1)
                yield _rows(ids[lo:hi], data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], plant)
                lo = hi

    return search


def _rows(ids: list[int | None], data: np.ndarray, offsets: np.ndarray, plant: bool) -> pa.RecordBatch:
    hashes, row, _, _ = words(data, offsets, SPACED, EXACT)
    lengths = np.bincount(row, minlength=len(ids))
    begins = np.concatenate(([0], np.cumsum(lengths)))
    sources = {}
    for d, doc_id in enumerate(ids):
        source = planted(doc_id, int(lengths[d])) if plant else None
        if source is not None:
            sources[d] = source
            hashes[begins[d] : begins[d + 1]] = hashes[begins[d] : begins[d + 1]][source]
    of, (start, length, period) = find_runs(hashes, lengths)
    cuts = np.searchsorted(of, np.arange(len(ids) + 1))
    raw, out = data.tobytes(), []
    for d, doc_id in enumerate(ids):
        own = slice(cuts[d], cuts[d + 1])
        runs = start[own], length[own], period[own]
        kept = raw[offsets[d] : offsets[d + 1]].split()
        if d in sources:
            kept = [kept[k] for k in sources[d].tolist()]
        if not len(runs[0]):
            out.append((doc_id, 0, None, None, None, None, [], b" ".join(kept).decode("utf-8", "replace")))
            continue
        kept = compress(kept, (~repeated(len(kept), runs)).tolist())
        listed = [{"start": s, "length": n, "period": q} for s, n, q in zip(*(x.tolist() for x in runs), strict=True)]
        best = min(listed, key=lambda r: (-r["length"], r["start"], r["period"]))
        out.append((doc_id, len(listed), *best.values(), 1000 * best["length"] // best["period"], listed, b" ".join(kept).decode("utf-8", "replace")))
    kinds = [*[pa.int64()] * 6, _RUN, pa.string()]
    names = [c.split()[0] for c in FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id, n_runs, the longest run, all runs and the text with repeats collapsed to one period. No shuffle.

    With ``plant``, documents chosen by their id are made periodic first (see ``planted``).
    """
    bound_arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_search(plant), FOUND)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    )
