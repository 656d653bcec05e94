"""Texts cut after a number of byte-pair tokens, by a table of ranks that the caller brings.

A text is cut into pieces by a pattern, as the table's makers did, and each
piece's bytes are merged: of all neighbours that stand together in the table
those of lowest rank first, the leftmost of several. Candidates wait in a
heap, pieces are linked to their neighbours, so a piece of n bytes costs n
log n. Pieces behind the last token that is wanted aren't looked at.
"""

import heapq
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries that a table of ranks has at most: it is sent to every executor.
MOST_RANKS = 1_000_000
#: Short pieces whose tokens a task keeps.
KEPT = 1 << 17
#: Words with the blank before them, numbers, marks and white space.
WORDS = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def merged(piece: bytes, ranks: Mapping[bytes, int]) -> list[bytes]:
    """The tokens of one piece."""
    if piece in ranks or len(piece) < 2:
        return [piece]
    n = len(piece)
    # Where the token that begins at a byte ends, and where the one before it begins; 0 ends mark bytes that begin none any more.
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, stop = heapq.heappop(heap)
        middle = end[k]
        # Stale unless both sides are still as they were when the pair was put in.
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[k], end[middle] = stop, 0
        if stop < n:
            before[stop] = k
            if (r := ranks.get(piece[k : end[stop]])) is not None:
                heapq.heappush(heap, (r, k, end[stop]))
        if (b := before[k]) >= 0 and (r := ranks.get(piece[b:stop])) is not None:
            heapq.heappush(heap, (r, b, stop))
    return [piece[k : end[k]] for k in range(n) if end[k]]


def kept_merges(ranks: Mapping[bytes, int]) -> Callable[[str], list[bytes]]:
    """The tokens of a piece; those of short pieces, which are mostly words that recur, are kept, up to ``KEPT`` of them."""
    short = lru_cache(KEPT)(lambda piece: merged(piece.encode(), ranks))
    return lambda piece: short(piece) if len(piece) <= 64 else merged(piece.encode(), ranks)


def pieces_of(text: str, pattern: regex.Pattern) -> Iterator[str]:
    """What the pattern finds, and what it leaves between."""
    at = 0
    for m in pattern.finditer(text):
        if m.start() > at:
            yield text[at : m.start()]
        yield m[0]
        at = m.end()
    if at < len(text):
        yield text[at:]


def token_count(text: str, merge: Callable[[str], list[bytes]], pattern: regex.Pattern) -> int:
    """How many tokens a text has. Where the pattern leaves nothing between its finds, these are listed at once."""
    found = pattern.findall(text) if not pattern.groups else []
    return sum(map(len, map(merge, found if found and sum(map(len, found)) == len(text) else pieces_of(text, pattern))))


def tokens(text: str, merge: Callable[[str], list[bytes]], pattern: regex.Pattern) -> Iterator[bytes]:
    for piece in pieces_of(text, pattern):
        yield from merge(piece)


def cut(text: str, most: int, merge: Callable[[str], list[bytes]], pattern: regex.Pattern) -> str:
    """The text, or what its first ``most`` tokens say: bytes of a character that is cut in two show as replacement characters."""
    held = []
    for token in tokens(text, merge, pattern):
        if len(held) == most:
            return b"".join(held).decode("utf-8", "replace")
        held.append(token)
    return text


def rank_table(table: DataFrame, token: str = "token", rank: str = "rank") -> dict[bytes, int]:
    """A table of ranks (bytes and a number each) on the driver; an error if it is no such small table, or lacks single bytes."""
    rows = table.select(F.col(token).cast("binary"), F.col(rank).cast("int")).limit(MOST_RANKS + 1).collect()
    if len(rows) > MOST_RANKS:
        raise ValueError(f"over {MOST_RANKS} ranks")
    return {bytes(t): r for t, r in rows}


def truncate_tokens(text: Column, most: int, ranks: Mapping[bytes, int], pattern: str = WORDS) -> Column:
    """The text cut after ``most`` tokens; null stays null."""

    @F.pandas_udf(T.StringType())
    def shorten(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces, merge = regex.compile(pattern), kept_merges(ranks)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else cut(t, most, merge, pieces))

    return shorten(text)


def token_counts(text: Column, ranks: Mapping[bytes, int], pattern: str = WORDS) -> Column:
    """How many tokens a text has; null has none."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces, merge = regex.compile(pattern), kept_merges(ranks)
        for texts in batches:
            yield texts.map(lambda t: 0 if t is None else token_count(t, merge, pieces)).astype("int64")

    return count(text)
