"""Texts rewritten step by step, with a table that leads places in the result back to the source.

A step is a list of edits: where a stretch begins and ends, and how long what
stands for it is. ``Places`` keeps, for the text as it is after some steps,
its pieces in order: where each begins, the stretch of the source that it
stands for, and whether it stands for it character by character. A further
step cuts the table at its edits and shifts what is behind them; a place is
found by binary search. Nothing is kept for each character.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np

#: Where an edit begins and ends, and the length of what replaces the stretch.
Edit = tuple[int, int, int]


class Places:
    """Pieces of a rewritten text by their beginning in it (``at``), with the stretches of the source (``begin``, ``end``) that they stand for."""

    def __init__(self, size: int) -> None:
        self.size = self.source = size
        self.at, self.begin, self.end = np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, size, np.int64)
        self.same = np.ones(1, dtype=bool)

    def _from(self, at: np.ndarray) -> np.ndarray:
        """Where the source of the characters at ``at`` begins; at the text's end, the source's end."""
        p = np.searchsorted(self.at, at, side="right") - 1
        return np.where(at >= self.size, self.source, self.begin[p] + np.where(self.same[p], at - self.at[p], 0))

    def _upto(self, at: np.ndarray) -> np.ndarray:
        """Where the source of the characters before ``at`` ends."""
        p = np.maximum(np.searchsorted(self.at, at, side="left") - 1, 0)
        return np.where(self.same[p], self.begin[p] + at - self.at[p], self.end[p])

    def span(self, start, end) -> tuple[np.ndarray, np.ndarray]:
        """The stretches of the source that stretches of the text stand for; an empty stretch has an empty source."""
        start, end = np.asarray(start, np.int64), np.asarray(end, np.int64)
        first = self._from(start)
        return first, np.where(end > start, self._upto(end), first)

    def then(self, edits: Sequence[Edit]) -> Places:
        """The table after one more step; ``edits`` are in order and apart."""
        if not len(edits):
            return self
        start, stop, fresh = np.asarray(edits, np.int64).T
        growth = np.cumsum(fresh - (stop - start))
        cut = np.unique(np.concatenate((self.at, start, stop)))
        cut = cut[cut < self.size]
        after = np.append(cut[1:], self.size)
        within = np.searchsorted(start, cut, side="right") - 1
        # An insertion has no stretch of its own: only edits that reach beyond the cut hold it.
        kept = (within < 0) | (cut >= stop[np.maximum(within, 0)])
        cut, after = cut[kept], after[kept]
        piece = np.searchsorted(self.at, cut, side="right") - 1
        same = self.same[piece]
        ended = np.searchsorted(stop, cut, side="right")
        moved = cut + np.where(ended > 0, growth[np.maximum(ended - 1, 0)], 0)
        first, last = self.span(start, stop)
        new = fresh > 0
        at = np.concatenate((moved, (start + growth - (fresh - (stop - start)))[new]))
        begin = np.concatenate((np.where(same, self.begin[piece] + cut - self.at[piece], self.begin[piece]), first[new]))
        end = np.concatenate((np.where(same, self.begin[piece] + after - self.at[piece], self.end[piece]), last[new]))
        order = np.argsort(at, kind="stable")
        out = Places(self.source)
        out.size = self.size + int(growth[-1])
        out.at, out.begin, out.end = at[order], begin[order], end[order]
        out.same = np.concatenate((same, np.zeros(int(new.sum()), dtype=bool)))[order]
        if not len(out.at):
            out.at, out.begin, out.end, out.same = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, dtype=bool)
        return out


def matches_at(pattern: re.Pattern, text: str, places: Iterable[int]) -> Iterator[re.Match]:
    """What ``finditer`` finds, for a pattern that can begin at some places only, given in order."""
    end = 0
    for p in places:
        if p >= end and (m := pattern.match(text, p)):
            yield m
            end = m.end()


@dataclass(frozen=True)
class Step:
    """What a pattern finds is replaced by a template, or by what a function makes of the match.

    ``needs`` says quickly what of a text may concern the step: without any,
    or without any of ``wants``, there is nothing to do. ``at`` gives, in
    order, the only places where the pattern can begin.
    """

    pattern: re.Pattern
    by: str | Callable[[re.Match], str]
    needs: Callable[[str], Collection] | None = None
    wants: frozenset[str] = frozenset()
    at: Callable[[str], Iterable[int]] | None = None

    def concerns(self, text: str, known: dict[Callable, Collection]) -> bool:
        """``known`` keeps what ``needs`` said of the text, for other steps that ask the same."""
        if self.needs is None:
            return True
        if self.needs not in known:
            known[self.needs] = self.needs(text)
        there = known[self.needs]
        return not self.wants.isdisjoint(there) if self.wants else bool(there)

    def run(self, text: str) -> tuple[str, list[Edit]]:
        made = self.by if callable(self.by) else (lambda m: m.expand(self.by)) if "\\" in self.by else (lambda _: self.by)
        edits, parts, at = [], [], 0
        for m in self.pattern.finditer(text) if self.at is None else matches_at(self.pattern, text, self.at(text)):
            new = made(m)
            if new != m[0]:
                edits.append((m.start(), m.end(), len(new)))
                parts += (text[at : m.start()], new)
                at = m.end()
        return ("".join(parts) + text[at:], edits) if edits else (text, edits)


class Lower:
    """Lower case; letters whose lower case is longer are edits."""

    def concerns(self, text: str, known: dict[Callable, Collection]) -> bool:
        return True

    def run(self, text: str) -> tuple[str, list[Edit]]:
        low = text.lower()
        if len(low) == len(text):
            return low, []
        return low, [(k, k + 1, len(c.lower())) for k, c in enumerate(text) if len(c.lower()) != 1]


def rewrite(text: str, steps: Iterable[Step | Lower]) -> tuple[str, list[list[Edit]]]:
    """The text after all steps, and their edits: ``traced`` makes the table of them where places are wanted."""
    log, known = [], {}
    for step in steps:
        if not step.concerns(text, known):
            continue
        before = text
        text, edits = step.run(text)
        if edits:
            log.append(edits)
        if text != before:
            known = {}
    return text, log


def traced(size: int, log: Iterable[Sequence[Edit]]) -> Places:
    out = Places(size)
    for edits in log:
        out = out.then(edits)
    return out
