"""Quantified claims in text: a cue of a dimension near a quantity of a fitting kind.

A small Arrow helper normalises each text and finds *marks*, the places of
cues, quantities and hypothetical wording, in tokens and characters, and
where in the raw text they come from. What belongs together is then decided
on the marks: ordered by token once forwards and once backwards, each mark
sees the nearest of every other sort on either side; the rest are conditions
on these and one join of claims with their quantities.

Several configurations are answered together: texts are read, normalised and
matched once, a mark carries the set of configurations that it counts for.

Each row of texts has a number of its own, so equal rows, repeated keys and
null keys have the claims of their own text, each.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cache, cached_property, lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import claim_tables as ct
from tallyloom.functions.offsets import Lower, Places, Step, matches_at, rewrite, traced
from tallyloom.session import Scratch, bound_arrow_batches, spread


@dataclass(frozen=True)
class Configuration:
    """What counts as a claim: cues and kinds by dimension, which dimensions hide or silence others, and constructions that suffice by themselves.

    ``with_dimensions`` adds dimensions of one's own to the built-in ones.
    """

    cues: dict[str, str] = field(default_factory=lambda: dict(ct.CUES))
    kinds: dict[str, list[str]] = field(default_factory=lambda: dict(ct.KINDS))
    hidden_from: dict[str, list[str]] = field(default_factory=lambda: dict(ct.HIDDEN_FROM))
    silenced_by: dict[str, list[str]] = field(default_factory=lambda: dict(ct.SILENCED_BY))
    self_sufficient: tuple = tuple(ct.SELF_SUFFICIENT)

    def with_dimensions(self, cues: dict[str, str], kinds: dict[str, list[str]], self_sufficient: Sequence[tuple] = ()) -> Configuration:
        if set(cues) != set(kinds):
            raise ValueError("every new dimension needs a cue and kinds")
        return replace(self, cues=self.cues | cues, kinds=self.kinds | kinds, self_sufficient=(*self.self_sufficient, *self_sufficient))


DEFAULT = Configuration()


# Normalised text ---------------------------------------------------------------------------------


#: The first letter of what stands behind a number.
_SPELT = re.compile(r"\s*([^\W\d_])")
_JAPANESE_OR_CHINESE = re.compile("[　-ヿ㐀-鿿＀-￯]")
_SPACE, _DIGIT = 1, 2
#: Bytes of UTF-8: hexadecimal digits as 1, all others as 0.
_HEX = bytes(b in b"0123456789abcdef" for b in range(256))
#: Bytes of UTF-8: white space of one byte as 0, all others as 1.
_SOLID = bytes(not chr(b).isspace() or b > 127 for b in range(256))


@cache
def _kinds() -> tuple[np.ndarray, bytes]:
    """What each character is, as bits: white space, a digit; and the same of bytes."""
    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(len(every), np.uint8)
    for pattern, bit in ((r"\s", _SPACE), (r"\d", _DIGIT)):
        for m in re.finditer(f"{pattern}+", every):
            out[m.start() : m.end()] |= bit
    return out, out[:256].tobytes()


class Landmarks:
    """Where a text's tokens begin and its digits stand: each character is looked up once, when it is first asked for, the rest are comparisons of whole arrays."""

    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def narrow(self) -> bytes | None:
        """The text with a byte a character, if all have one."""
        try:
            return self.text.encode("latin-1")
        except UnicodeEncodeError:
            return None

    @cached_property
    def kinds(self) -> np.ndarray:
        every, narrow = _kinds()
        if self.narrow is not None:
            return np.frombuffer(self.narrow.translate(narrow), np.uint8)
        return every[np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    @cached_property
    def starts(self) -> list[int]:
        # Digits aren't white space: what is left is 1 for blanks and 0 for others, and a token begins where it falls.
        blank = self.kinds & _SPACE
        out = (np.flatnonzero(blank[:-1] > blank[1:]) + 1).tolist()
        return [0, *out] if len(blank) and not blank[0] else out

    def has_token(self, size: int) -> bool:
        # White space of several bytes counts as solid here, so what has no such run has no such token.
        if len(self.text) < size or b"\1" * size not in self.text.encode("utf-8", "surrogatepass").translate(_SOLID):
            return False
        blanks = np.flatnonzero(self.kinds & _SPACE)
        if not len(blanks):
            return True
        return bool(max(blanks[0], len(self.text) - 1 - blanks[-1]) >= size or (blanks[1:] - blanks[:-1] > size).any())

    def has_hex(self, size: int) -> bool:
        """Whether so many hexadecimal digits stand in a row."""
        return b"\1" * size in self.text.encode("utf-8", "surrogatepass").translate(_HEX)

    @cached_property
    def digits(self) -> list[tuple[int, int]]:
        """Where runs of digits begin and end."""
        out, begin, end = [], -1, -1
        for k in np.flatnonzero(self.kinds & _DIGIT).tolist():
            if k != end:
                if end > 0:
                    out.append((begin, end))
                begin = k
            end = k + 1
        return [*out, (begin, end)] if end > 0 else out

    def behind_digits(self, sign: str) -> bool:
        """Whether a run of digits ends at a sign."""
        return any(self.text.startswith(sign, end) for _, end in self.digits)

    @cached_property
    def numbers(self) -> list[int]:
        """Where a number can begin: at a run of digits, or at a tilde ahead of it."""
        text, out = self.text, []
        for begin, _ in self.digits:
            if text.startswith("~", begin - 1) and begin > 0:
                out.append(begin - 1)
            elif begin > 1 and text[begin - 2] == "~" and text[begin - 1].isspace():
                out.append(begin - 2)
            out.append(begin)
        return out

    @cached_property
    def spelt(self) -> set[str]:
        """First letters of what stands behind numbers."""
        return {m[1] for _, end in self.digits if (m := _SPELT.match(self.text, end))}


@lru_cache(maxsize=1)
def landmarks(text: str) -> Landmarks:
    """Those of the text that is at hand."""
    return Landmarks(text)


def _holds(pattern: str | re.Pattern) -> Callable[[str], list]:
    found = re.compile(pattern).search
    return lambda text: [1] if found(text) else []


def _has(*words: str) -> Callable[[str], list]:
    if len(words) == 1:
        return lambda text: [1] if words[0] in text else []
    return lambda text: [1] if any(w in text for w in words) else []


@cache
def normal_steps() -> tuple[Step | Lower, ...]:
    """The rewriting steps in order. Most texts lack what most steps are about, which is told much faster than by the steps' own patterns:
    by words that all their finds hold, or by the text's landmarks.
    """
    foreign_search = _holds(_JAPANESE_OR_CHINESE)
    foreign = lambda text: [] if landmarks(text).narrow is not None else foreign_search(text)
    spelt = lambda text: landmarks(text).spelt
    behind_numbers = lambda text: [end for _, end in landmarks(text).digits]
    needs = {
        r"\S{120,}": lambda text: [1] if landmarks(text).has_token(120) else [],
        r"(?s)<!--.*?-->": _has("<!--"),
        r"(?:https?://|www\.)\S+": _has("://", "www."),
        r"\S+@\S+\.\S+": _has("@"),
        r"(?i)</?[a-z][^>]{0,300}>": _has("<"),
        r"(?s)share your feedback on copilot coding agent.*?survey\.?": _has("share your feedback on copilot coding agent"),
        r"link to devin run:.*?(?:\n|$)": _has("link to devin run:"),
        r"co-authored-by:.*?(?:\n|$)": _has("co-authored-by:"),
        r"\b\d{4}-\d{2}-\d{2}(?:t[\d:.]+z?)?\b": lambda text: [1] if landmarks(text).behind_digits("-") else [],
        r"\bv?\d+\.\d+\.\d+(?:[-+.][\w.]+)*\b": lambda text: [1] if landmarks(text).behind_digits(".") else [],
        r"\b[0-9a-f]{7,40}\b": lambda text: [1] if landmarks(text).has_hex(7) else [],
        r"([　-ヿ㐀-鿿＀-￯])(?=[\d(~\-+])": foreign,
        r"(?<=[\d)%xs])(?=[　-ヿ㐀-鿿＀-￯])": foreign,
        r"[、。：，（）「」【】]": foreign,
        r"(?<=\d)\+(?=\s|$)": _has("+"),
        r"(?<=\d)n(?=\s*±)": _has("±"),
        r"×": _has("×"),
        r"→|⟶|⇒|=>|->|-->": _has("→", "⟶", "⇒", "=>", "->"),
        r"[–—]": _has("–", "—"),
        r"≈|~": _has("≈"),
    }

    def step(p: str, by: str) -> Step:
        unit = p.removeprefix(r"(?<=\d)\s*")
        made = re.compile(p), by.replace("$", "\\")
        # Units after a number need a digit with their first letter behind it, and begin where the number ends.
        return Step(*made, spelt, frozenset(u[0] for u in unit.removeprefix("(?:").split("|")), behind_numbers) if unit != p else Step(*made, needs.get(p))

    return (*(step(p, by) for p, by in ct.STRIP_RAW), Lower(), *(step(p, by) for p, by in ct.STRIP_LOWER))


def normalise_text(raw: str | None) -> str:
    """Lower-case text with units folded, without markup, addresses, versions and hashes."""
    return rewrite(raw or "", normal_steps())[0]


@F.pandas_udf(T.StringType())
def normalise(text: pd.Series) -> pd.Series:
    """``normalise_text`` of a column; null is empty."""
    return text.map(normalise_text)


def normalise_with_places(raw: str) -> tuple[str, Places]:
    """The normalised text, and the table that leads its places back to the raw text."""
    text, log = rewrite(raw, normal_steps())
    return text, traced(len(raw), log)


# Marks -------------------------------------------------------------------------------------------

#: ``mark`` numbers the marks of a text, ``sort`` is its place in ``mark_sorts`` (null: none), ``place`` its token and, packed behind it, the number of a quantity or the last token of others.
MARK = "mark int, sort int, place long, role string, name string, conf long, token int, last_token int, start int, end int, raw_start int, raw_end int, found string"
_ARROW = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.int32()] * 6, pa.string()]


#: What every quantity of a kind holds, where that is found much faster than the quantity.
_HOLDS = {"mult": r"\d\s?(?:x|times)\b", "pct": r"\d\s?(?:%|percent)", "currency": r"[$€£]|\b(?:usd|eur|gbp|dollars?|cents?)\b|\d(?:usd|eur|gbp|dollar|cent)", "from_to": r"\bfrom\s|->", "before_after": r"(?:[:=|]|->)\s*\**~?\s?\d"}
#: Built-in patterns that begin with a number, and what a text holds in which a time is written ahead of its number.
_NUMBER_FIRST = frozenset(p for p in (*ct.QUANTITIES.values(), *(p for _, p, _, _ in ct.SELF_SUFFICIENT)) if p.startswith(rf"\b{ct.NUM}"))
_UNIT_AHEAD = re.compile(rf"\({ct.TIME}\)")
#: Of each built-in cue, what all that it finds holds a word of: told much faster than the cue is looked for.
_CUE_WORDS = {
    "D1": ("time", "latenc", "took", "take", "taking", "timing", "faster", "slower", "quicker", "speed", "elapsed", "wall", "startup", "start-up", "boot", "cold", "duration", "ttfb", "tti", "lcp", "fcp", "p50", "p75", "p9", "percentile", "レイテンシ", "高速化", "時間", "耗时", "时间", "延迟"),
    "D2": ("throughput", "/s", "second", "qps", "rps", "tps", "bps", "fps", "スループット", "吞吐"),
    "D3": ("mem", "heap", "rss", "resident", "footprint", "alloc", "garbage", "gc", "leak", "oom", "swap", "fault", "retained", "created", "arena", "pool", "メモリ", "ヒープ", "内存"),
    "D4": ("cpu", "utili", "cycles", "instruction", "ipc", "flops", "call", "invocation", "branch", "compute", "core", "呼び出し", "调用次数"),
    "D5": ("n+1", "trip", "quer", "db", "database", "sql", "api", "http", "network", "request", "payload", "bytes", "transfer", "response", "bandwidth", "cache", "hit", "miss", "disk", "i/o", "ops", "syscall", "file", "writes"),
    "D6": ("size", "bundle", "gzip", "brotli", "minified", "apk", "ipa", "shak", "dead"),
    "D7": ("build", "compil", "ci-", "ci ", "pipeline", "duration", "test", "time", "reload", "hmr", "ビルド時間", "编译时间", "构建时间"),
    "D8": ("cost", "pric", "bill", "spend", "energy", "power", "watt", "joule", "kwh", "battery", "carbon", "co2"),
    "D9": ("concurren", "parallelism", "load", "stress", "contention", "lock", "scal", "pool", "backpressure", "queue", "saturat", "simultaneous"),
    "D0": ("perf", "efficien", "overhead", "slowness", "bottleneck", "responsive", "snappier", "sluggish", "optimi", "speed"),
}
_WORDS_OF = {p: _CUE_WORDS[d] for d, p in ct.CUES.items()}


#: Tokens on either side of a digit within which a quantity with that digit ends, more than any pattern spans.
QUANTITY_REACH = 12
#: Tokens on either side of a quantity or a sufficient construction within which cues and doubts are looked for. What is a claim asks for less: a cue
#: within PAIR_WINDOW, a cue within PAIR_WINDOW of that one, and a few tokens more for cues that begin or end in one another.
CUE_REACH = 36
#: Built-in rules that begin with a word of speed, that span lines, and the others, which hold a digit and are as short as quantities.
_SPEED_RULES = frozenset(p for _, p, _, _ in ct.SELF_SUFFICIENT if p.startswith(ct.SPEED))
_LINE_RULES = frozenset(p for _, p, _, _ in ct.SELF_SUFFICIENT if r")[^\n]{0,400}\n" in p)
_SHORT_RULES = frozenset(p for _, p, _, _ in ct.SELF_SUFFICIENT) - _SPEED_RULES - _LINE_RULES
_SPEED_WORDS = ("faster", "slower", "quicker", "speed", "高速化", "加速", "短縮", "缩短")
#: Of rules that span lines, the part with the quantity; words of which each doubtful heading has one.
_TABLE_CELL = re.compile(rf"\|\s*\**{ct.NUM}\s?{ct.BYTES}\**\s*\|")
_HEADING_WORDS = ("expected", "estimated", "projected", "anticipated", "theoretical", "potential", "planned", "hypothes")


def _short_cue(pattern: str) -> bool:
    """Whether a cue spans a few tokens at most: a built-in one, or one without repeats, edges and open sets of characters."""
    return pattern in ct.CUES.values() or (not re.search(r"[*+{^$]|\\[sSWDBAZnrtfvxuUN]|(?<!\\)\.", pattern) and pattern.count(" ") <= 8)


@dataclass(frozen=True)
class Patterns:
    """The distinct patterns of several configurations; each with the set of configurations, as bits, that have it."""

    #: kind, pattern and what a text with such a quantity holds
    quantities: list[tuple[str, re.Pattern, re.Pattern | None]]
    #: dimension, pattern, configurations, whether it spans a few tokens at most
    cues: list[tuple[str, re.Pattern, int, bool]]
    #: which of ``cues``, those that hide it, configurations
    seen: list[tuple[int, tuple[int, ...], int]]
    #: number of the rule, pattern, configurations
    alone: list[tuple[str, re.Pattern, int]]
    hypothetical: re.Pattern
    heading: re.Pattern
    block: re.Pattern
    every: int


def rule_numbers(configurations: Sequence[Configuration]) -> dict[tuple, int]:
    """Distinct self-sufficient rules (dimension, pattern, kinds needed, silencing dimensions), numbered."""
    return {r: k for k, r in enumerate(dict.fromkeys((d, p, tuple(need), tuple(quiet)) for c in configurations for d, p, need, quiet in c.self_sufficient))}


def pattern_table(configurations: Sequence[Configuration]) -> Patterns:
    cues: dict[tuple[str, str], int] = {}
    seen: dict[tuple, int] = {}
    for k, c in enumerate(configurations):
        for cue in c.cues.items():
            cues[cue] = cues.get(cue, 0) | 1 << k
    place = {cue: at for at, cue in enumerate(cues)}
    for k, c in enumerate(configurations):
        for d, p in c.cues.items():
            key = place[d, p], tuple(sorted(place[o, c.cues[o]] for o in c.hidden_from.get(d, []) if o in c.cues))
            seen[key] = seen.get(key, 0) | 1 << k
    alone: dict[tuple, int] = {}
    for k, c in enumerate(configurations):
        for d, p, need, quiet in c.self_sufficient:
            rule = d, p, tuple(need), tuple(quiet)
            alone[rule] = alone.get(rule, 0) | 1 << k
    numbers = rule_numbers(configurations)
    return Patterns(
        [(kind, re.compile(p), re.compile(_HOLDS[kind]) if kind in _HOLDS else None) for kind, p in ct.QUANTITIES.items()],
        [(d, re.compile(p), bits, _short_cue(p)) for (d, p), bits in cues.items()],
        [(at, hiding, bits) for (at, hiding), bits in seen.items()],
        [(str(numbers[r]), re.compile(r[1]), bits) for r, bits in alone.items()],
        re.compile(ct.HYPOTHETICAL), re.compile(ct.PROSPECTIVE), re.compile(ct.BLOCK_BREAK), (1 << len(configurations)) - 1,
    )


def open_stretches(size: int, hiding: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What intervals leave of a text."""
    out, at = [], 0
    for s, e in sorted(hiding):
        if s > at:
            out.append((at, s))
        at = max(at, e)
    return [*out, (at, size)] if at < size else out


def stretches_around(starts: list[int], size: int, places: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """The stretches of a text, whole tokens, that reach so many tokens beyond some places, apart and in order. ``starts``: where the tokens begin."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(places):
        first, stop = bisect_right(starts, s) - 1 - reach, bisect_left(starts, e) + reach
        lo, hi = starts[first] if first > 0 else 0, starts[stop] if stop < len(starts) else size
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def _over(text: str, pattern: re.Pattern, where: list[tuple[int, int]]) -> Iterator[re.Match]:
    for lo, hi in where:
        yield from pattern.finditer(text, lo, hi)


def _places_of(text: str, words: Sequence[str]) -> list[int]:
    """Where any of some words begins, in order."""
    out = []
    for w in words:
        at = text.find(w)
        while at >= 0:
            out.append(at)
            at = text.find(w, at + 1)
    return sorted(out)


def _at_numbers(text: str, pattern: re.Pattern, digits: list[tuple[int, int]]) -> Iterator[re.Match]:
    """What a pattern that begins with a number finds in some stretches, in which all numbers are."""
    numbers, k = landmarks(text).numbers, 0
    for _, hi in digits:
        end = 0
        while k < len(numbers) and numbers[k] < hi:
            if numbers[k] >= end and (m := pattern.match(text, numbers[k], hi)):
                yield m
                end = m.end()
            k += 1


def _quantities(text: str, kind: str, pattern: re.Pattern, held: re.Pattern | None, digits: list[tuple[int, int]]) -> Iterable[re.Match]:
    if pattern.pattern in _NUMBER_FIRST or kind == "time" and not _UNIT_AHEAD.search(text):
        return _at_numbers(text, pattern, digits)
    return _over(text, pattern, digits if held is None else [at for at in digits if held.search(text, *at)])


def _with_words(words: Sequence[str], where: list[tuple[int, int]], pieces: list[str]) -> list[tuple[int, int]]:
    """The stretches of which the pieces of text hold a word."""
    out = []
    for at, piece in zip(where, pieces, strict=True):
        for w in words:
            if w in piece:
                out.append(at)
                break
    return out


def _sufficient(text: str, pattern: re.Pattern, digits: list[tuple[int, int]]) -> Iterator[re.Match]:
    """What a self-sufficient rule finds: the built-in ones are looked for where they can be."""
    p = pattern.pattern
    if p in _NUMBER_FIRST:
        return _at_numbers(text, pattern, digits)
    if p in _SHORT_RULES:
        return _over(text, pattern, digits)
    if p in _SPEED_RULES:
        return matches_at(pattern, text, _places_of(text, _SPEED_WORDS))
    if p in _LINE_RULES and not _TABLE_CELL.search(text):
        return iter(())
    return pattern.finditer(text)


def find_marks(text: str, patterns: Patterns, starts: list[int] | None = None, reach: int = CUE_REACH) -> list[tuple]:
    """Role, name, configurations, start and end of the marks of one normalised text; none where no claim can be.

    Quantities are looked for around digits, cues and doubts within ``reach``
    tokens of what may be claimed; headings of doubtful blocks anywhere. A cue
    must lie in what the cues that hide it leave of the text. It is looked for
    there only, so one that a hidden phrase would have begun or gone on with
    is found as well. ``starts``: where the text's tokens begin.
    """
    starts = landmarks(text).starts if starts is None else starts
    whole = [(0, len(text))]
    digits = stretches_around(starts, len(text), landmarks(text).digits, QUANTITY_REACH)
    out = [("quantity", kind, patterns.every, m.start(), m.end()) for kind, p, held in patterns.quantities for m in _quantities(text, kind, p, held, digits)]
    alone = [("self", number, bits, m.start(), m.end()) for number, p, bits in patterns.alone for m in _sufficient(text, p, digits)]
    if not out and not alone:
        return []
    near = stretches_around(starts, len(text), [m[3:] for m in (*out, *alone)], reach)
    pieces = [text[lo:hi] for lo, hi in near]
    fields = [_with_words(_WORDS_OF[p.pattern], near, pieces) if p.pattern in _WORDS_OF else near if short else whole for _, p, _, short in patterns.cues]
    spans = [[m.span() for lo, hi in field for m in p.finditer(text, lo, hi)] for (_, p, _, _), field in zip(patterns.cues, fields, strict=True)]
    if not alone and not any(spans):
        return []
    out += alone
    for (d, _, bits, _), found in zip(patterns.cues, spans, strict=True):
        out += [("raw_cue", d, bits, s, e) for s, e in found]
    for at, hiding, bits in patterns.seen:
        d, p, _, _ = patterns.cues[at]
        hidden = [span for o in hiding for span in spans[o]]
        if hidden:
            left = [(max(lo, a), min(hi, b)) for lo, hi in open_stretches(len(text), hidden) for a, b in fields[at] if max(lo, a) < min(hi, b)]
            found = [m.span() for m in _over(text, p, left)]
        else:
            found = spans[at]
        out += [("cue", d, bits, s, e) for s, e in found]
    out += [("hypothetical", "", patterns.every, m.start(), m.end()) for m in _over(text, patterns.hypothetical, near)]
    for m in patterns.heading.finditer(text) if any(w in text for w in _HEADING_WORDS) else ():
        stop = min(len(text), m.end() + ct.BLOCK_CHARS)
        cut = patterns.block.search(text, m.end(), stop)
        out.append(("block", "", patterns.every, m.start(), cut.start() if cut else stop))
    return out


_SHOWN = ("quantity", "cue", "self")


def silencers(configurations: Sequence[Configuration]) -> set[str]:
    """Dimensions that silence others: only of these is it asked where their cues stand in the text with nothing hidden."""
    return {d for c in configurations for quiet in (*c.silenced_by.values(), *(rule[3] for rule in c.self_sufficient)) for d in quiet}


def mark_sorts(patterns: Patterns, silencing: set[str]) -> list[tuple[str, str, int]]:
    """The sorts of marks that others look for around them: role, name and configurations."""
    quantities = [("quantity", kind, patterns.every) for kind, _, _ in patterns.quantities]
    cues = [("cue", patterns.cues[at][0], bits) for at, _, bits in patterns.seen]
    return list(dict.fromkeys([*quantities, *cues, *(("raw_cue", d, bits) for d, _, bits, _ in patterns.cues if d in silencing)]))


def _reaches(found: list[tuple], tokens: list[int], lo: list[int], hi: list[int]) -> list[tuple[int, int]]:
    """For each mark the stretch of raw text from itself to all quantities that it can be paired with: those within PAIR_WINDOW tokens."""
    at = sorted((t, k) for k, (t, f) in enumerate(zip(tokens, found, strict=True)) if f[0] == "quantity")
    out = []
    for k, (role, *_) in enumerate(found):
        own = [k]
        if role == "cue":
            own += [q for _, q in at[bisect_left(at, (tokens[k] - ct.PAIR_WINDOW, -1)) : bisect_left(at, (tokens[k] + ct.PAIR_WINDOW + 1, -1))]]
        out.append((min(lo[q] for q in own), max(hi[q] for q in own)))
    return out


def marks(texts: DataFrame, key: str, text: str, configurations: Sequence[Configuration] = (DEFAULT,), snippets: bool = False, places: bool = False, quotes: bool = False) -> DataFrame:
    """Rows of marks: row (the text's number), key and the columns of MARK. A text without a digit has no quantity, hence no mark is looked for.

    With ``snippets`` cues bring the normalised text around them; with
    ``places`` places in the raw text are filled in; with ``quotes``, too, and
    cues bring the raw text as far as the quantities that they may be paired
    with (``wide``, and where it begins), so that no text has to be met again.
    """
    bound_arrow_batches(texts.sparkSession)
    chosen = spread(texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))
    kind = chosen.schema["key"].dataType.simpleString()
    names = ["row", "key", *[c.split()[0] for c in MARK.split(", ")], "snippet", "wide", "wide_start"]
    configurations = list(configurations)

    def search(batches):
        patterns, steps, silencing = pattern_table(configurations), normal_steps(), silencers(configurations)
        sorts = {which: k for k, which in enumerate(mark_sorts(patterns, silencing))}
        number, digit = TaskContext.get().partitionId() << 40, re.compile(r"\d").search
        for batch in batches:
            at, numbers, rows = [], [], []
            for k, raw in enumerate(batch.column(1).to_pylist()):
                number += 1
                if raw is None or not digit(raw):
                    continue
                normal, log = rewrite(raw, steps)
                starts = landmarks(normal).starts
                found = find_marks(normal, patterns, starts)
                if not found:
                    continue
                found = [f for f in found if f[0] != "raw_cue" or f[1] in silencing]
                token = lambda c: max(bisect_right(starts, c) - 1, 0)  # noqa: B023, E731
                lo, hi = [f[3] for f in found], [f[4] for f in found]
                tokens = [token(c) for c in lo]
                raw_lo, raw_hi = (x.tolist() for x in traced(len(raw), log).span(lo, hi)) if places or quotes else ([None] * len(found),) * 2
                wide = _reaches(found, tokens, raw_lo, raw_hi) if quotes else None
                for mark, ((role, name, bits, s, e), a, b, first) in enumerate(zip(found, raw_lo, raw_hi, tokens, strict=True)):
                    near = " ".join(normal[max(0, s - ct.SNIPPET_CHARS) : s + ct.SNIPPET_CHARS].split()) if snippets and role in ("cue", "self") else None
                    last = token(e - 1) if role in ("cue", "block") else first
                    rows.append((mark, sorts.get((role, name, bits)), first << 32 | (mark if role == "quantity" else last), role, name, bits, first, last, s, e, a, b, normal[s:e] if role in _SHOWN else "", near, *((raw[slice(*wide[mark])], wide[mark][0]) if quotes and role in ("cue", "self") else (None, None))))
                at += [k] * len(found)
                numbers += [number] * len(found)
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*_ARROW, pa.string(), pa.string(), pa.int32()], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), batch.column(0).take(pa.array(at)), *columns], names=names)

    return chosen.mapInArrow(search, f"row long, key {kind}, {MARK}, snippet string, wide string, wide_start int")


# Claims ------------------------------------------------------------------------------------------


def _token(packed: str) -> Column:
    return F.shiftright(F.col(packed), 32).cast("int")


def _other(packed: str) -> Column:
    """What is packed behind a token."""
    return F.col(packed).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def _gap(first: Column, last: Column, at: Column) -> Column:
    """Tokens between a place and a cue: 0 within it."""
    return F.when(at.between(first, last), 0).otherwise(F.least(F.abs(at - first), F.abs(at - last)))


def _any(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _lists(values: Mapping[tuple[int, str], Sequence[str]], size: int) -> Callable[[str], Column]:
    """Whether the row's list holds an item: ``values`` has the lists by configuration and name, of ``size`` configurations. Told by comparing names, nothing is looked up."""

    def holds(item: str) -> Column:
        having: dict[tuple[str, ...], list[int]] = {}
        for k in range(size):
            having.setdefault(tuple(sorted(n for (c, n), v in values.items() if c == k and item in v)), []).append(k)
        return _any(F.col("name").isin(*names) if len(ks) == size else F.col("conf").isin(*ks) & F.col("name").isin(*names) for names, ks in having.items() if names)

    return holds


def _surroundings(found: DataFrame, sorts: Sequence[tuple[str, str, int]]) -> DataFrame:
    """Marks with the place of the nearest of each sort on either side: quantities by kind (``q``), cues and raw cues by dimension and set of configurations (``c``, ``r``); and hypothetical wording (``h``).

    Two orders of a text's marks, forwards and backwards, one sort each, for
    all configurations together. At a token quantities come behind the others,
    so that a cue's own token is ahead of it.
    """
    is_q = F.col("role") == "quantity"
    within = [F.col("token"), is_q.cast("int"), F.when(is_q, F.col("found")), F.when(~is_q, F.col("last_token")), F.col("start"), F.col("end"), F.col("name"), F.col("role")]
    # Sorts and places come with the marks: a number for each sort is little code and little to keep.
    places = {_column(which): F.when(F.col("sort") == k, F.col("place")) for k, which in enumerate(sorts)}
    doubt = F.col("role").isin("hypothetical", "block")
    own = Window.partitionBy("row")
    back = own.orderBy(*[c.asc() for c in within]).rowsBetween(Window.unboundedPreceding, -1)
    ahead = own.orderBy(*[c.desc() for c in within]).rowsBetween(Window.unboundedPreceding, -1)
    seen = found
    for side, frame, edge in (("b", back, F.max(F.when(doubt, F.col("last_token")))), ("a", ahead, F.min(F.when(doubt, F.col("token"))))):
        seen = seen.withColumns({f"{n}_{side}": F.last(c, ignorenulls=True).over(frame) for n, c in places.items()} | {f"h_{side}": edge.over(frame)})
    return seen


def _column(which: tuple[str, str, int]) -> str:
    """What a sort's columns begin with: quantities are of all configurations."""
    role, name, bits = which
    return f"q_{name}" if role == "quantity" else f"{'r' if role == 'raw_cue' else 'c'}{bits}_{name}"


def _by_configuration(seen: DataFrame, cue_sorts: Sequence[tuple[str, str, int]], size: int) -> DataFrame:
    """Marks once for each of their configurations (``conf``, its number), each with the cues around it that its configuration has."""
    of = lambda bits: [k for k in range(size) if bits >> k & 1]
    having = F.array_compact(F.array(*[F.when(F.col("conf").bitwiseAND(F.lit(1 << k)) != 0, F.lit(k)) for k in range(size)]))
    sets: dict[tuple[str, str], list[int]] = {}
    for role, d, bits in cue_sorts:
        if role != "quantity":
            sets.setdefault(("r" if role == "raw_cue" else "c", d), []).append(bits)
    # The cues of one dimension are of disjoint sets of configurations.
    own = lambda kind, d, bits, side: F.col(f"{kind}{bits}_{d}_{side}") if len(of(bits)) == size else F.when(F.col("conf").isin(of(bits)), F.col(f"{kind}{bits}_{d}_{side}"))
    around = {f"{kind}_{d}_{side}": F.coalesce(*[own(kind, d, bits, side) for bits in found]) for (kind, d), found in sets.items() for side in "ba"}
    # One configuration has every mark.
    each = (seen.withColumn("conf", F.explode(having)) if size > 1 else seen.withColumn("conf", F.lit(0))).withColumns(around)
    return each.drop(*[f"{kind}{bits}_{d}_{side}" for (kind, d), found in sets.items() for bits in found for side in "ba"])


def _within(kind: str, names: Sequence[str], tokens: int) -> Column:
    """Whether one of some names is so near on either side: ``r`` raw cues, ``c`` cues by their first token, ``q`` quantities."""
    return _any(F.coalesce(F.abs(_token(f"{kind}_{n}_{side}") - F.col("token")) <= tokens, F.lit(False)) for n in names for side in "ba")


#: The kinds in the order in which ties are decided, and where distance, kind and side stand in a number before the mark's own.
_KINDS = sorted(ct.QUANTITIES)
_DISTANCE, _KIND, _SIDE = 40, 33, 32


def _nearest(allowed: Callable[[str], Column]) -> Column:
    """The nearest quantity of the allowed kinds within PAIR_WINDOW: distance, kind, side and number of the mark, packed; ties to the kind first by name, then to the earlier."""
    options = []
    for at, kind in enumerate(_KINDS):
        for k, side in enumerate("ba"):
            c = f"q_{kind}_{side}"
            distance = F.abs(_token(c) - F.col("token"))
            packed = F.shiftleft(distance.cast("long"), _DISTANCE) + F.lit((at << _KIND) + (k << _SIDE)) + _other(c)
            options.append(F.when(allowed(kind) & (distance <= ct.PAIR_WINDOW), packed))
    return F.least(*options)


CLAIM = ["key", "dimension", "rule", "cue", "start", "end", "quantity_kind", "quantity", "quantity_start", "quantity_end"]
RAW = ["raw_start", "raw_end", "quantity_raw_start", "quantity_raw_end"]


def claims_by(texts: DataFrame, key: str, text: str, configurations: Mapping[str, Configuration], snippets: bool = False, places: bool = False, quotes: bool = False) -> DataFrame:
    """A row for each claim of each configuration: row, configuration and the columns of CLAIM; with ``snippets`` the text around the cue,
    with ``places`` the places in the raw text, with ``quotes`` these and the raw ``quote`` from cue to quantity. Texts are read once for all configurations.
    """
    names, confs = list(configurations), list(configurations.values())
    if len(confs) > 60:
        raise ValueError("at most 60 configurations fit into the bits of a mark")
    # Marks are few against the texts; they serve several times and are written once.
    scratch = Scratch(texts.sparkSession, "claims")
    stored = scratch.table(marks(texts, key, text, confs, snippets, places, quotes), "marks")
    dimensions = list(dict.fromkeys(d for c in confs for d in c.cues))
    patterns = pattern_table(confs)
    silencing = silencers(confs)
    sorts = mark_sorts(patterns, silencing)
    # Three sorts of marks ask for their surroundings; both orders are made once, and a mark is told apart by configuration only behind that.
    around = scratch.table(_surroundings(stored, sorts).filter(F.col("role").isin(*_SHOWN)).drop("sort", "place"), "seen")
    seen = _by_configuration(around, sorts, len(confs))
    per_conf = lambda pick: {(k, n): v for k, c in enumerate(confs) for n, v in pick(c).items()}
    lists = lambda pick: _lists(per_conf(pick), len(confs))
    conf, name, token = F.col("conf"), F.col("name"), F.col("token")
    sure = ~(F.coalesce(F.col("h_b") >= token - ct.EXCLUSION_WINDOW, F.lit(False)) | F.coalesce(F.col("h_a") <= token + ct.EXCLUSION_WINDOW, F.lit(False)))
    silenced = lambda by: _any(by(d) & _within("r", [d], ct.PAIR_WINDOW) for d in dimensions if d in silencing)

    # Cues with their nearest fitting quantity.
    cues = seen.filter("role = 'cue'").filter(sure & ~silenced(lists(lambda c: c.silenced_by)))
    cues = cues.withColumn("best", _nearest(lists(lambda c: c.kinds))).filter("best is not null")
    cues = cues.select("row", "key", "conf", name.alias("dimension"), "token", "last_token", "start", "end", "raw_start", "raw_end", F.col("found").alias("cue"), "snippet", "wide", "wide_start", "best")
    bits = lambda at, n: F.shiftright("best", at).bitwiseAND(F.lit((1 << n) - 1)).cast("int")
    cues = cues.withColumns({"quantity_kind": F.element_at(F.array(*[F.lit(k) for k in _KINDS]), bits(_KIND, 7) + 1), "its_quantity": bits(0, 32), "q_token": token + F.when(bits(_SIDE, 1) == 0, -bits(_DISTANCE, 23)).otherwise(bits(_DISTANCE, 23))})

    # What quantities have around them: of each dimension that takes their kind the nearest cue, and whether the fallback is out of the question.
    takes = lists(lambda c: {k: [d for d, own in c.kinds.items() if k in own] for k in ct.QUANTITIES})
    rival = lambda d: F.when(takes(d), F.least(*[_gap(_token(f"c_{d}_{side}"), _other(f"c_{d}_{side}"), token) for side in "ba"]))
    quantities = seen.filter("role = 'quantity'").select(
        F.col("row").alias("q_row"), F.col("conf").alias("q_conf"), F.col("mark").alias("q_mark"), F.col("start").alias("q_start"), F.col("end").alias("q_end"),
        F.col("found").alias("q_found"), F.col("raw_start").alias("q_raw_start"), F.col("raw_end").alias("q_raw_end"), *[rival(d).alias(f"rival_{d}") for d in dimensions],
        (_within("c", [d for d in dimensions if d != ct.FALLBACK], ct.PAIR_WINDOW) | _within("q", ct.UNIT_KINDS, ct.UNIT_WINDOW) | name.isin(*ct.UNIT_KINDS)).alias("named"),
    )
    same = (F.col("row") == F.col("q_row")) & (conf == F.col("q_conf")) & (F.col("its_quantity") == F.col("q_mark"))
    distance = _gap(token, F.col("last_token"), F.col("q_token"))
    # Both sides grow with the texts, and files of marks are much smaller than marks: neither is to be broadcast by its files' size.
    paired = cues.join(quantities.hint("merge"), same).withColumn("distance", distance)
    # A strictly nearer cue of another dimension wins the quantity; the fallback needs a quantity without any cue or unit beside it.
    paired = paired.filter(~_any(F.coalesce((F.col("dimension") != d) & (F.col(f"rival_{d}") < F.col("distance")), F.lit(False)) for d in dimensions))
    paired = paired.filter((F.col("dimension") != ct.FALLBACK) | ~F.col("named"))
    own = ["row", "conf", "snippet", "wide", "wide_start"]
    out = paired.select(*own, "key", "dimension", F.lit("cue+quantity").alias("rule"), "cue", "start", "end", "quantity_kind", F.col("q_found").alias("quantity"), F.col("q_start").alias("quantity_start"), F.col("q_end").alias("quantity_end"), "raw_start", "raw_end", F.col("q_raw_start").alias("quantity_raw_start"), F.col("q_raw_end").alias("quantity_raw_end"))

    # Constructions that suffice by themselves.
    numbers = rule_numbers(confs)
    if numbers:
        by = lambda pick: _lists({(0, str(k)): pick(r) for r, k in numbers.items()}, 1)
        need = by(lambda r: r[2] or [""])
        met = need("") | _any(need(kind) & _within("q", [kind], ct.PAIR_WINDOW) for kind in ct.QUANTITIES)
        alone = seen.filter("role = 'self'").filter(sure & ~silenced(by(lambda r: r[3])) & met)
        dimension = F.element_at(F.array(*[F.lit(r[0]) for r in numbers]), name.cast("int") + 1)
        made = alone.select(*own, "key", dimension.alias("dimension"), F.lit("self-sufficient").alias("rule"), F.col("found").alias("cue"), "start", "end", F.lit("self").alias("quantity_kind"), F.col("found").alias("quantity"), F.col("start").alias("quantity_start"), F.col("end").alias("quantity_end"), "raw_start", "raw_end", F.col("raw_start").alias("quantity_raw_start"), F.col("raw_end").alias("quantity_raw_end"))
        out = out.unionByName(made)
    out = out.withColumn("configuration", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("conf") + 1))
    if quotes:
        lo, hi = F.least("raw_start", "quantity_raw_start"), F.greatest("raw_end", "quantity_raw_end")
        out = out.withColumn("quote", F.substring("wide", lo - F.col("wide_start") + 1, hi - lo))
    return out.select("row", "configuration", *CLAIM, *(["snippet"] if snippets else []), *(RAW if places or quotes else []), *(["quote"] if quotes else []))


def extract_claims(texts: DataFrame, key: str, text: str, configuration: Configuration = DEFAULT, snippets: bool = False, places: bool = False, quotes: bool = False) -> DataFrame:
    """A row for each claim: key, dimension, rule, cue and quantity with their places in the normalised text; ``snippets``, ``places`` and ``quotes`` as in ``claims_by``."""
    return claims_by(texts, key, text, {"": configuration}, snippets, places, quotes).drop("row", "configuration")


def claim_flags(claims: DataFrame, texts: DataFrame, key: str, configuration: Configuration = DEFAULT) -> DataFrame:
    """Per key: a flag for each dimension (false without claims), the number of claims and the dimensions as text."""
    dimensions = sorted(configuration.cues)
    flags = claims.groupBy("key").agg(*[F.bool_or(F.col("dimension") == d).alias(d) for d in dimensions], F.count("*").alias("claims"))
    joined = texts.select(F.col(key).alias("key")).distinct().join(flags, "key", "left").na.fill(False, dimensions).na.fill(0, ["claims"])
    return joined.withColumn("dimensions", F.array_join(F.array_compact(F.array(*[F.when(F.col(d), F.lit(d)) for d in dimensions])), "|"))


# Corpora of several sources ----------------------------------------------------------------------


def joined_pieces(pieces: DataFrame, keys: Sequence[str], source: str, order: str, text: str) -> DataFrame:
    """keys, source, ``whole``, ``sizes`` and ``cell`` (keys and source as text): the pieces of a source in order, joined by line ends, and each one's
    order (``o``) and length (``n``). Null pieces don't count.
    """
    in_order = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    joined = pieces.filter(F.col(text).isNotNull()).groupBy(*keys, source).agg(in_order.alias("__pieces"))
    whole, sizes = F.array_join(F.transform("__pieces", lambda x: x["t"]), "\n"), F.transform("__pieces", lambda x: F.struct(x["o"].alias("o"), F.length(x["t"]).cast("long").alias("n")))
    return joined.select(*keys, source, whole.alias("whole"), sizes.alias("sizes"), F.to_json(F.struct(*keys, source)).alias("cell"))


def joined_boundaries(whole: DataFrame, keys: Sequence[str], source: str, order: str) -> DataFrame:
    """``record_boundaries`` of what ``joined_pieces`` made, with its ``cell``: from the sizes alone, texts aren't read again."""
    each = whole.select(*keys, source, "cell", F.posexplode("sizes").alias("__at", "__size"))
    end = F.sum(F.col("__size.n") + 1).over(Window.partitionBy("cell").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    return each.select(*keys, source, "cell", F.col("__size.o").alias(order), (F.col("__at") + 1).cast("long").alias("number"), (end - F.col("__size.n")).alias("begin"), end.alias("end"))


def record_boundaries(pieces: DataFrame, keys: Sequence[str], source: str, order: str, text: str) -> DataFrame:
    """keys, source, order and where each piece stands in its joined source: ``number`` from 1, ``begin`` and ``end`` in characters, by running sums of lengths."""
    known = pieces.filter(F.col(text).isNotNull())
    own = Window.partitionBy(*keys, source).orderBy(order, text)
    size = F.length(text).cast("long")
    end = F.sum(size + 1).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    return known.select(*keys, source, order, F.row_number().over(own).cast("long").alias("number"), (end - size).alias("begin"), end.alias("end"))


def spans_in_records(spans: DataFrame, records: DataFrame, cell: str, span: str, start: str, end: str) -> DataFrame:
    """``spans`` once for each record that they overlap, with the record's columns and the overlap's place in it (``record_start``, ``record_end``).

    ``spans``: cell, an identifier ``span``, start and end. ``records``: cell,
    number, begin, end, apart and in order. Where a span's first and last
    character stand is looked up in the order of both together, so spans and
    records of a cell are never paired off against each other.
    """
    kind = spans.schema[span].dataType
    at = lambda edge, place: spans.select(F.col(cell).alias("__c"), place.cast("long").alias("__p"), F.lit(1).alias("__k"), F.col(span).alias("__s"), F.lit(edge).alias("__e"), F.lit(None).cast("long").alias("__n"))
    begins = records.select(F.col(cell).alias("__c"), F.col("begin").cast("long").alias("__p"), F.lit(0).alias("__k"), F.lit(None).cast(kind).alias("__s"), F.lit("").alias("__e"), F.col("number").cast("long").alias("__n"))
    both = begins.unionByName(at("first", F.col(start))).unionByName(at("last", F.greatest(F.col(start), F.col(end) - 1)))
    run = Window.partitionBy("__c").orderBy("__p", "__k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("__n", F.last("__n", ignorenulls=True).over(run)).filter("__k = 1")
    ranges = seen.groupBy("__s").agg(*[F.max(F.when(F.col("__e") == e, F.col("__n"))).alias(f"__{e}") for e in ("first", "last")])
    each = spans.join(ranges, spans[span] == ranges["__s"]).withColumn("number", F.explode(F.sequence("__first", "__last"))).drop("__s", "__first", "__last")
    met = each.join(records.withColumnsRenamed({"begin": "__begin", "end": "__end"}), [cell, "number"])
    met = met.filter((F.col("__begin") < F.col(end)) & (F.col("__end") > F.col(start)))
    return met.withColumn("record_start", F.greatest(F.col(start), F.col("__begin")) - F.col("__begin")).withColumn("record_end", F.least(F.col(end), F.col("__end")) - F.col("__begin")).drop("__begin", "__end")


def claim_records(pieces: DataFrame, keys: Sequence[str], source: str, order: str, text: str, configuration: Configuration = DEFAULT) -> DataFrame:
    """Cue and quantity of each claim of a corpus, once for each piece that they stand in: keys, source, claim (a number), dimension, rule, part, words, the piece's order and the place in it."""
    scratch = Scratch(pieces.sparkSession, "records")
    whole = scratch.table(joined_pieces(pieces, keys, source, order, text), "texts")
    found = extract_claims(whole, "cell", "whole", configuration, places=True).withColumn("claim", F.monotonically_increasing_id())
    found = scratch.table(found.withColumnRenamed("key", "cell"), "claims")
    part = lambda name, words, lo, hi: F.struct(F.lit(name).alias("part"), F.col(words).alias("words"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    parts = F.explode(F.array(part("cue", "cue", "raw_start", "raw_end"), part("quantity", "quantity", "quantity_raw_start", "quantity_raw_end"))).alias("p")
    parts = found.select("cell", "claim", "dimension", "rule", parts).select("cell", "claim", "dimension", "rule", "p.*")
    parts = parts.withColumn("span", F.concat_ws("/", F.col("claim").cast("string"), "part"))
    records = joined_boundaries(whole, keys, source, order)
    out = spans_in_records(parts, records, "cell", "span", "lo", "hi")
    return out.select(*keys, source, "claim", "dimension", "rule", "part", "words", order, "number", "record_start", "record_end")


def corpus_claims(pieces: DataFrame, keys: Sequence[str], source: str, order: str, text: str, diff_source: str, configuration: Configuration = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims in several sources of texts: a roll-up by keys, the first claim of each source and dimension, and sizes.

    ``pieces``: keys, source, order, text. The pieces of a source are joined
    by line ends in order. The roll-up has each dimension's flag and its flag
    without ``diff_source`` (``<dimension>_nodiff``), how many dimensions
    there are (all, without the fallback, without the diff), and ``dimensions``
    and ``sources`` as text. Sizes are characters by source, 0 where none is.
    Texts to be kept apart, as those of bots, have a key of their own that says so.
    """
    scratch = Scratch(pieces.sparkSession, "corpus")
    whole = scratch.table(joined_pieces(pieces, keys, source, order, text), "texts")
    found = scratch.table(extract_claims(whole, "cell", "whole", configuration, snippets=True), "claims")
    cells = found.groupBy("key", "dimension").agg(F.count("*").alias("n_claims"), F.min(F.struct("start", "rule", "cue", "quantity_kind", "quantity", "snippet")).alias("first"))
    cells = whole.select(*keys, source, F.col("cell").alias("key")).join(cells, "key")
    first = cells.select(*keys, source, "dimension", "n_claims", *[F.col(f"first.{c}").alias(c) for c in ("rule", "cue", "quantity_kind", "quantity", "snippet")])
    dimensions = sorted(configuration.cues)
    nodiff = F.col(source) != diff_source
    per_key = cells.groupBy(*keys).agg(*[F.bool_or(F.col("dimension") == d).alias(d) for d in dimensions], *[F.bool_or((F.col("dimension") == d) & nodiff).alias(f"{d}_nodiff") for d in dimensions], F.array_join(F.sort_array(F.collect_set(source)), "|").alias("sources"))
    flags = [*dimensions, *[f"{d}_nodiff" for d in dimensions]]
    rolled = pieces.select(*keys).distinct().join(per_key, list(keys), "left").na.fill(False, flags).na.fill("", ["sources"])
    count = lambda names: reduce(lambda a, b: a + b, [F.col(n).cast("int") for n in names])
    rolled = rolled.withColumn("n_dimensions", count(dimensions)).withColumn("n_specific", count([d for d in dimensions if d != ct.FALLBACK])).withColumn("n_nodiff", count([f"{d}_nodiff" for d in dimensions]))
    rolled = rolled.withColumn("dimensions", F.array_join(F.array_compact(F.array(*[F.when(F.col(d), F.lit(d)) for d in dimensions])), "|"))
    sizes = corpus_sizes(whole.select(*keys, source, "whole"), pieces.select(*keys).distinct(), keys, source, "whole")
    return rolled, first, sizes


#: Sources of a corpus that are listed at most.
MOST_SOURCES = 1000


def corpus_sizes(texts: DataFrame, population: DataFrame, keys: Sequence[str], source: str, text: str) -> DataFrame:
    """Long: keys, source and ``chars`` of every source of every key, 0 where there is no text."""
    names = [r[0] for r in texts.select(source).distinct().limit(MOST_SOURCES + 1).collect()]
    if len(names) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: a source is a kind of text, not a key")
    every = population.withColumn(source, F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")))
    return every.join(texts.select(*keys, source, F.length(text).cast("long").alias("chars")), [*keys, source], "left").na.fill(0, ["chars"])


def coverage_by(texts: DataFrame, key: str, text: str, group: str, configurations: Mapping[str, Configuration], base: str) -> DataFrame:
    """What each configuration covers: per configuration and group, keys, the share with a dimension, the mean number, and how many are new against ``base``.

    Texts are read and matched once for all configurations. Keys are unique.
    """
    kept = texts.select(F.col(key).alias("key"), F.col(group).alias("__group"))
    found = claims_by(texts, key, text, configurations).groupBy("key", "configuration").agg(F.count_distinct("dimension").alias("n_dimensions"))
    every = kept.withColumn("configuration", F.explode(F.array(*[F.lit(n) for n in configurations])))
    flags = every.join(found, ["key", "configuration"], "left").na.fill(0, ["n_dimensions"])
    flags = flags.withColumn("__base", F.max(F.when(F.col("configuration") == base, F.col("n_dimensions"))).over(Window.partitionBy("key")))
    has = F.col("n_dimensions") > 0
    return flags.groupBy("configuration", F.col("__group").alias(group)).agg(F.count("*").alias("n"), F.avg(has.cast("int")).alias("covered"), F.avg("n_dimensions").alias("mean_dimensions"), F.count_if(has & (F.col("__base") == 0)).alias("newly_covered"))


def expected_dimensions(phrases: Column, rules: Sequence[tuple[str, str]] = tuple(ct.EXPECTED), masks: Sequence[tuple[str, str]] = tuple(ct.EXPECTED_FIRST)) -> Column:
    """The dimensions that a phrase speaks of, in order, joined by bars. Narrow phrases (``masks``) are credited first and hidden from the broader rules."""
    text, credit = F.lower(F.coalesce(phrases.cast("string"), F.lit(""))), {}
    for pattern, dimension in masks:
        credit.setdefault(dimension, []).append(text.rlike(pattern))
        text = F.regexp_replace(text, pattern, f"{dimension}TOKEN")
    tests = dict.fromkeys(sorted({d for _, d in masks} | {d for d, _ in rules}))
    for d in tests:
        hits = credit.get(d, []) + [text.rlike(p) for own, p in rules if own == d]
        tests[d] = reduce(lambda a, b: a | b, hits)
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(d)) for d, c in tests.items()])), "|")
