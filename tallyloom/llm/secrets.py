"""Secret scans by multipart credential linking.

Three parts make a credential: an identity (access key id, client id, user),
a secret and an endpoint. Each part is found as an interval of code points.
Strong parts (keyword assignments, access key ids, long hex runs) are
reported wherever they stand. Weak ones (tokens of high entropy, plain
identity fields, endpoints) say little alone: they are reported only where
complementary parts stand in the same scope, a paragraph, at most ``GAP``
characters apart. Linking is an interval join within the scope: both sides
are sorted by start; a part's partner is the next to start, or the one before
it that ends nearest, by the running maximum of their ends.

Defined cases: null and empty texts hold no span; repeated rows are reported
each; parts of one kind don't overlap; of several partners the nearest is
named, on ties the earlier one. Extra columns are ignored (``find_secrets``)
or kept (``redact_secrets``).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import bound_arrow_batches

#: Characters between parts of one credential at most.
GAP = 200
#: Bits a character that a token without keyword needs.
ENTROPY = 3.6

#: Order of kinds that start at the same place.
KINDS = ("assign", "access", "hex", "identity", "endpoint", "token")

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

IDENTITY = re.compile(r"""\b(?:client_?id|user(?:name)?|login|account(?:_?id)?|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(r"""\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|ssh)://[^\s"'<>]{4,}|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:-]{4,}""", re.IGNORECASE | re.ASCII)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
_BREAK = re.compile(r"\n[ \t\r]*\n")

_STRONG_SECRET, _STRONG_IDENTITY = {"assign", "hex"}, {"access"}


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    partner: int | None = None

    def key(self) -> tuple[int, int, int]:
        return self.start, KINDS.index(self.kind), self.end


def base_spans(text: str) -> list[Span]:
    """The strong parts: leftmost, without overlaps within a kind."""
    found = [Span("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [Span("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [Span("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def entropy(token: str) -> float:
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in Counter(token).values())


def weak_tokens(text: str, covered: list[Span]) -> list[Span]:
    """Tokens with letters of both cases, digits and high entropy, outside the strong parts."""
    out = []
    taken = sorted((s.start, s.end) for s in covered)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for m in TOKEN.finditer(text):
        token = m[0]
        if not (any(c.islower() for c in token) and any(c.isupper() for c in token)) or entropy(token) < ENTROPY:
            continue
        at = bisect_left(starts, m.end())
        if not at or reach[at - 1] <= m.start():
            out.append(Span("token", m.start(), m.end()))
    return out


def _nearest(span: Span, starts: list[int], ends: list[int], scope: tuple[int, int]) -> int | None:
    """Start of the nearest part within the scope and GAP characters. ``starts`` are sorted, ``ends`` the running maxima of the ends within each scope."""
    at = bisect_left(starts, span.start)
    best = []
    if at < len(starts) and starts[at] < scope[1]:
        best.append((max(0, starts[at] - span.end), starts[at]))
    low = bisect_left(starts, scope[0], 0, at)
    if low < at:
        end = min(span.start, ends[at - 1])
        best.append((span.start - end, starts[bisect_left(ends, end, low, at)]))  # the first that ends there or later
    gap, start = min(best, default=(GAP + 1, 0))
    return start if gap <= GAP else None


def link(text: str, strong: list[Span]) -> list[Span]:
    """Strong spans, and weak ones that have complementary parts in reach; each with its nearest partner's start."""
    secrets = [s for s in strong if s.kind in _STRONG_SECRET]
    identities = [s for s in strong if s.kind in _STRONG_IDENTITY]
    weak_ids = [Span("identity", m.start(), m.end()) for m in IDENTITY.finditer(text)]
    ends = [Span("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    if not (secrets or identities or weak_ids or ends):
        return []
    tokens = weak_tokens(text, strong) if identities or weak_ids or ends else []
    by_start = lambda spans: sorted(spans, key=lambda s: s.start)
    keys, others = by_start(secrets + tokens), by_start(identities + weak_ids + ends)
    if not keys or not others:
        return by_start(strong)
    cuts = [0, *(m.start() for m in _BREAK.finditer(text)), len(text) + 1]

    def scope(span: Span) -> tuple[int, int]:
        at = bisect_left(cuts, span.start + 1) - 1
        return cuts[at], cuts[at + 1]

    out = []
    for part, partners in ((keys, others), (others, keys)):
        starts, ends, last = [o.start for o in partners], [], None
        for o in partners:
            ends.append(max(o.end, ends[-1]) if ends and scope(o) == last else o.end)
            last = scope(o)
        for s in part:
            partner = _nearest(s, starts, ends, scope(s))
            if partner is not None or s.kind in _STRONG_SECRET | _STRONG_IDENTITY:
                out.append(Span(s.kind, s.start, s.end, partner))
    return out


def scan(text: str | None) -> list[Span]:
    """All spans to report, by start and kind."""
    if not text:
        return []
    return sorted(link(text, base_spans(text)), key=Span.key)


SPANS = "array<struct<kind:string,start:int,end:int,partner:int,found:string>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("partner", pa.int32()), ("found", pa.string())]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and its spans, with the text found and the start of the nearest complementary part. No shuffle."""
    bound_arrow_batches(docs.sparkSession)

    def search(batches):
        for batch in batches:
            rows = [[{"kind": s.kind, "start": s.start, "end": s.end, "partner": s.partner, "found": t[s.start : s.end]} for s in scan(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _ARROW)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(search, f"doc_id long, spans {SPANS}")


def blank(text: str | None, spans: list[Span], mark: str = "[REDACTED]") -> str | None:
    """The text with each run of overlapping secrets replaced; endpoints stay."""
    if not text:
        return text
    out, at = [], 0
    for s in spans:
        if s.kind == "endpoint":
            continue
        if s.start >= at:
            out += [text[at : s.start], mark]
        at = max(at, s.end)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame) -> DataFrame:
    """All documents with their columns; secrets in ``text`` are blanked and ``n_chars``, where present, follows. No shuffle."""
    bound_arrow_batches(docs.sparkSession)
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [scan(t) for t in texts]
            if any(found):
                changed = [blank(t, s) if s else t for t, s in zip(texts, found, strict=True)]
                columns = list(batch.columns)
                columns[at] = pa.array(changed, columns[at].type)
                if size is not None:
                    old = columns[size].to_pylist()
                    columns[size] = pa.array([len(t) if s else n for t, s, n in zip(changed, found, old, strict=True)], columns[size].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(clean, docs.schema)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    joined = lambda kept: F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter(spans, lambda s: s["kind"].isin("assign", "access", "hex"))), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: s["partner"].isNotNull())).cast("long").alias("n_linked"),
    )
