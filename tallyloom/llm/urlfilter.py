"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one multiword Shift-And automaton: a bit for
each state of each rule, a mask for each byte. One step of the whole set
over one byte of a URL is a shift (with the carries between words), an AND
and an OR with the states that a ``*`` keeps alive. A batch of URLs steps
together, a numpy row each; a row leaves the batch where its URL ends.

A canonical URL is ``host/path``: the host lower-cased, the scheme, query and
fragment gone. Globs match the whole of it, byte by byte in UTF-8: ``*`` any
run, ``?`` one byte. A host rule is two globs, for the host itself and for
its subdomains, whose leading ``*`` ends where the path begins; of all that
match, the one with the longest rule wins, on ties the earlier one.

Defined cases: a null url, or one without ``://``, has an empty host and
path; no rule fits and the globs see an empty URL; repeated rows are judged
each; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.bytetext import utf8_buffers
from tallyloom.session import bound_arrow_batches

#: Host rules as host/path, with their verdicts.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
#: Globs over host/path for what no host rule decides.
GLOBS = [("*pills*", "block"), ("*casino*", "block"), ("*porn*", "block"), ("*free-money*", "block"), ("*/wp-login*", "block"), ("*/*.exe", "block"), ("*/*.zip", "block")]
DEFAULT = "allow"


@dataclass(frozen=True)
class Glob:
    pattern: str
    verdict: str
    #: The host rule that it stands for, and how much it outweighs others; globs of their own have none.
    rule: str | None = None
    weight: int = 0
    #: Whether a leading ``*`` takes bytes of the host only, none from the first ``/`` on.
    in_host: bool = False


def rule_globs(rules: list[tuple[str, str]]) -> list[Glob]:
    return [Glob(p, verdict, rule, len(rule), p.startswith("*")) for rule, verdict in rules for p in (f"{rule}*", f"*.{rule}*")]


@dataclass
class Automaton:
    """Masks as rows of ``words`` 64-bit words."""

    step: np.ndarray
    keep: np.ndarray
    #: States kept by bytes other than ``/``.
    keep_host: np.ndarray
    begin: np.ndarray
    accept: list[tuple[int, int]]
    globs: list[Glob]

    @classmethod
    def build(cls, globs: list[Glob]) -> Automaton:
        symbols: list[tuple[int, int | None]] = []
        loops, host_loops, starts, accept = [], [], [], []
        bits = 0
        for glob in globs:
            starts.append(bits)
            for at, c in enumerate(glob.pattern.encode()):
                if c == ord("*"):
                    (host_loops if glob.in_host and at == 0 else loops).append(bits)
                else:
                    bits += 1
                    symbols.append((bits, None if c == ord("?") else c))
            accept.append(divmod(bits, 64))
            bits += 1
        words = -(-bits // 64) or 1
        mask = np.zeros((260, words), dtype=np.uint64)
        for bit, c in symbols:
            mask[slice(0, 256) if c is None else c, bit // 64] |= np.uint64(1 << bit % 64)
        for row, own in ((256, loops), (257, starts), (258, host_loops)):
            for bit in own:
                mask[row, bit // 64] |= np.uint64(1 << bit % 64)
        return cls(mask[:256], mask[256], mask[256] | mask[258], mask[257], accept, globs)

    def run(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which globs match each URL: a boolean row each."""
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        state = np.repeat(self.begin[None, :], len(size), axis=0)
        longest = int(size.max(initial=0))
        alive = np.searchsorted(-size[order], -np.arange(1, longest + 1), side="right")
        first = offsets[:-1][order]
        one, top = np.uint64(1), np.uint64(63)
        keep = np.repeat(self.keep_host[None, :], 256, axis=0)
        keep[ord("/")] = self.keep
        for at in range(longest):
            n = int(alive[at])
            now = state[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            byte = data[first[:n] + at]
            state[:n] = (moved & self.step[byte]) | (now & keep[byte])
        out = np.zeros((len(size), len(self.accept)), dtype=bool)
        for k, (word, bit) in enumerate(self.accept):
            out[order, k] = (state[:, word] >> np.uint64(bit)) & one != 0
        return out


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column; both empty without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.substring(text, F.instr(text, "://") + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, globs: list[tuple[str, str]] = GLOBS, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, the winning host rule or null, the glob that decided, and the verdict. No shuffle."""
    spark = pages.sparkSession
    bound_arrow_batches(spark)
    every = rule_globs(rules) + [Glob(p, v) for p, v in globs]
    known = spark.sparkContext.broadcast(Automaton.build(every))
    rank = sorted(range(len(every)), key=lambda k: (-every[k].weight, k))

    def judge(batches):
        machine = known.value
        for batch in batches:
            data, offsets = utf8_buffers(batch.column(3))
            hit = machine.run(data, offsets)[:, rank]
            first = np.where(hit.any(axis=1), hit.argmax(axis=1), -1).tolist()
            won = [every[rank[k]] if k >= 0 else Glob("", default) for k in first]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([g.rule for g in won], pa.string()), pa.array([g.pattern or None for g in won], pa.string()), pa.array([g.verdict for g in won], pa.string())], names=["page_id", "host", "path", "rule", "glob", "verdict"])

    host, path = host_path(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    return parts.withColumn("line", F.concat("host", "path")).mapInArrow(judge, "page_id long, host string, path string, rule string, glob string, verdict string")


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("glob")


def op6_sql() -> str:
    fits = []
    for rule, verdict in sorted(RULES, key=lambda r: (-len(r[0]), RULES.index(r))):
        host, _, path = rule.partition("/")
        fits.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')", rule, verdict))
    other = " ".join(f"WHEN (host || path) LIKE '{p.replace('*', '%')}' THEN '{v}'" for p, v in GLOBS if "_" not in p)
    return f"""
    WITH cut AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
    SELECT page_id, host, path, CASE {' '.join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits)} END AS rule,
      CASE {' '.join(f"WHEN {f} THEN '{v}'" for f, _, v in fits)} {other} ELSE '{DEFAULT}' END AS verdict FROM parts"""
