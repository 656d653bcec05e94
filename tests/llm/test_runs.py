"""Periodic runs against all starts and periods tried one by one."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import runs


def brute(words, least=runs.LEAST, exponent=runs.EXPONENT):
    """Every run of a list of words, by definition."""
    out, n = set(), len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, exponent * q) and not any(all(words[x] == words[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(docs, **limits):
    flat = np.array([w for d in docs for w in d], dtype=np.uint64)
    of, (s, n, q) = runs.find_runs(flat, np.array([len(d) for d in docs], dtype=np.int64), **limits)
    out = [[] for _ in docs]
    for d, *run in zip(of.tolist(), s.tolist(), n.tolist(), q.tolist()):
        out[d].append(tuple(run))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=5))
def test_small_alphabets(docs):
    assert found(docs) == [brute(d) for d in docs]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=24), max_size=3))
def test_all_cubes(docs):
    assert found(docs, least=3, exponent=3) == [brute(d, 3, 3) for d in docs]


def test_periods_within_periods_and_across_documents():
    draw = random.Random(4)
    docs = []
    for _ in range(60):
        root = [draw.randrange(50) for _ in range(draw.randrange(1, 9))]
        body = root * draw.randrange(3, 12) + root[: draw.randrange(len(root))]
        body = (body + [99]) * draw.choice([1, 1, 4, 6])
        docs.append([draw.randrange(50) for _ in range(draw.randrange(20))] + body + [draw.randrange(50) for _ in range(draw.randrange(20))])
    docs += [[7] * 5, [7] * 6, [], [1, 2] * 4, [1, 2] * 3 + [1], [7] * 3, [7] * 3]
    got = found(docs)
    assert got == [brute(d) for d in docs]
    assert got[-7:] == [[], [(0, 6, 1)], [], [(0, 8, 2)], [], [], []]


def test_long_periodic_text():
    words = np.array(([3, 1, 4, 1, 5, 9, 2, 6] * 40_000)[:-3], dtype=np.uint64)
    of, (s, n, q) = runs.find_runs(words, np.array([len(words)]))
    assert (of.tolist(), s.tolist(), n.tolist(), q.tolist()) == ([0], [0], [len(words)], [8])


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    rs = brute(words)
    gone = {k for s, length, q in rs for k in range(s + q, s + length)}
    best = min(rs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if rs else None
    return (doc_id, len(rs), *best, milli, digest("".join(f"{s},{k},{q}\n" for s, k, q in rs)), digest(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_query_against_brute_force(spark, tmp_path):
    """Nulls, empty and very long texts, odd spaces, repeated rows, equally long runs and a clashing extra column."""
    draw = random.Random(9)
    rows = [(None, None), (None, "a b " * 9), (1, ""), (2, " \t\n"), (3, "x" * 3000), (4, "la la la la la la"), (4, "la la la la la la"), (5, "a a a a a a b c c c c c c"), (6, "é é é é " * 7), (7, "\x1ca b\x0bc\x0cd\r\ne " * 5)]
    rows += [(k, " ".join(draw.choice(["un", "deux", "Trois", "trois"]) for _ in range(draw.randrange(120)))) for k in range(10, 90)]
    rows += [(k, " ".join(f"w{draw.randrange(400)}" for _ in range(300))) for k in range(90, 130)]
    rows += [(131, "tic tac toe " * 30_000)]
    spark.createDataFrame([(i, t, 5, "z") for i, t in rows], "doc_id long, text string, n_runs int, start string").write.parquet(f"{tmp_path}/documents.parquet")
    out = runs.op12_runs(spark, str(tmp_path))
    got = sorted(map(tuple, out.collect()), key=str)
    small = [r for r in rows if r[0] != 131]
    assert [r for r in got if r[0] != 131] == sorted((expected(*r) for r in small), key=str)
    (long,) = [r for r in got if r[0] == 131]
    if zlib.crc32(b"131") % 10:
        assert long[1:6] == (1, 0, 90_000, 3, 30_000_000) and long[7] == digest("tic tac toe")


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert runs.op12_runs(spark, str(tmp_path)).count() == 0
