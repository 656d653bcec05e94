"""Repeated passages against the definition, window by window."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import anchors

W = anchors.WINDOW


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(texts):
    """Kept words of each text, by definition."""
    held = [split(t) for t in texts]
    seen = Counter(tuple(ws[k : k + W]) for ws in held for k in range(len(ws) - W + 1))
    out = []
    for ws in held:
        gone = {k + d for k in range(len(ws) - W + 1) if seen[tuple(ws[k : k + W])] > 1 for d in range(W)}
        out.append([w for k, w in enumerate(ws) if k not in gone])
    return held, out


def corpus():
    draw = random.Random(5)
    fresh = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    shared = [fresh(n) for n in (34, 35, 36, 52, 53, 120, 400)]
    texts = []
    for k in range(150):
        parts = fresh(draw.randrange(60))
        for _ in range(draw.randrange(4)):
            s = draw.choice(shared)
            a = draw.randrange(len(s))
            parts += (s if k % 3 else s[a:]) + fresh(draw.randrange(40))
        texts.append(" ".join(parts))
    texts += texts[:20] + texts[:3]  # copies
    texts += ["la " * 34, "la " * 35, "lo " * 36, "da di " * 60, "a b c " * 2000]
    edited = [list(shared[6]) for _ in range(6)]
    for k, e in enumerate(edited):
        e[37 * (k + 1)] = f"edit{k}"
    texts += [" ".join(e) for e in edited]
    texts += [None, "", " \n\t", "Word one \x1cb\x0bc", "x" * 5000]
    return texts


def expected(rows):
    held, kept = brute([t for _, t in rows])
    return sorted(((i, len(h), len(h) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for (i, _), h, k in zip(rows, held, kept, strict=True)), key=str)


def test_query_against_brute_force(spark, tmp_path):
    """Passages around the window's length, edits, copies, nulls, repeated rows and a clashing extra column."""
    rows = list(enumerate(corpus()))
    rows += [rows[7], (None, "alone " + "here"), (None, rows[9][1])]
    spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, copies int, k1 string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, anchors.op11_anchors(spark, str(tmp_path)).collect()), key=str) == expected(rows)


def test_many_flushes_and_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(anchors, "RANGE_BYTES", 1000)
    rows = list(enumerate(corpus()[:120]))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(9).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, anchors.op11_anchors(spark, str(tmp_path)).collect()), key=str) == expected(rows)


def test_hot_passage_and_very_long_text(spark, tmp_path):
    """A passage in every text at any offset, and a text of 200,000 words that repeats it now and then."""
    draw = random.Random(8)
    hot = " ".join(f"h{k}" for k in range(50))
    rows = [(k, " ".join(f"u{draw.randrange(10**9)}" for _ in range(draw.randrange(40))) + " " + hot + f" end{k}") for k in range(400)]
    rows.append((1000, " ".join(f"v{k}" if k % 997 else hot for k in range(200_000))))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in anchors.op11_anchors(spark, str(tmp_path)).collect()}
    assert all(got[k]["n_removed"] == 50 for k in range(400)) and got[1000]["n_removed"] == 50 * 201


def test_spans_and_texts_without_repeats(spark):
    rows = [(1, "p " + " ".join(map(str, range(40))) + " q", 9, "de"), (2, " ".join(map(str, range(40))), 5, None), (3, "no  repeats\there", 15, "en"), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, kept string")
    spans = sorted((r["n_words"], [tuple(s) for s in r["repeats"]]) for r in anchors.passages(docs).collect())
    assert spans == [(0, []), (3, []), (40, [(0, 40)]), (42, [(1, 41)])]
    out = anchors.drop_repeats(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, "p q", 3, "de"), (2, "", 0, None), (3, "no  repeats\there", 15, "en"), (4, None, None, None)]
    assert anchors.drop_repeats(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, (1 << 62) - 1), max_size=200))
def test_packing_gives_back(values):
    v = np.sort(np.array(values, dtype=np.uint64))
    assert (anchors.unpack(anchors.pack(v), len(v)) == v).all() if len(v) else True


def test_every_window_holds_one_block():
    for n in range(W, 120):
        blocks = list(range(n // anchors.BLOCK))
        assert anchors._marked([blocks], np.array([n])).sum() == n - W + 1
        for b in blocks:
            starts = np.flatnonzero(anchors._marked([[b]], np.array([n])))
            assert starts.tolist() == [s for s in range(n - W + 1) if s <= b * anchors.BLOCK and (b + 1) * anchors.BLOCK <= s + W]
