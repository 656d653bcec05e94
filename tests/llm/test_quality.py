"""The byte-level network: gradients, coverage of whole texts, held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import quality as ql


def offsets(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))


def test_gradients_match_differences():
    net = ql.Network.start()
    for name in ("table", "filters", "offset", "top", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    texts = [b"some plain words here " * 20, b"%%% $$$ &&&", b"", b"x" * 700]
    y, w = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 1])

    def loss():
        p = ql.probabilities(net, *offsets(texts))
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    grads = ql.step_gradients(net, *offsets(texts), y, w)
    rng = np.random.default_rng(0)
    for p, g in zip(net.parameters(), grads, strict=True):
        flat, gf = p.reshape(-1), np.asarray(g).reshape(-1)
        for k in rng.integers(0, len(flat), 6):
            old = flat[k]
            flat[k] = old + 1e-4
            up = loss()
            flat[k] = old - 1e-4
            down = loss()
            flat[k] = old
            assert (up - down) / 2e-4 == pytest.approx(gf[k], abs=2e-4)


def test_chunks_cover_every_block():
    first = np.array([0, 1, 5, 17, 117])
    members, start = ql.chunks(first)
    for t in range(4):
        assert set(members[start[t] : start[t + 1]].ravel()) == set(range(first[t], first[t + 1]))


def test_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(5)
    net = ql.Network.start()
    texts = [bytes(rng.integers(32, 127, int(n)).astype(np.uint8)) for n in (0, 3, 52, 53, 58, 64, 200, 500, 5000)] + [b"ab cd " * 30]
    whole = ql.probabilities(net, *offsets(texts))
    alone = [ql.probabilities(net, *offsets([t]))[0] for t in texts]
    back = ql.probabilities(net, *offsets(texts[::-1]))[::-1]
    assert np.allclose(whole, alone, atol=1e-6) and np.allclose(whole, back, atol=1e-6)


def test_repeats():
    padded, first = ql.layout(*offsets([b"x" * 50 + b"abcd efgh abcd", b"abcdefghijkl" * 6]))
    flags = ql.repeats(padded, first)
    assert flags[63] and not flags[55] and not flags[:44].any() and flags[int(first[1]) * ql.BLOCK + 60]


def test_held_out(spark):
    rng = np.random.default_rng(1)
    words = ["river", "mill", "field", "barley", "people", "green", "the", "and"]
    rows = []
    for i in range(400):
        good = i % 3 > 0
        text = " ".join(rng.choice(words, rng.integers(5, 80)))
        rows.append((i, text if good else "".join(w + "$$$ " for w in text.split()), int(good)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(3, None)], "doc_id long, quality int")
    net = ql.train(docs, labels)
    out = ql.score(docs, net).withColumn("held", ql.fold(F.col("doc_id"), ql.FOLDS) == ql.HELD_OUT).filter("held").collect()
    assert len(out) > 40 and np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in out]) > 0.95
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (None, "é" * 200_000, "b"), (1, None, "a")], "doc_id long, text string, score string")
    scored = ql.score(odd, net).collect()
    assert len(scored) == 4 and all(0 <= r["score"] <= 1 for r in scored) and scored[0]["score"] == scored[1]["score"]
    assert ql.keep_good(odd, net, 0.0).count() == 4 and ql.keep_good(odd, net).columns == odd.columns
    assert ql.train(docs, labels.limit(0)) == 0.5
    assert ql.train(docs, labels.filter("quality = 1")) == 1.0
    assert ql.score(docs.limit(0), net).count() == 0


def naive_probability(net, text):
    """The network by loops over one text: every filter at every place, chunks of blocks, mean and maximum over chunks."""
    blocks = -(-(len(text) + 2 * ql.WIDTH) // ql.BLOCK)
    padded = list(text) + [0] * (blocks * ql.BLOCK - len(text))
    back = lambda p: any(p - lag - 3 >= 0 and padded[p - 3 : p + 1] == padded[p - lag - 3 : p - lag + 1] for lag in range(2, ql.LAGS + 1))
    repeat = [float(p >= ql.LAGS + 4 and padded[p] != 0 and back(p)) for p in range(len(padded))]
    peaks = []
    for b in range(blocks):
        best = [-1e9] * ql.FILTERS
        for p in range(b * ql.BLOCK, (b + 1) * ql.BLOCK):
            if p + ql.WIDTH > len(padded):
                continue
            seen = [v for q in range(p, p + ql.WIDTH) for v in (*net.table[padded[q]].tolist(), repeat[q])]
            best = [max(x, sum(s * w for s, w in zip(seen, net.filters[:, f].tolist(), strict=True))) for f, x in enumerate(best)]
        peaks.append([max(0.0, x + float(o)) for x, o in zip(best, net.offset, strict=True)])
    starts = range(0, 1 + ql.HOP * -(-max(blocks - ql.CHUNK, 0) // ql.HOP), ql.HOP)
    pooled = [[max(peaks[min(s + k, blocks - 1)][f] for k in range(ql.CHUNK)) for f in range(ql.FILTERS)] for s in starts]
    x = [sum(p[f] for p in pooled) / len(pooled) for f in range(ql.FILTERS)] + [max(p[f] for p in pooled) for f in range(ql.FILTERS)]
    return 1 / (1 + np.exp(-(float(np.dot(x, net.top)) + float(net.bias[0]))))


def test_forward_pass_against_loops():
    net = ql.Network.start()
    texts = [b"", b"plain words", b"the same the same the same " * 9, bytes(range(1, 250)) * 3]
    got = ql.probabilities(net, *offsets(texts))
    assert got == pytest.approx([naive_probability(net, t) for t in texts], abs=1e-5)
