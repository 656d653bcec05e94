"""Near-duplicates against brute force; sketches against exact similarity."""

import random

import numpy as np
import pyarrow as pa

from tallyloom.llm import neardup as nd
from tallyloom.llm.bytetext import utf8_buffers, words
from tallyloom.llm.graph import components, contract
from tallyloom.session import Scratch


def shingle_set(text):
    hashes, row, _, _ = words(*utf8_buffers(pa.array([text])))
    return set(nd.weighed(hashes, row, 1)[1].tolist())


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        parent[root(a)] = root(b)
    out = {}
    for n in nodes:
        out.setdefault(root(n), set()).add(n)
    return sorted(map(sorted, out.values()))


def test_sketches_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        n = 400
        common, a, b = rng.integers(0, 1 << 48, int(n * share)), rng.integers(0, 1 << 48, n - int(n * share)), rng.integers(0, 1 << 48, n - int(n * share))
        sets = [np.unique(np.concatenate((common, x))).astype(np.uint64) for x in (a, b)]
        weights = [1 + (s % np.uint64(3)).astype(float) for s in sets]
        row = np.repeat([0, 1], [len(s) for s in sets])
        drawn = nd.sketch(row, np.concatenate(sets), np.concatenate(weights), 2, 2000)
        w = [dict(zip(s.tolist(), x.tolist(), strict=True)) for s, x in zip(sets, weights, strict=True)]
        exact = sum(1 / sum(max(w[0].get(e, 0) / w[0][d], w[1].get(e, 0) / w[1][d]) for e in w[0].keys() | w[1].keys()) for d in w[0].keys() & w[1].keys())
        assert abs((drawn[0] == drawn[1]).mean() - exact) < 0.05


def test_similarity_of_weighted_sets():
    a = np.array([1, 2, 3, 4], np.uint64) | (np.array([1, 5, 1, 2], np.uint64) << np.uint64(48))
    b = np.array([2, 3, 9], np.uint64) | (np.array([1, 1, 4], np.uint64) << np.uint64(48))
    x, y = ({int(v & np.uint64((1 << 48) - 1)): 1 + np.log(int(v >> np.uint64(48))) for v in s} for s in (a, b))
    exact = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())
    assert abs(nd.similarity(a.tobytes(), b.tobytes()) - max(exact, 2 / 5)) < 1e-12
    assert nd.similarity(a.tobytes(), a.tobytes()) == 1


def test_contract_and_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    nodes = {n for e in edges for n in e}
    got = dict(zip(*(x.tolist() for x in contract(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))), strict=True))
    want = groups(edges, nodes)
    assert sorted(sorted(n for n in got if got[n] == r) for r in set(got.values())) == want
    df = spark.createDataFrame(edges, "a long, b long")
    scratch = Scratch(spark, "test")
    for block in (1000, 20):
        labels = {r["node"]: r["label"] for r in components(scratch.table(df, "in"), scratch, block_edges=block).collect()}
        assert labels == {n: min(g) for g in want for n in g}


def corpus(seed=1, families=12, most=30):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "bcdfghjk" for b in ("ara", "elo", "imu", "ony", "uti")]
    texts = []
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(1, most)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy).capitalize() + rng.choice([".", "!", " "]))
        del f
    texts += [None, "", "?!", "One line. " * 300, "One line. " * 300 + "and another"]
    rng.shuffle(texts)
    return texts


def brute(texts):
    sets = [shingle_set(t) if t else set() for t in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return pairs, groups(pairs, range(len(texts)))


def test_classes_match_brute_force(spark, monkeypatch):
    texts = corpus()
    pairs, want = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for few, chunk in ((nd.FEW, nd.CHUNK), (0, 8)):
        monkeypatch.setattr(nd, "FEW", few)
        monkeypatch.setattr(nd, "CHUNK", chunk)
        got = {}
        for r in nd.near_classes(docs).collect():
            got.setdefault(r["class_id"], set()).add(r["doc_id"])
        mine = sorted(map(sorted, got.values()))
        where = {d: k for k, g in enumerate(mine) for d in g}
        # Every link of set Jaccard is kept; what is merged beyond has a probability Jaccard of the threshold.
        assert all(where[a] == where[b] for a, b in pairs)
        assert len(mine) >= len(want) - 2


def test_one_document_of_each_class_stays(spark):
    texts = corpus(2, 6, 10)
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s"), (None, "all alone in this text of words", "x"), (50_000, "all alone in this text of words", "y")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node string, kept_rows int")
    kept = nd.drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.collect())
    classes = {}
    for r in nd.near_classes(docs).collect():
        classes.setdefault(r["class_id"], []).append(r["doc_id"])
    wordless = [i for i, t in enumerate(texts) if not t or t == "?!"]
    assert len(got) == len(set(got)) and set(wordless) <= set(got)
    assert set(got) == {min(x for x in c if x is not None) for c in classes.values()}
    assert nd.near_classes(docs.limit(0)).count() == 0 and nd.drop_near_copies(docs.limit(0)).count() == 0


def test_busy_probes_ask_when_the_largest_component_changes(spark):
    """A bucket where the busy probes' component has outgrown the one that was largest when they were found."""
    old, new = [1, 2, 3], [10, 11, 12, 13]
    rows = spark.createDataFrame([(7, n, 1) for n in old] + [(7, n, 10) for n in new], "band long, node long, label long")
    met = lambda busy: {(p, m) for p in asked(busy) for m in old + new}

    def asked(busy):
        got = nd._chunks(rows, spark.createDataFrame([(7, n) for n in busy], "band long, node long")).collect()
        assert {r["node"] for r in got if r["role"] == 0} >= (set(old + new) if any(r["role"] == 1 for r in got) else set())
        return {r["node"] for r in got if r["role"] == 1}

    # Members 10 and 11 were probes of the component 1 and busy; now theirs is the largest.
    pairs = met([10, 11])
    assert all((a, b) in pairs or (b, a) in pairs for a in (10, 11) for b in old)
    assert asked([2]) == {2}


def test_copies_with_repeated_lines_are_linked(spark):
    """A fifth of the text's lines repeated: the sets stay alike while the weighted sketches part."""
    rng = random.Random(3)
    rows = []
    for f, times in enumerate((10, 100, 1000, 1000, 100, 300)):
        lines = [" ".join(f"{rng.choice('bcdfgh')}{rng.randrange(10**6)}" for _ in range(5)) for _ in range(40)]
        more = "\n".join("\n".join(lines) if k == 0 else "\n".join(lines[-8:]) for k in range(times))
        rows += [(10 * f, "\n".join(lines)), (10 * f + 1, more)]
    sets = [shingle_set(t) for _, t in rows]
    near = {rows[2 * k][0] for k in range(len(rows) // 2) if len(sets[2 * k] & sets[2 * k + 1]) >= 0.8 * len(sets[2 * k] | sets[2 * k + 1])}
    got = {r["doc_id"]: r["class_id"] for r in nd.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) == 6 and all(got[d] == got[d + 1] == d for d in near)
