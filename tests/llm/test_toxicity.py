"""Toxicity: held-out accuracy, gapped insults, edge cases."""

import itertools
import math
import random

import numpy as np
import pytest

from tallyloom.llm import toxicity as tx

INSULTS = ["zorkel", "grubnik", "flatzen"]


def rows(n):
    words = "the river flows along green fields near a mill where people grow some barley and you are really calm".split()
    rng = random.Random(9)
    out = []
    for i in range(n):
        toxic = i % 4 == 0
        text = " ".join(rng.choice(words) for _ in range(12)) + "."
        out.append((i, text + (f" You are a {INSULTS[i % 3]}, really." if toxic else " What a day."), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model(spark):
    data = rows(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(7, None)], "doc_id long, toxic int")
    return docs, labels, tx.train(docs, labels)


def naive_features(unit):
    """All ordered triples of a unit's letters, its start and its end, within the span; by loops over places."""
    places = [(0, 0)] + [(k + 1, int(tx._letter_codes()[ord(c)])) for k, c in enumerate(tx.plain(unit))] + [(len(tx.plain(unit)) + 1, 63)]
    out = {}
    for (p, a), (_, b), (r, c) in itertools.combinations(places, 3):
        if min(a, b, c) >= 0 and r - p < tx.SPAN:
            out[a, b, c] = out.get((a, b, c), 0) + tx.DECAY ** (r - p + 1)
    return out


def naive_kernel(x, y):
    fx, fy = naive_features(x), naive_features(y)
    norm = lambda f: math.sqrt(sum(v * v for v in f.values()))
    return sum(v * fy.get(k, 0) for k, v in fx.items()) / (norm(fx) * norm(fy)) if fx and fy else 0.0


UNITS = ["stupid", "s-t-u-p-i-d", "stu pid", "harvest", "st", "straße", "a1b2", "aaaaaaaa", "x.y.z.w"]


def test_kernel_against_loops_over_all_subsequences():
    gram = tx.Landmarks(UNITS).kernel(UNITS)
    assert np.allclose(gram, [[naive_kernel(x, y) for y in UNITS] for x in UNITS])
    assert gram[0, 1] > gram[0, 3] and gram[0, 2] > gram[0, 3]


def test_kernel_weights_equal_the_sum_over_landmarks():
    basis, alpha = UNITS[:5], np.array([0.5, -1.0, 2.0, 0.25, -0.75])
    model = tx.Model(tx.expansion(basis, alpha), 0.125)
    asked = [*UNITS, "stubid"]
    want = [0.125 + sum(a * naive_kernel(u, b) for a, b in zip(alpha, basis, strict=True)) for u in asked]
    assert np.allclose(model.margins(asked), want)


def test_stretches_of_sentences():
    known = frozenset(tx.junctions_of("idiot"))
    units = lambda t: tx.document_units(t, known)
    assert "id iot" in units("an id iot here") and "i diot" in units("an i diot here") and "id io t" in units("id io t")
    assert "id. iot" not in " ".join(units("an id. iot")) and "id iot" not in units("an id. Iot")
    assert "i d i o t" in units("i - d - i - o - t") and "i d i o t" in units("i d i o t")
    assert sorted(tx.neighbours("x id io t y id iot".split(), known)) == ["id io", "id io t", "id iot", "io t"]
    # A long run is one stretch, not one for each of its beginnings.
    assert len(tx.neighbours(["id", "io"] * 5000, frozenset({"id io", "io id"}))) == 10_000
    assert tx.word_pairs("Go away. You fool!") == {"go away", "you fool"}


def test_held_out_and_variants(model):
    docs, _, m = model
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", tx.fold(docs["doc_id"], tx.FOLDS).alias("f")).collect()}
    got = {r["doc_id"]: r["score"] for r in tx.score(docs, m).collect()}
    held = [i for i in got if fold[i] == tx.HELD_OUT]
    right = [(got[i] >= tx.THRESHOLD) == (i % 4 == 0) for i in held]
    assert len(held) > 50 and np.mean(right) > 0.97
    scorer = tx.Scorer(m)
    texts = ["you z-o-r-k-e-l", "you zorxkel", "z o r k e l", "a zor kel here", "z - o - r - k - e - l", "the river flows", None, ""]
    scores = [m.score(x) for x, _ in scorer.worst(texts)]
    assert all(s >= tx.THRESHOLD for s in scores[:5]) and all(s < tx.THRESHOLD for s in scores[5:])


def test_words_that_insult_only_together(spark):
    rng = random.Random(4)
    words = "river barley mill field green calm day road stone lamp".split()
    rows = []
    for i in range(400):
        say = [rng.choice(words) for _ in range(14)] + ["rotten", "apple"]
        rng.shuffle(say)
        say = [w for k, w in enumerate(say) if not (w == "apple" and k and say[k - 1] == "rotten")] + ["apple"]
        toxic = i % 4 == 0
        rows.append((i, " ".join(say) + (". You rotten apple now." if toxic else ". A calm day."), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    m = tx.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    scorer = tx.Scorer(m)
    assert [m.score(a) >= tx.THRESHOLD for a, _ in scorer.worst(["a rotten apple now", "an apple, a rotten day", "rotten. Apple"])] == [True, False, False]


def test_edges(spark, model):
    docs, labels, m = model
    odd = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "zorkel " * 50_000, "b"), (3, "", "c")], "doc_id long, text string, score string")
    assert tx.score(odd, m).count() == 4
    kept = tx.drop_toxic(odd, m)
    assert kept.columns == odd.columns and kept.count() == 3
    empty = tx.train(docs.limit(0), labels)
    assert {r["score"] for r in tx.score(odd, empty).collect()} == {empty.score(None), empty.score(-1.0)}
    assert tx.score(docs.limit(0), m).count() == 0
