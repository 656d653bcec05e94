"""Audits against counts by loops; what must hold and doesn't is an error."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import audits as au
from tallyloom.operators import classify
from tallyloom.operators.expect import ExpectationError


def table(df):
    return {(r["audit"], r["arm"], r["measure"]): r["value"] for r in df.collect()}


def test_occurrences_labels_and_sample_by_loops(spark):
    rng = random.Random(2)
    votes = [(i % 40, i, "xy"[i % 40 % 2], *[rng.random() < 0.4 for _ in range(3)]) for i in range(90)]
    frame = lambda rows: spark.createDataFrame(rows, "item int, occ int, arm string, a boolean, b boolean, c boolean")
    got = table(au.occurrence_audit(frame(votes), ["item"], "occ", "arm", ["a", "b", "c"]))
    for arm in ("x", "y", au.ALL):
        own = [v for v in votes if arm in (v[2], au.ALL)]
        good = {v[0] for v in own if sum(v[3:]) >= 2}
        items = {v[0] for v in own}
        assert [got["occurrences", arm, m] for m in ("items", "occurrences", "true_positive", "false_positive", "precision")] == [len(items), len(own), len(good), len(items - good), len(good) / len(items)]
    for bad in (votes + votes[:1], votes + [(1, 900, "x", True, True, None)], votes + [(1, 901, "x", True, True, True)]):
        with pytest.raises(ExpectationError):
            au.occurrence_audit(frame(bad), ["item"], "occ", "arm", ["a", "b", "c"])
    nothing = table(au.occurrence_audit(frame(votes).limit(0), ["item"], "occ", "arm", ["a", "b", "c"]))
    assert nothing["occurrences", au.ALL, "items"] == 0 and nothing["occurrences", au.ALL, "precision"] is None

    labels = [(i, "xy"[i % 2], *[rng.choice("pq") for _ in range(3)]) for i in range(50)]
    frame = lambda rows: spark.createDataFrame(rows, "item int, arm string, a string, b string, c string")
    got = table(au.label_audit(frame(labels), ["item"], "arm", ["a", "b", "c"], ("p", "q")))
    assert got == {("labels", arm, x): n for arm in ("x", "y", au.ALL) for x in "pq" if (n := sum(v[2:].count(x) >= 2 and arm in (v[1], au.ALL) for v in labels))}
    for bad in (labels + labels[:1], labels + [(99, "x", "p", "q", "r")], labels + [(99, "x", "p", "q", None)]):
        with pytest.raises(ExpectationError):
            au.label_audit(frame(bad), ["item"], "arm", ["a", "b", "c"], ("p", "q"))
    with pytest.raises(ValueError):
        au.label_audit(frame(labels), ["item"], "arm", ["a", "b"], ("p", "q"))

    sample = [(i, rng.choice(["yes", "no", "open"]), rng.random() < 0.5, "st"[i % 2], [2.0, 5.0][i % 2], [0.5, 0.2][i % 2]) for i in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "item int, said string, perf boolean, stratum string, w double, p double")
    audit = lambda rows: au.sample_audit(frame(rows), ["item"], "said", "yes", "no", "open", "perf", "stratum", "w", "p")
    got = table(audit(sample))
    for arm, weight in (("raw", lambda r: 1.0), ("weighted", lambda r: r[4])):
        total = lambda p, t: sum(weight(r) for r in sample if r[1] != "open" and r[2] == p and (r[1] == "yes") == t)  # noqa: E731, B023
        tp, fp, fn = total(True, True), total(True, False), total(False, True)
        assert [got["sample", arm, m] for m in ("tp", "fp", "fn", "tn")] == [tp, fp, fn, total(False, False)]
        assert [got["sample", arm, m] for m in ("precision", "recall", "f1")] == pytest.approx([tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn)])
    assert got["sample", au.ALL, "sample_n"] == 60 and got["sample", au.ALL, "decided_n"] == sum(r[1] != "open" for r in sample) and got["sample", "s", "sampled"] == 30
    audit([*sample, (99, "open", True, "s", None, None)])
    for bad in ([*sample, sample[0]], [*sample, (99, "maybe", True, "s", 2.0, 0.5)], [*sample, (99, "yes", True, "s", 3.0, 0.5)], [*sample, (99, "yes", True, "s", None, 0.5)]):
        with pytest.raises(ExpectationError):
            audit(bad)


def test_revalidation_recovers_but_never_rewrites_what_is_bound_elsewhere(spark):
    requests = spark.createDataFrame([(k, f"h{k}", f"text {k}") for k in range(4)], "id int, digest string, body string")
    frame = lambda rows: spark.createDataFrame(rows, "id int, digest string, quote string, state string")
    again = lambda rows: au.revalidate(frame(rows), requests, ["id"], ["digest"], "state", {"empty": F.length("quote") > 0, "quote": F.contains("body", "quote")})
    rows = [(0, "h0", "text", "classified"), (1, "h1", "ext 1", "error"), (2, "h2", "none", "error"), (3, "h3", None, "error")]
    assert sorted(map(tuple, again(rows).collect())) == [(0, "classified", "classified", None), (1, "error", "classified", None), (2, "error", "error", "quote"), (3, "error", "error", "empty")]
    assert again([]).count() == 0
    for bad in ([(0, "h1", "text", "error")], [(0, None, "text", "error")], [(9, "h9", "text", "error")], [(0, "h0", "no", "classified")], [rows[0], rows[0]]):
        with pytest.raises(ExpectationError):
            again(bad)


def test_labelled_samples_and_sources(spark):
    rows = spark.createDataFrame([(k, "x") for k in range(6)], "id int, extra string")
    valid = spark.createDataFrame([(0,), (1,), (1,), (2,)], "id int")
    first = spark.createDataFrame([(0, "p"), (1, "none"), (2, "q"), (5, "p")], "id int, pattern string")
    second = spark.createDataFrame([(0, True), (1, False), (2, False)], "id int, present boolean")
    made = lambda a, b: au.labelled_sample(rows, valid, "id", a, b, "pattern", "present", "none")
    assert sorted(map(tuple, made(first, second).collect())) == [(0, "x", "p", True), (2, "x", "q", False)]
    for a, b in ((first.filter("id <> 2"), second), (first, second.filter("id <> 1")), (first.union(first), second)):
        with pytest.raises(ExpectationError):
            made(a, b)
    loose = spark.createDataFrame([("['Comment', 'description']",), ("CODE DIFF",), ("other",), (None,)], "v string")
    names = {"description": "description", "comment": "comments", "code diff": "code_diff"}
    assert [r[0] for r in loose.select(au.keyword_sources(F.col("v"), names)).collect()] == ["description|comments", "code_diff", "", ""]
    said = spark.createDataFrame([(" AI Agent",), ("human agent",), ("Humans",), ("Bot ",), (" ",), (None,)], "v string")
    assert [r[0] for r in said.select(classify.author_group(F.col("v"))).collect()] == ["agent", "agent", "human", "bot", "unknown", "unknown"]


def test_frozen_requests_pack_occurrences_and_refuse_what_changed(spark):
    frozen = spark.createDataFrame([(1, "one"), (2, None)], "id int, text string")
    status = spark.createDataFrame([(1, "complete"), (2, "complete"), (3, "partial")], "id int, state string")
    found = spark.createDataFrame([(1, "b", "D2"), (1, "a", "D1"), (1, "a", "D1"), (7, "z", "D1")], "id int, occ string, dim string")
    made = lambda s, f, st, most=100: au.frozen_requests(s, f, st, found, ["id"], F.col("state") == "complete", "occ", "dim", F.concat(F.lit("say "), F.coalesce("text", F.lit(""))), most)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted(map(tuple, made(frozen, frozen.union(frozen), status).collect())) == [(1, digest("say one"), 7, 2, "a=D1|b=D2"), (2, digest("say "), 4, 0, "")]
    assert made(frozen.limit(0), frozen.limit(0), status).count() == 0
    for bad in ((frozen.filter("id = 1"), frozen, status), (frozen, frozen, status.filter("id <> 2")), (frozen, frozen, status.union(status)), (frozen, frozen, status.withColumn("state", F.lit("partial"))), (frozen, frozen, status, 6)):
        with pytest.raises(ExpectationError):
            made(*bad)
