"""Atomic files, bound checkpoints, corrections and retries with their evidence, cutting by tokens."""

import hashlib
import threading

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import tokens as tk
from tallyloom.operators import corrections as co
from tallyloom.sources import atomic, sinks
from tallyloom.streaming import incremental as inc

# Files -------------------------------------------------------------------------------------------


def test_files_are_replaced_whole(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/deep/er/state.json"
    assert atomic.read_json(spark, path) is None
    digest = atomic.write_json(spark, path, {"b": [1, "é"], "a": None})
    text = atomic.read_text(spark, path)
    assert atomic.read_json(spark, path) == {"b": [1, "é"], "a": None} and digest == hashlib.sha256(text.encode()).hexdigest() and text.index('"a"') < text.index('"b"')
    atomic.write_text(spark, path, "")
    assert atomic.read_text(spark, path) == ""
    atomic.write_text(spark, path, "old")
    # What is read back differs: the old file stays, and nothing is left beside it.
    with monkeypatch.context() as m:
        m.setattr(atomic._Store, "read", lambda self, p: b"broken")
        with pytest.raises(atomic.WriteError):
            atomic.write_text(spark, path, "new")
    assert atomic.read_text(spark, path) == "old"
    assert [p.name for p in (tmp_path / "deep/er").iterdir() if not p.name.endswith(".crc")] == ["state.json"]


def test_one_of_several_creates(spark, tmp_path):
    path, won = f"file://{tmp_path}/first", []
    tries = [threading.Thread(target=lambda k=k: won.append((atomic.create_text(spark, path, str(k)), k))) for k in range(6)]
    for t in tries:
        t.start()
    for t in tries:
        t.join()
    winners = [k for ok, k in won if ok]
    assert len(won) == 6 and len(winners) == 1 and atomic.read_text(spark, path) == str(winners[0])


def test_a_checkpoint_keeps_its_configuration(spark, tmp_path):
    source, out, state = (f"file://{tmp_path}/{x}" for x in ("source", "out", "state"))
    schema = spark.range(1).schema
    spark.range(8).repartition(2).write.parquet(source)
    stream = lambda: inc.file_stream(spark, source, schema, 1)
    inc.run_available(stream(), inc.write_batch(out), state, {"model": "a", "n": 1})
    spark.range(8, 10).write.mode("append").parquet(source)
    touched = []
    with pytest.raises(inc.OtherConfiguration):
        inc.run_available(stream(), lambda b, k: touched.append(k), state, {"model": "b", "n": 1})
    with pytest.raises(inc.OtherConfiguration):
        inc.run_until(stream(), lambda b, k: touched.append(k), state, lambda: False, {})
    assert not touched and spark.read.parquet(out).count() == 8
    inc.run_available(stream(), inc.write_batch(out), state, {"n": 1, "model": "a"})
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(10))


def test_printed_tables_by_lines(spark):
    df = spark.createDataFrame([(2, "b|c", None), (1, "a_b\nc", 0.5)], "id int, t string, x double")
    assert [r["value"] for r in sinks.markdown_lines(df, ["id"]).collect()] == ["| id | t | x |", "| --- | --- | --- |", "| 1 | a_b c | 0.5 |", r"| 2 | b\|c |  |"]
    assert [r["value"] for r in sinks.latex_lines(df, ["id"]).collect()] == [r"\begin{tabular}{lll}", r"\hline", r"id & t & x \\", r"\hline", r"1 & a\_b c & 0.5 \\", r"2 & b|c &  \\", r"\hline", r"\end{tabular}"]


# Evidence ----------------------------------------------------------------------------------------


def test_corrections_need_their_evidence(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    record = "Build took 5 min, now 3 min."
    records = spark.createDataFrame([(1, record), (1, record), (1, "other"), (2, "of two"), (1, None)], "id int, text string")
    labels = spark.createDataFrame([(1, k, "D1") for k in "abcdefghijkl"] + [(1, "m", "D2"), (2, "a", "D1")], "id int, item string, dimension string")
    fine = {"id": 1, "item": "a", "from_label": "D1", "to_label": "D7", "rationale": "build", "record_sha256": sha(record), "quotes": ["Build", "3 min"], "quantity": "5 min", "start": 11, "end": 16}
    changed = [
        ({}, None), ({"item": "b", "from_label": "D2"}, "another label"), ({"item": "c", "to_label": "D1"}, "no new label"), ({"item": "d", "to_label": "X"}, "no new label"), ({"item": "e", "rationale": " "}, "no rationale"),
        ({"item": "f", "record_sha256": sha("of two")}, "no such record"), ({"item": "g", "quotes": ["Build", "4 min"]}, "no evidence"), ({"item": "h", "quotes": []}, "no evidence"), ({"item": "i", "start": 12}, "quantity elsewhere"),
        ({"item": "z"}, "no such item"), ({"item": "j"}, "several corrections"), ({"item": "j", "to_label": "D3"}, "several corrections"), ({"item": "k", "quotes": None}, "no evidence"), ({"item": "l", "quotes": [""]}, "no evidence"), ({"item": "m", "from_label": "D2", "to_label": "D3"}, None),
    ]
    schema = "id int, item string, from_label string, to_label string, rationale string, record_sha256 string, quotes array<string>, quantity string, start int, end int"
    asked = spark.createDataFrame([tuple((fine | c).values()) for c, _ in changed], schema)
    judged = co.judged_corrections(asked, labels, records, ["id"], "item", "dimension", "text", [f"D{k}" for k in range(10)])
    got = sorted((r["item"], r["to_label"], r["problem"]) for r in judged.collect())
    assert got == sorted(((fine | c)["item"], (fine | c)["to_label"], p) for c, p in changed)
    out = {(r["id"], r["item"]): (r["dimension"], r["corrected"]) for r in co.correct_labels(labels, judged, ["id"], "item", "dimension").collect()}
    assert len(out) == 14 and {k: v for k, v in out.items() if v[1]} == {(1, "a"): ("D7", True), (1, "m"): ("D3", True)} and out[1, "b"] == ("D1", False)


def test_retries_answer_the_same_input(spark):
    base = spark.createDataFrame([(1, "error", "h1"), (2, "error", "h2"), (3, "ok", "h3"), (4, "error", None), (5, "error", "h5")], "id int, state string, sha string")
    retry = spark.createDataFrame([(1, "ok", "h1"), (2, "ok", "other"), (3, "ok", "h3"), (4, "ok", None), (5, "ok", "h5"), (5, "error", "h5"), (9, "ok", "h9")], "id int, state string, sha string")
    failed = F.col("state") == "error"
    problems = {r["id"]: r["problem"] for r in co.retry_problems(base, retry, ["id"], failed, "sha").collect()}
    assert problems == {2: "another input", 3: "not an error", 5: "repeated", 9: "not an error"}
    out = sorted((r["id"], r["state"], r["sha"]) for r in co.replace_errors(base, retry, ["id"], failed, "sha").collect())
    assert out == [(1, "ok", "h1"), (2, "error", "h2"), (3, "ok", "h3"), (4, "ok", None), (5, "error", "h5")]


# Tokens ------------------------------------------------------------------------------------------

PAIRS = "th he in er an re on at en nd the ing and ent tion ion to or is it as es ed ar te ti io ll lle aa aaa aaaa ab aba bab é".split()
RANKS = {bytes([k]): k for k in range(256)} | {p.encode(): 256 + k for k, p in enumerate(PAIRS) if len(p.encode()) > 1}


def naive(piece, ranks):
    """Merge the lowest pair, the leftmost of several, looking at all of them each time."""
    if piece in ranks:
        return [piece]
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while True:
        pairs = [(ranks[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in ranks]
        if not pairs:
            return parts
        _, k = min(pairs)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="abeaéhntidolr ", max_size=40))
def test_merges_against_repeated_scans(text):
    pieces = regex.compile(tk.WORDS)
    want = [t for m in pieces.finditer(text) for t in naive(m[0].encode(), RANKS)]
    assert list(tk.tokens(text, RANKS, pieces)) == want
    for most in (0, 1, 3, len(want), len(want) + 1):
        assert tk.cut(text, most, RANKS, pieces) == (text if len(want) <= most else b"".join(want[:most]).decode("utf-8", "replace"))


def test_cut_columns(spark):
    long = "the thing " * 30_000 + "aaaa" * 5000
    df = spark.createDataFrame([(1, "the and then"), (2, None), (3, ""), (4, long), (5, "éé")], "id int, t string")
    table = spark.createDataFrame([(bytearray(k), v) for k, v in RANKS.items()], "token binary, rank int")
    ranks = tk.rank_table(table)
    assert ranks == RANKS
    got = {r["id"]: (r["c"], r["n"]) for r in df.select("id", tk.truncate_tokens(F.col("t"), 3, ranks).alias("c"), tk.token_counts(F.col("t"), ranks).alias("n")).collect()}
    whole = {k: len([t for m in regex.finditer(tk.WORDS, x) for t in naive(m[0].encode(), RANKS)]) for k, x in ((1, "the and then"), (5, "éé"))}
    assert got[1] == ("the and", whole[1]) and got[2] == (None, 0) and got[3] == ("", 0) and got[5][1] == whole[5] and got[4][0] == "the th" and got[4][1] > 60_000


def test_words_that_recur_are_merged_once(monkeypatch):
    ranks = {bytes([k]): k for k in range(256)} | {b"th": 256, b"the": 257}
    asked, real = [], tk.merged
    monkeypatch.setattr(tk, "merged", lambda piece, table: asked.append(piece) or real(piece, table))
    found = list(tk.tokens("the other" * 50, tk.kept_merges(ranks), tk.regex.compile(tk.WORDS)))
    assert b"".join(found) == b"the other" * 50 and len(asked) == len(set(asked)) == 3
