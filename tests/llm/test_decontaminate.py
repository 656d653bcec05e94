"""Decontamination against brute force: every item against every stretch of every text."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate as dc
from tallyloom.session import Scratch

WORDS = [f"{a}{b}" for a in ("ba", "ke", "lo", "mu", "ny") for b in ("d", "f", "g", "h")]


def edits(x, y):
    """Least edits between item x and any stretch of y, by the plain table."""
    row = [0] * (len(y) + 1)
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_search_finds_what_brute_force_finds():
    rng = random.Random(3)
    for _ in range(60):
        item = [rng.choice(WORDS) for _ in range(rng.randint(5, 24))]
        text = [rng.choice(WORDS) for _ in range(rng.randint(0, 60))]
        copy = list(item)
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(copy) or 1)
            copy[at : at + rng.randint(0, 1)] = [rng.choice(WORDS)] * rng.randint(0, 1)
        text[10:10] = copy
        found = dc.ItemSet.build([(7, " ".join(item))], dc.ERROR_RATE, dc.MIN_WORDS).search(" ".join(text))
        least, budget = edits(item, text), dc.error_budget(len(item))
        assert [(f[0], f[1]) for f in found] == ([(7, least)] if least <= budget else [])


def test_pieces_cover_the_item():
    words = list("abcdefghijk")
    assert [w for _, p in dc.pieces(words, 3) for w in p] == words


def test_leaks_and_edge_cases(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, f"before. {passage.upper()}! after", "x"), (2, "nothing here", "x"), (3, None, "x"), (4, "", "x"), (1, f"before. {passage.upper()}! after", "x"), (None, passage, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(5, passage), (6, None), (7, "too short"), (8, passage)], "item_id long, text string")
    found = sorted((r["doc_id"] or 0, r["item_id"], r["distance"]) for r in dc.find_leaks(docs, bench).collect())
    assert found == [(0, 5, 0), (0, 8, 0), (1, 5, 0), (1, 5, 0), (1, 8, 0), (1, 8, 0)]
    kept = dc.drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    assert dc.find_leaks(docs, bench.limit(0)).count() == 0
    assert dc.find_leaks(docs.limit(0), bench).count() == 0


def test_joined_pieces_give_what_the_automaton_gives(spark):
    rng = random.Random(5)
    say = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [(k, " ".join(say(rng.randint(4, 30)))) for k in range(30)] + [(None, "ba be bi bo bu by"), (3, "ba be bi bo bu by"), (3, "ba be bi bo bu by")]
    texts = []
    for k in range(60):
        words = say(rng.randint(0, 40))
        copy = items[k % len(items)][1].split()
        if copy and k % 3:
            copy[rng.randrange(len(copy))] = "zz"
        texts.append((k % 50, " ".join(words[:10] + copy + words[10:]) if k % 4 else None))
    texts += [(99, "ba be bi bo bu by " * 3000), texts[1]]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string").withColumn("key", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string")
    line = lambda df: sorted(map(str, df.collect()))
    want, joined = dc.find_leaks(docs, bench), dc.find_leaks(docs, bench, broadcast_chars=0)
    assert line(want) == line(joined) and want.count() > 30
    kept = dc.drop_leaks(docs, bench, broadcast_chars=0)
    assert kept.columns == docs.columns and line(kept) == line(dc.drop_leaks(docs, bench))
    assert line(dc.find_leaks(docs, bench, broadcast_chars=0, min_words=1))[:1] is not None


def test_ties_and_very_long_texts(spark):
    item = "one two three four five six seven eight nine ten"
    long = "mill " * 300_000 + item + " river " + item + " mill" * 10
    found = dc.find_leaks(spark.createDataFrame([(1, long)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r["distance"], r["first_word"], r["last_word"]) for r in found] == [(0, 300_000, 300_009)]


def test_items_that_are_not_searched_are_named(spark):
    bench = spark.createDataFrame([(1, "one two three four"), (2, "one two three four five"), (3, None), (4, " .. "), (1, "x"), (None, "y z")], "item_id long, text string").withColumn("words", F.lit("clash"))
    rows = sorted(((r["item_id"] or 0), r["words"]) for r in dc.unsearched_items(bench).collect())
    assert rows == [(0, 2), (1, 1), (1, 4), (3, 0), (4, 0)]
    assert sorted(r["item_id"] for r in dc.unsearched_items(bench, 1).collect()) == [3, 4]
    assert dc.unsearched_items(bench.limit(0)).count() == 0


def test_rare_cuts_share_least_of_all_cuts():
    rng = random.Random(8)
    for _ in range(40):
        budget = rng.randint(1, 3)
        size = rng.randint(3 * (budget + 1), 3 * (budget + 1) + 6)
        common = np.array([rng.choice([1, 1, 2, 50, 900]) for _ in range(size - 2)], dtype=float)
        cost = lambda cuts: sum(common[lo : hi - 2].min() for lo, hi in zip(cuts, cuts[1:], strict=False))  # noqa: E731, B023
        every = [(0, *inner, size) for inner in itertools.combinations(range(1, size), budget)]
        least = min(cost(c) for c in every if min(b - a for a, b in zip(c, c[1:], strict=False)) >= 3)
        got = dc.rare_cuts(common, size, budget)
        assert got[0] == 0 and got[-1] == size and len(got) == budget + 2 and min(b - a for a, b in zip(got, got[1:], strict=False)) >= 3
        assert cost(got) == least
    # Longer items are cut in blocks.
    got = dc.rare_cuts(np.ones(4000 - 2), 4000, 799)
    assert len(got) == 801 and got[-1] == 4000 and min(np.diff(got)) >= 3


def test_a_stock_phrase_in_many_items_meets_few_of_them(spark):
    rng = random.Random(9)
    own = lambda n: [f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(n)]
    phrase = "which of these is".split()
    items = [(k, " ".join(phrase + own(8) + phrase + own(rng.randint(4, 9)))) for k in range(600)]
    texts = [(k, " ".join(own(20) + phrase * 2 + own(20))) for k in range(30)]
    for k in range(30, 60):
        copy = items[7 * k][1].split()
        for at in rng.sample(range(len(copy)), k % 6):
            copy[at] = "zz"
        texts.append((k, " ".join(own(10) + copy + own(10))))
    found = dc.ItemSet.build(items, dc.ERROR_RATE, dc.MIN_WORDS)
    met = lambda text: {i for _, places in found.automaton.iter(f" {text} ") for i, _ in places}
    assert all(not met(t) for _, t in texts[:30]) and max(len(met(t)) for _, t in texts) == 1
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i, least) for d, t in texts[30:] for i, item in [items[7 * d]] if (least := edits(item.split(), t.split())) <= dc.error_budget(len(item.split()))}
    assert len(want) > 15
    for limit in (dc.BROADCAST_CHARS, 0):
        assert {(r["doc_id"], r["item_id"], r["distance"]) for r in dc.find_leaks(docs, bench, broadcast_chars=limit).collect()} == want
    scratch = Scratch(spark, "test")
    cut = bench.mapInArrow(dc._cut_items(dc.ERROR_RATE, dc.MIN_WORDS), f"item_id long, line string, budget int, pieces {dc._PIECES}").withColumn("item", F.monotonically_increasing_id())
    recut = dc._cut_where_rare(scratch.table(cut, "items"), scratch)
    assert recut.count() == len(items)
    assert recut.select("item", F.inline("pieces")).groupBy("hash").count().agg(F.max("count")).first()[0] == 1


def test_any_cut_finds_the_same(spark, monkeypatch):
    rng = random.Random(10)
    say = lambda n: [rng.choice(WORDS[:9]) for _ in range(n)]
    items = [(k, " ".join(say(rng.randint(5, 40)))) for k in range(40)] + [(1, "ba be bi bo bu by"), (None, "ba be bi bo bu by")]
    texts = [(k, " ".join(say(12) + items[k % 41][1].split()[k % 3 :] + say(12))) for k in range(60)]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = []
    for shared, limit in ((10**9, dc.BROADCAST_CHARS), (0, dc.BROADCAST_CHARS), (0, 0)):
        monkeypatch.setattr(dc, "SHARED", shared)
        got.append(sorted(map(str, dc.find_leaks(docs, bench, broadcast_chars=limit).collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) > 40
