"""The forest against exact search."""

import math

import numpy as np

from pyspark.sql import functions as F

from tallyloom.llm import ann


SMALL = "/root/testdata/sf0.01"


def exact(ids, x, q, k):
    score = x @ x[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
    order = sorted((-s, i) for s, i in zip(score, ids, strict=True) if i != ids[q])
    return [(i, -s) for s, i in order[:k]]


def test_recall_on_a_shard():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((6000, 32))
    ids = np.arange(6000)
    shard = ann.Shard.build(ids, x)
    q = np.arange(0, 6000, 60)
    got = {}
    for a, b, _ in zip(*(c.tolist() for c in shard.search(ids[q], x[q], 5, ann.SHARE)), strict=True):
        got.setdefault(int(q[a]), set()).add(b)
    hits = [len(got[int(i)] & {b for b, _ in exact(ids, x, i, 5)}) for i in q]
    assert np.mean(hits) / 5 >= 0.9


def test_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 8)).tolist()
    rows = [(i, base[i % 40 if i < 80 else 0]) for i in range(200)]
    bad = [(300, None), (301, []), (302, [0.0] * 8), (303, [1.0] * 7 + [None]), (304, [math.nan] * 8), (305, [math.inf] + [1.0] * 7), (None, base[1]), (306, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = ann.nearest_neighbours(df, F.col("vec_id") % 50 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ids, x = np.arange(200), np.array([v for _, v in rows])
    assert sorted(by) == [0, 50, 100, 150]
    for q, found in by.items():
        want = exact(ids, x, q, 5)
        assert np.allclose([s for _, s in found], [s for _, s in want])
        # Equal vectors may differ in the last digit of their cosines, as sums go; ids are compared where scores are apart.
        assert len({i for i, _ in found}) == 5 and q not in {i for i, _ in found}
    assert [i for i, _ in by[100]][:5] == [0, 40, 80, 81, 82]


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.nearest_neighbours(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1)]
    assert ann.nearest_neighbours(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_blocks_and_shards_answer_alike(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.standard_normal((900, 8)).tolist())] + [(7, [0.5] * 8), (7, [0.4] * 8), (50, [0.1, 0.2])], "vec_id long, embedding array<double>")
    # A share over the number of trees looks at everything: exact whatever the shards and blocks.
    asked = lambda **kw: sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest_neighbours(df, F.col("vec_id") % 50 == 0, share=float(ann.TREES), **kw).collect())
    one = asked()
    assert one == asked(shard_rows=100, block_bytes=64) == asked(shard_rows=100)
    assert len(one) == 18 * 5 and len({(q, v) for q, _, v in one}) == len(one)


def test_recall_of_the_registered_query(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x, ids = np.array(rows["embedding"].tolist(), dtype=np.float64), rows["vec_id"].to_numpy()
    got = {}
    for r in ann.op7_ann(spark, SMALL).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 50 == 0)
    hits = 0
    for q, found in got.items():
        want = dict(exact(ids, x, int(np.flatnonzero(ids == q)[0]), 5))
        hits += len(want.keys() & found.keys())
        assert len(found) == 5 and all(abs(want[i] - s) < 1e-12 for i, s in found.items() if i in want)
    assert hits / (5 * len(got)) >= 0.9


def test_very_large_and_very_small_vectors(spark):
    """Cosines don't depend on magnitudes, whatever finite size they have."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((60, 6))
    sizes = [1.0, 1e200, 1e-200, 1e300, 1e-300, 3e-310]
    big = [(x[k] * sizes[k % 6]).tolist() for k in range(60)]
    out = {}
    for name, rows in (("plain", x.tolist()), ("sized", big)):
        df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
        out[name] = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest_neighbours(df, F.col("vec_id") % 10 == 0).collect()}
    assert out["plain"].keys() == out["sized"].keys() and len(out["plain"]) == 30
    for key, (i, s) in out["plain"].items():
        assert out["sized"][key][0] == i and abs(out["sized"][key][1] - s) < 1e-12
