"""Statistics against closed forms, printed values and brute force."""

import itertools
import math
from fractions import Fraction
from statistics import median

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.stats import contingency, intervals, multiplicity, outcomes, prob, rank, regression, resample, sparse, stratified

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
numbers = st.lists(st.integers(-5, 5), min_size=2, max_size=12)


def arms(spark, x, y):
    return spark.createDataFrame([("x", float(v)) for v in x] + [("y", float(v)) for v in y], "arm string, v double")


def test_tails():
    assert prob.chi2_sf(16.136770520235913, 8) == pytest.approx(0.040463819757913036, rel=1e-12)
    assert prob.chi2_sf(0.9494523977309448, 1) == pytest.approx(0.3298604, rel=1e-5)
    assert prob.normal_ppf(0.975) == pytest.approx(1.959963984540054, abs=1e-12)
    odds, p = prob.fisher_exact(423, 918 - 423, 515, 901 - 515)
    assert p == pytest.approx(2.65115897781e-06, rel=1e-9) and odds == pytest.approx(0.6405, abs=1e-4)
    assert prob.binomial_ppf(0.025, 20) == 6


def test_printed_tables():
    counts = np.array([[222, 99, 135, 21, 35, 92, 5, 348, 92], [215, 76, 155, 18, 20, 124, 8, 344, 74]])
    x, dof, _ = contingency.pearson(counts)
    assert (x, dof) == (pytest.approx(16.136770520235913), 8)
    assert contingency.cramers_v(counts) == pytest.approx(0.08801641524175795)
    presence = np.array([[929, 200], [910, 219]])
    assert contingency.pearson(presence, yates=True)[0] == pytest.approx(0.9494523977309448)
    assert contingency.pearson(np.array([[615, 515], [827, 302]]), yates=True)[0] == pytest.approx(85.88506995720871)


def test_proportions(spark):
    row = spark.range(1).select(intervals.wilson(F.lit(76), F.lit(119)).alias("w"), intervals.effects(F.lit(20), F.lit(30), F.lit(10), F.lit(40)).alias("e"), intervals.wilson(F.lit(0), F.lit(0)).alias("n"), intervals.effects(F.lit(0), F.lit(5), F.lit(2), F.lit(3)).alias("z")).first()
    assert tuple(row["w"]) == pytest.approx((0.5492576585240164, 0.7193812872912441))
    assert (row["e"]["risk_difference"], row["e"]["risk_ratio"], row["e"]["odds_ratio"]) == pytest.approx((0.2, 2.0, 8 / 3))
    assert row["n"] is None and row["z"]["odds_ratio"] == pytest.approx(0.5 * 3.5 / (5.5 * 2.5))
    assert contingency.cramers_v(np.array([[20, 30], [10, 40]])) == pytest.approx(0.2182178902)


def test_adaptive_test():
    assert contingency.independence([[20, 30], [10, 40]])["test"] == "chi-square"
    assert contingency.independence([[3, 1], [1, 3]])["test"] == "fisher"
    assert contingency.independence([[3, 0], [5, 0]])["test"] == "n/a"
    out = contingency.independence([[3, 1, 0], [1, 3, 2]], draws=2000)
    assert out["test"] == "monte-carlo" and 0 < out["p"] <= 1


def test_adjusted_p(spark):
    df = spark.createDataFrame([("f", 1, 0.01), ("f", 2, 0.04), ("f", 3, 0.03), ("f", 4, None), ("g", 1, 0.5)], "family string, k int, p double")
    got = {(r["family"], r["k"]): (r["holm"], r["bh"]) for r in multiplicity.adjust(df, "p", ["family"], ["k"]).collect()}
    assert got["f", 1] == pytest.approx((0.03, 0.03)) and got["f", 2] == pytest.approx((0.06, 0.04)) and got["f", 3] == pytest.approx((0.06, 0.04))
    assert got["f", 4] == (None, None) and got["g", 1] == pytest.approx((0.5, 0.5))


@few
@given(numbers, numbers)
def test_ranks_against_pairs(spark, x, y):
    df = arms(spark, x, y)
    u = sum((a > b) + (a == b) / 2 for a, b in itertools.product(x, y))
    row = rank.mann_whitney(df, "arm", "v", "x", "y").first()
    assert row["u"] == u and row["delta"] == pytest.approx(2 * u / (len(x) * len(y)) - 1)
    d = [[(a > b) - (a < b) for b in y] for a in x]
    mean = np.mean(d)
    got = rank.cliffs_delta(df, "arm", "v", "x", "y").first()
    assert got["delta"] == pytest.approx(mean)
    want = median(a - b for a, b in itertools.product(x, y))
    assert rank.hodges_lehmann(df, "arm", "v", "x", "y").first()["shift"] == pytest.approx(want)


def test_exact_mann_whitney_p(spark):
    x, y = [1.5, 7.0, 3.2], [2.0, 9.0, 8.1, 10.5]
    row = rank.mann_whitney(arms(spark, x, y), "arm", "v", "x", "y").first()
    pool = x + y
    us = [sum(a > b for a in c for b in pool if b not in c) for c in itertools.combinations(pool, 3)]
    low = min(row["u"], 12 - row["u"])
    assert rank.mann_whitney_p(row) == pytest.approx(min(1, 2 * sum(u <= low for u in us) / len(us)))


def test_moses_interval(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(1, 1, 40).tolist(), rng.normal(0, 1, 30).tolist()
    out = rank.hodges_lehmann(arms(spark, x, y), "arm", "v", "x", "y").first()
    d = sorted(a - b for a in x for b in y)
    k = round(len(d) / 2 - 1.959963984540054 * math.sqrt(len(d) * 71 / 12))
    assert (out["low"], out["high"]) == pytest.approx((d[k - 1], d[len(d) - k]))


def test_shifts_by_groups_with_and_without_a_task_for_each(spark):
    rng = np.random.default_rng(1)
    rows = [(g, arm, float(round(v, 2))) for g, n in (("a", 25), ("b", 7)) for arm, d in (("x", 1.0), ("y", 0.0)) for v in rng.normal(d, 2, n)] + [("c", "x", 1.0)]
    df = spark.createDataFrame(rows, "g string, arm string, v double")
    one = {r["g"]: (r["shift"], r["low"], r["high"]) for r in rank.hodges_lehmann(df, "arm", "v", "x", "y", ["g"]).collect()}
    many = {r["g"]: (r["shift"], r["low"], r["high"]) for r in rank.hodges_lehmann(df, "arm", "v", "x", "y", ["g"], most=10).collect()}
    assert one["c"] == many["c"] == (None, None, None)
    assert all(one[g] == pytest.approx(many[g], abs=1e-9) for g in "ab")


def test_large_shifts_take_few_steps(spark):
    """Blocks bracket the ranks of a large group, so that a handful of steps remain; hot values, null groups and a skewed arm included."""
    rng = np.random.default_rng(3)
    rows = [(g, arm, float(v)) for g in (None, "a") for arm, n, d in (("x", 300, 40), ("y", 170, 0)) for v in np.concatenate((rng.integers(0, 900, n) / 4 + d, np.full(n // 3, 100.25)))]
    df = spark.createDataFrame(rows, "g string, arm string, v double").cache()
    spark.sparkContext.setJobGroup("large shifts", "")
    out = rank.hodges_lehmann(df, "arm", "v", "x", "y", ["g"], most=10).collect()
    spark.sparkContext.setJobGroup("", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("large shifts")) < 160
    small = rank.hodges_lehmann(df, "arm", "v", "x", "y", ["g"], most=10, block=7).collect()
    for g in (None, "a"):
        x, y = ([v for h, a, v in rows if h == g and a == arm] for arm in "xy")
        d = np.sort(np.subtract.outer(x, y).ravel())
        want = [np.median(d), *(d[k - 1] for k in rank.shift_ranks(len(x), len(y))[2:])]
        for r in [r for r in (*out, *small) if r["g"] == g]:
            assert (r["n1"], r["n2"]) == (len(x), len(y)) and (r["shift"], r["low"], r["high"]) == pytest.approx(want, abs=1e-9)


def test_percentiles_and_expected_counts(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g, n in (("a", 101), ("b", 2), ("c", 1)) for v in rng.integers(0, 30, n)] + [(None, 5.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["quantiles"] for r in rank.percentiles(df, ["g"], "v", (0.1, 0.5, 0.9)).collect()}
    assert set(got) >= {"a", "b", "c"}
    for g in "abc":
        assert got[g] == pytest.approx(np.quantile([v for x, v in rows if x == g], [0.1, 0.5, 0.9]).tolist())
    cells = [(int(a), int(b)) for a, b in zip(rng.integers(0, 4, 60), rng.integers(0, 6, 60), strict=True) if (a, b) != (0, 0)]
    row = contingency.chi_square(spark.createDataFrame(cells, "r int, c int"), "r", "c").first()
    table = np.zeros((4, 6))
    for a, b in cells:
        table[a, b] += 1
    x, dof, expected = contingency.pearson(contingency.trim(table))
    assert (row["chi_square"], row["dof"], row["least_expected"], row["share_expected_5"]) == pytest.approx((x, dof, expected.min(), (expected >= 5).mean()))


def test_small_samples_keep_the_formulas_bounds(spark):
    # Variance 0 in a complete separation; bounds are the formula's.
    row = rank.cliffs_delta(arms(spark, [5.0, 6.0], [1.0, 2.0]), "arm", "v", "x", "y").first()
    assert row["delta"] == 1.0
    assert rank.cliffs_delta(arms(spark, [5.0], [1.0, 2.0]), "arm", "v", "x", "y").first()["low"] is None


def test_outcome_bundle(spark):
    rows = [("x", True, 1.0), ("x", False, 2.0), ("x", None, 9.0), ("y", False, 3.0), ("y", False, None), ("y", True, 5.0)] * 4
    df = spark.createDataFrame(rows, "arm string, done boolean, v double")
    got = {(r["arm"], r["measure"]): (r["rows"], r["n"], r["estimate"]) for r in outcomes.summarise(df, "arm", "done", ["v"]).collect()}
    assert got == {("x", "done"): (12, 8, 0.5), ("y", "done"): (12, 12, pytest.approx(1 / 3)), ("x", "v"): (12, 12, 2.0), ("y", "v"): (12, 8, 4.0)}
    tests = {r["measure"]: r for r in outcomes.contrasts(df, "arm", "x", "y", "done", ["v"]).collect()}
    assert tests["done"]["method"] == "fisher" and tests["done"]["estimate"] == pytest.approx(1 / 6)
    assert tests["v"]["estimate"] == pytest.approx(median(a - b for a, b in itertools.product([1.0, 2.0, 9.0] * 4, [3.0, 5.0] * 4)))
    assert all(t["bh"] >= t["p"] for t in tests.values())


def test_kruskal_and_median_interval(spark):
    groups = {"a": [1, 2, 2, 5], "b": [3, 4, 4, 6, 7], "c": [8], "d": [2, 9, 9]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    row = rank.kruskal(df, "g", "v").first()
    used = {g: v for g, v in groups.items() if len(v) > 1}
    every = sorted(v for vs in used.values() for v in vs)
    ranks = {v: np.mean([i + 1 for i, w in enumerate(every) if w == v]) for v in every}
    n = len(every)
    h = 12 / (n * (n + 1)) * sum(sum(ranks[v] for v in vs) ** 2 / len(vs) for vs in used.values()) - 3 * (n + 1)
    h /= 1 - sum(every.count(v) ** 3 - every.count(v) for v in set(every)) / (n**3 - n)
    assert row["h"] == pytest.approx(h) and row["groups"] == 3 and 0 < rank.kruskal_p(row) < 1
    many = spark.createDataFrame([("x", float(i)) for i in range(20)] + [("y", 1.0)], "g string, v double")
    got = {r["g"]: (r["median"], r["low"], r["high"]) for r in rank.median_interval(many, "g", "v").collect()}
    assert got["x"] == (9.5, 5.0, 14.0) and got["y"][1:] == (None, None)


def test_strata(spark):
    t = spark.createDataFrame([("a", 10.0, 5.0, 6.0, 9.0), ("b", 8.0, 12.0, 4.0, 16.0), ("empty", 0.0, 0.0, 3.0, 4.0)], "s string, a double, b double, c double, d double")
    row = stratified.mantel_haenszel(t).first()
    r, s = 10 * 9 / 30 + 8 * 16 / 40, 5 * 6 / 30 + 12 * 4 / 40
    assert row["strata"] == 2 and row["odds_ratio"] == pytest.approx(r / s) and row["low"] < r / s < row["high"]
    bd = stratified.breslow_day(t, r / s).first()
    assert bd["strata"] == 2 and 0 <= bd["tarone"] <= bd["breslow_day"]


def test_logistic_regression(spark):
    cells = {(0, 0): (30, 10), (0, 1): (20, 20), (1, 0): (15, 25), (1, 1): (5, 35)}
    rows = [(x, z, y, k % 7) for (x, z), (no, yes) in cells.items() for y, n in ((0, no), (1, yes)) for k in range(n)]
    df = spark.createDataFrame(rows, "x int, z int, y int, c int")
    terms = {"one": F.lit(1.0), "x": F.col("x"), "z": F.col("z"), "xz": F.col("x") * F.col("z")}
    fit = regression.fit_logistic(df, terms, F.col("y"))
    logit = {k: math.log(yes / no) for k, (no, yes) in cells.items()}
    assert fit.beta == pytest.approx([logit[0, 0], logit[1, 0] - logit[0, 0], logit[0, 1] - logit[0, 0], logit[1, 1] - logit[1, 0] - logit[0, 1] + logit[0, 0]], abs=1e-8)
    assert fit.covariance[0, 0] == pytest.approx(1 / 30 + 1 / 10)
    # Each row a cluster of its own: the sandwich is that of White.
    single = df.withColumn("id", F.monotonically_increasing_id())
    robust = regression.cluster_covariance(single, terms, F.col("y"), "id", fit)
    n = len(rows)
    assert robust.clusters == n and robust.covariance[0, 0] == pytest.approx((1 / 30 + 1 / 10) * n / (n - 1) * (n - 1) / (n - 4))
    small = regression.fit_logistic(df, {k: v for k, v in terms.items() if k != "xz"}, F.col("y"))
    assert regression.likelihood_ratio(fit, small)["dof"] == 1


def test_rarefied():
    assert resample.rarefied([3, 2, 1], 6) == 3
    assert resample.rarefied([2, 1], 1) == pytest.approx(1)


def test_bootstrap_against_whole_tensors(spark):
    """Weights drawn by halves, over several blocks, are a multinomial draw; the sparse tables give the V of the dense ones."""
    rng = np.random.default_rng(0)
    tensor = rng.integers(0, 3, (600, 2, 3))
    rows = [(f"k{k:04d}", f"r{r}", f"c{c}", int(n)) for (k, r, c), n in np.ndenumerate(tensor) if n]
    df = spark.createDataFrame(rows, "k string, r string, c string, n int").select("k", "r", "c", F.explode(F.sequence(F.lit(1), "n")))
    names = sorted({x[0] for x in rows})
    tensor = tensor[[int(n[1:]) for n in names]]
    draws, seed = 700, 5
    weights = np.concatenate([np.concatenate([sparse.cluster_weights(len(names), b, seed, run, size) for b in range(-(-len(names) // sparse.BLOCK))]) for run, size in ((0, 500), (1, 200))], axis=1)
    assert (weights.sum(0) == len(names)).all() and weights.mean() == 1 and weights.var(1).mean() == pytest.approx(1 - 1 / len(names), abs=0.03)
    assert np.corrcoef(weights[:300].sum(0), weights[300:].sum(0))[0, 1] < -0.99
    want = [contingency.cramers_v(np.tensordot(w, tensor, axes=1)) for w in weights.T]
    tables = sparse.bootstrap_tables(df, "k", "r", "c", draws, seed)
    got = {r["draw"]: r["v"] for r in sparse.cramers_v_by(tables, "draw").collect()}
    assert [got[d] for d in range(draws)] == pytest.approx(want, rel=1e-9)
    out = sparse.bootstrap_cramers_v(df, "k", "r", "c", draws, seed)
    assert (out["low"], out["high"]) == pytest.approx(tuple(np.quantile(want, [0.025, 0.975]))) and out["cramers_v"] == pytest.approx(contingency.cramers_v(tensor.sum(0))) and out["draws"] == draws
    assert sparse.bootstrap_cramers_v(df.limit(0), "k", "r", "c", 10)["draws"] == 0
    one = spark.createDataFrame([("a", "x", "p"), ("b", "x", "q")], "k string, r string, c string")
    assert sparse.bootstrap_cramers_v(one, "k", "r", "c", 10)["draws"] == 0 and sparse.bootstrap_cramers_v(one, "k", "r", "c", 10, degenerate="zero")["high"] == 0


def test_bootstrap_of_more_cells_than_a_driver_would_take(spark):
    """2.4 million filled cells of 600,000 clusters: V stays where the whole table has it."""
    df = spark.range(2_400_000).select((F.col("id") % 600_000).alias("k"), (F.col("id") % 2).alias("r"), ((F.col("id") * 7919 + F.floor(F.col("id") / 3)) % 3).alias("c"))
    out = sparse.bootstrap_cramers_v(df, "k", "r", "c", draws=6)
    assert out["draws"] == 6 and out["low"] - 0.01 <= out["cramers_v"] <= out["high"] + 0.01


def test_random_tables_by_ranges(spark):
    """Margins hold in every block, means are those of shuffled labels, and results agree with small tables drawn whole."""
    rng = np.random.default_rng(3)
    table = rng.integers(0, 4, (3, 700))
    cells = spark.createDataFrame([(int(r), int(c), int(n)) for (r, c), n in np.ndenumerate(table) if n], "r long, c long, n long")
    marks = rng.integers(0, 2, 700)
    score = lambda numbers, tables: np.stack([tables.sum((1, 2)), *[(tables[:, :, r] * marks[numbers]).sum(1) for r in range(3)], *[(tables[:, :, r] > 0).sum(1) for r in range(3)]], axis=1)
    own, sums = sparse.permuted_sums(cells, score, 3, 800, 9)
    got = np.array([[r[f"s{k}"] for k in range(7)] for r in sums.orderBy("draw").collect()])
    assert own.tolist() == [table.sum(), *(table * marks).sum(1), *(table > 0).sum(1)]
    assert got.shape == (800, 7) and (got[:, 0] == table.sum()).all() and (got[:, 1:4].sum(1) == (table * marks).sum()).all()
    assert got[:, 1:4].mean(0) == pytest.approx(table.sum(1) * (table * marks).sum() / table.sum(), rel=0.01)
    dense = (contingency.random_tables(table, 800, 1) > 0).sum(2)
    assert got[:, 4:].mean(0) == pytest.approx(dense.mean(0), rel=0.01) and got[:, 4:].std(0) == pytest.approx(dense.std(0), rel=0.15)


def test_permutation_tests(spark):
    df = lambda counts: spark.createDataFrame([(a, f"l{k}") for a, row in enumerate(counts) for k, n in enumerate(row) for _ in range(n)], "arm int, label string")
    assert sparse.richness_permutation(df([[5, 5, 0], [5, 5, 0]]), "arm", "label", 200)["p"] == 1
    out = sparse.richness_permutation(df([[4, 0, 0, 0], [1, 1, 1, 1]]), "arm", "label", 4000)
    # Of 70 ways to deal five labels' rows over two arms of four, all with four labels against one.
    rows, hits, ways = [0, 0, 0, 0, 0, 1, 2, 3], 0, 0
    for chosen in itertools.combinations(range(8), 4):
        a, b = {rows[k] for k in chosen}, {rows[k] for k in range(8) if k not in chosen}
        ways, hits = ways + 1, hits + (abs(len(a) - len(b)) >= 3)
    assert (out["first"], out["second"], out["difference"]) == (1, 4, -3) and out["p"] == pytest.approx(hits / ways, abs=0.02)
    with pytest.raises(ValueError):
        sparse.richness_permutation(df([[1], [1], [1]]), "arm", "label", 10)
    pairs = spark.createDataFrame([(g, g) for g in range(3)] * 10, "g int, s int")
    expected = spark.createDataFrame([(g, g) for g in range(3)] * 2 + [(0, 9)], "g int, s int")
    found = sparse.alignment_permutation(pairs, "g", "s", expected, 500)
    assert found["observed"] == 1 and found["p"] == 1 / 501 and found["low"] <= found["expected"] <= found["high"] < 1
    assert sparse.weighted_quantile(np.array([1, 5, 9]), np.array([2, 3, 1]), 0.4) == np.quantile([1, 1, 5, 5, 5, 9], 0.4)


def test_permutations_over_all_rows(spark):
    from tallyloom.plans import catalog, cohort  # noqa: F401

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lang is not null")
    langs = sorted(r[0] for r in docs.select("lang").distinct().collect())
    cells = docs.groupBy("lang", F.least(F.floor(F.col("n_chars") / 2000), F.lit(2)).cast("int")).count().collect()
    share = sum(n for lang, size, n in cells if langs.index(lang) % 3 == size) / sum(n for *_, n in cells)
    out = catalog.QUERIES["expected_alignment"](spark, "/root/testdata/sf0.1").first()
    assert out["observed"] == pytest.approx(share, abs=1e-12) and out["low"] <= out["expected"] <= out["high"]
    # The work follows the cells: margins far over what an element each could hold.
    table = np.array([[4, 1], [2, 6]]) * 10**12
    drawn = contingency.random_tables(table, 50, 1)
    assert (drawn.sum(1) == table.sum(0)).all() and (drawn.sum(2) == table.sum(1)).all()
    cells = spark.createDataFrame([(r, c, int(table[r, c])) for r in range(2) for c in range(2)], "r long, c long, n long")
    own, sums = sparse.permuted_sums(cells, lambda numbers, tables: tables.sum(1), 2, 50, 1)
    assert own.tolist() == table.sum(1).tolist() and {tuple(r) for r in sums.select("s0", "s1").collect()} == {tuple(table.sum(1).tolist())}


def test_random_tables_are_hypergeometric(spark):
    table = np.array([[3, 1, 2], [2, 5, 1], [1, 0, 2]])
    drawn = contingency.random_tables(table, 40_000, 7)
    assert drawn.mean(0) == pytest.approx(table.sum(1, keepdims=True) * table.sum(0) / table.sum(), abs=0.03)
    want = [math.comb(6, k) * math.comb(11, 6 - k) / math.comb(17, 6) for k in range(7)]
    assert np.bincount(drawn[:, 0, 0], minlength=7) / 40_000 == pytest.approx(want, abs=0.01)


def _counts_of_tens_of_millions(spark):
    """Values 0 to 4 with some 10**7 rows each in either arm, as counts."""
    return [(float(x), 10_000_000 + 100_000 * x, 12_000_000 - 90_000 * x) for x in range(5)]


def test_rank_statistics_of_very_many_rows(spark):
    """No product of counts overflows; the same numbers by Python's integers and fractions."""
    rows = _counts_of_tens_of_millions(spark)
    counts = spark.createDataFrame(rows, "x double, a long, b long")
    n, m = sum(r[1] for r in rows), sum(r[2] for r in rows)
    t = rank.with_below(counts)
    u = Fraction(sum(a * (2 * sum(r[2] for r in rows if r[0] < x) + b) for x, a, b in rows), 2)
    ties = sum((a + b) ** 3 - (a + b) for _, a, b in rows)
    got = rank.mann_whitney_of(t).first()
    assert (got["n1"], got["n2"], got["u"]) == (n, m, float(u)) and got["tie_term"] == pytest.approx(ties, rel=1e-14)
    variance = Fraction(n * m, 12) * ((n + m + 1) - Fraction(ties, (n + m) * (n + m - 1)))
    assert got["z"] == pytest.approx((abs(float(u) - n * m / 2) - 0.5) / float(variance) ** 0.5, rel=1e-9)
    d = 2 * u / (n * m) - 1
    cliff = rank.cliffs_delta_of(t).first()
    assert cliff["delta"] == pytest.approx(float(d), rel=1e-9) and cliff["low"] < cliff["delta"] < cliff["high"]
    over_b = {x: Fraction(sum(r[2] for r in rows if r[0] < x) - sum(r[2] for r in rows if r[0] > x), m) for x, _, _ in rows}
    over_a = {x: Fraction(sum(r[1] for r in rows if r[0] > x) - sum(r[1] for r in rows if r[0] < x), n) for x, _, _ in rows}
    va, vb = sum(a * (over_b[x] - d) ** 2 for x, a, _ in rows), sum(b * (over_a[x] - d) ** 2 for x, _, b in rows)
    inner = sum(a * (m - b) for _, a, b in rows) - n * m * d * d
    var = float((m * m * va + n * n * vb - inner) / (n * m * (n - 1) * (m - 1)))
    f, z = float(d), 1.959963984540054
    assert cliff["low"] == pytest.approx((f - f**3 - z * var**0.5 * ((1 - f * f) ** 2 + z * z * var) ** 0.5) / (1 - f * f + z * z * var), rel=1e-6)
    shift = rank.hodges_lehmann_of(counts).first()
    assert (shift["shift"], shift["low"], shift["high"]) == (0.0, 0.0, 0.0)
    cells = spark.createDataFrame([(g, x, k) for x, a, b in rows for g, k in (("a", a), ("b", b))], "g string, x double, m long")
    k = rank.kruskal_of(cells, "g").first()
    # Of two groups H is the square of U's distance from its mean, in standard errors.
    assert k["groups"] == 2 and k["h"] == pytest.approx(float((u - Fraction(n * m, 2)) ** 2 / variance), rel=1e-7)
