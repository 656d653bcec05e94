"""Operators on small frames, many against plain loops."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.functions import values as vl
from tallyloom.operators import claims, classify, expect, measures, relational, sampling, votes

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_text_functions(spark):
    r = one(
        spark,
        a=tx.clean(F.lit("\u00a0 x \u2003")), b=tx.clean(F.lit(None)), c=tx.label(F.lit("  ")), d=tx.truncate(F.lit("abcdef"), 3), e=tx.first_line(F.lit("a\r\nb")), f=tx.word_count(F.lit(" a  b\n")),
        g=tx.matches_any(F.lit("É"), ["é"]), h=tx.visible_text(F.lit("<p>a &amp; <b>b</b></p><script>x</script> [t](u) **k**")), i=tx.occurrences(F.lit("aaaa"), F.lit("aa")), j=tx.section("T", F.lit(" ")), k=tx.format_p(F.lit(0.0001)), l=tx.format_share(F.lit(0.123)),
    )
    assert tuple(r) == ("x", "", None, "abc…", "a", 2, True, "a & b t k", 2, "T:\n[NONE]", "<0.001", "12.3%")


def test_value_functions(spark):
    r = one(
        spark,
        a=vl.number(F.lit("inf")), b=vl.positive_integer(F.lit("3.0")), c=vl.positive_integer(F.lit("3.5")), d=vl.truth(F.lit(" Yes ")), e=vl.percent_change(F.lit(0.0), F.lit(2.0)), f=vl.iso_week(F.to_timestamp(F.lit("2024-12-30"))),
        g=vl.page_address(F.lit("HTTP://A.b/C/?x#y")), h=vl.pull_request_address(F.lit("https://Host/Own/Rep/pull/12/files")), i=vl.repository_name(F.lit("https://host.org/Own/Rep.git")), j=vl.agreed(F.lit(None).cast("string"), F.lit("a"), F.lit("a")), k=vl.agreed(F.lit("a"), F.lit("b")),
        m=F.array_join(vl.text_list(F.lit("['a', 'b']")), ","), n=F.array_join(vl.text_list(F.lit("a, ,b")), ","), o=vl.magnitude(F.lit(-0.4)), p=vl.utc(F.lit("nope")), q=F.array_join(vl.in_domain_order(F.array(F.lit("b"), F.lit("a")), ["a", "b", "c"]), ""),
    )
    assert tuple(r) == (None, 3, None, True, None, "2025-W01", "http://a.b/C", "own/rep#12", "own/rep", "a", None, "a,b", "a,b", "medium", None, "ab")


def test_cascade_charges_the_first_reason(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 50), (4, 500)], "id int, n int")
    rules = {"small": F.col("n") < 10, "medium": F.col("n") < 100}
    kept, removed = classify.apply_cascade(df, rules)
    assert [r["id"] for r in kept.orderBy("id").collect()] == [1, 4]
    assert {r["id"]: r["reason"] for r in removed.collect()} == {2: "small", 3: "medium"}
    assert [tuple(r) for r in classify.cascade_counts(df, rules).orderBy("step").collect()] == [(0, "small", 1, 3), (1, "medium", 1, 2), (2, "kept", 2, 2)]


def test_arrays_and_authors(spark):
    config = lambda x: x.endswith(".yml")
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    r = one(spark, a=classify.only_matching(arr("a.yml"), config), b=classify.only_matching(arr("a.yml", "b.c"), config), c=classify.none_or_blank(arr("a", " ")), d=classify.commit_type(F.lit("Fix(ui)!: x")), e=classify.commit_type(F.lit("fixes")))
    assert tuple(r) == (True, False, True, "fix", None)
    who = classify.automation_author(F.lit(None), F.lit("Bot"), F.lit("robo-pal[bot]"), F.lit(""), ["robo"], ["made by"])
    assert one(spark, w=who)["w"] == "bot"


def test_attribution(spark):
    rows = spark.createDataFrame([(1, "r", "2025-02-01"), (2, "r", "2025-02-01"), (3, "s", "2025-02-01"), (4, "r", "bad"), (5, "r", "2026-01-01"), (6, "s", "2024-01-01")], "id int, repo string, created string")
    rules = spark.createDataFrame([("x", "Robo", "2025-01-01"), ("y", "Auto", "2025-01-15")], "rule string, agent string, since string")
    matches = spark.createDataFrame([(1, "y"), (1, "x"), (6, "x")], "id int, rule string")
    searches = spark.createDataFrame([("r", "x", True), ("r", "y", True), ("s", "x", True), ("s", "y", False)], "repo string, rule string, complete boolean")
    got = {r["id"]: (r["status"], r["agent"]) for r in classify.attribute(rows, matches, searches, "id", "repo", "created", rules, "2025-12-31").collect()}
    assert got == {1: ("agent", "Robo"), 2: ("negative", None), 3: ("unresolved", None), 4: ("invalid_date", None), 5: ("outside_scope", None), 6: ("negative", None)}


def test_taxonomy_parent(spark):
    tax = spark.createDataFrame([("a", "P"), ("b", "P"), ("b", "Q")], "child string, parent string")
    got = {r["child"]: (r["parent"], r["problem"]) for r in classify.unique_parent(spark.createDataFrame([("a",), ("b",), ("z",)], "child string"), tax, "child", "parent").collect()}
    assert got == {"a": ("P", None), "b": (None, "ambiguous"), "z": (None, "unknown")}


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, ""), (None, "n")], "k int, t string")
    b = spark.createDataFrame([(2, "y"), (3, "z")], "k int, t string")
    assert {r["k"]: r["side"] for r in relational.outer_with_side(a, b.drop("t"), ["k"]).collect()} == {1: "left_only", 2: "both", 3: "right_only", None: "left_only"}
    assert {r["k"]: r["t"] for r in relational.outer_text(a, b, ["k"], "t", "+").collect()} == {1: "x", 2: "y", 3: "z", None: "n"}
    assert sorted(str(r["k"]) for r in relational.pending(a, b, ["k"]).collect()) == ["1", "None"]
    assert sorted((r["k"] or 0, r["t"]) for r in relational.upsert(a, b, ["k"]).collect()) == [(0, "n"), (1, "x"), (2, "y"), (3, "z")]
    assert {(r["k"], r["only_in"]) for r in relational.key_difference(a.filter("k is not null"), b, ["k"]).collect()} == {(1, "left"), (3, "right")}
    with pytest.raises(expect.ExpectationError):
        expect.checked_join(a, b.union(b), ["k"], "many_to_one")


spans = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.integers(1, 8)), min_size=1, max_size=15)


@few
@given(spans)
def test_intervals_against_loops(spark, rows):
    df = spark.createDataFrame([(k, s, s + n) for k, s, n in rows], "k int, s int, e int")
    want = []
    for k in {r[0] for r in rows}:
        reach = None
        for s, e in sorted((s, s + n) for key, s, n in rows if key == k):
            if reach is None or s >= reach:
                want.append([k, s, e, 1])
            else:
                want[-1][2], want[-1][3] = max(want[-1][2], e), want[-1][3] + 1
            reach = max(reach or 0, e)
    assert sorted(map(tuple, relational.merge_intervals(df, ["k"], "s", "e").collect())) == sorted(map(tuple, want))
    points = spark.createDataFrame([(k, p) for k in range(3) for p in range(0, 40, 3)], "k int, p int")
    got = sorted((r["k"], r["p"], r["s"], r["e"]) for r in relational.range_join(points, df, ["k"], "p", "s", "e", 5).collect())
    assert got == sorted((k, p, s, s + n) for k, s, n in rows for p in range(0, 40, 3) if s <= p < s + n)


@few
@given(st.lists(st.integers(0, 60), min_size=1, max_size=25))
def test_packing_against_a_loop(spark, sizes):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "k int, i int, s long")
    want = [[0, 0]]
    for s in sizes:
        if want[-1][0] and (want[-1][0] >= 4 or want[-1][1] + s > 100):
            want.append([0, 0])
        want[-1][0] += 1
        want[-1][1] += s
    got = relational.capacity_batches(df, ["k"], ["i"], "s", 4, 100).orderBy("batch").collect()
    assert [[r["rows"], r["size"]] for r in got] == want


@few
@given(st.integers(0, 10_000))
def test_matched_pairs_against_the_greedy_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("uv"), rng.choice("xy"), rng.random() < 0.2, f"{rng.random():.6f}") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, s string, arm string, broken boolean, h string")
    gone = set()
    for i, s, arm, broken, _ in rows:
        if broken:
            others = [(h, j) for j, t, other, b, h in rows if t == s and other != arm and not b and j not in gone]
            if others:
                gone.add(max(others, key=lambda x: (x[0], -x[1]))[1])
    want = sorted(i for i, _, _, broken, _ in rows if not broken and i not in gone)
    assert sorted(r["id"] for r in sampling.drop_matched_pairs(df, "s", "arm", "broken", "h", ["id"]).collect()) == want


def test_balanced_sample(spark):
    scarce = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(5)], "id int, s string")
    pool = spark.createDataFrame([(100 + i, "a" if i < 9 else "b") for i in range(10)], "id int, s string")
    m = sampling.balanced_manifest(scarce, pool, ["s"], ["id"], "seed")
    counts = {(r["s"], r["arm"]): r["count"] for r in m.filter("selected").groupBy("s", "arm").count().collect()}
    assert counts == {("a", "scarce"): 3, ("b", "scarce"): 2, ("a", "pool"): 3, ("b", "pool"): 1}
    assert {r["s"]: r["short"] for r in sampling.sampling_plan(scarce, pool, ["s"]).collect()} == {"a": 0, "b": 1}


def test_votes(spark):
    v = [(1, "a", "p"), (1, "b", "p"), (1, "c", "q"), (2, "a", "p"), (2, "b", "q"), (2, "c", "r"), (3, "a", "z"), (3, "b", "z"), (3, "c", "z")]
    df = spark.createDataFrame(v, "id int, voter string, label string")
    got = {r["id"]: (r["label"], r["status"], r["coalition"]) for r in votes.majority(df, ["id"], ["label"], "voter", ["a", "b", "c"]).collect()}
    assert got == {1: ("p", "majority", "a+b"), 2: (None, "none", ""), 3: ("z", "unanimous", "a+b+c")}
    two = spark.createDataFrame([(1, v, p, "t", "x") for v, p in (("a", True), ("b", True), ("c", False))] + [(2, v, v == "a", "t", "x") for v in "abc"], "id int, voter string, present boolean, kind string, kinds string")
    got = {r["id"]: (r["present"], r["primary_type"], r["resolution"]) for r in votes.two_stage(two, ["id"], "present", "kind", "kinds", "voter", ["a", "b", "c"]).collect()}
    assert got == {1: (True, "t", "exact_majority"), 2: (False, None, "absent")}
    k = spark.createDataFrame([("x", "x")] * 20 + [("x", "y")] * 5 + [("y", "x")] * 10 + [("y", "y")] * 15, "a string, b string")
    assert votes.kappa(k, "a", "b").first()["kappa"] == pytest.approx(0.4)
    assert votes.kappa(k.filter("a = 'x' and b = 'x'"), "a", "b").first()["kappa"] is None


def test_measures(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), (None, 9)], "k string, n int")
    assert {r["k"]: r["share"] for r in measures.value_counts(df, "k").collect()} == {"a": 0.5, "b": 0.25, None: 0.25}
    assert [tuple(r) for r in measures.capped_histogram(df, "n", 2).orderBy("bin").collect()] == [(0, 0, 0.0), (1, 2, pytest.approx(2 / 3)), (2, 1, pytest.approx(1 / 3))]
    before, after = (spark.createDataFrame(r, "k int, f string, m double") for r in ([(1, "x", 0.0), (1, "y", 2.0)], [(1, "x", 4.0), (1, "z", 9.0)]))
    row = measures.paired_change(before, after, ["k"], "f", ["m"]).first()
    assert (row["items"], row["m_before"], row["m_after"], row["m_percent"]) == (1, 0.0, 4.0, None)


def test_expectations(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a")], "k int, v string")
    assert {(r["k"], r["problem"]) for r in expect.bad_keys(df, ["k"]).collect()} == {(1, "duplicate"), (None, "null_key")}
    assert expect.outside_domain(df, "v", ["a"]).first()["value"] == "b"
    assert {r["rule"]: r["rows"] for r in expect.broken_rules(df, {"set": F.col("k").isNotNull(), "fine": F.lit(True)}).collect()} == {"set": 1}
    assert expect.several_values(df, ["k"], "v").count() == 1
    assert expect.population_hash(df, ["k", "v"]).first() == expect.population_hash(df.orderBy(F.desc("v")), ["k", "v"]).first()
    assert {r["v"]: r["parts"] for r in expect.reconcile(df, [df.limit(0), df.filter("v = 'a'")], ["v"]).collect()} == {"a": 2, "b": 0}
    other = df.withColumn("x", F.lit(1.0)), df.withColumn("x", F.lit(1.0 + 1e-9))
    assert expect.differing_cells(*other, ["k", "v"]).count() == 2  # the null key pairs with nothing, on either side
    with pytest.raises(expect.ExpectationError):
        expect.require_columns(df, ["k", "z"])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Latency dropped from 120 ms to 45 ms.", {"D1"}),
        ("Memory usage reduced by 40%.", {"D3"}),
        ("This should make it 3x faster.", set()),
        ("Build time went from 12 min to 5 min.", {"D7"}),
        ("Overall performance improved by 15%.", {"D0"}),
        ("Expected latency gains\nlatency down 20% here", set()),
        ("throughput of 900 req/s", {"D2"}),
        ("no numbers about latency", set()),
        ("see https://x.y/latency-120ms and v1.2.3", set()),
        ("8 threads now", {"D9"}),
    ],
)
def test_claims(spark, text, want):
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    out = claims.extract_claims(df, "id", "text")
    assert {r["dimension"] for r in out.collect()} == want
    flags = {r["key"]: r["dimensions"] for r in claims.claim_flags(out, df, "id").collect()}
    assert flags == {1: "|".join(sorted(want)), 2: "", 3: ""}


def test_claims_see_unicode_spaces_and_own_dimensions(spark):
    df = spark.createDataFrame([(1, "https://x.y/z\u3000実行時間 120ms"), (2, "disk usage 20 mb")], "id long, text string")
    assert {(r["key"], r["dimension"]) for r in claims.extract_claims(df, "id", "text").collect()} == {(1, "D1")}
    wider = claims.DEFAULT.with_dimensions({"X1": r"\bdisk usage\b"}, {"X1": ["bytes"]})
    assert (2, "X1") in {(r["key"], r["dimension"]) for r in claims.extract_claims(df, "id", "text", wider).collect()}
    with pytest.raises(ValueError):
        claims.DEFAULT.with_dimensions({"X1": "x"}, {})


def test_corpus_of_several_sources(spark):
    rows = [(1, "description", 0, "Latency dropped from 120 ms to 45 ms."), (1, "code_diff", 0, "Memory usage reduced by 40%."), (1, "code_diff", 1, None), (2, "description", 0, "nothing"), (1, "description", 1, "Latency rose by 3 ms")]
    df = spark.createDataFrame(rows, "id long, source string, n int, text string")
    rolled, first, sizes = claims.corpus_claims(df, ["id"], "source", "n", "text", "code_diff")
    got = {r["id"]: (r["dimensions"], r["D3"], r["D3_nodiff"], r["n_nodiff"], r["sources"]) for r in rolled.collect()}
    assert got == {1: ("D1|D3", True, False, 1, "code_diff|description"), 2: ("", False, False, 0, "")}
    one = {(r["source"], r["dimension"]): r for r in first.collect()}
    assert set(one) == {("description", "D1"), ("code_diff", "D3")} and one["description", "D1"]["n_claims"] >= 2 and "120" in one["description", "D1"]["snippet"]
    assert {(r["id"], r["source"]): r["chars"] for r in sizes.collect()} == {(1, "description"): 58, (1, "code_diff"): 28, (2, "description"): 7, (2, "code_diff"): 0}


def test_checked_lookups_binding_and_controls(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    table = spark.createDataFrame([("a", 10), ("b", 20)], "k string, v int")
    assert {r["id"]: r["v"] for r in expect.required_lookup(df, table, "k").collect()} == {1: 10, 2: 20, 3: None}
    with pytest.raises(expect.ExpectationError):
        expect.required_lookup(df, table.filter("v = 10"), "k")
    with pytest.raises(ValueError):
        relational.bind_columns(df.select("id"), table, "id", "v")
    assert expect.off_control(df, {"rows": (F.count("*"), 3)}).count() == 0


def test_batches_in_order(spark):
    rows = [("a", k, s) for k, s in enumerate([5, 5, 1, 30, 2, None, 2])] + [(None, 0, 4), ("b", 0, 1)]
    df = spark.createDataFrame(rows, "g string, k int, s long")
    got = sorted(((r["g"] or "", r["batch"], r["rows"], r["size"]) for r in relational.capacity_batches(df, ["g"], ["k"], "s", 3, 10).collect()))
    assert got == [("", 0, 1, 4), ("a", 0, 2, 10), ("a", 1, 1, 1), ("a", 2, 1, 30), ("a", 3, 3, 4), ("b", 0, 1, 1)]
    assert relational.capacity_batches(df.limit(0), ["g"], ["k"], "s", 3, 10).count() == 0


def test_portable_values(spark):
    df = spark.createDataFrame([(1, {"a": float("nan"), "b": 2.5}, "NaN"), (2, None, "x")], "id int, m map<string,double>, s string")
    out = {r["id"]: (r["m"], r["s"]) for r in df.select("id", vl.portable(F.col("m"), df.schema["m"].dataType).alias("m"), vl.portable(F.col("s"), df.schema["s"].dataType).alias("s")).collect()}
    assert out == {1: ('{"a":null,"b":2.5}', '"NaN"'), 2: ("", '"x"')}
