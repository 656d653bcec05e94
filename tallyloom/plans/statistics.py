"""Queries of votes and statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import values as vl
from tallyloom.operators import votes
from tallyloom.plans.catalog import Tables, query
from tallyloom.stats import contingency, intervals, multiplicity, outcomes, rank, regression, resample, sparse, stratified
from tallyloom.stats.prob import chi2_sf

Z = intervals.Z
_WEEK = "(isoyear(ts) || '-W' || lpad(week(ts)::VARCHAR, 2, '0'))"



def normal_tail_sql(z: str) -> str:
    """SQL for the chance of a standard normal above ``z`` (0 or more): a series below 3, a continued fraction above."""
    x = f"(({z}) / sqrt(2.0))"
    series = f"2 / sqrt(pi()) * exp(-{x} * {x}) * {x} * list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(120, 0, -1), lambda k: k::DOUBLE)), lambda a, k: 1 + a * 2 * {x} * {x} / (2 * k + 1))"
    fraction = f"exp(-{x} * {x}) / sqrt(pi()) / list_reduce(list_prepend({x}, list_transform(range(150, 0, -1), lambda k: k::DOUBLE)), lambda a, k: {x} + k / 2 / a)"
    return f"(0.5 * (CASE WHEN {x} < 3 THEN 1 - {series} ELSE {fraction} END))"


def adjusted_sql(tests: str, key: str) -> str:
    """SQL for Holm's and Benjamini and Hochberg's values over all rows of ``tests`` (columns: the key and p)."""
    return f"""(SELECT *, max(least(1, (m - i + 1) * p)) OVER (ORDER BY p, {key} ROWS UNBOUNDED PRECEDING) AS holm, min(least(1, m / i * p)) OVER (ORDER BY p DESC, {key} DESC ROWS UNBOUNDED PRECEDING) AS bh
FROM (SELECT *, row_number() OVER (ORDER BY p, {key}) AS i, count(*) OVER ()::DOUBLE AS m FROM {tests}))"""


#: SQL for the logarithm of a binomial coefficient.
LOG_CHOOSE = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


# Votes: three voters made from hashes of the labelled documents -------------------------------------

_VOTERS = ("a", "b", "c")
_VOTES = """(SELECT doc_id, voter, ('p' || ((doc_id * CASE voter WHEN 'a' THEN 1 WHEN 'b' THEN 3 ELSE 7 END) // 2) % 3) AS parent, ('c' || (doc_id * CASE voter WHEN 'a' THEN 1 WHEN 'b' THEN 3 ELSE 7 END) % 4) AS child,
  (doc_id * CASE voter WHEN 'a' THEN 5 WHEN 'b' THEN 11 ELSE 2 END) % 9 > 2 AS present, CASE voter WHEN 'a' THEN 1 WHEN 'b' THEN 2 ELSE 3 END AS v FROM labels, (VALUES ('a'), ('b'), ('c')) x(voter))"""


def made_votes(t: Tables) -> DataFrame:
    v = t.labels.select("doc_id", F.explode(F.array(*[F.lit(x) for x in _VOTERS])).alias("voter"))
    k = F.col("doc_id") * F.when(F.col("voter") == "a", 1).when(F.col("voter") == "b", 3).otherwise(7)
    p = F.col("doc_id") * F.when(F.col("voter") == "a", 5).when(F.col("voter") == "b", 11).otherwise(2)
    return v.select("doc_id", "voter", F.concat(F.lit("p"), (F.floor(k / 2) % 3).cast("string")).alias("parent"), F.concat(F.lit("c"), (k % 4).cast("string")).alias("child"), (p % 9 > 2).alias("present"))


_TALLY = f"SELECT doc_id, parent, child, count(*) AS n, min(v) AS f, string_agg(voter, '+' ORDER BY v) AS coalition FROM {_VOTES} GROUP BY 1, 2, 3"


@query(f"""WITH t AS ({_TALLY}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS k FROM t)
SELECT doc_id, CASE WHEN n >= 2 THEN parent END AS parent, CASE WHEN n >= 2 THEN child END AS child, CASE n WHEN 3 THEN 'unanimous' WHEN 2 THEN 'majority' ELSE 'none' END AS status, CASE WHEN n >= 2 THEN coalition ELSE '' END AS coalition, n AS votes FROM r WHERE k = 1""")
def majority_vote(t: Tables) -> DataFrame:
    """Atomic (parent, child) majority of three voters."""
    return votes.majority(made_votes(t), ["doc_id"], ["parent", "child"], "voter", _VOTERS)


@query(f"""WITH v AS (SELECT * FROM {_VOTES}), s AS (SELECT doc_id, count(*) FILTER (present) AS positive_votes FROM v GROUP BY 1),
p AS (SELECT doc_id, parent, count(*) AS n FROM v WHERE present GROUP BY 1, 2 HAVING count(*) >= 2), e AS (SELECT doc_id, child, count(*) AS n FROM v WHERE present GROUP BY doc_id, parent, child HAVING count(*) >= 2)
SELECT s.doc_id, positive_votes, positive_votes >= 2 AS present, CASE WHEN positive_votes >= 2 THEN parent END AS primary_type, CASE WHEN positive_votes >= 2 THEN child END AS exact_types,
CASE WHEN positive_votes < 2 THEN 'absent' WHEN e.n = 3 THEN 'full_unanimous' WHEN e.n >= 2 THEN 'exact_majority' WHEN p.n >= 2 THEN 'primary_majority' ELSE 'unresolved' END AS resolution
FROM s LEFT JOIN p USING (doc_id) LEFT JOIN e USING (doc_id)""")
def two_stage_vote(t: Tables) -> DataFrame:
    """Presence first, then type among the positive voters."""
    return votes.two_stage(made_votes(t), ["doc_id"], "present", "parent", "child", "voter", _VOTERS)


@query(f"""WITH w AS (SELECT doc_id, bool_or(present) FILTER (voter = 'a') AS a, bool_or(present) FILTER (voter = 'b') AS b, bool_or(present) FILTER (voter = 'c') AS c FROM {_VOTES} GROUP BY 1)
SELECT doc_id % 10 AS grp, count(*) AS occurrences, bool_or(a::INT + b::INT + c::INT >= 2) AS any_accepted, (bool_or(a)::INT + bool_or(b)::INT + bool_or(c)::INT) >= 2 AS voters_majority FROM w GROUP BY 1""")
def any_accepted_vote(t: Tables) -> DataFrame:
    """Occurrence-level against voter-level majority."""
    wide = made_votes(t).groupBy("doc_id").pivot("voter", list(_VOTERS)).agg(F.first("present"))
    return votes.any_accepted(wide.withColumn("grp", F.col("doc_id") % 10), ["grp"], list(_VOTERS))


_KAPPA = """WITH x AS ({rows}), n AS (SELECT {by} count(*)::DOUBLE AS n, avg((a = b)::INT) AS o FROM x {group}),
p AS (SELECT {by} a AS l, count(*) AS c FROM x GROUP BY ALL), q AS (SELECT {by} b AS l, count(*) AS c FROM x GROUP BY ALL),
e AS (SELECT {pby} sum(p.c * q.c)::DOUBLE AS s FROM p JOIN q ON p.l = q.l {on} GROUP BY ALL)
SELECT {nby} n::BIGINT AS n, round(o, 9) AS agreement, round(s / (n * n), 9) AS expected, round((o - s / (n * n)) / (1 - s / (n * n)), 9) AS kappa FROM n JOIN e ON {join}"""


@query(_KAPPA.format(rows=f"SELECT x.doc_id % 2 AS arm, x.parent AS a, y.parent AS b FROM {_VOTES} x JOIN {_VOTES} y ON x.doc_id = y.doc_id AND x.voter = 'a' AND y.voter = 'b'", by="arm,", group="GROUP BY 1", pby="p.arm,", on="AND p.arm = q.arm", nby="n.arm,", join="n.arm = e.arm"))
def cohen_kappa(t: Tables) -> DataFrame:
    """Agreement of two voters by arm."""
    v = made_votes(t)
    a, b = (v.filter(F.col("voter") == x).select("doc_id", F.col("parent").alias(x)) for x in "ab")
    k = votes.kappa(a.join(b, "doc_id").withColumn("arm", F.col("doc_id") % 2), "a", "b", ["arm"])
    return k.withColumns({c: F.round(c, 9) for c in ("agreement", "expected", "kappa")})


@query(f"""SELECT x.parent AS old_label, y.parent AS new_label, count(*) AS n FROM {_VOTES} x JOIN {_VOTES} y ON x.doc_id = y.doc_id AND x.voter = 'a' AND y.voter = 'c' GROUP BY 1, 2""")
def label_transitions(t: Tables) -> DataFrame:
    v = made_votes(t)
    return votes.transitions(v.filter("voter = 'a'"), v.filter("voter = 'c'"), ["doc_id"], "parent")


# Proportions -------------------------------------------------------------------------------------


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    p = f"({k} / {n}::DOUBLE)"
    base, mid = f"(1 + {Z * Z} / {n})", f"({p} + {Z * Z} / (2.0 * {n}))"
    half = f"({Z} * sqrt({p} * (1 - {p}) / {n} + {Z * Z} / (4.0 * {n} * {n})))"
    return f"greatest(0, ({mid} - {half}) / {base})", f"least(1, ({mid} + {half}) / {base})"


_LOW, _HIGH = wilson_sql("k", "n")


@query(f"""WITH p AS (SELECT {_WEEK} AS period, count(*) FILTER (event_type = 'purchase') AS k, count(*) AS n FROM events GROUP BY 1)
SELECT period, k, n, round(k / n, 9) AS rate, round({_LOW}, 9) AS low, round({_HIGH}, 9) AS high FROM p""")
def wilson_rates_by_period(t: Tables) -> DataFrame:
    """Share of purchases by week with Wilson's interval."""
    p = t.events.groupBy(vl.iso_week(F.col("ts")).alias("period")).agg(F.count_if(F.col("event_type") == "purchase").alias("k"), F.count("*").alias("n"))
    w = intervals.wilson(F.col("k"), F.col("n"))
    return p.select("period", "k", "n", F.round(F.col("k") / F.col("n"), 9).alias("rate"), F.round(w["low"], 9).alias("low"), F.round(w["high"], 9).alias("high"))


_L1, _H1 = wilson_sql("a", "n1")
_L0, _H0 = wilson_sql("c", "n0")
_ARMS = f"""p AS (SELECT {_WEEK} AS period, count(*) FILTER (user_id % 2 = 0 AND event_type = 'purchase') AS a, count(*) FILTER (user_id % 2 = 0) AS n1, count(*) FILTER (user_id % 2 = 1 AND event_type = 'purchase') AS c, count(*) FILTER (user_id % 2 = 1) AS n0 FROM events GROUP BY 1)"""


def week_arms(t: Tables) -> DataFrame:
    even, buy = F.col("user_id") % 2 == 0, F.col("event_type") == "purchase"
    return t.events.groupBy(vl.iso_week(F.col("ts")).alias("period")).agg(F.count_if(even & buy).alias("a"), F.count_if(even).alias("n1"), F.count_if(~even & buy).alias("c"), F.count_if(~even).alias("n0"))


@query(f"""WITH {_ARMS}, w AS (SELECT *, a / n1 AS p1, c / n0 AS p0, {_L1} AS l1, {_H1} AS h1, {_L0} AS l0, {_H0} AS h0 FROM p)
SELECT period, round(p1 - p0, 9) AS difference, round(p1 - p0 - sqrt((p1 - l1) ** 2 + (h0 - p0) ** 2), 9) AS low, round(p1 - p0 + sqrt((h1 - p1) ** 2 + (p0 - l0) ** 2), 9) AS high, round(l1 - h0, 9) AS outer_low, round(h1 - l0, 9) AS outer_high FROM w""")
def newcombe_diff(t: Tables) -> DataFrame:
    """Difference of two arms' purchase rates by week."""
    cells = [F.col(x) for x in ("a", "n1", "c", "n0")]
    n, b = intervals.newcombe(*cells), intervals.bound_difference(*cells)
    return week_arms(t).select("period", F.round(F.col("a") / F.col("n1") - F.col("c") / F.col("n0"), 9).alias("difference"), F.round(n["low"], 9).alias("low"), F.round(n["high"], 9).alias("high"), F.round(b["low"], 9).alias("outer_low"), F.round(b["high"], 9).alias("outer_high"))


@query(f"""WITH {_ARMS}, x AS (SELECT period, a::DOUBLE AS a, n1 - a AS b, c::DOUBLE AS c, n0 - c AS d FROM p)
SELECT period, round(a / (a + b) - c / (c + d), 9) AS risk_difference, round((a / (a + b)) / (c / (c + d)), 9) AS risk_ratio, round(a * d / (b * c), 9) AS odds_ratio,
round(exp(ln(a * d / (b * c)) - {Z} * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 9) AS or_low, round(exp(ln(a * d / (b * c)) + {Z} * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 9) AS or_high FROM x""")
def risk_odds_effects(t: Tables) -> DataFrame:
    e = intervals.effects(F.col("a"), F.col("n1") - F.col("a"), F.col("c"), F.col("n0") - F.col("c"))
    return week_arms(t).select("period", e.alias("e")).select("period", *[F.round(f"e.{x}", 9).alias(x) for x in ("risk_difference", "risk_ratio", "odds_ratio", "or_low", "or_high")])


@query("""WITH x AS (SELECT c_mktsegment AS r, o_orderstatus AS c, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), rr AS (SELECT r, sum(n) AS nr FROM x GROUP BY 1), cc AS (SELECT c, sum(n) AS nc FROM x GROUP BY 1), s AS (SELECT sum(n)::DOUBLE AS t FROM x),
g AS (SELECT coalesce(x.n, 0) AS n, nr * nc / t AS e, t FROM rr CROSS JOIN cc CROSS JOIN s LEFT JOIN x USING (r, c)), k AS (SELECT (SELECT count(*) FROM rr) AS a, (SELECT count(*) FROM cc) AS b)
SELECT any_value(t)::BIGINT AS n, any_value(a) AS row_levels, any_value(b) AS column_levels, ((any_value(a) - 1) * (any_value(b) - 1))::BIGINT AS dof, round(sum((n - e) ** 2 / e), 6) AS chi_square,
round(sqrt(sum((n - e) ** 2 / e) / (any_value(t) * (least(any_value(a), any_value(b)) - 1))), 9) AS cramers_v, round(min(e), 6) AS least_expected, avg((e >= 5)::INT) AS share_expected_5 FROM g, k""")
def chi2_cramers(t: Tables) -> DataFrame:
    """Order status against market segment."""
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "o_orderstatus")
    out = contingency.chi_square(j, "c_mktsegment", "o_orderstatus")
    return out.withColumn("chi_square", F.round("chi_square", 6)).withColumn("cramers_v", F.round("cramers_v", 9)).withColumn("least_expected", F.round("least_expected", 6))


_HYPER = f"({LOG_CHOOSE.format(n='r1', k='k')} + {LOG_CHOOSE.format(n='(n - r1)', k='(c1 - k)')} - {LOG_CHOOSE.format(n='n', k='c1')})"


@query(f"""WITH t AS (SELECT lang, count(*) FILTER (toxic = 0 AND quality = 0)::DOUBLE AS a, count(*) FILTER (toxic = 0 AND quality = 1)::DOUBLE AS b, count(*) FILTER (toxic = 1 AND quality = 0)::DOUBLE AS c, count(*) FILTER (toxic = 1 AND quality = 1)::DOUBLE AS d
FROM labels JOIN documents USING (doc_id) GROUP BY 1), m AS (SELECT *, a + b AS r1, c + d AS r2, a + c AS c1, b + d AS c2, a + b + c + d AS n FROM t),
x AS (SELECT *, least(r1, r2) * least(c1, c2) / n AS least_e, (a * d - b * c) ** 2 * n / (r1 * r2 * c1 * c2) AS x2 FROM m),
f AS (SELECT lang, a, r1, c1, n, unnest(range(greatest(0, r1 + c1 - n)::BIGINT, least(r1, c1)::BIGINT + 1)) AS k FROM x WHERE r1 > 0 AND r2 > 0 AND c1 > 0 AND c2 > 0),
h AS (SELECT lang, k = a AS own, {_HYPER} AS l FROM f), o AS (SELECT lang, max(l) FILTER (own) + ln(1 + 1e-7) AS bound FROM h GROUP BY 1), p AS (SELECT h.lang, least(1, sum(exp(l)) FILTER (l <= bound)) AS p FROM h JOIN o USING (lang) GROUP BY 1)
SELECT lang, CASE WHEN least(r1, r2, c1, c2) = 0 THEN 'n/a' WHEN least_e >= 5 THEN 'chi-square' ELSE 'fisher' END AS test, CASE WHEN least(r1, r2, c1, c2) > 0 THEN round(CASE WHEN least_e >= 5 THEN x2 WHEN b * c > 0 THEN a * d / (b * c) WHEN a * d > 0 THEN 'inf'::DOUBLE END, 6) END AS statistic,
CASE WHEN least(r1, r2, c1, c2) > 0 AND least_e >= 5 THEN 1 END::INTEGER AS dof, round(CASE WHEN least(r1, r2, c1, c2) = 0 THEN NULL WHEN least_e >= 5 THEN 2 * {normal_tail_sql('sqrt(x2)')} ELSE p.p END, 9) AS p FROM x LEFT JOIN p USING (lang)""")
def independence_by_language(t: Tables) -> DataFrame:
    """The adaptive test of toxic against quality within each language."""
    d = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    out = contingency.tests_by(d, "toxic", "quality", ["lang"])
    return out.withColumn("statistic", F.round("statistic", 6)).withColumn("p", F.round("p", 9))


def weekly_tables(t: Tables) -> DataFrame:
    e = t.events.select(vl.iso_week(F.col("ts")).alias("w"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("arm"), (F.col("event_type") == "purchase").alias("buy"))
    return stratified.strata_tables(e, "w", "arm", "even", "odd", "buy")


_TABLES = f"t AS (SELECT period, a::DOUBLE AS a, (n1 - a)::DOUBLE AS b, c::DOUBLE AS c, (n0 - c)::DOUBLE AS d, (n1 + n0)::DOUBLE AS n FROM p)"


@query(f"""WITH {_ARMS}, {_TABLES}, s AS (SELECT count(*) AS strata, sum(a * d / n) AS r, sum(b * c / n) AS s, sum((a + d) / n * a * d / n) AS pr, sum((a + d) / n * b * c / n + (b + c) / n * a * d / n) AS m, sum((b + c) / n * b * c / n) AS qs,
sum(a - (a + b) * (a + c) / n) AS off, sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))) AS v FROM t)
SELECT strata, round(r / s, 9) AS odds_ratio, round(exp(ln(r / s) - {Z} * sqrt(pr / (2 * r * r) + m / (2 * r * s) + qs / (2 * s * s))), 9) AS low, round(exp(ln(r / s) + {Z} * sqrt(pr / (2 * r * r) + m / (2 * r * s) + qs / (2 * s * s))), 9) AS high,
round(greatest(abs(off) - 0.5, 0) ** 2 / v, 9) AS chi_square FROM s""")
def mantel_haenszel(t: Tables) -> DataFrame:
    """The common odds ratio of purchases, even against odd users, over weeks."""
    out = stratified.mantel_haenszel(weekly_tables(t))
    return out.withColumns({c: F.round(c, 9) for c in ("odds_ratio", "low", "high", "chi_square")})


@query(f"""WITH {_ARMS}, {_TABLES}, o AS (SELECT sum(a * d / n) / sum(b * c / n) AS w FROM t), q AS (SELECT a, a + c AS m1, a + b AS n1, c + d AS n0, w, 1 - w AS qa, c + d - (a + c) + w * (a + b + a + c) AS qb, -w * (a + b) * (a + c) AS qc FROM t, o),
f AS (SELECT *, (-qb + sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) AS x1, (-qb - sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) AS x2 FROM q), g AS (SELECT *, CASE WHEN x1 BETWEEN greatest(0, m1 - n0) AND least(m1, n1) THEN x1 ELSE x2 END AS f FROM f),
v AS (SELECT *, 1 / (1 / f + 1 / (m1 - f) + 1 / (n1 - f) + 1 / (n0 - m1 + f)) AS v FROM g)
SELECT count(*) AS strata, round(sum((a - f) ** 2 / v), 6) AS breslow_day, round(sum((a - f) ** 2 / v) - sum(a - f) ** 2 / sum(v), 6) AS tarone, count(*) - 1 AS dof FROM v""")
def breslow_day(t: Tables) -> DataFrame:
    tables = weekly_tables(t)
    odds = stratified.mantel_haenszel(tables).first()["odds_ratio"]
    return stratified.breslow_day(tables, odds).withColumn("breslow_day", F.round("breslow_day", 6)).withColumn("tarone", F.round("tarone", 6))


_BUNDLE = f"""e AS (SELECT {_WEEK} AS week, dayofweek(ts)::VARCHAR AS day, user_id % 2 = 0 AS even, event_type = 'purchase' AS buy FROM events), l AS (SELECT 'week' AS stratified_by, week AS k, even, buy FROM e UNION ALL SELECT 'day', day, even, buy FROM e),
t AS (SELECT stratified_by, k, count(*) FILTER (even AND buy)::DOUBLE AS a, count(*) FILTER (even AND NOT buy)::DOUBLE AS b, count(*) FILTER (NOT even AND buy)::DOUBLE AS c, count(*) FILTER (NOT even AND NOT buy)::DOUBLE AS d, count(*)::DOUBLE AS n FROM l GROUP BY ALL),
u AS (SELECT * FROM t WHERE a + b > 0 AND c + d > 0 AND a + c > 0 AND b + d > 0),
s AS (SELECT stratified_by, sum(a * d / n) AS r, sum(b * c / n) AS s, sum((a + d) / n * a * d / n) AS pr, sum((a + d) / n * b * c / n + (b + c) / n * a * d / n) AS m, sum((b + c) / n * b * c / n) AS qs, sum(a - (a + b) * (a + c) / n) AS off, sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))) AS v FROM u GROUP BY 1),
q AS (SELECT stratified_by, a, a + c AS m1, a + b AS n1, c + d AS n0, r / s AS w FROM u JOIN s USING (stratified_by)), f AS (SELECT *, n0 - m1 + w * (n1 + m1) AS qb FROM q),
g AS (SELECT *, (-qb + sqrt(qb * qb + 4 * (1 - w) * w * n1 * m1)) / (2 * (1 - w)) AS x1, (-qb - sqrt(qb * qb + 4 * (1 - w) * w * n1 * m1)) / (2 * (1 - w)) AS x2 FROM f), h AS (SELECT *, CASE WHEN x1 BETWEEN greatest(0, m1 - n0) AND least(m1, n1) THEN x1 ELSE x2 END AS f FROM g),
b AS (SELECT stratified_by, count(*) AS strata, sum((a - f) ** 2 / v) AS breslow_day, sum((a - f) ** 2 / v) - sum(a - f) ** 2 / sum(v) AS tarone, count(*) - 1 AS dof FROM (SELECT *, 1 / (1 / f + 1 / (m1 - f) + 1 / (n1 - f) + 1 / (n0 - m1 + f)) AS v FROM h) GROUP BY 1),
o AS (SELECT *, sqrt(pr / (2 * r * r) + m / (2 * r * s) + qs / (2 * s * s)) AS se FROM s)"""


@query(f"""WITH {_BUNDLE} SELECT stratified_by, strata, round(r / s, 9) AS odds_ratio, round(exp(ln(r / s) - {Z} * se), 9) AS low, round(exp(ln(r / s) + {Z} * se), 9) AS high, round(greatest(abs(off) - 0.5, 0) ** 2 / v, 6) AS chi_square, round(breslow_day, 6) AS breslow_day, round(tarone, 6) AS tarone, dof FROM o JOIN b USING (stratified_by)""")
def stratified_bundle(t: Tables) -> DataFrame:
    """Purchases of two arms, stratified by week and by day of the week: the common odds ratio, its test, and whether the strata's odds agree."""
    e = t.events.select(vl.iso_week(F.col("ts")).alias("week"), (F.dayofweek("ts") - 1).cast("string").alias("day"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("arm"), (F.col("event_type") == "purchase").alias("buy"))
    out = outcomes.stratified_bundle(e, ["week", "day"], "arm", "even", "odd", "buy")
    return out.withColumns({c: F.round(c, 9) for c in ("odds_ratio", "low", "high")} | {c: F.round(c, 6) for c in ("chi_square", "breslow_day", "tarone")})


@query("""WITH x AS (SELECT c_mktsegment AS family, c_custkey, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE ((c_custkey * 7919) % 1009) / 1009.0 END::DOUBLE AS p FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, c_custkey) AS i, count(*) OVER (PARTITION BY family) AS m FROM x WHERE p IS NOT NULL)
SELECT family, c_custkey, round(p, 9) AS p, round(max(least(1, (m - i + 1) * p)) OVER (PARTITION BY family ORDER BY p, c_custkey ROWS UNBOUNDED PRECEDING), 9) AS holm, round(min(least(1, m / i * p)) OVER (PARTITION BY family ORDER BY p DESC, c_custkey DESC ROWS UNBOUNDED PRECEDING), 9) AS bh FROM k
UNION ALL SELECT family, c_custkey, p, NULL, NULL FROM x WHERE p IS NULL""")
def holm_bh_adjust(t: Tables) -> DataFrame:
    """Adjusted p-values within segments."""
    p = F.when(F.col("c_custkey") % 50 != 0, ((F.col("c_custkey") * 7919) % 1009) / 1009.0)
    x = t.customer.select(F.col("c_mktsegment").alias("family"), "c_custkey", p.alias("p"))
    return multiplicity.adjust(x, "p", ["family"], ["c_custkey"]).withColumns({c: F.round(c, 9) for c in ("p", "holm", "bh")})


# Ranks -------------------------------------------------------------------------------------------

_UV = """v AS (SELECT o_totalprice AS x, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1),
w AS (SELECT *, coalesce(sum(b) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bb, coalesce(sum(a) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ab FROM v)"""


@query(f"""WITH {_UV}, s AS (SELECT sum(a)::BIGINT AS n1, sum(b)::BIGINT AS n2, sum(a * (bb + b / 2)) AS u, sum((a + b) ** 3 - (a + b))::DOUBLE AS t FROM w), z AS (SELECT *, n1 * n2 / 12.0 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1.0))) AS v FROM s)
SELECT n1, n2, u, t AS tie_term, round(greatest((abs(u - n1 * n2 / 2.0) - 0.5) / sqrt(v), 0), 9) AS z, round(2 * u / (n1 * n2) - 1, 9) AS delta FROM z""")
def mann_whitney_u(t: Tables) -> DataFrame:
    """Prices of finished against open orders."""
    return rank.mann_whitney(t.orders, "o_orderstatus", "o_totalprice", "F", "O").withColumn("z", F.round("z", 9)).withColumn("delta", F.round("delta", 9))


@query(f"""WITH {_UV}, s AS (SELECT sum(a)::DOUBLE AS n1, sum(b)::DOUBLE AS n2, sum(a * (bb + b / 2))::DOUBLE AS u, sum((a + b) ** 3 - (a + b))::DOUBLE AS t FROM w), z AS (SELECT *, greatest((abs(u - n1 * n2 / 2.0) - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1.0)))), 0) AS z FROM s)
SELECT u, round(2 * u / (n1 * n2) - 1, 9) AS delta, round(2 * {normal_tail_sql('z')}, 9) AS p FROM z""")
def mann_whitney_test(t: Tables) -> DataFrame:
    """The test of the two arms above, with its p-value."""
    out = rank.with_p(rank.mann_whitney(t.orders, "o_orderstatus", "o_totalprice", "F", "O"))
    return out.select("u", F.round("delta", 9).alias("delta"), F.round("p", 9).alias("p"))


@query(f"""WITH {_UV}, n AS (SELECT sum(a)::DOUBLE AS n1, sum(b)::DOUBLE AS n2 FROM w), d AS (SELECT a, b, bb, n1, n2, (bb - (n2 - bb - b)) / n2 AS oa, ((n1 - ab - a) - ab) / n1 AS ob FROM w, n),
s AS (SELECT any_value(n1) AS m, any_value(n2) AS k, sum(a * oa) / any_value(n1) AS d, sum(a * oa * oa) AS sa, sum(b * ob * ob) AS sb, sum(a * (n2 - b)) AS decided FROM d),
g AS (SELECT *, greatest((k * k * (sa - m * d * d) + m * m * (sb - k * d * d) - (decided - m * k * d * d)) / (m * k * (m - 1) * (k - 1)), 0) AS v FROM s)
SELECT m::BIGINT AS n1, k::BIGINT AS n2, round(d, 9) AS delta, round((d - d ** 3 - {Z} * sqrt(v) * sqrt((1 - d * d) ** 2 + {Z * Z} * v)) / (1 - d * d + {Z * Z} * v), 9) AS low, round((d - d ** 3 + {Z} * sqrt(v) * sqrt((1 - d * d) ** 2 + {Z * Z} * v)) / (1 - d * d + {Z * Z} * v), 9) AS high FROM g""")
def cliffs_delta(t: Tables) -> DataFrame:
    d = rank.cliffs_delta(t.orders, "o_orderstatus", "o_totalprice", "F", "O")
    return d.withColumns({c: F.round(c, 9) for c in ("delta", "low", "high")})


@query("""WITH r AS (SELECT o_orderpriority AS g, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS k, o_totalprice AS x FROM orders), t AS (SELECT sum(c ** 3 - c)::DOUBLE AS t FROM (SELECT count(*) AS c FROM r GROUP BY x)),
s AS (SELECT g, count(*) AS n, sum(k) AS r FROM r GROUP BY 1), q AS (SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(r * r / n) AS q FROM s), h AS (SELECT k, n, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n ** 3 - n)) AS h FROM q, t)
SELECT k AS groups, n::BIGINT AS n, round(h, 6) AS h, k - 1 AS dof, round((h - k + 1) / (n - k), 9) AS epsilon2 FROM h""")
def kruskal_h(t: Tables) -> DataFrame:
    """Prices over priorities."""
    return rank.kruskal(t.orders, "o_orderpriority", "o_totalprice").withColumn("h", F.round("h", 6)).withColumn("epsilon2", F.round("epsilon2", 9))


@query("""SELECT round(median(a.c_acctbal - b.c_acctbal), 6) AS shift FROM customer a, customer b WHERE a.c_mktsegment = 'MACHINERY' AND b.c_mktsegment = 'BUILDING'""")
def hodges_lehmann(t: Tables) -> DataFrame:
    """Shift of balances between two segments, without forming the differences."""
    return rank.hodges_lehmann(t.customer, "c_mktsegment", "c_acctbal", "MACHINERY", "BUILDING").select(F.round("shift", 6).alias("shift"))


@query(f"""WITH d AS (SELECT a.c_acctbal - b.c_acctbal AS x FROM customer a, customer b WHERE a.c_mktsegment = 'MACHINERY' AND b.c_mktsegment = 'BUILDING'),
n AS (SELECT count(*) FILTER (c_mktsegment = 'MACHINERY') AS n1, count(*) FILTER (c_mktsegment = 'BUILDING') AS n2 FROM customer), r AS (SELECT n1 * n2 AS pairs, greatest(1, least(n1 * n2, round_even(n1 * n2 / 2.0 - {Z} * sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0), 0)))::BIGINT AS r FROM n),
o AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM d)
SELECT round(median(x), 6) AS shift, round(max(x) FILTER (i = r), 6) AS low, round(max(x) FILTER (i = pairs - r + 1), 6) AS high FROM o, r""")
def hodges_lehmann_interval(t: Tables) -> DataFrame:
    """Moses' interval of the shift.

    Its bounds are order statistics of the differences, found as the shift is.
    """
    out = rank.hodges_lehmann(t.customer, "c_mktsegment", "c_acctbal", "MACHINERY", "BUILDING")
    return out.select(*[F.round(x, 6).alias(x) for x in ("shift", "low", "high")])


@query(f"""WITH s AS (SELECT o_orderpriority, count(*) AS n, median(o_totalprice) AS median FROM orders GROUP BY 1), k AS (SELECT DISTINCT n, unnest(range(0, n + 1)) AS k FROM s),
c AS (SELECT n, k, sum(exp({LOG_CHOOSE.format(n='n', k='k')} - n * ln(2))) OVER (PARTITION BY n ORDER BY k) AS upto FROM k), r AS (SELECT n, min(k) AS r FROM c WHERE upto >= 0.025 * (1 - 1e-12) GROUP BY 1),
v AS (SELECT o_orderpriority, o_totalprice AS x, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS i FROM orders)
SELECT o_orderpriority, n, round(median, 6) AS median, max(x) FILTER (i = r) AS low, max(x) FILTER (i = n - r + 1) AS high FROM s JOIN r USING (n) JOIN v USING (o_orderpriority) GROUP BY ALL""")
def median_ci_rank(t: Tables) -> DataFrame:
    """Median price by priority with its distribution-free interval."""
    return rank.median_interval(t.orders, "o_orderpriority", "o_totalprice").withColumn("median", F.round("median", 6))


# Regression and resampling -----------------------------------------------------------------------


@query()
def logit_trend_cluster(t: Tables) -> DataFrame:
    """Trend of purchases by arm over days, errors clustered by user."""
    day = (F.unix_micros("ts") / 8.64e10) - 19_723
    fit, test = regression.trend(t.events, (F.col("user_id") % 2 == 0), day, (F.col("event_type") == "purchase"), "user_id")
    rows = [(x["term"], x["estimate"], x["se"], x["p"], x["odds_ratio"], x["low"], x["high"]) for x in fit.terms()] + [("interaction (LR)", test["chi_square"], None, test["p"], None, None, None)]
    return t.spark.createDataFrame(rows, "term string, estimate double, se double, p double, odds_ratio double, low double, high double")


_TWO = f"""e AS (SELECT user_id, user_id % 2 = 0 AS x, event_type = 'purchase' AS y FROM events), t AS (SELECT count(*) FILTER (x AND y)::DOUBLE AS a, count(*) FILTER (x AND NOT y)::DOUBLE AS b, count(*) FILTER (NOT x AND y)::DOUBLE AS c, count(*) FILTER (NOT x AND NOT y)::DOUBLE AS d FROM e),
m AS (SELECT *, a / (a + b) AS p1, c / (c + d) AS p0, 1 / c + 1 / d AS v0, 1 / a + 1 / b AS v1, a + b + c + d AS n FROM t),
g AS (SELECT user_id, any_value(x) AS x, sum(CASE WHEN y THEN 1 ELSE 0 END - CASE WHEN x THEN p1 ELSE p0 END) AS s FROM e, m GROUP BY user_id),
r AS (SELECT sum(s * s) AS m00, sum(s * s) FILTER (x) AS m11, count(*)::DOUBLE AS g FROM g),
k AS (SELECT *, g / (g - 1) * (n - 1) / (n - 2) AS f FROM m, r),
w AS (SELECT 'intercept' AS term, ln(c / d) AS estimate, sqrt(f * v0 * v0 * (m00 - m11)) AS se FROM k UNION ALL SELECT 'arm', ln(a * d / (b * c)), sqrt(f * (v0 * v0 * m00 - 2 * v0 * (v0 + v1) * m11 + (v0 + v1) ** 2 * m11)) FROM k),
l AS (SELECT 2 * (a * ln(p1) + b * ln(1 - p1) + c * ln(p0) + d * ln(1 - p0) - (a + c) * ln((a + c) / n) - (b + d) * ln((b + d) / n)) AS x FROM m)"""


@query(f"""WITH {_TWO} SELECT term, round(estimate, 7) AS estimate, round(se, 7) AS se, round(2 * {normal_tail_sql('abs(estimate / se)')}, 7) AS p, round(exp(estimate), 7) AS odds_ratio FROM w UNION ALL SELECT 'arm (LR)', round(x, 7), NULL, round(2 * {normal_tail_sql('sqrt(greatest(x, 0))')}, 7), NULL FROM l""")
def logit_two_arms(t: Tables) -> DataFrame:
    """Purchases by arm as a logistic regression, errors clustered by user, and its likelihood-ratio test. Two arms make a table that has closed forms, which the SQL uses."""
    e = t.events.select("user_id", (F.col("user_id") % 2 == 0).cast("double").alias("x"), (F.col("event_type") == "purchase").cast("double").alias("y"))
    terms = {"intercept": F.lit(1.0), "arm": F.col("x")}
    fit = regression.fit_logistic(e, terms, F.col("y"))
    test = regression.likelihood_ratio(fit, regression.fit_logistic(e, {"intercept": F.lit(1.0)}, F.col("y")))
    rows = [(r["term"], r["estimate"], r["se"], r["p"], r["odds_ratio"]) for r in regression.cluster_covariance(e, terms, F.col("y"), "user_id", fit).terms()] + [("arm (LR)", test["chi_square"], None, test["p"], None)]
    out = t.spark.createDataFrame(rows, "term string, estimate double, se double, p double, odds_ratio double")
    return out.withColumns({c: F.round(c, 7) for c in ("estimate", "se", "p", "odds_ratio")})


@query(f"""WITH c AS (SELECT user_id % 2 = 0 AS x, user_id % 3 = 0 AS z, count(*) FILTER (event_type = 'purchase')::DOUBLE AS a, count(*) FILTER (event_type <> 'purchase')::DOUBLE AS b FROM events GROUP BY ALL),
s AS (SELECT sum(CASE WHEN x = z THEN 1 ELSE -1 END * ln(a / b)) AS estimate, sqrt(sum(1 / a + 1 / b)) AS se FROM c)
SELECT round(exp(estimate), 7) AS ratio_of_odds, round(exp(estimate - {Z} * se), 7) AS low, round(exp(estimate + {Z} * se), 7) AS high, round(2 * {normal_tail_sql('abs(estimate / se)')}, 7) AS p FROM s""")
def interaction_wald(t: Tables) -> DataFrame:
    """How the odds ratio of two arms differs between two groups: the interaction of a logistic regression, which has a closed form for its four cells."""
    e = t.events.select((F.col("user_id") % 2 == 0).cast("double").alias("x"), (F.col("user_id") % 3 == 0).cast("double").alias("z"), (F.col("event_type") == "purchase").cast("double").alias("y"))
    fit = regression.fit_logistic(e, {"one": F.lit(1.0), "x": F.col("x"), "z": F.col("z"), "both": F.col("x") * F.col("z")}, F.col("y"))
    r = fit.terms()[3]
    return t.spark.createDataFrame([(r["odds_ratio"], r["low"], r["high"], r["p"])], "ratio_of_odds double, low double, high double, p double").withColumns({c: F.round(c, 7) for c in ("ratio_of_odds", "low", "high", "p")})


@query()
def bootstrap_cramers(t: Tables) -> DataFrame:
    """Language against length, documents drawn by source."""
    d = t.documents.select("source", "lang", F.when(F.col("n_chars") < 1500, "short").otherwise("long").alias("size"))
    out = sparse.bootstrap_cramers_v(d, "source", "lang", "size", draws=2000)
    return t.spark.createDataFrame([(out["cramers_v"], out["low"], out["high"], out["draws"])], "cramers_v double, low double, high double, draws long")


@query()
def perm_richness(t: Tables) -> DataFrame:
    """Distinct part types sold in two halves of the suppliers."""
    d = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select((F.col("l_suppkey") % 2).alias("arm"), "p_brand")
    out = sparse.richness_permutation(d, "arm", "p_brand")
    return t.spark.createDataFrame([(out["first"], out["second"], out["difference"], float(out["p"]))], "first long, second long, difference long, p double")


@query(f"""WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT lang, sum(n)::BIGINT AS t, least(100, sum(n))::BIGINT AS m, count(*) AS observed FROM c GROUP BY 1)
SELECT lang, observed, round(sum(1 - CASE WHEN t - n < m THEN 0 ELSE exp({LOG_CHOOSE.format(n='(t - n)', k='m')} - {LOG_CHOOSE.format(n='t', k='m')}) END), 6) AS expected FROM c JOIN s USING (lang) GROUP BY ALL""")
def rarefaction(t: Tables) -> DataFrame:
    """Distinct sources expected among 100 documents of each language."""
    return resample.rarefied_by(t.documents, ["lang"], "source", 100).withColumn("expected", F.round("expected", 6))


@query("""WITH x AS (SELECT c_nationkey, c_mktsegment AS r, o_orderstatus AS c, count(*)::DOUBLE AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), rr AS (SELECT c_nationkey, r, sum(n) AS nr FROM x GROUP BY ALL), cc AS (SELECT c_nationkey, c, sum(n) AS nc FROM x GROUP BY ALL),
s AS (SELECT c_nationkey, sum(n) AS t, count(DISTINCT r) AS a, count(DISTINCT c) AS b FROM x GROUP BY 1), k AS (SELECT s.c_nationkey, t, (a - 1) * (b - 1) AS dof, t * (sum(n * n / (nr * nc)) - 1) AS x2 FROM x JOIN rr USING (c_nationkey, r) JOIN cc USING (c_nationkey, c) JOIN s USING (c_nationkey) GROUP BY s.c_nationkey, t, a, b)
SELECT c_nationkey, CASE WHEN dof > 0 THEN round(x2, 6) END AS chi_square, dof, CASE WHEN dof > 0 AND dof % 2 = 0 THEN round(exp(-x2 / 2) * list_sum(list_transform(range(0, dof // 2), lambda i: (x2 / 2) ** i / factorial(i::INTEGER))), 9) END AS p FROM k""")
def chi2_tail(t: Tables) -> DataFrame:
    """p-values of the chi-square of status against segment, by nation. The SQL has the tail of even degrees of freedom, which three states give."""
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "c_mktsegment", "o_orderstatus")

    @F.pandas_udf("double")
    def tail(x: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([None if v != v or v is None or not k else chi2_sf(v, int(k)) for v, k in zip(x.tolist(), dof.tolist(), strict=True)], dtype="float64")

    rows = contingency.chi_square(j, "c_mktsegment", "o_orderstatus", ["c_nationkey"])
    return rows.select("c_nationkey", F.round("chi_square", 6).alias("chi_square"), "dof", F.round(tail("chi_square", "dof"), 9).alias("p"))
