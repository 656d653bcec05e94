"""Outcome bundles: one event and several measures of two arms, summarised and compared as one family of tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import Scratch
from tallyloom.stats import intervals, rank
from tallyloom.stats.contingency import pearson
from tallyloom.stats.multiplicity import adjust
from tallyloom.stats.prob import chi2_sf, fisher_exact
from tallyloom.stats.stratified import breslow_day, mantel_haenszel, strata_tables

Z = intervals.Z


def long_measures(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """A row for each known value: the keys, ``measure`` and ``value``."""
    wide = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in measures])
    return wide.unpivot(list(keys), list(measures), "measure", "value").filter("value is not null and not isnan(value)")


def summarise(df: DataFrame, arm: str, event: str, measures: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long: a row for each group, arm and measure, the event among them, with n, estimate and interval.

    The event (boolean, null where not observed) has its rate with Wilson's
    interval; a measure has its median with the distribution-free one. ``n``
    counts what is known, ``rows`` all.
    """
    keys = [*by, arm]
    counts = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.count(event).alias("n"), F.count_if(F.col(event)).alias("k"))
    w = intervals.wilson(F.col("k"), F.col("n"))
    rates = counts.select(*keys, F.lit(event).alias("measure"), "rows", "n", F.try_divide(F.col("k"), F.col("n")).alias("estimate"), w["low"].alias("low"), w["high"].alias("high"))
    known = long_measures(df, keys, measures).withColumn("__cell", F.to_json(F.struct(*keys, "measure")))
    medians = rank.median_interval(known, "__cell", "value")
    cells = known.select(*keys, "measure", "__cell").distinct()
    named = medians.join(cells, "__cell").join(counts.select(*keys, "rows"), keys)
    return rates.unionByName(named.select(*keys, "measure", "rows", "n", F.col("median").alias("estimate"), "low", "high"))


def binary_contrast(a: float, b: float, c: float, d: float) -> dict:
    """[[a, b], [c, d]]: Yates' chi-square, or Fisher's test where an expected count is below 5; rate difference with Wald's interval, odds ratio with the log-Wald one."""
    table = np.array([[a, b], [c, d]], float)
    out = dict.fromkeys(("method", "statistic", "p", "effect", "estimate", "estimate_low", "estimate_high", "odds_ratio", "odds_low", "odds_high", "chi_p", "fisher_p"))
    if (table.sum(0) == 0).any() or (table.sum(1) == 0).any():
        return out
    x, dof, expected = pearson(table, yates=True)
    out["chi_p"], out["fisher_p"] = chi2_sf(x, dof), fisher_exact(*map(int, table.ravel()))[1]
    small = expected.min() < 5
    out["method"], out["p"], out["statistic"] = ("fisher", out["fisher_p"], x) if small else ("chi-square", out["chi_p"], x)
    out["effect"] = math.sqrt(x / table.sum())
    n = table.sum(1)
    rates = table[:, 0] / n
    half = Z * math.sqrt((rates * (1 - rates) / n).sum())
    out["estimate"] = float(rates[0] - rates[1])
    out["estimate_low"], out["estimate_high"] = out["estimate"] - half, out["estimate"] + half
    if table.min() > 0:
        log, se = math.log(a * d / (b * c)), math.sqrt((1 / table).sum())
        out["odds_ratio"], out["odds_low"], out["odds_high"] = math.exp(log), math.exp(log - Z * se), math.exp(log + Z * se)
    return out


def _binary(tables: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``columns`` of ``binary_contrast`` for rows with a, b, c and d; ``keys`` and the cells stay."""

    def judge(frames):
        for f in frames:
            rows = [binary_contrast(*x) for x in f[["a", "b", "c", "d"]].itertuples(index=False)]
            for name in columns:
                f[name] = [r[name] for r in rows]
            yield f

    kept = tables.select(*keys, *[F.col(x).cast("long").alias(x) for x in "abcd"])
    made = [T.StructField(c, T.StringType() if c == "method" else T.DoubleType()) for c in columns]
    return kept.mapInPandas(judge, T.StructType([*kept.schema.fields, *made]))


def contrasts(df: DataFrame, arm: str, first: str, second: str, event: str, measures: Sequence[str], by: Sequence[str] = (), shifts: bool = True) -> DataFrame:
    """Long: a row for each group and measure, the event among them: method, sizes, statistic, p, effect and estimate with intervals, and ``bh``.

    The event: Yates' chi-square or Fisher's test, Cramér's V and the
    difference of rates. Measures: Mann-Whitney's U, Cliff's delta and the
    Hodges-Lehmann shift (null without ``shifts``). All tests of a group are
    one family.
    """
    of = lambda a, e: F.count_if((F.col(arm) == a) & (F.col(event) == e))
    tables = df.filter(F.col(event).isNotNull()).groupBy(*by).agg(of(first, True).alias("a"), of(first, False).alias("b"), of(second, True).alias("c"), of(second, False).alias("d"))
    binary = _binary(tables, by, ["method", "statistic", "p", "effect", "estimate", "estimate_low", "estimate_high"]).filter("method is not null")
    null = F.lit(None).cast("double")
    rates = binary.select(*by, F.lit(event).alias("measure"), "method", (F.col("a") + F.col("b")).alias("n1"), (F.col("c") + F.col("d")).alias("n2"), "statistic", "p", "effect", null.alias("effect_low"), null.alias("effect_high"), "estimate", "estimate_low", "estimate_high")
    keys = [*by, "measure"]
    known = long_measures(df, [*by, arm], measures)
    # Counts of distinct values serve three statistics; they and their running sums are written once.
    scratch = Scratch(df.sparkSession, "contrasts")
    counts = scratch.table(rank.arm_counts(known, arm, "value", first, second, keys), "counts")
    running = scratch.table(rank.with_below(counts, keys), "running")
    u = rank.with_p(rank.mann_whitney_of(running, keys)).filter("n1 > 0 and n2 > 0")
    delta = rank.cliffs_delta_of(running, Z, keys).select(*keys, F.col("low").alias("effect_low"), F.col("high").alias("effect_high"))
    ranks = u.join(delta, keys)
    if shifts:
        found = rank.hodges_lehmann_of(counts, keys)
        ranks = ranks.join(found.select(*keys, F.col("shift").alias("estimate"), F.col("low").alias("estimate_low"), F.col("high").alias("estimate_high")), keys)
    else:
        ranks = ranks.withColumns({c: null for c in ("estimate", "estimate_low", "estimate_high")})
    ranks = ranks.select(*keys, F.lit("mann-whitney").alias("method"), "n1", "n2", F.col("u").alias("statistic"), "p", F.col("delta").alias("effect"), "effect_low", "effect_high", "estimate", "estimate_low", "estimate_high")
    return adjust(rates.unionByName(ranks).withColumn("__family", F.lit(1)), "p", ["__family", *by], ["measure"]).drop("__family", "holm")


def period_contrasts(df: DataFrame, period: str, arm: str, first: str, second: str, event: str) -> DataFrame:
    """A row for each period: both arms' rates, the difference with Wald's and Newcombe's intervals, Yates' chi-square, Fisher's p, and Holm's p over the periods."""
    tables = strata_tables(df, period, arm, first, second, event)
    tests = _binary(tables, [period], ["statistic", "chi_p", "fisher_p", "estimate", "estimate_low", "estimate_high"])
    n1, n0 = F.col("a") + F.col("b"), F.col("c") + F.col("d")
    n = intervals.newcombe(F.col("a"), n1, F.col("c"), n0)
    out = tests.select(
        period, n1.alias("n1"), n0.alias("n0"), F.try_divide(F.col("a"), n1).alias("rate1"), F.try_divide(F.col("c"), n0).alias("rate0"), F.col("estimate").alias("difference"), F.col("estimate_low").alias("low"), F.col("estimate_high").alias("high"),
        n["low"].alias("newcombe_low"), n["high"].alias("newcombe_high"), F.col("statistic").alias("chi_square"), "chi_p", "fisher_p",
    )
    return adjust(out.withColumn("__family", F.lit(1)), "fisher_p", ["__family"], [period]).drop("__family", "bh")


def stratified_bundle(df: DataFrame, strata: Sequence[str], arm: str, first: str, second: str, event: str) -> DataFrame:
    """A row for each way to stratify: the common odds ratio with its interval and test, and the homogeneity of the strata's odds ratios."""
    out, scratch = None, Scratch(df.sparkSession, "strata")
    for by in strata:
        # Read for the common odds ratio and again for what it implies: written once.
        tables = scratch.table(strata_tables(df, by, arm, first, second, event), "tables")
        common = mantel_haenszel(tables)
        homogeneous = breslow_day(tables, common.first()["odds_ratio"])
        row = common.drop("strata").crossJoin(F.broadcast(homogeneous)).withColumn("stratified_by", F.lit(by))
        out = row if out is None else out.unionByName(row)
    return out
