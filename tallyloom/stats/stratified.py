"""Stratified 2x2 tables: Mantel–Haenszel's common odds ratio and Breslow–Day's homogeneity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.stats.intervals import Z


def strata_tables(df: DataFrame, stratum: str, arm: str, first: str, second: str, event: str) -> DataFrame:
    """stratum, a, b, c, d: events and non-events of the first arm, then of the second."""
    e = F.coalesce(F.col(event), F.lit(False))
    one, two = F.col(arm) == first, F.col(arm) == second
    cells = {"a": one & e, "b": one & ~e, "c": two & e, "d": two & ~e}
    return df.groupBy(stratum).agg(*[F.count_if(c).cast("double").alias(n) for n, c in cells.items()])


def mantel_haenszel(tables: DataFrame, z: float = Z) -> DataFrame:
    """One row: informative strata, the common odds ratio, its interval (Robins, Breslow and Greenland) and the corrected chi-square."""
    t = tables.withColumn("n", F.col("a") + F.col("b") + F.col("c") + F.col("d"))
    t = t.filter((F.col("a") + F.col("b") > 0) & (F.col("c") + F.col("d") > 0) & (F.col("a") + F.col("c") > 0) & (F.col("b") + F.col("d") > 0))
    a, b, c, d, n = (F.col(x) for x in "abcdn")
    p, q, r, s = (a + d) / n, (b + c) / n, a * d / n, b * c / n
    expected = (a + b) * (a + c) / n
    variance = (a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))
    sums = t.agg(
        F.count("*").alias("strata"), F.sum(r).alias("r"), F.sum(s).alias("s"), F.sum(p * r).alias("pr"), F.sum(p * s + q * r).alias("mixed"), F.sum(q * s).alias("qs"), F.sum(a - expected).alias("off"), F.sum(F.when(n > 1, variance)).alias("variance")
    )
    odds = F.when((F.col("s") > 0) & (F.col("r") > 0), F.col("r") / F.col("s"))
    se = F.sqrt(F.col("pr") / (2 * F.col("r") * F.col("r")) + F.col("mixed") / (2 * F.col("r") * F.col("s")) + F.col("qs") / (2 * F.col("s") * F.col("s")))
    corrected = F.greatest(F.abs(F.col("off")) - 0.5, F.lit(0.0))
    return sums.select("strata", odds.alias("odds_ratio"), F.exp(F.log(odds) - z * se).alias("low"), F.exp(F.log(odds) + z * se).alias("high"), F.when(F.col("variance") > 0, corrected * corrected / F.col("variance")).alias("chi_square"))


def breslow_day(tables: DataFrame, odds_ratio: float) -> DataFrame:
    """One row: strata used, Breslow–Day's statistic and with Tarone's correction, and degrees of freedom.

    In each stratum the first cell fitted to the common odds ratio is the root
    of a quadratic within its feasible range.
    """
    a, b, c, d = (F.col(x) for x in "abcd")
    m1, n1, n0, n = a + c, a + b, c + d, a + b + c + d
    t = tables.filter((m1 > 0) & (n1 > 0) & (n0 > 0) & (b + d > 0))
    w = F.lit(float(odds_ratio))
    lo, hi = F.greatest(F.lit(0.0), m1 - n0), F.least(m1, n1)
    # (1 - w) x^2 + (n0 - m1 + w (n1 + m1)) x - w n1 m1 = 0
    qa, qb, qc = 1 - w, n0 - m1 + w * (n1 + m1), -w * n1 * m1
    root = F.sqrt(F.greatest(qb * qb - 4 * qa * qc, F.lit(0.0)))
    x1, x2 = (-qb + root) / (2 * qa), (-qb - root) / (2 * qa)
    flat = n1 * m1 / n
    fitted = F.when(F.abs(qa) < 1e-12, flat).when((x1 >= lo) & (x1 <= hi), x1).otherwise(x2)
    t = t.select(a.alias("a"), fitted.alias("f"), m1.alias("m1"), n1.alias("n1"), n0.alias("n0"))
    f = F.col("f")
    var = 1 / (1 / f + 1 / (F.col("m1") - f) + 1 / (F.col("n1") - f) + 1 / (F.col("n0") - F.col("m1") + f))
    sums = t.agg(F.count("*").alias("strata"), F.sum(F.pow(F.col("a") - f, 2) / var).alias("x"), F.sum(F.col("a") - f).alias("off"), F.sum(var).alias("var"))
    return sums.select("strata", F.col("x").alias("breslow_day"), (F.col("x") - F.col("off") * F.col("off") / F.col("var")).alias("tarone"), (F.col("strata") - 1).alias("dof"))
