"""Aggregates beyond the built-in ones: shares, funnels, paired changes, confusion, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.stats.rank import percentiles


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares of all values, null among them. Shares come from the counts, not from the rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("__total")).drop("__total")


def describe(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """count, mean, standard deviation, least, exact quartiles and greatest."""
    moments = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    quartiles = percentiles(df, group, value, (0.25, 0.5, 0.75)).select(*group, F.col("quantiles").alias("__q"))
    out = moments.join(quartiles, list(group), "left") if group else moments.crossJoin(F.broadcast(quartiles))
    return out.select(*group, "n", "mean", "std", "least", *[F.element_at("__q", k + 1).alias(f"q{25 * (k + 1)}") for k in range(3)], "greatest")


def label_shares(df: DataFrame, group: Sequence[str], label: str, domain: Sequence[str]) -> DataFrame:
    """Per group: rows, and for each label of the domain its count and share, long."""
    counts = df.groupBy(*group).agg(F.count("*").alias("total"), *[F.count_if(F.col(label) == d).alias(d) for d in domain])
    return counts.unpivot([*group, "total"], list(domain), label, "n").withColumn("share", F.try_divide(F.col("n"), F.col("total")))


def paired_change(before: DataFrame, after: DataFrame, keys: Sequence[str], item: str, metrics: Sequence[str]) -> DataFrame:
    """Means over the items that both sides have, their difference, and the change in percent (null from 0)."""
    a = before.select(*keys, item, *[F.col(m).alias(f"__b_{m}") for m in metrics])
    b = after.select(*keys, item, *[F.col(m).alias(f"__a_{m}") for m in metrics])
    joined = a.join(b, [*keys, item])
    means = []
    for m in metrics:
        both = F.col(f"__b_{m}").isNotNull() & F.col(f"__a_{m}").isNotNull()
        means += [F.avg(F.when(both, F.col(f"__b_{m}"))).alias(f"{m}_before"), F.avg(F.when(both, F.col(f"__a_{m}"))).alias(f"{m}_after")]
    out = joined.groupBy(*keys).agg(F.count("*").alias("items"), *means)
    for m in metrics:
        x, y = F.col(f"{m}_before"), F.col(f"{m}_after")
        out = out.withColumn(f"{m}_delta", y - x).withColumn(f"{m}_percent", F.when(x != 0, (y - x) * 100 / x))
    return out


def complete_cases(df: DataFrame, keys: Sequence[str], item: str, count: int) -> DataFrame:
    """Rows of the keys that have exactly so many distinct items."""
    whole = df.groupBy(*keys).agg(F.countDistinct(item).alias("__n")).filter(F.col("__n") == count).select(*keys)
    return df.join(whole, list(keys), "left_semi")


def funnel(df: DataFrame, group: Sequence[str], key: str, layers: dict[str, Column]) -> DataFrame:
    """Distinct keys of each layer, by group, in one pass."""
    return df.groupBy(*group).agg(*[F.countDistinct(F.when(c, F.col(key))).alias(n) for n, c in layers.items()])


def capped_histogram(df: DataFrame, value: str, cap: int) -> DataFrame:
    """Counts and shares of 0, 1, ... up to the cap, which stands for itself and more."""
    binned = df.filter(F.col(value).isNotNull()).withColumn("bin", F.least(F.col(value), F.lit(cap)).cast("int"))
    counts = value_counts(binned, "bin")
    domain = F.broadcast(df.sparkSession.range(cap + 1).select(F.col("id").cast("int").alias("bin")))
    return domain.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("share", F.lit(0.0)).alias("share"))


def confusion(df: DataFrame, predicted: str, actual: str, weight: Column | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Weighted confusion counts, precision, recall and F1; null where undefined."""
    w = weight if weight is not None else F.lit(1.0)
    p, a = F.coalesce(F.col(predicted).cast("boolean"), F.lit(False)), F.coalesce(F.col(actual).cast("boolean"), F.lit(False))
    total = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0.0))
    sums = df.groupBy(*group).agg(F.count("*").alias("n"), total(p & a).alias("tp"), total(p & ~a).alias("fp"), total(~p & a).alias("fn"), total(~p & ~a).alias("tn"))
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def most_common(df: DataFrame, group: Sequence[str], label: str, order: str) -> DataFrame:
    """Each group's most frequent label; of equals the one that came first by ``order``."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(*group, label).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    best = counts.groupBy(*group).agg(F.max_by(F.struct(label, "n"), F.struct("n", (-F.col("__first")).alias("f"))).alias("__best"))
    return best.select(*group, f"__best.{label}", "__best.n")


def fixed_counts(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Counts over a fixed domain, 0 where nothing is."""
    names = F.broadcast(df.sparkSession.createDataFrame([(d,) for d in domain], f"{column} string"))
    return names.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def token_cost(df: DataFrame, group: Sequence[str], tokens_in: str, tokens_out: str, price_in: float, price_out: float) -> DataFrame:
    """Tokens and their cost at prices for a million; unknown counts are 0."""
    i, o = F.coalesce(F.sum(tokens_in), F.lit(0)), F.coalesce(F.sum(tokens_out), F.lit(0))
    return df.groupBy(*group).agg(F.count("*").alias("requests"), i.cast("long").alias("tokens_in"), o.cast("long").alias("tokens_out"), ((i * price_in + o * price_out) / 1e6).alias("cost"))


def co_reporting(df: DataFrame, group: str, gain: str, other: str, label: str = "All") -> DataFrame:
    """Per group and overall: rows with gain, with the other, with both, and the share of gains without the other."""
    g, o = F.coalesce(F.col(gain), F.lit(False)), F.coalesce(F.col(other), F.lit(False))
    out = df.rollup(group).agg(
        F.when(F.grouping(group) == 1, label).otherwise(F.col(group)).alias("__g"), F.count("*").alias("n"), F.count_if(g).alias("gain"), F.count_if(o).alias("other"), F.count_if(g & o).alias("both"), F.count_if(g & ~o).alias("gain_only")
    )
    return out.select(F.col("__g").alias(group), "n", "gain", "other", "both", "gain_only", F.try_divide(F.col("gain_only"), F.col("gain")).alias("gain_only_share"))


def clip_quantiles(df: DataFrame, value: str, low: float, high: float, name: str) -> DataFrame:
    """``name``: the value clipped to two interpolated quantiles of all rows; null stays null."""
    bounds = percentiles(df, [], value, (low, high)).select(F.get("quantiles", F.lit(0)).alias("__low"), F.get("quantiles", F.lit(1)).alias("__high"))
    clipped = F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value).cast("double"), F.col("__low")), F.col("__high")))
    return df.crossJoin(F.broadcast(bounds)).withColumn(name, clipped).drop("__low", "__high")
