"""Rank statistics from counts of distinct values: no pair of rows is formed."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import Scratch, bound_arrow_batches
from tallyloom.stats.prob import binomial_ppf, chi2_sf, normal_ppf, normal_sf

#: Distinct values up to which ranks are made in one ordered pass; beyond it values are dealt into ranges first.
ONE_PASS = 200_000

#: Distinct values of a block of a large group, and thresholds that a step asks about in a bracket.
BLOCK = 4096
ASKED = 15
#: Which bracket each of ``shift_ranks`` begins in: the median's two ranks lie side by side.
RANK_BRACKETS = (0, 0, 1, 2)


def arm_counts(df: DataFrame, arm: str, value: str, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """A row for each distinct value, in groups: ``x`` and the rows of either arm, ``a`` and ``b``."""
    known = df.filter(F.col(value).isNotNull() & F.col(arm).isin(first, second))
    return known.groupBy(*by, F.col(value).cast("double").alias("x")).agg(F.count_if(F.col(arm) == first).alias("a"), F.count_if(F.col(arm) == second).alias("b"))


def with_below(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts with the rows of either arm below each value (a_below, b_below)."""
    return running(counts, "x", {"a_below": "a", "b_below": "b"}, by)


def two_arms(df: DataFrame, arm: str, value: str, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of distinct values with those below. They serve several times and are written once."""
    return with_below(Scratch(df.sparkSession, "arms").table(arm_counts(df, arm, value, first, second, by), "counts"), by)


def running(counts: DataFrame, order: str, sums: dict[str, str], within: Sequence[str] = (), exact: str | None = None) -> DataFrame:
    """Sums over all smaller values, in groups. Values are dealt into ranges by approximate quantiles: sums within a range, and over the ranges before.

    ``exact``: the column that ``order``, a double, stands for, where doubles may not tell its values apart.
    """
    cuts = sorted(set(counts.approxQuantile(order, [k / 64 for k in range(1, 64)], 0.01)))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    dealt = counts.withColumn("__bucket", bucket)
    before = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*within, "__bucket").agg(*[F.sum(s).alias(f"__{n}") for n, s in sums.items()])
    ahead = totals.select(*within, "__bucket", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy(*within, "__bucket").orderBy(exact or order).rowsBetween(Window.unboundedPreceding, -1)
    # Null keys are groups, too.
    right = ahead.select(*[F.col(c).alias(f"__r_{c}") for c in (*within, "__bucket")], *[f"__{n}" for n in sums])
    on = F.col("__bucket") == F.col("__r___bucket")
    for c in within:
        on = on & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    joined = dealt.join(right if within else F.broadcast(right), on).drop(*[f"__r_{c}" for c in (*within, "__bucket")])
    return joined.withColumns({n: F.col(f"__{n}") + F.coalesce(F.sum(s).over(inside), F.lit(0)) for n, s in sums.items()}).drop("__bucket", *[f"__{n}" for n in sums])


def _real(name: str) -> Column:
    """A count for products: those of longs would overflow."""
    return F.col(name).cast("double")


def mann_whitney(df: DataFrame, arm: str, value: str, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """A row for each group: sizes, U of the first arm, the tie term, z with continuity correction, and Cliff's delta."""
    return mann_whitney_of(two_arms(df, arm, value, first, second, by), by)


def mann_whitney_of(t: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``mann_whitney`` from counts (``with_below``)."""
    wins = _real("a") * (F.col("b_below") + F.col("b") / 2)
    ties = _real("a") + _real("b")
    sums = t.groupBy(*by).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(wins).alias("u"), F.sum(ties * ties * ties - ties).alias("tie_term"))
    n1, n2 = _real("n1"), _real("n2")
    n, pairs = n1 + n2, n1 * n2
    variance = pairs / 12.0 * ((n + 1) - F.col("tie_term") / (n * (n - 1)))
    z = (F.abs(F.col("u") - pairs / 2.0) - 0.5) / F.sqrt(variance)
    fine = (F.col("n1") > 0) & (F.col("n2") > 0)
    return sums.select(*by, "n1", "n2", F.when(fine, F.col("u")).alias("u"), "tie_term", F.when(fine & (variance > 0), F.greatest(z, F.lit(0.0))).alias("z"), F.when(fine, 2 * F.col("u") / pairs - 1).alias("delta"))


def mann_whitney_p(row) -> float | None:
    """Two-sided p of a row of ``mann_whitney``: exact for small arms without ties, else normal."""
    n1, n2, u = row["n1"], row["n2"], row["u"]
    if not n1 or not n2 or u is None:
        return None
    n1, n2 = int(n1), int(n2)
    if row["tie_term"] == 0 and min(n1, n2) <= 8:
        counts = [1] + [0] * (n1 * n2)
        for k in range(1, n1 + 1):  # the generating function of U, factor by factor
            for s in range(n1 * n2, n2 + k - 1, -1):
                counts[s] -= counts[s - n2 - k]
            for s in range(k, n1 * n2 + 1):
                counts[s] += counts[s - k]
        low = sum(counts[: int(min(u, n1 * n2 - u)) + 1])
        return min(1.0, 2 * low / math.comb(n1 + n2, n1))
    return 1.0 if row["z"] is None else min(1.0, 2 * normal_sf(row["z"]))


def with_p(tests: DataFrame) -> DataFrame:
    """Rows of ``mann_whitney`` with their two-sided ``p``; a row for each group, worked out on the executors."""

    def add(frames):
        for f in frames:
            f["p"] = [mann_whitney_p({k: None if v is None or v != v else v for k, v in r.items()}) for r in f.to_dict("records")]
            yield f

    wide = tests.withColumn("u", F.col("u").cast("double"))
    return wide.mapInPandas(add, T.StructType([*wide.schema.fields, T.StructField("p", T.DoubleType())]))


def cliffs_delta(df: DataFrame, arm: str, value: str, first: str, second: str, z: float = 1.959963984540054, by: Sequence[str] = ()) -> DataFrame:
    """A row for each group: delta with Cliff's asymmetric interval, from each value's dominance over the other arm.

    A variance below 0 counts as 0; bounds are given as the formula has them,
    so in very small samples they may pass -1 or 1. Null bounds for arms of
    fewer than two rows.
    """
    return cliffs_delta_of(two_arms(df, arm, value, first, second, by), z, by)


def cliffs_delta_of(t: DataFrame, z: float = 1.959963984540054, by: Sequence[str] = ()) -> DataFrame:
    """``cliffs_delta`` from counts (``with_below``)."""
    n = t.groupBy(*by).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    r = t.join(n, list(by)) if by else t.crossJoin(F.broadcast(n))
    a, b, m, k = _real("a"), _real("b"), _real("n1"), _real("n2")
    over_b = (F.col("b_below") - (F.col("n2") - F.col("b_below") - F.col("b"))) / k
    over_a = ((F.col("n1") - F.col("a_below") - F.col("a")) - F.col("a_below")) / m
    sums = r.groupBy(*by, "n1", "n2").agg(F.sum(a * over_b).alias("s"), F.sum(a * over_b * over_b).alias("sa"), F.sum(b * over_a * over_a).alias("sb"), F.sum(a * (k - b)).alias("decided"))
    d = F.col("s") / m
    va, vb = F.col("sa") - m * d * d, F.col("sb") - k * d * d
    all_pairs = F.col("decided") - m * k * d * d
    var = (k * k * va + m * m * vb - all_pairs) / (m * k * (m - 1) * (k - 1))
    var = F.greatest(var, F.lit(0.0))
    root = z * F.sqrt(var) * F.sqrt(F.pow(1 - d * d, 2) + z * z * var)
    bottom = 1 - d * d + z * z * var
    fine = (m > 1) & (k > 1) & (bottom > 0)
    return sums.select(*by, "n1", "n2", d.alias("delta"), F.when(fine, (d - d * d * d - root) / bottom).alias("low"), F.when(fine, (d - d * d * d + root) / bottom).alias("high"))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: groups, rows, H with tie correction, degrees of freedom and epsilon squared. Groups of one row are left out; equal values give 0."""
    cells = df.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("x")).agg(F.count("*").alias("m"))
    # The counts serve three times; they are written once.
    return kruskal_of(Scratch(df.sparkSession, "kruskal").table(cells, "cells"), group)


def kruskal_of(cells: DataFrame, group: str) -> DataFrame:
    """``kruskal`` from counts: the group, a value ``x`` and ``m``, how many rows have it."""
    sizes = cells.groupBy(group).agg(F.sum("m").alias("__n"))
    cells = cells.join(sizes.filter("__n >= 2").select(group), group)
    values = running(cells.groupBy("x").agg(F.sum("m").alias("t")), "x", {"below": "t"}).withColumn("rank", F.col("below") + (F.col("t") + 1) / 2)
    sums = cells.join(values.select("x", "rank"), "x").groupBy(group).agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("rank")).alias("r"))
    t = _real("t")
    ties = values.agg(F.sum(t * t * t - t).alias("ties"))
    whole = sums.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q")).crossJoin(ties)
    n, k = _real("n"), F.col("groups")
    h0 = 12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    correction = 1 - F.col("ties") / (n * n * n - n)
    h = F.when(correction > 0, h0 / correction).otherwise(0.0)
    return whole.select("groups", "n", h.alias("h"), (k - 1).cast("long").alias("dof"), F.when(n > k, (h - k + 1) / (n - k)).alias("epsilon2"))


def kruskal_p(row) -> float | None:
    return None if row["dof"] is None or row["dof"] < 1 else (1.0 if row["h"] == 0 else chi2_sf(row["h"], row["dof"]))


def moses_rank(n: int, m: int, level: float = 0.95) -> int:
    """The rank of the difference that bounds Moses' interval from below."""
    pairs = n * m
    return min(max(round(pairs / 2 - normal_ppf(0.5 + level / 2) * math.sqrt(pairs * (n + m + 1) / 12)), 1), pairs)


def shift_ranks(n: int, m: int, level: float = 0.95) -> list[int]:
    """Ranks of the differences that the median (two of them) and the interval's bounds are."""
    pairs, low = n * m, moses_rank(n, m, level)
    return [(pairs + 1) // 2, pairs // 2 + 1, low, pairs - low + 1]


def differences_at(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, ranks: Sequence[int]) -> list[float]:
    """The differences x - y of some ranks, from sorted distinct values and their counts, by bisection over how many lie below."""
    m = int(ny.sum())
    cy = np.concatenate(([0], np.cumsum(ny)))

    def below(t: float) -> int:
        """Differences of at most t: y >= x - t."""
        return int((nx * (m - cy[np.searchsorted(y, x - t, side="left")])).sum())

    def statistic(k: int) -> float:
        lo, hi = x[0] - y[-1], x[-1] - y[0]
        for _ in range(200):
            mid = (lo + hi) / 2
            if below(mid) >= k:
                hi = mid
            else:
                lo = mid
            if hi - lo <= 1e-13 * max(1.0, abs(lo), abs(hi)):
                break
        # The nearest difference that is really there.
        best = None
        for j in (-1, 0, 1):
            at = np.searchsorted(y, x - hi) + j
            ok = (at >= 0) & (at < len(y))
            if ok.any():
                d = x[ok] - y[at[ok]]
                c = float(d[np.argmin(np.abs(d - hi))])
                best = c if best is None or abs(c - hi) < abs(best - hi) else best
        return hi if best is None else best

    return [statistic(k) for k in ranks]


def _open_pairs(xs: pd.DataFrame, ys: pd.DataFrame, ranks: Sequence[int]) -> list[tuple]:
    """Per bracket of ``RANK_BRACKETS``: its number and ends, the differences surely below it, and the blocks of either side whose differences may lie in it.

    The smallest differences of pairs of blocks have no rank above that of the
    true ones, the largest none below: both are looked up as differences are.
    """
    n, m = (b["size"].to_numpy(object if int(xs["size"].sum()) * int(ys["size"].sum()) >= 1 << 62 else np.int64) for b in (xs, ys))
    x_lo, x_hi, y_lo, y_hi = (b[c].to_numpy() for b in (xs, ys) for c in ("lo", "hi"))
    margin = 1e-9 * max(1.0, *(float(np.abs(e).max()) for e in (x_lo, x_hi, y_lo, y_hi)))
    least, most = differences_at(x_lo, n, y_hi, m, ranks), differences_at(x_hi, n, y_lo, m, ranks)
    upto = np.concatenate((m[:0], [0], np.cumsum(m)))
    out = []
    for k in sorted(set(RANK_BRACKETS)):
        own = [i for i, b in enumerate(RANK_BRACKETS) if b == k]
        lo, hi = min(least[i] for i in own) - margin, max(most[i] for i in own) + margin
        first, stop = np.searchsorted(y_hi, x_lo - hi, side="left"), np.searchsorted(y_lo, x_hi - lo, side="left")
        sure = sum(int(a) * int(upto[-1] - upto[j]) for a, j in zip(n, stop, strict=True))
        wide = np.maximum(stop - first, 0)
        at_y = np.concatenate([np.arange(f, f + w) for f, w in zip(first, wide, strict=True)])
        out.append((k, float(lo), float(hi), str(sure), np.repeat(xs["id"].to_numpy(), wide), ys["id"].to_numpy()[at_y]))
    return out


def _count_below(batches):
    """Rows ``ask, j, below`` of a task: over its pairs of blocks, the differences of at most the bracket's j-th threshold."""
    found: dict[int, list[int]] = {}
    for batch in batches:
        column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        for r in range(batch.num_rows):
            x, n, y, m = (column[c][r].values.to_numpy() for c in ("x", "n", "y", "m"))
            if float(n.sum()) * float(m.sum()) >= 2.0**62:
                n, m = n.astype(object), m.astype(object)
            upto = np.concatenate((m[:0], [0], np.cumsum(m)))
            sums = found.setdefault(column["ask"][r].as_py(), [0] * ASKED)
            for j, t in enumerate(thresholds(column["lo"][r].as_py(), column["hi"][r].as_py())):
                sums[j] += int((n * (upto[-1] - upto[np.searchsorted(y, x - t, side="left")])).sum())
    rows = [(ask, j, str(s)) for ask, sums in found.items() for j, s in enumerate(sums)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string()), strict=True)], names=["ask", "j", "below"])


def thresholds(lo: float, hi: float) -> list[float]:
    """Where a step asks within a bracket."""
    return [lo + (hi - lo) * j / (ASKED + 1) for j in range(1, ASKED + 1)]


def _shifts_of_large(counts: DataFrame, by: Sequence[str], sizes: list, level: float, block: int = BLOCK) -> list[tuple]:
    """Shift and interval of groups too large for one task.

    The values of either side are dealt into blocks. The blocks' ends and
    sizes bracket each rank so closely that a block's differences to few other
    blocks can lie in the bracket; these pairs of blocks are written once, and
    a step counts over them how many differences lie below some thresholds,
    without a shuffle of values. Brackets end within 1e-13 of their size; the
    driver holds four for each such group.
    """
    spark = counts.sparkSession
    bound_arrow_batches(spark)
    scratch = Scratch(spark, "shift")
    side = [*by, "__first"]
    dealt = running(counts.withColumn("__one", F.lit(1)), "x", {"__at": "__one"}, side)
    blocks = dealt.groupBy(*side, F.floor(F.col("__at") / block).alias("__block")).agg(F.sort_array(F.collect_list(F.struct("x", "n"))).alias("__v"), F.sum("n").alias("size"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    blocks = scratch.table(blocks.select(*side, "size", "lo", "hi", F.col("__v.x").alias("x"), F.col("__v.n").alias("n"), F.monotonically_increasing_id().alias("id")), "blocks")
    keys = [f for f in counts.schema.fields if f.name in by]
    schema = T.StructType([*keys, *T._parse_datatype_string("gid long, bracket int, lo double, hi double, sure string, xs array<long>, ys array<long>").fields])

    def pair(pdf):
        pdf = pdf.sort_values("lo")
        xs, ys = pdf[pdf["__first"]], pdf[~pdf["__first"]]
        own = [pdf[c].iloc[0] for c in by]
        ranks = shift_ranks(int(xs["size"].sum()), int(ys["size"].sum()), level)
        return pd.DataFrame([[*own, int(pdf["id"].min()), *row] for row in _open_pairs(xs, ys, ranks)], columns=schema.names)

    ends = blocks.select(*side, "id", "size", "lo", "hi")
    brackets = scratch.table((ends.groupBy(*by) if by else ends.withColumn("__all", F.lit(1)).groupBy("__all")).applyInPandas(pair, schema), "brackets")
    each = brackets.select("gid", "bracket", F.explode(F.arrays_zip("xs", "ys")).alias("p")).select("gid", "bracket", "p.*")
    pairs = each.join(blocks.select(F.col("id").alias("xs"), "x", "n"), "xs").join(blocks.select(F.col("id").alias("ys"), F.col("x").alias("y"), F.col("n").alias("m")), "ys")
    pairs = scratch.table(pairs.select("gid", "bracket", "x", "n", "y", "m"), "pairs")

    ranks = {tuple(s[c] for c in by): shift_ranks(s["n"], s["m"], level) for s in sizes}
    open_ = [{"key": tuple(r[c] for c in by), "at": i, "gid": r["gid"], "bracket": r["bracket"], "lo": r["lo"], "hi": r["hi"], "k": ranks[tuple(r[c] for c in by)][i] - int(r["sure"])} for r in brackets.drop("xs", "ys").collect() for i, b in enumerate(RANK_BRACKETS) if b == r["bracket"]]
    for _ in range(60):
        wide = [o for o in open_ if o["hi"] - o["lo"] > 1e-13 * max(1.0, abs(o["lo"]), abs(o["hi"]))]
        if not wide:
            break
        # Ranks side by side share their bracket until they part.
        asks = {ask: i for i, ask in enumerate(dict.fromkeys((o["gid"], o["bracket"], o["lo"], o["hi"]) for o in wide))}
        table = spark.createDataFrame([(*ask, i) for ask, i in asks.items()], "gid long, bracket int, lo double, hi double, ask long")
        counted = pairs.join(table, ["gid", "bracket"]).select("ask", "lo", "hi", "x", "n", "y", "m").mapInArrow(_count_below, "ask long, j int, below string")
        got = {(r[0], r[1]): int(r[2]) for r in counted.groupBy("ask", "j").agg(F.sum(F.col("below").cast("decimal(38,0)"))).collect()}
        for o in wide:
            ask, ts = asks[o["gid"], o["bracket"], o["lo"], o["hi"]], thresholds(o["lo"], o["hi"])
            first = next((j for j in range(ASKED) if got.get((ask, j), 0) >= o["k"]), ASKED)
            o["lo"], o["hi"] = (ts[first - 1] if first else o["lo"]), (ts[first] if first < ASKED else o["hi"])
    scratch.drop(pairs)
    found: dict[tuple, list[float]] = {}
    for o in sorted(open_, key=lambda o: o["at"]):
        found.setdefault(o["key"], []).append(o["hi"])
    return [(*key, (v[0] + v[1]) / 2, v[2], v[3]) for key, v in found.items()]


def hodges_lehmann(df: DataFrame, arm: str, value: str, first: str, second: str, by: Sequence[str] = (), most: int = ONE_PASS, level: float = 0.95, block: int = BLOCK) -> DataFrame:
    """Per group: sizes, the median of all differences first - second, and Moses' interval by ranks; null where an arm is empty.

    Distinct values are counted. A group of up to ``most`` of them is worked
    out in one task; the ranks of larger groups are bracketed over blocks of
    ``block`` distinct values. Differences are never formed.
    """
    return hodges_lehmann_of(Scratch(df.sparkSession, "shift").table(arm_counts(df, arm, value, first, second, by), "counts"), by, most, level, block)


def _of_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """A join on groups; a null key is a group, too."""
    right = right.withColumnsRenamed({c: f"__r_{c}" for c in by})
    return left.join(right, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in by], F.lit(True)), how)


def hodges_lehmann_of(arms: DataFrame, by: Sequence[str] = (), most: int = ONE_PASS, level: float = 0.95, block: int = BLOCK) -> DataFrame:
    """``hodges_lehmann`` from counts (``arm_counts``)."""
    sides = F.explode(F.array(*[F.struct(F.lit(k == "a").alias("__first"), F.col(k).alias("n")) for k in "ab"])).alias("__s")
    counts = arms.select(*by, "x", sides).select(*by, "x", "__s.*").filter("n > 0")
    side = F.col("__first")
    sizes = counts.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(side, F.col("n"))), F.lit(0)).alias("n1"), F.coalesce(F.sum(F.when(~side, F.col("n"))), F.lit(0)).alias("n2"), F.count("*").alias("__distinct"),
        (F.min(F.when(side, F.col("x"))) - F.max(F.when(~side, F.col("x")))).alias("__low"), (F.max(F.when(side, F.col("x"))) - F.min(F.when(~side, F.col("x")))).alias("__high"),
    )
    keys = [f for f in sizes.schema.fields if f.name in by]
    schema = T.StructType([*keys, *[T.StructField(c, T.DoubleType()) for c in ("shift", "low", "high")]])
    fits = sizes.filter(f"n1 > 0 and n2 > 0 and __distinct <= {most}")
    few = _of_groups(counts, fits, by, "left_semi")

    def work(pdf):
        pdf = pdf.sort_values("x")
        x, y = pdf[pdf["__first"]], pdf[~pdf["__first"]]
        a, b, low, high = differences_at(x["x"].to_numpy(), x["n"].to_numpy(), y["x"].to_numpy(), y["n"].to_numpy(), shift_ranks(int(x["n"].sum()), int(y["n"].sum()), level))
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), (a + b) / 2, low, high]], columns=schema.names)

    out = (few.groupBy(*by) if by else few.withColumn("__all", F.lit(1)).groupBy("__all")).applyInPandas(work, schema)
    large = sizes.filter(f"n1 > 0 and n2 > 0 and __distinct > {most}").select(*by, F.col("n1").alias("n"), F.col("n2").alias("m"), F.col("__low").alias("low"), F.col("__high").alias("high")).collect()
    if large:
        many = _of_groups(counts, sizes.filter(f"n1 > 0 and n2 > 0 and __distinct > {most}"), by, "left_semi")
        out = out.unionByName(arms.sparkSession.createDataFrame(_shifts_of_large(many, by, large, level, block), schema))
    return _of_groups(sizes.select(*by, "n1", "n2"), out, by, "left").select(*by, "n1", "n2", "shift", "low", "high")


def median_ranks(n: int, level: float = 0.95) -> tuple[int, int] | None:
    """Ranks of the order statistics that bound the median; None where there are too few rows."""
    r = binomial_ppf((1 - level) / 2, n) if n else 0
    return (r, n - r + 1) if r >= 1 else None


def order_statistics(df: DataFrame, group: Sequence[str], value: str, ranks: Callable[[Column], Column]) -> DataFrame:
    """Per group: ``n`` and ``found``, the values at the ranks (from 1, null for none) that ``ranks`` makes of n, an array.

    Looked up in running counts of distinct values, which go by ranges: no
    task and no buffer holds a group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("__x")).agg(F.count("*").alias("__m"))
    counts = Scratch(df.sparkSession, "ranks").table(counts, "counts")
    sizes = counts.groupBy(*group).agg(F.sum("__m").alias("n")).withColumn("__ranks", ranks(F.col("n")))
    steps = running(counts, "__x", {"__below": "__m"}, group)
    met = steps.join(sizes, list(group)) if group else steps.crossJoin(F.broadcast(sizes))
    asked = met.select(*group, "n", "__x", "__below", "__m", F.posexplode("__ranks").alias("__k", "__r"))
    hit = asked.filter("__r > __below and __r <= __below + __m").groupBy(*group, "n").agg(F.map_from_entries(F.collect_list(F.struct("__k", "__x"))).alias("__at"))
    whole = sizes.join(hit.drop("n"), list(group), "left") if group else sizes.crossJoin(F.broadcast(hit.drop("n")))
    return whole.select(*group, "n", F.transform("__ranks", lambda r, k: F.element_at("__at", k)).alias("found"))


def percentiles(df: DataFrame, group: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Per group: ``n`` and the interpolated quantiles at ``shares``, an array ``quantiles``."""
    at = lambda n, q: (n - 1) * q
    found = order_statistics(df, group, value, lambda n: F.array(*[r.cast("long") for q in shares for r in (F.floor(at(n, q)) + 1, F.ceil(at(n, q)) + 1)]))

    def between(k: int, q: float) -> Column:
        lo, hi, part = F.get("found", F.lit(2 * k)), F.get("found", F.lit(2 * k + 1)), at(F.col("n"), q) - F.floor(at(F.col("n"), q))
        return F.when(lo == hi, lo).otherwise(lo * (1 - part) + hi * part)

    return found.select(*group, "n", F.array(*[between(k, q) for k, q in enumerate(shares)]).alias("quantiles"))


def median_interval(df: DataFrame, group: str, value: str, level: float = 0.95) -> DataFrame:
    """Per group: rows, median and its distribution-free interval; null bounds where there are too few rows."""

    @F.pandas_udf("array<long>")
    def bounds(sizes: pd.Series) -> pd.Series:
        known: dict[int, list[int | None]] = {}
        for n in sizes.unique().tolist():
            known[n] = [(n + 1) // 2, n // 2 + 1, *(median_ranks(n, level) or (None, None))]
        return sizes.map(known)

    found = order_statistics(df, [group], value, bounds)
    at = lambda k: F.get("found", F.lit(k))
    return found.select(group, "n", ((at(0) + at(1)) / 2).alias("median"), at(2).alias("low"), at(3).alias("high"))
