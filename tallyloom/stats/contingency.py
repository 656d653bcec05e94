"""Contingency tables: chi-square, Cramér's V, Fisher's test, the adaptive test of independence."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import Scratch
from tallyloom.stats.prob import chi2_sf, fisher_exact
from tallyloom.stats.rank import running


def chi_square(df: DataFrame, row: str, column: str, by: Sequence[str] = ()) -> DataFrame:
    """n, levels, chi-square, degrees of freedom, Cramér's V and the shares of small expected counts, by groups.

    Rows are counted into cells once; expected counts come from the cells'
    margins. Empty cells are never formed: each adds its expected count, and
    all expected counts together are n. Null values are left out. Where a
    side has one level only the statistics are null.
    """
    cells = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(*by, F.col(row).alias("__r"), F.col(column).alias("__c")).agg(F.count("*").alias("__n"))
    cells = Scratch(df.sparkSession, "contingency").table(cells, "cells")
    joined = lambda a, b: a.join(b, list(by)) if by else a.crossJoin(F.broadcast(b))
    rows = cells.groupBy(*by, "__r").agg(F.sum("__n").alias("__nr"))
    columns = cells.groupBy(*by, "__c").agg(F.sum("__n").alias("__nc"))
    whole = joined(
        rows.groupBy(*by).agg(F.sum("__nr").alias("n"), F.count("*").alias("row_levels"), F.min("__nr").alias("__least_r")),
        columns.groupBy(*by).agg(F.count("*").alias("column_levels"), F.min("__nc").alias("__least_c")),
    )
    expected = F.col("__nr").cast("double") * F.col("__nc") / F.col("n")
    off = F.col("__n") - expected
    filled = joined(cells.join(rows, [*by, "__r"]).join(columns, [*by, "__c"]), whole.select(*by, "n"))
    sums = filled.groupBy(*by).agg(F.sum(off * off / expected).alias("__off"), F.sum(expected).alias("__met"))
    # A row's expected count is 5 or more in the columns of at least 5 n / row total: counted over the sorted margins.
    marks = joined(rows, whole.select(*by, "n")).select(*by, F.expr("CAST((5 * n + __nr - 1) div __nr AS double)").alias("v"), F.lit(1).alias("asked"), F.lit(0).alias("there"))
    marks = marks.unionByName(columns.select(*by, F.col("__nc").cast("double").alias("v"), F.lit(0).alias("asked"), F.lit(1).alias("there"))).groupBy(*by, "v").agg(F.sum("asked").alias("asked"), F.sum("there").alias("there"))
    below = joined(running(marks, "v", {"below": "there"}, by), whole.select(*by, "column_levels"))
    large = below.groupBy(*by).agg(F.sum(F.col("asked") * (F.col("column_levels") - F.col("below"))).alias("__large"))
    out = joined(joined(whole, sums), large)
    dof = ((F.col("row_levels") - 1) * (F.col("column_levels") - 1)).cast("long")
    fine = dof > 0
    x = F.col("__off") + F.greatest(F.lit(0.0), F.col("n") - F.col("__met"))
    v = F.sqrt(x / (F.col("n") * (F.least("row_levels", "column_levels") - 1)))
    least = F.col("__least_r").cast("double") * F.col("__least_c") / F.col("n")
    return out.select(*by, "n", "row_levels", "column_levels", dof.alias("dof"), F.when(fine, x).alias("chi_square"), F.when(fine, v).alias("cramers_v"), least.alias("least_expected"), (F.col("__large") / (F.col("row_levels") * F.col("column_levels"))).alias("share_expected_5"))


def tests_by(df: DataFrame, row: str, column: str, by: Sequence[str]) -> DataFrame:
    """The adaptive test of ``independence`` for each group: test, statistic, degrees of freedom and p. A group's cells make one small table."""
    cells = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(*by, F.col(row).cast("string").alias("r"), F.col(column).cast("string").alias("c")).agg(F.count("*").alias("n"))
    tables = cells.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("r", "c", "n"))).alias("__cells"))

    def judge(frames):
        for f in frames:
            out = []
            for own in f.pop("__cells"):
                rows, columns = ({v: k for k, v in enumerate(sorted({x[d] for x in own}))} for d in ("r", "c"))
                table = np.zeros((len(rows), len(columns)))
                for x in own:
                    table[rows[x["r"]], columns[x["c"]]] = x["n"]
                out.append(independence(table))
            for name in ("test", "statistic", "dof", "p"):
                f[name] = [o[name] for o in out]
            yield f

    keys = [f for f in tables.schema.fields if f.name in by]
    return tables.mapInPandas(judge, T.StructType([*keys, T.StructField("test", T.StringType()), T.StructField("statistic", T.DoubleType()), T.StructField("dof", T.IntegerType()), T.StructField("p", T.DoubleType())]))


def pearson(table: np.ndarray, yates: bool = False) -> tuple[float, int, np.ndarray]:
    """Chi-square, degrees of freedom and expected counts; Yates' correction never passes 0."""
    expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    off = np.abs(table - expected)
    if yates and table.shape == (2, 2):
        off = off - np.minimum(0.5, off)
    return float((off * off / expected).sum()), (table.shape[0] - 1) * (table.shape[1] - 1), expected


def cramers_v(table: np.ndarray) -> float | None:
    table = trim(table)
    if min(table.shape) < 2:
        return None
    return float(np.sqrt(pearson(table)[0] / (table.sum() * (min(table.shape) - 1))))


def trim(table: np.ndarray) -> np.ndarray:
    """The table without empty rows and columns."""
    table = np.asarray(table, float)
    return table[table.sum(1) > 0][:, table.sum(0) > 0]


def draw_subsets(rng: np.random.Generator, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Multivariate hypergeometric draws, a row each: how many of ``counts`` are in a random subset of ``sizes`` items.

    Each item is taken with the chance size / items; of too many some are put
    back, of too few some are added, which are random subsets again, of about
    the root of the size. So the work doesn't grow with the counts, and
    nothing bounds them (numpy's own draws end at 1e9).
    """
    items = counts.sum(1)
    taken = rng.binomial(counts, (sizes / np.maximum(items, 1))[:, None])
    off = taken.sum(1) - sizes
    over, under = off > 0, off < 0
    if over.any():
        taken[over] -= draw_subsets(rng, taken[over], off[over])
    if under.any():
        taken[under] += draw_subsets(rng, counts[under] - taken[under], -off[under])
    return taken


def random_tables(table: np.ndarray, draws: int, seed: int | Sequence[int]) -> np.ndarray:
    """Tables with the margins of ``table``, as from shuffled column labels: an array (draws, rows, columns). Work grows with cells, not with counts."""
    rng = np.random.default_rng(seed)
    table = np.asarray(table).astype(np.int64)
    left = np.repeat(table.sum(0)[None, :], draws, axis=0)
    out = np.empty((draws, *table.shape), dtype=np.int64)
    for k, size in enumerate(table.sum(1)[:-1]):
        out[:, k] = draw_subsets(rng, left, np.full(draws, size))
        left = left - out[:, k]
    out[:, -1] = left
    return out


def independence(table: np.ndarray, draws: int = 20_000, seed: int = 20_250_911) -> dict:
    """Test of independence by what the table allows.

    Chi-square where Cochran's rule holds (four of five expected counts at
    least 5, none under 1), Fisher's test for other 2x2 tables, else Monte
    Carlo over tables of the same margins. A table with one level is n/a.
    """
    table = trim(table)
    if min(table.shape) < 2:
        return {"test": "n/a", "statistic": None, "dof": None, "p": None}
    x, dof, expected = pearson(table)
    if (expected >= 5).mean() >= 0.8 and expected.min() >= 1:
        return {"test": "chi-square", "statistic": x, "dof": dof, "p": chi2_sf(x, dof)}
    if table.shape == (2, 2):
        odds, p = fisher_exact(*map(int, table.ravel()))
        return {"test": "fisher", "statistic": odds, "dof": None, "p": p}
    drawn = random_tables(table, draws, seed)
    off = drawn - expected
    likely = (off * off / expected).sum((1, 2)) >= x - 1e-9
    return {"test": "monte-carlo", "statistic": x, "dof": dof, "p": float((likely.sum() + 1) / (draws + 1))}
