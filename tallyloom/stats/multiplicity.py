"""Adjusted p-values within families; null p-values take no part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def adjust(df: DataFrame, p: str, family: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``holm`` and ``bh``: Holm's step-down and Benjamini and Hochberg's step-up values. Families are tables of tests, hence small."""
    known = df.filter(F.col(p).isNotNull())
    up = Window.partitionBy(*family).orderBy(F.col(p).asc(), *[F.col(k).asc() for k in keys])
    down = Window.partitionBy(*family).orderBy(F.col(p).desc(), *[F.col(k).desc() for k in keys])
    m = F.count("*").over(Window.partitionBy(*family))
    ranked = known.withColumn("__i", F.row_number().over(up)).withColumn("__m", m)
    holm = F.max(F.least(F.lit(1.0), (F.col("__m") - F.col("__i") + 1) * F.col(p))).over(up.rowsBetween(Window.unboundedPreceding, 0))
    bh = F.min(F.least(F.lit(1.0), F.col("__m") / F.col("__i") * F.col(p))).over(down.rowsBetween(Window.unboundedPreceding, 0))
    done = ranked.withColumn("holm", holm).withColumn("bh", bh).drop("__i", "__m")
    return done.unionByName(df.filter(F.col(p).isNull()).withColumn("holm", F.lit(None).cast("double")).withColumn("bh", F.lit(None).cast("double")))
