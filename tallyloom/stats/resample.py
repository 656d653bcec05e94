"""Rarefaction: distinct labels expected in smaller samples. Resampling is in ``sparse``."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rarefied(counts: Sequence[int], sample: int) -> float:
    """Distinct labels expected in a sample without replacement, in exact integers."""
    total = sum(counts)
    if sample > total:
        raise ValueError(f"{sample} of {total}")
    whole = math.comb(total, sample)
    return sum(1 - math.comb(total - n, sample) / whole for n in counts if n)


def rarefied_by(df: DataFrame, group: Sequence[str], label: str, sample: int) -> DataFrame:
    """Per group: labels observed, and expected in a sample of ``sample`` rows (all rows where there are fewer)."""

    @F.pandas_udf("double")
    def absent(n: pd.Series, total: pd.Series) -> pd.Series:
        """Chance that a label isn't drawn: a product over the draws."""
        out = []
        for a, t in zip(n.tolist(), total.tolist(), strict=True):
            left = t - np.arange(min(sample, t))
            out.append(float(np.exp(np.log1p(-a / left).sum())) if a < left[-1] else 0.0)
        return pd.Series(out)

    counts = df.filter(F.col(label).isNotNull()).groupBy(*group, label).agg(F.count("*").alias("__n"))
    totals = counts.groupBy(*group).agg(F.sum("__n").alias("__t"))
    met = counts.join(totals, list(group))
    # Labels with the same count share a chance.
    same = met.groupBy(*group, "__n", "__t").agg(F.count("*").alias("__labels"))
    return same.withColumn("__p", 1 - absent("__n", "__t")).groupBy(*group).agg(F.sum("__labels").alias("observed"), F.sum(F.col("__labels") * F.col("__p")).alias("expected"))
