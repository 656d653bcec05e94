"""Deterministic samples: rows ordered by a hash of seed and keys, so that any engine draws the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.values import order_hash


def lowest_hashes(df: DataFrame, strata: Sequence[str], quota: DataFrame | int, seed: str, keys: Sequence[str]) -> DataFrame:
    """Each stratum's first rows by hash, up to its quota, with ``selection_hash`` and ``selection_rank``.

    ``quota``: a number, or a table with the strata and a column ``quota``.
    """
    hashed = df.withColumn("selection_hash", order_hash(seed, *[F.col(k) for k in keys]))
    w = Window.partitionBy(*strata).orderBy("selection_hash", *keys)
    ranked = hashed.withColumn("selection_rank", F.row_number().over(w))
    if isinstance(quota, int):
        return ranked.filter(F.col("selection_rank") <= quota)
    return ranked.join(quota.select(*strata, "quota"), list(strata)).filter(F.col("selection_rank") <= F.col("quota")).drop("quota")


def sampling_plan(scarce: DataFrame, pool: DataFrame, strata: Sequence[str]) -> DataFrame:
    """For each stratum: rows of both arms, the pool's quota (the scarce arm's rows), its inclusion probability, and what is short."""
    a = scarce.groupBy(*strata).agg(F.count("*").alias("quota"))
    b = pool.groupBy(*strata).agg(F.count("*").alias("pool_rows"))
    both = a.join(b, list(strata), "full_outer").na.fill(0, ["quota", "pool_rows"])
    return both.select(*strata, "quota", "pool_rows", F.try_divide(F.least("quota", "pool_rows"), F.col("pool_rows")).alias("inclusion"), F.greatest(F.col("quota") - F.col("pool_rows"), F.lit(0)).alias("short"))


def balanced_manifest(scarce: DataFrame, pool: DataFrame, strata: Sequence[str], keys: Sequence[str], seed: str, arms: tuple[str, str] = ("scarce", "pool")) -> DataFrame:
    """Every row of both arms with its stratum's population and quota, inclusion probability, hash and whether it is selected.

    All scarce rows are; of the pool the lowest hashes are, as many in each stratum.
    """
    plan = sampling_plan(scarce, pool, strata)
    cells = [*strata, *keys]
    whole = scarce.select(*cells).join(plan, list(strata)).select(*cells, F.lit(arms[0]).alias("arm"), F.col("quota").alias("population"), "quota", F.lit(1.0).alias("inclusion"), F.lit(True).alias("sure"))
    drawn = pool.select(*cells).join(plan, list(strata)).select(*cells, F.lit(arms[1]).alias("arm"), F.col("pool_rows").alias("population"), "quota", "inclusion", F.lit(False).alias("sure"))
    every = whole.unionByName(drawn).withColumn("selection_hash", order_hash(seed, *[F.col(k) for k in keys]))
    w = Window.partitionBy("arm", *strata).orderBy("selection_hash", *keys)
    ranked = every.withColumn("selection_rank", F.row_number().over(w))
    return ranked.withColumn("selected", F.col("sure") | (F.col("selection_rank") <= F.col("quota"))).drop("sure")


def weighted_sample(df: DataFrame, stratum: str, quotas: dict[str, int], keys: Sequence[str], seed: str) -> DataFrame:
    """Disproportionate sample: each stratum's quota of lowest hashes, with inclusion probability and weight."""
    spark = df.sparkSession
    quota = F.broadcast(spark.createDataFrame(sorted(quotas.items()), f"{stratum} string, quota long"))
    sizes = df.groupBy(stratum).agg(F.count("*").alias("population"))
    drawn = lowest_hashes(df, [stratum], quota, seed, keys)
    known = sizes.join(quota, stratum).withColumn("taken", F.least("population", "quota"))
    return drawn.join(known.select(stratum, "population", "taken"), stratum).withColumn("inclusion", F.col("taken") / F.col("population")).withColumn("weight", F.col("population") / F.col("taken")).drop("taken")


def drop_matched_pairs(df: DataFrame, stratum: str, arm: str, incomplete: str, hash_column: str, keys: Sequence[str]) -> DataFrame:
    """Rows left after each incomplete row takes a row of the other arm in its stratum with it.

    Incomplete rows in the order of their keys take the complete rows of the
    opposite arm with the largest hash first: the n-th incomplete row of a
    stratum and arm meets the n-th candidate. Both sides are ranked and
    joined, so nothing is looped over.
    """
    broken = F.coalesce(F.col(incomplete), F.lit(False))
    marked = df.withColumn("__broken", broken)
    per_arm = Window.partitionBy(stratum, arm)
    asked = marked.filter("__broken").groupBy(stratum, arm).agg(F.count("*").alias("__asked"))
    # Arms are two: what the others of a stratum ask for is the stratum's total less one's own.
    total = asked.groupBy(stratum).agg(F.sum("__asked").alias("__total"))
    ranked = marked.withColumn("__turn", F.row_number().over(per_arm.orderBy(F.col("__broken").asc(), F.col(hash_column).desc(), *keys)))
    joined = ranked.join(total, stratum, "left").join(asked, [stratum, arm], "left")
    taken = F.coalesce(F.col("__total"), F.lit(0)) - F.coalesce(F.col("__asked"), F.lit(0))
    return joined.filter(~F.col("__broken") & (F.col("__turn") > taken)).drop("__broken", "__turn", "__total", "__asked")
