"""Votes of several voters on one row: majorities, two stages, agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def majority(votes: DataFrame, keys: Sequence[str], labels: Sequence[str], voter: str, voters: Sequence[str], least: int = 2) -> DataFrame:
    """The label tuple that at least ``least`` voters share, for each key.

    ``status``: unanimous, majority or none; ``coalition``: its voters in the
    given order. Among tuples with equal votes the one named first, in the
    order of voters, is the candidate. A voter's repeated vote counts once.
    """
    order = F.array_position(F.array(*[F.lit(v) for v in voters]), F.col(voter)).cast("int")
    tally = votes.select(*keys, *labels, order.alias("__v")).distinct().groupBy(*keys, *labels).agg(F.countDistinct("__v").alias("__n"), F.sort_array(F.collect_set("__v")).alias("__by"))
    first = F.max(F.struct("__n", (-F.element_at("__by", 1)).alias("__first"), "__by", *labels)).alias("__top")
    best = tally.groupBy(*keys).agg(first)
    n, won = F.col("__top.__n"), F.col("__top.__n") >= least
    names = F.array(*[F.lit(v) for v in voters])
    coalition = F.array_join(F.transform(F.col("__top.__by"), lambda i: F.element_at(names, i)), "+")
    status = F.when(n == len(voters), "unanimous").when(won, "majority").otherwise("none")
    return best.select(*keys, *[F.when(won, F.col(f"__top.{x}")).alias(x) for x in labels], status.alias("status"), F.when(won, coalition).otherwise("").alias("coalition"), n.cast("long").alias("votes"))


def two_stage(votes: DataFrame, keys: Sequence[str], present: str, primary: str, types: str, voter: str, voters: Sequence[str]) -> DataFrame:
    """Presence by two votes; then, among positive voters only, the primary type by two and the exact (primary, types) pair by two."""
    stage = votes.groupBy(*keys).agg(F.count_if(F.col(present)).alias("positive_votes"), F.count("*").alias("voters")).withColumn("present", F.col("positive_votes") >= 2)
    positive = votes.filter(F.col(present))
    by_primary = majority(positive, keys, [primary], voter, voters).select(*keys, F.col(primary).alias("primary_type"), F.col("votes").alias("primary_votes"))
    exact = majority(positive, keys, [primary, types], voter, voters).select(*keys, F.col(types).alias("exact_types"), F.col("votes").alias("exact_votes"))
    joined = stage.join(by_primary, list(keys), "left").join(exact, list(keys), "left")
    here = F.col("present")
    resolution = (
        F.when(~here, "absent")
        .when(F.col("exact_votes") == len(voters), "full_unanimous")
        .when(F.col("exact_votes") >= 2, "exact_majority")
        .when(F.col("primary_votes") >= 2, "primary_majority")
        .otherwise("unresolved")
    )
    return joined.select(*keys, "positive_votes", "present", F.when(here, F.col("primary_type")).alias("primary_type"), F.when(here, F.col("exact_types")).alias("exact_types"), resolution.alias("resolution"))


def binary_majority(columns: Sequence[str], least: int = 2) -> Column:
    """Whether at least ``least`` of the columns hold; null if so few are known that it is open."""
    yes = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in columns), F.lit(0))
    no = sum((F.coalesce((~F.col(c)).cast("int"), F.lit(0)) for c in columns), F.lit(0))
    return F.when(yes >= least, True).when(no > len(columns) - least, False)


def any_accepted(occurrences: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key: whether a majority accepts any occurrence, and the majority of the voters' own verdicts; the two may differ."""
    per_voter = [F.bool_or(c).alias(c) for c in columns]
    grouped = occurrences.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.bool_or(binary_majority(columns)).alias("any_accepted"), *per_voter)
    return grouped.withColumn("voters_majority", binary_majority(columns)).drop(*columns)


def kappa(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Agreement and Cohen's kappa of two label columns, by groups; null where chance agreement is 1 or no pair is known.

    Pairs are counted once; marginals come from those counts.
    """
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.count("*").alias("__n"))
    whole = pairs.groupBy(*by).agg(F.sum("__n").alias("n"), F.sum(F.when(F.col("__a") == F.col("__b"), F.col("__n")).otherwise(0)).alias("__same"))
    left = pairs.groupBy(*by, F.col("__a").alias("__label")).agg(F.sum("__n").alias("__na"))
    right = pairs.groupBy(*by, F.col("__b").alias("__label")).agg(F.sum("__n").alias("__nb"))
    chance = left.join(right, [*by, "__label"]).groupBy(*by).agg(F.sum(F.col("__na").cast("double") * F.col("__nb")).alias("__products"))
    joined = whole.join(chance, list(by), "left") if by else whole.crossJoin(chance)
    agreement = F.col("__same") / F.col("n")
    expected = F.coalesce("__products", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return joined.select(*by, "n", agreement.alias("agreement"), expected.alias("expected"), F.when(expected < 1, (agreement - expected) / (1 - expected)).alias("kappa"))


def transitions(old: DataFrame, new: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """How many keys went from each old label to each new one; a side without the key is ``(none)``."""
    a = old.select(*keys, F.col(label).cast("string").alias("old_label"))
    b = new.select(*keys, F.col(label).cast("string").alias("new_label"))
    joined = a.join(b, list(keys), "full_outer").na.fill("(none)", ["old_label", "new_label"])
    return joined.groupBy("old_label", "new_label").agg(F.count("*").alias("n"))


def mismatches(votes: DataFrame, keys: Sequence[str], voter: str, labels: Sequence[str]) -> DataFrame:
    """Keys on which voters differ in any label, with every voter's labels side by side: keys and ``said``, "voter=label|label; ..." in the order of voters."""
    said = F.concat(F.col(voter), F.lit("="), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in labels]))
    kinds = F.countDistinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in labels]))
    return votes.groupBy(*keys).agg(kinds.alias("__kinds"), F.array_join(F.sort_array(F.collect_list(said)), "; ").alias("said")).filter("__kinds > 1").drop("__kinds")
