"""Audits of a study's labels, worked out again from what is stored: votes on occurrences, labels by several models, a weighted manual sample;
stored results looked at again under today's rules; labelled samples and frozen requests put together with their checks.

What must hold is checked before anything is counted; a violation is an ExpectationError that shows an example.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import expect, measures, relational

ALL = "All"


def _long(df: DataFrame, audit: str, arm: Column, names: Sequence[str]) -> DataFrame:
    """A row for each of the columns ``names``: audit, arm, measure, value."""
    values = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(F.lit(audit).alias("audit"), arm.cast("string").alias("arm"), F.inline(values))


def _for_all(counts: DataFrame, arm: str, names: Sequence[str]) -> DataFrame:
    """Counts by arm, as text, and their sums for all arms."""
    whole = counts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).select(F.lit(ALL).alias(arm), *names)
    return counts.select(F.col(arm).cast("string").alias(arm), *names).unionByName(whole)


def occurrence_audit(votes: DataFrame, keys: Sequence[str], occurrence: str, arm: str, voters: Sequence[str]) -> DataFrame:
    """How many items hold up: those with an occurrence that most voters accept. A row for each arm (and All) and measure.

    ``votes`` has a row for each occurrence of an item (``keys``) and a
    Boolean column for each voter; null votes, repeated occurrences and items
    of several arms are errors. Precision is null without items.
    """
    expect.require_none(expect.bad_keys(votes, [*keys, occurrence]).filter("problem = 'duplicate'"), "repeated occurrences")
    known = F.lit(True)
    for v in voters:
        known = known & F.col(v).isNotNull()
    expect.require_none(votes.filter(~known), "missing votes")
    yes = sum((F.col(v).cast("int") for v in voters), F.lit(0))
    items = votes.groupBy(*keys).agg(F.min(arm).alias(arm), F.max(arm).alias("__other"), F.count("*").alias("occurrences"), F.bool_or(2 * yes > len(voters)).alias("__holds"))
    expect.require_none(items.filter(~F.col(arm).eqNullSafe(F.col("__other"))), "items of several arms")
    names = ["items", "occurrences", "true_positive", "false_positive"]
    counts = items.groupBy(arm).agg(F.count("*").alias("items"), F.sum("occurrences").alias("occurrences"), F.count_if("__holds").alias("true_positive"), F.count_if(~F.col("__holds")).alias("false_positive"))
    whole = _for_all(counts, arm, names).withColumn("precision", F.try_divide("true_positive", "items"))
    return _long(whole, "occurrences", F.col(arm), [*names, "precision"])


def label_audit(votes: DataFrame, keys: Sequence[str], arm: str, voters: Sequence[str], domain: tuple[str, str]) -> DataFrame:
    """How many items most voters give each of two labels, by arm and for all. An odd number of voters, so that there is no tie."""
    if len(voters) % 2 == 0:
        raise ValueError("an even number of voters may tie")
    expect.require_none(expect.bad_keys(votes, keys).filter("problem = 'duplicate'"), "repeated items")
    for v in voters:
        expect.require_none(expect.outside_domain(votes, v, domain), f"labels of {v}")
    first = sum(((F.col(v) == domain[0]).cast("int") for v in voters), F.lit(0))
    decided = votes.select(F.col(arm), F.when(2 * first > len(voters), domain[0]).otherwise(domain[1]).alias("measure"))
    counts = decided.groupBy(arm, "measure").agg(F.count("*").alias("n"))
    whole = counts.groupBy("measure").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("arm"), "measure", "n")
    both = counts.select(F.col(arm).cast("string").alias("arm"), "measure", "n").unionByName(whole)
    return both.select(F.lit("labels").alias("audit"), "arm", "measure", F.col("n").cast("double").alias("value"))


def sample_audit(rows: DataFrame, keys: Sequence[str], label: str, positive: str, negative: str, undecided: str, predicted: str, stratum: str, weight: str, probability: str) -> DataFrame:
    """A classifier against a manual sample: counts and scores of the rows decided, as they are (arm raw) and weighted, and the sample by strata.

    Labels outside the three, repeated items, and weights of decided rows
    that aren't the inverse of the probability to be drawn, are errors.
    """
    expect.require_none(expect.bad_keys(rows, keys).filter("problem = 'duplicate'"), "repeated items")
    expect.require_none(expect.outside_domain(rows, label, (positive, negative, undecided)), "manual labels")
    decided = rows.filter(F.col(label) != undecided).withColumn("__true", F.col(label) == positive)
    sound = (F.col(weight) > 0) & (F.abs(F.col(weight) * F.col(probability) - 1) < 1e-9)
    expect.require_none(decided.filter(~F.coalesce(sound, F.lit(False))), "weights that aren't inverse probabilities")
    names = ["tp", "fp", "fn", "tn", "precision", "recall", "f1"]
    raw = _long(measures.confusion(decided, predicted, "__true"), "sample", F.lit("raw"), names)
    weighed = _long(measures.confusion(decided, predicted, "__true", F.col(weight)), "sample", F.lit("weighted"), names)
    sizes = rows.agg(F.count("*").alias("sample_n"), F.count_if(F.col(label) != undecided).alias("decided_n"))
    strata = rows.groupBy(stratum).agg(F.count("*").alias("sampled"))
    return raw.unionByName(weighed).unionByName(_long(sizes, "sample", F.lit(ALL), ["sample_n", "decided_n"])).unionByName(_long(strata, "sample", F.col(stratum), ["sampled"]))


def replay(occurrences: DataFrame, labels: DataFrame, sample: DataFrame) -> DataFrame:
    """The three audits as one table: audit, arm, measure, value."""
    return occurrences.unionByName(labels).unionByName(sample)


def revalidate(stored: DataFrame, requests: DataFrame, keys: Sequence[str], bound: Sequence[str], status: str, rules: dict[str, Column], accepted: str = "classified", failed: str = "error") -> DataFrame:
    """Stored results under today's rules, without asking again: keys, previous_status, status and problem (the first rule that a result breaks).

    ``rules`` are conditions on the columns of stored rows and requests (an
    unknown outcome breaks a rule). A result without a request, or bound to
    another one (a column of ``bound`` differs, by null too), and one that was
    accepted and now breaks a rule, is an error: nothing may be rewritten then.
    """
    expect.require_none(expect.bad_keys(stored, keys), "results aren't one for each request")
    expect.require_none(expect.bad_keys(requests, keys), "requests aren't told apart by their keys")
    asked = requests.withColumnsRenamed({b: f"__asked_{b}" for b in bound}).withColumn("__there", F.lit(True))
    met = stored.join(asked, list(keys), "left")
    same = F.col("__there").isNotNull()
    for b in bound:
        same = same & F.col(b).eqNullSafe(F.col(f"__asked_{b}"))
    expect.require_none(met.filter(~same).select(*keys), "results of another request")
    problem = F.coalesce(*[F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]) if rules else F.lit(None).cast("string")
    judged = met.select(*keys, F.col(status).alias("previous_status"), problem.alias("problem")).withColumn("status", F.when(F.col("problem").isNull(), accepted).otherwise(failed))
    expect.require_none(judged.filter((F.col("previous_status") == accepted) & (F.col("status") == failed)), "accepted results that don't hold any more")
    return judged.select(*keys, "previous_status", "status", "problem")


def keyword_sources(value: Column, keywords: dict[str, str], separator: str = "|") -> Column:
    """The names whose keyword stands in a loosely written list, in the order of ``keywords`` (keyword to name); empty for null."""
    lower = F.lower(F.coalesce(value.cast("string"), F.lit("")))
    return F.concat_ws(separator, *[F.when(F.contains(lower, F.lit(k)), name) for k, name in keywords.items()])


def labelled_sample(rows: DataFrame, valid: DataFrame, key: str, first: DataFrame, second: DataFrame, label: str, present: str, nothing: str) -> DataFrame:
    """The valid rows with both sets of labels, without those labelled ``nothing``. Labels that a valid row lacks (``label``, ``present``), or has twice, are errors."""
    kept = rows.join(valid.select(key).distinct(), key, "left_semi")
    both = expect.checked_join(expect.checked_join(kept, first, [key], "many_to_one", "left"), second, [key], "many_to_one", "left")
    expect.require_none(both.filter(F.col(label).isNull()).select(key), f"rows without {label}")
    expect.require_none(both.filter(F.col(present).isNull()).select(key), f"rows without {present}")
    return both.filter(F.col(label) != nothing)


def frozen_requests(selected: DataFrame, frozen: DataFrame, status: DataFrame, occurrences: DataFrame, keys: Sequence[str], complete: Column, occurrence: str, dimension: str, prompt: Column, most: int) -> DataFrame:
    """A request for each item of a frozen sample: keys, prompt_sha256, prompt_chars, activation_count and the packed occurrence_ids ("id=dimension|...").

    The items selected today must be those frozen, each with exactly one
    status row that is ``complete``; a prompt (an expression on the frozen
    rows) over ``most`` characters is an error. An item's repeated
    occurrences count once; items without any have a count of 0.
    """
    expect.require_none(relational.key_difference(selected, frozen, keys), "the selection isn't the frozen sample")
    items = frozen.dropDuplicates(list(keys))
    known = status.join(items.select(*keys), list(keys), "left_semi")
    expect.require_none(expect.bad_keys(known, keys), "several status rows")
    expect.require_none(items.join(known.filter(complete), list(keys), "left_anti").select(*keys), "items whose collection isn't complete")
    told = F.concat(F.col(occurrence).cast("string"), F.lit("="), F.col(dimension).cast("string"))
    packed = occurrences.groupBy(*keys).agg(F.sort_array(F.collect_set(told)).alias("__ids"))
    made = items.select(*keys, prompt.alias("__prompt")).join(packed, list(keys), "left")
    out = made.select(*keys, F.sha2("__prompt", 256).alias("prompt_sha256"), F.length("__prompt").cast("long").alias("prompt_chars"), F.coalesce(F.size("__ids"), F.lit(0)).cast("long").alias("activation_count"), F.coalesce(F.array_join("__ids", "|"), F.lit("")).alias("occurrence_ids"))
    expect.require_none(out.filter(F.col("prompt_chars") > most).select(*keys, "prompt_chars"), "prompts over the budget")
    return out
