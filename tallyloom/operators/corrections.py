"""Changes that must carry their evidence: audited corrections of labels, and results of retries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import is_blank


def judged_corrections(corrections: DataFrame, labels: DataFrame, records: DataFrame, keys: Sequence[str], item: str, label: str, text: str, domain: Sequence[str]) -> DataFrame:
    """``corrections`` with ``problem``: the first thing that speaks against each, null where it applies.

    A correction has the keys of its request, the ``item`` in it, from_label,
    to_label, rationale, record_sha256, quotes and, if ``quantity`` is a
    column, quantity, its start and end. It holds if exactly one text among
    the request's records has that digest, all quotes stand in that text as
    they are, the quantity is where it is said to be, and the item's label is
    the one to be changed. Records are met by keys and digest; no other
    record is looked at.
    """
    digest = records.select(*keys, F.sha2(F.col(text).cast("string"), 256).alias("record_sha256"), F.col(text).cast("string").alias("__text")).filter("__text is not null").distinct()
    evidence = digest.groupBy(*keys, "record_sha256").agg(F.count("*").alias("__texts"), F.min("__text").alias("__text"))
    old = labels.groupBy(*keys, item).agg(F.count("*").alias("__labels"), F.min(label).alias("__label"))
    numbered = corrections.withColumn("__times", F.count("*").over(Window.partitionBy(*keys, item)))
    met = numbered.join(evidence, [*keys, "record_sha256"], "left").join(old, [*keys, item], "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    quoted = (F.size("quotes") > 0) & F.forall("quotes", lambda q: (F.length(q) > 0) & F.contains(F.col("__text"), q))
    problem = (
        F.when(F.col("__times") > 1, "several corrections")
        .when(no(F.col("__labels") == 1), "no such item")
        .when(no(F.col("__label") == F.col("from_label")), "another label")
        .when(no(F.col("to_label").isin(*domain)) | no(F.col("to_label") != F.col("from_label")), "no new label")
        .when(is_blank(F.col("rationale")), "no rationale")
        .when(no(F.col("__texts") == 1), "no such record")
        .when(no(quoted), "no evidence")
    )
    if "quantity" in corrections.columns:
        problem = problem.when(no(F.substring("__text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("quantity")), "quantity elsewhere")
    return met.select(*corrections.columns, problem.alias("problem"))


def correct_labels(labels: DataFrame, judged: DataFrame, keys: Sequence[str], item: str, label: str) -> DataFrame:
    """``labels`` with the new label where a correction applies, and ``corrected``. Corrections with a problem change nothing."""
    fine = judged.filter("problem is null").select(*keys, item, F.col("to_label").alias("__new"))
    out = labels.join(fine, [*keys, item], "left")
    return out.withColumn(label, F.coalesce("__new", label)).withColumn("corrected", F.col("__new").isNotNull()).drop("__new")


def retry_problems(base: DataFrame, retry: DataFrame, keys: Sequence[str], failed: Column, digest: str) -> DataFrame:
    """Keys of retried rows that may not replace anything, with ``problem``: not an error, repeated, or another input (its ``digest`` differs from the failed row's)."""
    errors = base.filter(failed).select(*keys, F.col(digest).alias("__asked"), F.lit(True).alias("__there"))
    counted = retry.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(digest).alias("__given"))
    met = counted.join(errors, list(keys), "left")
    problem = F.when(F.col("__there").isNull(), "not an error").when(F.col("__n") > 1, "repeated").when(~F.col("__asked").eqNullSafe(F.col("__given")), "another input")
    return met.select(*keys, problem.alias("problem")).filter("problem is not null")


def replace_errors(base: DataFrame, retry: DataFrame, keys: Sequence[str], failed: Column, digest: str) -> DataFrame:
    """``base`` with its errors replaced by retried rows of the same keys and the same input; other retried rows change nothing (``retry_problems`` names them)."""
    bad = retry_problems(base, retry, keys, failed, digest).select(*keys)
    fine = retry.join(bad, list(keys), "left_anti").select(*base.columns)
    gone = base.filter(failed).select(*keys).join(fine.select(*keys), list(keys), "left_semi")
    return base.join(gone, list(keys), "left_anti").unionByName(fine)
