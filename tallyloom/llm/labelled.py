"""Labelled documents to fit a classifier on: without the held-out ones, in a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, column: str, folds: int, held_out: int) -> DataFrame:
    """doc_id, text and label (0 or 1) of the labelled documents that aren't held out."""
    marks = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    marks = marks.filter(fold(F.col("doc_id"), folds) != held_out)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(marks, "doc_id")


def bounded_sample(rows: DataFrame, most: dict[int, int]) -> tuple[DataFrame, dict[int, float]]:
    """Of each label about ``most`` rows at most, by a hash of doc_id, and the share drawn; the same rows on every run."""
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    keep, shares = F.lit(False), {}
    for label, n in most.items():
        shares[label] = min(1.0, n / max(1, counts.get(label, 0)))
        keep = keep | ((F.col("label") == label) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * shares[label])))
    return rows.filter(keep), shares
