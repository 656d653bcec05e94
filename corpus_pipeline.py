"""From raw documents to a training mix: five stages, each over all rows that the one before kept.

1. ``toxicity``: a model is fitted on labelled documents; those that score
   the threshold or more go.
2. ``near_dedup``: one document of each class of near copies stays.
3. ``decontaminate``: documents that hold a benchmark item, give or take its
   edit budget, go.
4. ``secrets``: secrets are blanked in the text; ``n_chars`` follows.
5. ``mix``: the mix to target weights along the curriculum, range-sorted by
   training position: a row for each time that a document is drawn.

Stages 1 to 4 return the columns of documents. Each stage's result is written
as Parquet in the shared folder and read again as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import decontaminate, mixing, neardup, secrets, toxicity
from tallyloom.session import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.draw(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("decontaminate", drop_leaks),
    ("secrets", blank_secrets),
    ("mix", mix),
]

#: Trained models and sketches are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = scratch.table(stage(spark, docs, sf_dir), name)
        # Nothing reads a stage's input once its result is stored.
        if k:
            scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
