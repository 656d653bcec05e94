"""Queries of claim extraction over documents and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import claims
from tallyloom.operators.relational import join_in_order
from tallyloom.plans.catalog import Tables, query

#: Sentences put behind the invented prose, by doc_id, so that there is something to extract.
_CLAIMS = [
    "Latency dropped from 120 ms to 45 ms.",
    "Throughput rose to 1,200 req/s under load.",
    "Memory usage reduced by 40%.",
    "This should make it 3x faster.",
    "Build time went from 12 min to 5 min.",
    "Overall performance improved by 15%.",
    "The bundle is 250 kb smaller.",
]


def with_sentence(number: str) -> Column:
    """The text with the sentence of the row's number, or none, behind it."""
    k = (F.col(number) % (len(_CLAIMS) + 1)).cast("int")
    return F.concat_ws("\n", "text", F.coalesce(F.get(F.array(*[F.lit(c) for c in _CLAIMS]), k), F.lit("")))


def claim_texts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", with_sentence("doc_id").alias("text"))


@query()
def claim_extraction(t: Tables) -> DataFrame:
    """Claims in all documents."""
    return claims.extract_claims(claim_texts(t), "doc_id", "text").withColumnRenamed("key", "doc_id")


@query()
def claim_rollup(t: Tables) -> DataFrame:
    """Flags of all documents by dimension."""
    texts = claim_texts(t)
    return claims.claim_flags(claims.extract_claims(texts, "doc_id", "text"), texts, "doc_id").withColumnRenamed("key", "doc_id")


@query()
def conversation_claims(t: Tables) -> DataFrame:
    """Claims by conversation and role, turns in order."""
    c = t.conversations.withColumn("key", F.concat_ws(":", "conv_id", "role"))
    texts = join_in_order(c, ["key"], "turn", with_sentence("turn"), "\n")
    return claims.extract_claims(texts, "key", "text").groupBy("key", "dimension").agg(F.count("*").alias("n"))
