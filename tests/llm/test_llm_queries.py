"""Queries and the pipeline run over a small folder, and agree with DuckDB where SQL can say it."""

import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tallyloom.llm import decontaminate, registry, secrets

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want, got = con.execute(registry.ORACLES[name]).df(), registry.QUERIES[name](spark, SMALL).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    norm = lambda d: sorted(tuple("" if pd.isna(v) else (str(round(float(v), 4)) if isinstance(v, (int, float)) else str(v)) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert norm(want) == norm(got)


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in registry.QUERIES}
    assert "pipeline" in entry.queries()


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, docs, SMALL).toPandas(), docs.schema)
        assert out.columns == docs.columns, name
        rows.append(out.count())
        docs = out
    assert rows == sorted(rows, reverse=True) and rows[-1] > 0.5 * rows[0]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() > 0


def test_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], spark.read.parquet(f"{SMALL}/documents.parquet").schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0, name


def test_pipeline_against_its_parts_by_brute_force(spark):
    """Few documents, each stage's decision worked out here without the operators' joins."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(80)
    extra = docs.orderBy("doc_id").limit(5).withColumn("doc_id", docs["doc_id"] + 100_000)
    docs = spark.createDataFrame(docs.unionByName(extra).toPandas(), docs.schema)
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").toPandas()
    (_, _), (_, dedup), (_, clean), (_, hide), (_, mix) = corpus_pipeline.STAGES
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"]: r["text"] for r in dedup(spark, docs, SMALL).collect()}
    shingled = {d: ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", (t or "").lower())) else None) for d, t in rows.items()}
    gone = rows.keys() - kept.keys()
    assert set(range(100_000, 100_000 + 5)) & rows.keys() <= gone | {d for d in rows if shingled[d] is None}
    near = lambda a, b: shingled[a] and shingled[b] and len(shingled[a] & shingled[b]) >= 0.8 * len(shingled[a] | shingled[b])
    assert not [(a, b) for a in kept for b in kept if a < b and near(a, b)]
    found = {r["doc_id"] for r in clean(spark, docs, SMALL).collect()}
    items = [decontaminate.split_words(t) for t in bench["text"] if t]

    def leaks(text):
        words = decontaminate.split_words(text)
        for item in (i for i in items if len(i) >= decontaminate.MIN_WORDS):
            row = [0] * (len(words) + 1)
            for i, a in enumerate(item, 1):
                new = [i]
                for j, b in enumerate(words, 1):
                    new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
                row = new
            if min(row) <= decontaminate.error_budget(len(item)):
                return True
        return False

    short = {d for d, t in rows.items() if len((t or "").split()) < 120}
    assert {d for d in short if not leaks(rows[d])} == found & short
    hidden = {r["doc_id"]: r["text"] for r in hide(spark, docs, SMALL).collect()}
    assert hidden == {d: secrets.blank(t, secrets.scan(t)) for d, t in rows.items()}
    drawn = mix(spark, docs, SMALL).collect()
    assert [r["position"] for r in drawn] == sorted(r["position"] for r in drawn) and {r["doc_id"] for r in drawn} <= rows.keys()
