"""Readers, writers, incremental runs."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.sources import sinks, tables
from tallyloom.streaming import incremental as inc


def test_read_any(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"x, ""y"""\n2,\n')
    (tmp_path / "b.jsonl").write_text('{"id": 1, "text": "x"}\n')
    schema = "id long, text string"
    assert [tuple(r) for r in tables.read_any(spark, f"file://{tmp_path}/a.csv", schema).collect()] == [(1, 'x, "y"'), (2, None)]
    assert tables.read_any(spark, f"file://{tmp_path}/b.jsonl", schema).first()["text"] == "x"
    with pytest.raises(ValueError, match="schema"):
        tables.read_any(spark, f"file://{tmp_path}/a.csv")


def test_columns(spark):
    df = spark.createDataFrame([(1, "x")], "id int, body string")
    assert tables.find_column(df, ["text", "body"]) == "body" and tables.find_column(df, ["z"], required=False) is None
    with pytest.raises(KeyError):
        tables.find_column(df, ["z"])
    want = T.StructType([T.StructField("n", T.LongType()), T.StructField("id", T.StringType())])
    assert tables.conform(df, want).collect() == [(None, "1")]


def test_fragments(spark, tmp_path):
    docs = [{"key": 1, "files": [{"name": "a"}, {"name": "b"}], "runs": []}, {"key": 2, "files": None, "runs": [{"ok": True}]}]
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(d))
    kinds = {"files": T.StructType([T.StructField("name", T.StringType())]), "runs": T.StructType([T.StructField("ok", T.BooleanType())])}
    out = tables.read_fragments(spark, f"file://{tmp_path}", kinds, T.StructType([T.StructField("key", T.LongType())]))
    assert sorted(map(tuple, out["files"].collect())) == [(1, "a"), (1, "b")] and out["runs"].collect() == [(2, True)]


def test_ranges_respect_the_cap(spark):
    rows = [(f"2024-01-{d:02d} 05:00:00",) for d in range(1, 29) for _ in range(d)]
    df = spark.createDataFrame(rows, "t string").select(F.to_timestamp("t").alias("t"))
    got = tables.plan_ranges(df, "t", 60).orderBy("first_day").collect()
    assert sum(r["rows"] for r in got) == len(rows) and all(r["rows"] <= 60 for r in got)
    assert all((b["first_day"] - a["last_day"]).days == 1 for a, b in zip(got, got[1:], strict=False))
    assert tables.plan_ranges(df, "t", 5).filter("capped").count() > 0
    assert tables.plan_ranges(df.limit(0), "t", 5).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id int, n int")
    assert sinks.write_decisions(df, F.col("n") > 9, f"file://{tmp_path}/d") == {"all": 3, "kept": 1, "excluded": 2}
    assert sinks.write_enriched(df, {"m": F.col("n") * 2}, f"file://{tmp_path}/e") == 3
    with pytest.raises(ValueError, match="exist"):
        sinks.enrich(df, {"n": F.lit(1)})
    assert sinks.to_markdown(df.limit(1)) == "| id | n |\n| --- | --- |\n| 1 | 5 |\n"
    assert r"1 & 5 \\" in sinks.to_latex(df.limit(1))


def test_batches_arrive_once(spark, tmp_path):
    source, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    schema = spark.range(1).schema
    spark.range(10).repartition(3).write.mode("append").parquet(source)
    inc.run_available(inc.file_stream(spark, source, schema, 1), inc.write_batch(out), state)
    spark.range(10, 14).write.mode("append").parquet(source)
    inc.run_available(inc.file_stream(spark, source, schema, 1), inc.write_batch(out), state)
    inc.run_available(inc.file_stream(spark, source, schema, 1), inc.write_batch(out), state)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(14))


def test_units_and_signature(spark):
    rows, units = spark.createDataFrame([("a",), ("a",), ("b",)], "u string"), spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "u string, expected int")
    assert {r["u"]: r["complete"] for r in inc.completed_units(rows, units, "u").collect()} == {"a": True, "b": False, "c": False}
    assert inc.pipeline_signature({"a": 1, "b": 2}) == inc.pipeline_signature({"b": 2, "a": 1}) != inc.pipeline_signature({"a": 1})
    done = rows.filter("u = 'a'").distinct()
    assert inc.enrich_pending(rows, done, ["u"], lambda d: d.withColumn("x", F.lit(1))).collect() == [("b", 1)]


def test_results_by_outcome(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("z", False)], "id string, bad boolean")
    out = tables.accept_results(got, asked, "id", F.col("bad"))
    assert {k: [r["id"] for r in d.collect()] for k, d in out.items()} == {"completed": ["a"], "failed": ["b"], "unknown": ["z"], "missing": ["c"]}


def test_a_run_stops_between_batches_and_goes_on(spark, tmp_path):
    source, out, state = (f"file://{tmp_path}/{x}" for x in ("source", "out", "state"))
    schema = spark.range(1).schema
    spark.range(12).repartition(4).write.parquet(source)
    done = []
    work = inc.write_batch(out)
    go = lambda b, k: (work(b, k), done.append(k))
    assert not inc.run_until(inc.file_stream(spark, source, schema, 1), go, state, lambda: len(done) >= 2)
    assert spark.read.parquet(out).count() < 12 and len(done) == 2
    assert inc.run_until(inc.file_stream(spark, source, schema, 1), go, state, lambda: False)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(12))


def test_csv_and_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\nd', 1 / 3), (2, "", 1e-300), (3, None, None)], "id long, t string, x double")
    sinks.write_csv(df, f"file://{tmp_path}/x.csv")
    assert sorted(map(tuple, tables.read_any(spark, f"file://{tmp_path}/x.csv", df.schema).collect()), key=lambda r: r[0]) == [(1, 'a "b", c\nd', 1 / 3), (2, None, 1e-300), (3, None, None)]
    with pytest.raises(ValueError):
        sinks.to_json_lines(spark.range(3), 2)
    assert sinks.to_json_lines(spark.range(1)) == '{"id": "0"}\n'
