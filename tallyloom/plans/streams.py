"""Queries of event-time windows and of incremental runs over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.catalog import Tables, query
from tallyloom.session import Scratch
from tallyloom.streaming import incremental as inc

_TIME = "yyyy-MM-dd HH:mm:ss"


@query("SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(t: Tables) -> DataFrame:
    return inc.tumbling(t.events, "ts", "6 hours", ["event_type"]).withColumn("window_start", F.date_format("window_start", _TIME))


@query("""WITH w AS (SELECT unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']) AS s, event_type FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM w GROUP BY 1, 2""")
def sliding_windows(t: Tables) -> DataFrame:
    return inc.sliding(t.events, "ts", "12 hours", "6 hours", ["event_type"]).withColumn("window_start", F.date_format("window_start", _TIME))


@query("""WITH p AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS q FROM events), g AS (SELECT user_id, ts, sum(CASE WHEN q IS NULL OR ts >= q + INTERVAL '4 hours' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM p)
SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) + 14400000000 AS session_end, count(*) AS n FROM g GROUP BY user_id, k""")
def session_windows(t: Tables) -> DataFrame:
    s = inc.sessions(t.events, "ts", "4 hours", "user_id")
    return s.select("user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "n")


@query("SELECT event_id, user_id, value * 2 AS doubled FROM events WHERE event_type = 'purchase'")
def incremental_enrichment(t: Tables) -> DataFrame:
    """Purchases enriched by micro-batches from files, each batch written once."""
    scratch = Scratch(t.spark, "stream")
    source, out = scratch.new_path("source"), scratch.new_path("out")
    t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "value").write.option("maxRecordsPerFile", 50_000).parquet(source)
    schema = t.spark.read.parquet(source).schema
    stream = inc.file_stream(t.spark, source, schema, 2).withColumn("doubled", F.col("value") * 2)
    inc.run_available(stream, inc.write_batch(out), scratch.new_path("checkpoint"))
    return t.spark.read.parquet(out).select("event_id", "user_id", "doubled")
