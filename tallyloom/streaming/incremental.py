"""Incremental processing with Structured Streaming: idempotent batches, done units, windows.

Event-time windows are an extension; the incremental pieces stand in for
journaled checkpoints and resume files.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyloom.operators.relational import pending
from tallyloom.sources.atomic import create_text, read_text


def pipeline_signature(config: dict) -> str:
    """A digest of a configuration; a run may resume only under the same one."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class OtherConfiguration(Exception):
    """A checkpoint belongs to a run under another configuration."""


def bind_checkpoint(spark: SparkSession, checkpoint: str, config: dict) -> bool:
    """Bind a checkpoint to a configuration, whose digest stands beside it; whether this is its first run.

    The digest is created if there is none, so of several first runs one
    binds it. Under another configuration it is an error, before anything is read.
    """
    path, signature = checkpoint.rstrip("/") + ".signature", pipeline_signature(config)
    if create_text(spark, path, signature):
        return True
    if (found := read_text(spark, path)) != signature:
        raise OtherConfiguration(f"{checkpoint} was begun under {found}, not {signature}")
    return False


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 16) -> DataFrame:
    """Parquet files of a folder as they arrive; each is read once for a checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_available(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, config: dict | None = None) -> StreamingQuery:
    """Process all that has arrived in micro-batches, then stop. ``work`` must be idempotent for a batch id. With ``config`` the checkpoint is bound to it."""
    if config is not None:
        bind_checkpoint(stream.sparkSession, checkpoint, config)
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class Stopped(Exception):
    """A run was asked to stop before a batch began."""


def run_until(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, stop: Callable[[], bool], config: dict | None = None) -> bool:
    """Process what has arrived until ``stop`` says so between two batches; whether all was processed.

    A batch under way is finished. The one that was to come isn't begun and
    is the first of the next run from the same checkpoint. With ``config`` the
    checkpoint is bound to it.
    """
    if config is not None:
        bind_checkpoint(stream.sparkSession, checkpoint, config)
    asked = []

    def unless_stopped(batch: DataFrame, batch_id: int) -> None:
        if stop():
            asked.append(batch_id)
            raise Stopped(f"before batch {batch_id}")
        work(batch, batch_id)

    query = stream.writeStream.foreachBatch(unless_stopped).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not asked:
            raise
    return not asked


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Work that writes each batch to a folder of its own: a batch run again replaces itself, so that rows arrive exactly once."""

    def work(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return work


def enrich_pending(incoming: DataFrame, done: DataFrame | None, keys: list[str], enrich: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Enrich only rows that aren't done yet."""
    return enrich(pending(incoming, done, keys) if done is not None else incoming)


def completed_units(rows: DataFrame, units: DataFrame, unit: str) -> DataFrame:
    """Units of which every row is there: ``units`` has unit and expected rows; partial ones are to be run again."""
    have = rows.groupBy(unit).agg(F.count("*").alias("rows"))
    return units.join(have, unit, "left").select(unit, F.coalesce(F.col("rows") == F.col("expected"), F.lit(False)).alias("complete"))


def tumbling(events: DataFrame, ts: str, width: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts by window and keys; with ``late``, a stream's windows close so long after their end."""
    if late:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def sliding(events: DataFrame, ts: str, width: str, step: str, keys: list[str], late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, width, step), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def first_by_key(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """A stream without repeated keys, kept in state for as long as rows may be late."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
