"""Scans: named tables, files by suffix, fragments, batch results, range planning."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None, revision: str | None = None) -> DataFrame:
    """A Parquet table of ``folder`` (or of its snapshot ``revision``); timestamps without zone are taken as UTC.

    ``columns`` are pruned at the scan.
    """
    path = f"{folder}/{revision}/{name}.parquet" if revision else f"{folder}/{name}.parquet"
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def register_views(spark: SparkSession, folder: str, names: Iterable[str] = NAMES) -> dict[str, DataFrame]:
    """The named tables, also as temporary views."""
    tables = {name: read_table(spark, folder, name) for name in names}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, CSV with header, or JSON lines, by the path's suffix. CSV and JSON need a schema: inferred types change with the data."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if schema is None:
        raise ValueError(f"{path}: {kind} files need a schema")
    if kind == "csv":
        return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if kind in ("json", "jsonl", "ndjson"):
        return spark.read.schema(schema).json(path)
    raise ValueError(f"{path}: no reader for .{kind}")


def find_column(df: DataFrame, candidates: Sequence[str], required: bool = True) -> str | None:
    """The first of the candidates that the table has."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None and required:
        raise KeyError(f"none of {list(candidates)} among {df.columns}")
    return found


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns in order: missing ones are null, others are dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_fragments(spark: SparkSession, path: str, tables: dict[str, T.StructType], common: T.StructType) -> dict[str, DataFrame]:
    """A folder of JSON documents, each with one array of records for each table, as flat tables.

    Every record gets the document's common fields in front.
    """
    parts = [T.StructField(name, T.ArrayType(kind)) for name, kind in tables.items()]
    docs = spark.read.schema(T.StructType([*common.fields, *parts])).json(path)
    prefix = [f.name for f in common.fields]
    return {name: docs.select(*prefix, F.inline(name)) for name in tables}


def accept_results(results: DataFrame, requested: DataFrame, key: str, error: Column) -> dict[str, DataFrame]:
    """Batch results split into ``completed``, ``failed`` and ``unknown`` (ids that nobody requested); ``missing`` are requests without result.

    Of several results for one id a completed one wins, then the first by all columns.
    """
    known = requested.select(key).distinct()
    marked = results.withColumn("__failed", F.coalesce(error, F.lit(False)))
    rest = [c for c in results.columns if c != key]
    one = marked.groupBy(key).agg(F.min(F.struct("__failed", *rest)).alias("__one")).select(key, "__one.*")
    here = one.join(known, key, "left_semi")
    return {
        "completed": here.filter(~F.col("__failed")).drop("__failed"),
        "failed": here.filter("__failed").drop("__failed"),
        "unknown": one.join(known, key, "left_anti").drop("__failed"),
        "missing": known.join(one, key, "left_anti"),
    }


def month_ranges(spark: SparkSession, start: str, end: str) -> DataFrame:
    """month, first and last day (both inclusive, clipped to the whole range) of every month touched."""
    days = spark.range(1).select(F.to_date(F.lit(start)).alias("s"), F.to_date(F.lit(end)).alias("e")).filter("s <= e")
    months = days.select("s", "e", F.explode(F.sequence(F.trunc("s", "MM"), F.trunc("e", "MM"), F.expr("interval 1 month"))).alias("m"))
    return months.select(F.date_format("m", "yyyy-MM").alias("month"), F.greatest("m", "s").alias("first_day"), F.least(F.last_day("m"), "e").alias("last_day"))


def plan_ranges(days: DataFrame, day: str, cap: int, most_rounds: int = 20) -> DataFrame:
    """Ranges of days that hold at most ``cap`` rows each: first_day, last_day, rows, capped.

    A range over the cap is cut in the middle, again and again; a single day
    over the cap can't be cut and is marked. Counts go by day first, so the
    rounds work on a table of days.
    """
    counts = days.filter(F.col(day).isNotNull()).groupBy(F.to_date(day).alias("d")).agg(F.count("*").alias("n"))
    bounds = counts.agg(F.min("d"), F.max("d")).first()
    spark = days.sparkSession
    schema = "first_day date, last_day date, rows long, capped boolean"
    if bounds[0] is None:
        return spark.createDataFrame([], schema)
    open_ranges, done = [(bounds[0], bounds[1])], []
    for _ in range(most_rounds):
        if not open_ranges:
            break
        ranges = F.broadcast(spark.createDataFrame(open_ranges, "a date, b date"))
        sized = ranges.join(counts, F.col("d").between(F.col("a"), F.col("b")), "left").groupBy("a", "b").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()
        open_ranges = []
        for a, b, n in sized:
            if n <= cap or a == b:
                done.append((a, b, n, n > cap))
            else:
                middle = a + (b - a) // 2
                open_ranges += [(a, middle), (middle + timedelta(days=1), b)]
    return spark.createDataFrame(done, schema)


def page_requests(totals: DataFrame, total: str, page_size: int) -> DataFrame:
    """One row for each page of a paged listing: ``page`` from 1, and the rows on it."""
    pages = F.ceil(F.col(total) / page_size).cast("int")
    paged = totals.filter(F.col(total) > 0).withColumn("page", F.explode(F.sequence(F.lit(1), pages)))
    return paged.withColumn("rows_on_page", F.least(F.lit(page_size), F.col(total) - (F.col("page") - 1) * page_size).cast("long"))
