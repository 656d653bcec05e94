"""Filters, joins, set operations, windows and reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import Scratch
from tallyloom.stats.rank import running

# Filters -----------------------------------------------------------------------------------------


def at_least(df: DataFrame, column: str, floor: float) -> DataFrame:
    """Rows whose number reaches the floor; what is no number counts as 0."""
    return df.filter(F.coalesce(F.col(column).cast("string").try_cast("double"), F.lit(0.0)) >= floor)


def in_window(df: DataFrame, ts: str, start: str, end: str, keys: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Rows of a closed time window and, if given, of a set of keys; a null time is outside."""
    out = df.filter(F.col(ts).between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))))
    return out.join(keys.select(key).distinct(), key, "left_semi") if keys is not None else out


def time_bounds(df: DataFrame, ts: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row: the least and greatest time, where not configured."""
    configured = lambda x: F.to_timestamp(F.lit(x)) if x else F.lit(None).cast("timestamp")
    return df.agg(F.coalesce(configured(start), F.min(ts)).alias("window_start"), F.coalesce(configured(end), F.max(ts)).alias("window_end"))


def equals_folded(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows equal to a value whatever the case; a table without the column has none."""
    return df.filter(F.lower(column) == value.lower()) if column in df.columns else df.limit(0)


def split_rows(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Kept and removed rows; an unknown condition removes."""
    sure = F.coalesce(keep, F.lit(False))
    return df.filter(sure), df.filter(~sure)


def all_equal(columns: Sequence[str], value: str) -> Column:
    return F.forall(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), lambda x: x == value)


def one_value(columns: Sequence[str]) -> Column:
    """Whether the columns agree, nulls left out."""
    return F.size(F.array_distinct(F.array_compact(F.array(*[F.col(c) for c in columns])))) == 1


def fold_rare(df: DataFrame, column: str, least: int, other: str = "Other") -> DataFrame:
    """Values with fewer than ``least`` rows become ``other``. Counts are aggregated and joined, so that no window holds a whole value."""
    counts = df.groupBy(column).agg(F.count("*").alias("__n")).filter(F.col("__n") < least).select(F.col(column).alias("__rare"))
    joined = df.join(counts, F.col(column) == F.col("__rare"), "left")
    return joined.withColumn(column, F.when(F.col("__rare").isNotNull(), other).otherwise(F.col(column))).drop("__rare")


# Joins -------------------------------------------------------------------------------------------


def outer_with_side(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join with ``side``: both, left_only or right_only."""
    a, b = left.withColumn("__l", F.lit(1)), right.withColumn("__r", F.lit(1))
    joined = a.join(b, list(on), "full_outer")
    side = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    return joined.withColumn("side", side).drop("__l", "__r")


def outer_text(left: DataFrame, right: DataFrame, on: Sequence[str], text: str, separator: str = "\n\n") -> DataFrame:
    """Full outer join that puts both sides' texts together, without the blank ones."""
    joined = left.withColumnRenamed(text, "__a").join(right.withColumnRenamed(text, "__b"), list(on), "full_outer")
    return joined.withColumn(text, F.concat_ws(separator, F.nullif("__a", F.lit("")), F.nullif("__b", F.lit("")))).drop("__a", "__b")


def without_known(left: DataFrame, right: DataFrame, left_columns: Sequence[str], right_columns: Sequence[str], normal) -> DataFrame:
    """Rows of which no column's normalised value is in any column of ``right``.

    Values of the right side are one distinct column; each left column is an
    anti join against it, so no pair of rows is ever compared.
    """
    known = right.select(F.explode(F.array_compact(F.array(*[normal(F.col(c)) for c in right_columns]))).alias("__known")).distinct()
    for column in left_columns:
        left = left.join(known, normal(F.col(column)) == F.col("__known"), "left_anti")
    return left


def pending(incoming: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows not processed yet; a row with a null key is always pending."""
    return incoming.join(done.select(*keys).distinct(), list(keys), "left_anti")


def look_up(df: DataFrame, table: DataFrame, on: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Left join to the first row of each key; the row count stays."""
    first = keep_first(table, on, order)
    return df.join(first, list(on), "left")


def override(df: DataFrame, column: str, better: DataFrame, on: Sequence[str], better_column: str, unless: Column) -> DataFrame:
    """``better_column`` where it is known and ``unless`` doesn't hold, else ``column``."""
    joined = df.join(better.select(*on, F.col(better_column).alias("__better")), list(on), "left")
    return joined.withColumn(column, F.when(~F.coalesce(unless, F.lit(False)) & F.col("__better").isNotNull(), F.col("__better")).otherwise(F.col(column))).drop("__better")


def range_join(points: DataFrame, ranges: DataFrame, on: Sequence[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points in half-open ranges [start, end) of the same key, as an equi-join on bins of ``width``.

    A range is copied to each bin that it touches; a point looks in its own bin.
    """
    binned = ranges.filter(F.col(start) < F.col(end)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    spots = points.withColumn("__bin", F.floor(F.col(at) / width))
    return spots.join(binned, [*on, "__bin"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bin")


# Set operations ----------------------------------------------------------------------------------


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_first(frames: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Union that keeps a key's row from the earliest frame that has it."""
    ranked = union_all(*[f.withColumn("__source", F.lit(k)) for k, f in enumerate(frames)])
    return keep_first(ranked, keys, [F.col("__source"), *order]).drop("__source")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows replace those of the same key, others are added."""
    return union_all(pending(existing, incoming, keys), incoming)


def key_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of one side only, with ``only_in``; empty if the populations are equal."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return outer_with_side(a, b, keys).filter("side <> 'both'").withColumn("only_in", F.when(F.col("side") == "left_only", "left").otherwise("right")).drop("side")


def bind_columns(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Two frames side by side, row by row in their orders (numbers): the n-th row of one with the n-th of the other.

    Frames of different lengths are an error. Positions go by ranges of the order values, so no task numbers a whole frame.
    """
    rows = [df.count() for df in (left, right)]
    if rows[0] != rows[1]:
        raise ValueError(f"{rows[0]} rows can't be bound to {rows[1]}")
    shared = set(left.columns) & set(right.columns)
    if shared:
        raise ValueError(f"columns on both sides: {sorted(shared)}")
    placed = [numbered(df, [], order, "__place") for df, order in ((left, left_order), (right, right_order))]
    return placed[0].join(placed[1], "__place").drop("__place")


# Windows and ranks -------------------------------------------------------------------------------


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in order; null keys are equal. Rank filters are applied before the shuffle, too."""
    return top_per_group(df, keys, order, 1)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n).drop("__rank")


def share_of(df: DataFrame, count: str, within: Sequence[str] = ()) -> DataFrame:
    """``total`` and ``share`` of a count within groups; a total of 0 gives a null share. Totals are summed first and joined to the rows."""
    if not within:
        out = df.crossJoin(F.broadcast(df.agg(F.sum(count).alias("total"))))
    else:
        totals = df.groupBy(*within).agg(F.sum(count).alias("total")).select(*[F.col(k).alias(f"__{k}") for k in within], "total")
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in within])
        out = df.join(totals, on).drop(*[f"__{k}" for k in within])
    return out.withColumn("share", F.try_divide(F.col(count), F.col("total")))


def ecdf(df: DataFrame, value: str, within: Sequence[str] = ()) -> DataFrame:
    """Steps of the empirical distribution: each distinct value, its rows, and the share of rows up to it.

    Values are counted first; running sums see distinct values, range by range.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*within, value).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*within).agg(F.sum("n").alias("__total"))
    below = running(counts, value, {"__below": "n"}, within)
    joined = below.join(totals, list(within)) if within else below.crossJoin(F.broadcast(totals))
    return joined.withColumn("share", (F.col("__below") + F.col("n")) / F.col("__total")).drop("__below", "__total")


def mid_ranks(df: DataFrame, value: str, within: Sequence[str] = ()) -> DataFrame:
    """A row for each distinct value: ``n`` ties, and the mean rank ``mid_rank`` that they share."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*within, value).agg(F.count("*").alias("n"))
    return running(counts, value, {"__below": "n"}, within).withColumn("mid_rank", F.col("__below") + (F.col("n") + 1) / 2).drop("__below")


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Islands of overlapping half-open intervals: keys, start, end and how many were merged. Touching ones stay apart."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("__reach", F.max(end).over(before)).withColumn("__new", F.when(F.col("__reach").isNull() | (F.col(start) >= F.col("__reach")), 1).otherwise(0))
    return marked.withColumn("__island", F.sum("__new").over(upto)).groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged")).drop("__island")


def halves(df: DataFrame, stratum: str) -> DataFrame:
    """``half``: early or late, by the rank of the row's stratum among the distinct strata in order."""
    strata = df.select(stratum).distinct()
    order = Window.orderBy(stratum)
    named = strata.withColumn("half", F.when(F.dense_rank().over(order) <= F.floor(F.count("*").over(Window.partitionBy()) / 2), "early").otherwise("late"))
    return df.join(F.broadcast(named) if strata.limit(10_001).count() <= 10_000 else named, stratum)


def fixed_batches(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: int) -> DataFrame:
    """Numbered batches of a fixed number of rows within each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def capacity_batches(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, most_rows: int, most_size: int) -> DataFrame:
    """Batches filled in order until the next row would break a limit: keys, batch (from 0), rows, size.

    A row over the size limit is a batch of its own; a null size counts as 0.
    Filling is sequential by nature: a key's rows pass one task in order,
    which holds the open batch and nothing else.
    """
    rows = df.select(*keys, *[F.col(c) for c in order if c not in keys], F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("__size"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order, "__size").select(*keys, "__size")
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(c, T.LongType()) for c in ("batch", "rows", "size")]])

    def fill(batches):
        key, batch, n, total = None, 0, 0, 0
        for data in batches:
            sizes = data.column(len(keys)).to_pylist()
            done, kept = [], []
            for k, own in enumerate(zip(*[data.column(c).to_pylist() for c in range(len(keys))], strict=True)):
                if n and own == key and n < most_rows and total + sizes[k] <= most_size:
                    n, total = n + 1, total + sizes[k]
                    continue
                if n:
                    done.append((*key, batch, n, total))
                batch = batch + 1 if n and own == key else 0
                key, n, total = own, 1, sizes[k]
            kept += done
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), [*(f.type for f in list(data.schema)[:-1]), *[pa.int64()] * 3], strict=True)], names=schema.names)
            types = [f.type for f in list(data.schema)[:-1]]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, batch, n, total), [*types, *[pa.int64()] * 3], strict=True)], names=schema.names)

    return rows.mapInArrow(fill, schema)


def _as_double(value: Column, kind: T.DataType) -> Column:
    return F.unix_date(value).cast("double") if isinstance(kind, T.DateType) else F.unix_micros(value.cast("timestamp")).cast("double") if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else value.cast("double")


def numbered(df: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """``name``: the row's number from 1 by ``order`` (numbers, dates or times) within its keys. Order values are counted into ranges first, so no task has a whole key; rows of equal order are numbered in some order."""
    if not isinstance(df.schema[order].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"{order} is no number, date or time")
    counts = df.groupBy(*keys, F.col(order).alias("__o")).agg(F.count("*").alias("__n")).withColumn("__v", _as_double(F.col("__o"), df.schema[order].dataType))
    ahead = running(counts, "__v", {"__ahead": "__n"}, keys, exact="__o").select(*[F.col(k).alias(f"__{k}") for k in keys], "__o", "__ahead")
    on = F.col(order).eqNullSafe(F.col("__o"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    same = F.row_number().over(Window.partitionBy(*keys, order).orderBy(F.lit(0)))
    return df.join(ahead, on).withColumn(name, F.col("__ahead") + same).drop("__o", "__ahead", *[f"__{k}" for k in keys])


def dense_numbers(df: DataFrame, column: str, name: str) -> DataFrame:
    """The distinct values of a column with their numbers from 0 in order. Values are dealt by ranges; no task has them all. Null is a value, the first."""
    scratch = Scratch(df.sparkSession, "numbers")
    dealt = df.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column)
    placed = scratch.table(dealt.withColumn("__place", F.monotonically_increasing_id()), "placed").withColumn("__part", F.shiftright("__place", 33))
    held = placed.groupBy("__part").agg(F.count("*").alias("__rows"), F.min("__place").alias("__first"))
    # One row for each range.
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = held.select("__part", (before - F.col("__first")).alias("__shift"))
    return placed.join(shifts, "__part").select(column, (F.col("__place") + F.col("__shift")).alias(name))


# Reshaping ---------------------------------------------------------------------------------------


def cross_counts(df: DataFrame, rows: str, columns: str, row_domain: Sequence[str], column_domain: Sequence[str]) -> DataFrame:
    """Counts over a fixed domain of rows and columns, 0 where nothing is; values outside the domain don't count."""
    spark = df.sparkSession
    domain = F.broadcast(spark.createDataFrame([(r, k) for k, r in enumerate(row_domain)], f"{rows} string, __order int"))
    cells = df.groupBy(rows).pivot(columns, list(column_domain)).agg(F.count(F.lit(1)))
    filled = domain.join(cells, rows, "left").na.fill(0, list(column_domain))
    return filled.orderBy("__order").select(rows, *[F.col(f"`{c}`").cast("long").alias(c) for c in column_domain])


def distribution(df: DataFrame, arm: str, category: str, categories: Sequence[str]) -> DataFrame:
    """arm, category, n, total and share for every arm and category of the domain."""
    arms = df.groupBy(arm).agg(F.count("*").alias("total"))
    domain = arms.withColumn(category, F.explode(F.array(*[F.lit(c) for c in categories])))
    counts = df.groupBy(arm, category).agg(F.count("*").alias("n"))
    out = domain.join(counts, [arm, category], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(arm, category, "n", "total", F.try_divide(F.col("n"), F.col("total")).alias("share"))


def with_margins(df: DataFrame, rows: str, columns: str, label: str = "All") -> DataFrame:
    """Counts of all pairs with totals by row, by column and overall."""
    named = lambda c: F.when(F.grouping(c) == 1, label).otherwise(F.col(c).cast("string")).alias(c)
    return df.cube(rows, columns).agg(named(rows).alias("__r"), named(columns).alias("__c"), F.count("*").alias("n")).select(F.col("__r").alias(rows), F.col("__c").alias(columns), "n")


def profile(df: DataFrame, group: str, flags: Sequence[str], label: str = "All") -> DataFrame:
    """Per group and overall: rows, the share of each flag, the share of rows with any, and the mean number of flags."""
    as_int = {f: F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in flags}
    total = sum(as_int.values(), F.lit(0))
    prepared = df.select(F.col(group), *[c.alias(f) for f, c in as_int.items()], total.alias("__total"))
    sums = [F.count("*").alias("n"), *[F.avg(f).alias(f"{f}_share") for f in flags], F.avg((F.col("__total") > 0).cast("int")).alias("any_share"), F.avg("__total").alias("mean_flags")]
    return prepared.rollup(group).agg(F.when(F.grouping(group) == 1, label).otherwise(F.col(group)).alias("__g"), *sums).drop(group).withColumnRenamed("__g", group)


def join_in_order(df: DataFrame, keys: Sequence[str], order: str, text: Column, separator: str = "\n\n") -> DataFrame:
    """A key's non-blank texts in order as one ``text``."""
    kept = df.withColumn("__text", text).filter(F.trim(F.coalesce("__text", F.lit(""))) != "")
    gathered = F.sort_array(F.collect_list(F.struct(order, "__text")))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(gathered, lambda x: x["__text"]), separator).alias("text"))


def render_records(columns: Sequence[str], separator: str = " | ") -> Column:
    """A row as ``column=value`` pairs; nulls are left out."""
    return F.concat_ws(separator, *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns])


def distinct_joined(df: DataFrame, keys: Sequence[str], column: str, separator: str = " | ") -> DataFrame:
    """A key's distinct non-blank values, sorted, as one string."""
    return df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")))), separator).alias(column))
