"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1. Each source has a target (words that the mix
takes from it) and a schedule: how strongly it is drawn at each knot of
time, linear between knots. The schedule's integral, scaled to the target,
is the source's cumulative demand; its inverse gives the time at which the
source's n-th word is drawn. Documents of a source queue in the order of a
digest of their id, pass after pass while demand lasts; the document at
which demand ends is drawn up to that word. A pass of a document takes its
position from the middle of its words, and the mix is range-sorted by
position.

Only DataFrame functions. A source may hold a third of all rows: running
sums go in two levels, within buckets of the digest and over bucket totals,
so that no task sees a whole source. The table of sources is broadcast only
while it is small.

Defined cases: null texts have no words and are never drawn; a null source
is a source of its own, after all others; documents without words take 0;
equal ids tie and are told apart by their sizes; equal ids of equal size are
drawn alike in some order; extra columns are ignored (``plan_mix``) or kept
(``draw``). Without any word all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.session import Scratch

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: Times a source is passed through at most.
MOST_PASSES = 3
#: Knots of time, and the pull at each for the sources in order, repeating: early, even, late.
KNOTS = (0.0, 0.5, 1.0)
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Rows of a bucket aimed at, and digits (base 16) of the digest that name a bucket at least and at most.
BUCKET_ROWS, LEAST_DIGITS, MOST_DIGITS = 100_000, 2, 8
#: More sources than this are joined by a shuffle.
BROADCAST_SOURCES = 10_000

_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, schedules: tuple[tuple[float, ...], ...] = SCHEDULES) -> DataFrame:
    """A row for each source: source, source_rows, source_size, target and its schedule.

    Shares go by weight; no source takes over ``most`` times its size, and
    what that leaves is shared among the others again. Raising all shares
    together, sources reach their bound in the order of bound / weight; the
    level is found where the bounds reached and the weights left use up the
    total, with one ordered pass over the sources.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    totals = sizes.groupBy("source").agg(F.count("*").alias("source_rows"), F.sum("size").alias("source_size"))
    turn = (F.row_number().over(by_name) - 1).cast("int")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col("turn"), F.lit(len(values))) + 1).cast("int"))
    named = totals.withColumn("turn", turn).withColumn("weight", pick([float(w) for w in weights]))
    pulls = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in schedules]), (F.pmod(F.col("turn"), F.lit(len(schedules))) + 1).cast("int"))
    named = named.withColumn("pulls", pulls).withColumn("bound", F.lit(float(most)) * F.col("source_size"))
    order = [(F.col("bound") / F.col("weight")), F.col("turn")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    # The level if this source and all behind it stay below their bounds; the first that holds is the level.
    level = left / F.sum("weight").over(after)
    staged = named.withColumn("level", level).withColumn("holds", F.col("level") * F.col("weight") <= F.col("bound"))
    final = F.min(F.when(F.col("holds"), F.struct(F.col("bound") / F.col("weight"), F.col("turn"), F.col("level").alias("level")))).over(whole)
    return staged.withColumn("final", final["level"]).select(
        "source", "source_rows", "source_size", F.coalesce(F.least(F.col("bound"), F.col("final") * F.col("weight")), F.lit(0.0)).alias("target"), "pulls"
    )


def invert_demand(words: Column, target: Column, pulls: Column, knots: tuple[float, ...] = KNOTS) -> Column:
    """The time at which a source has been asked for so many words: the inverse of its integrated schedule."""
    n = len(knots)
    at = [F.element_at(pulls, k + 1) for k in range(n)]
    areas = [(at[k] + at[k + 1]) / 2 * (knots[k + 1] - knots[k]) for k in range(n - 1)]
    total = sum(areas[1:], areas[0])
    asked = F.when(target > 0, F.least(words / target, F.lit(1.0))).otherwise(F.lit(0.0)) * total
    out, done = F.lit(knots[-1]), [F.lit(0.0)]
    for area in areas:
        done.append(done[-1] + area)
    for k in reversed(range(n - 1)):
        rest, width = F.greatest(asked - done[k], F.lit(0.0)), knots[k + 1] - knots[k]
        slope = (at[k + 1] - at[k]) / width
        # rest = pull * x + slope / 2 * x^2, solved without cancellation; a flat schedule is covered too.
        root = F.sqrt(F.greatest(at[k] * at[k] + slope * rest * 2, F.lit(0.0)))
        x = F.when(at[k] + root > 0, rest * 2 / (at[k] + root)).otherwise(F.lit(0.0))
        out = F.when(asked <= done[k + 1], F.lit(knots[k]) + F.least(x, F.lit(width))).otherwise(out)
    return out


def _queue(docs: DataFrame) -> DataFrame:
    """Sizes and places in the queue of a source: the digest of the id, then id and size."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")).cast("binary")).alias("place"),
    )


def _attach(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """The columns of a row's source. Nulls are a source; a small table of sources is broadcast, a large one shuffled."""
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    right = sources.withColumnRenamed("source", "its_source")
    right = F.broadcast(right) if few else right
    return rows.join(right, rows["source"].eqNullSafe(right["its_source"])).drop("its_source")


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, schedules: tuple[tuple[float, ...], ...] = SCHEDULES) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, taken, and its passes.

    ``passes``: an array of (pass, words, position), one entry for each time it is drawn.
    """
    # Texts are read once: what the mix needs of them is a few columns, written for the passes below.
    sizes = Scratch(docs.sparkSession, "mixing").table(_queue(docs), "sizes")
    sources = source_targets(sizes, weights, most, schedules)
    rows = _attach(sizes, sources)
    # Digits so that a bucket of the largest source stays near BUCKET_ROWS.
    digits = F.least(F.lit(MOST_DIGITS), F.greatest(F.lit(LEAST_DIGITS), F.ceil(F.log(16.0, F.col("source_rows") / BUCKET_ROWS)).cast("int")))
    rows = rows.withColumn("bucket", F.substring("place", F.lit(1), digits))
    inside = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(along), F.lit(0))).select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "ahead")
    rows = rows.join(buckets, rows["source"].eqNullSafe(buckets["b_source"]) & (rows["bucket"] == buckets["b_bucket"]))
    rows = rows.withColumn("begin", F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    demand = F.round("target").cast("long")
    offset = lambda k: F.col("source_size") * k + F.col("begin")
    words = lambda k: F.greatest(F.lit(0), F.least(F.col("size"), demand - offset(k)))
    one = lambda k: F.struct(F.lit(k + 1).alias("pass"), words(k).alias("words"), invert_demand(offset(k) + words(k) / 2, F.col("target"), F.col("pulls")).alias("position"))
    passes = F.filter(F.array(*[one(k) for k in range(most)]), lambda p: p["words"] > 0)
    out = rows.withColumn("passes", passes)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "passes")


def draw(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, schedules: tuple[tuple[float, ...], ...] = SCHEDULES) -> DataFrame:
    """The mix itself, range-sorted by position: doc_id, source, pass, words and position, a row for each time a document is drawn."""
    plan = plan_mix(docs, weights, most, schedules)
    return plan.select("doc_id", "source", "size", F.inline("passes")).orderBy("position", "source", "doc_id", "pass")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    first = F.round(F.element_at(F.transform("passes", lambda p: p["position"]), 1), 6)
    out = plan.select("doc_id", "size", "source_size", "target", "taken", F.when(F.size("passes") > 0, first).alias("first_position"))
    return out.orderBy(F.col("first_position").asc_nulls_last(), "doc_id", "size")


def op5_sql() -> str:
    """The same over DuckDB's documents."""
    n = len(KNOTS)
    total = " + ".join(f"(p{k} + p{k + 1}) / 2 * {KNOTS[k + 1] - KNOTS[k]}" for k in range(n - 1))
    done = ["0.0"]
    for k in range(n - 1):
        done.append(f"({done[-1]} + (p{k} + p{k + 1}) / 2 * {KNOTS[k + 1] - KNOTS[k]})")
    cases = ""
    for k in range(n - 1):
        width = KNOTS[k + 1] - KNOTS[k]
        rest = f"greatest(asked - {done[k]}, 0)"
        root = f"sqrt(greatest(p{k} * p{k} + (p{k + 1} - p{k}) / {width} * {rest} * 2, 0))"
        cases += f" WHEN asked <= {done[k + 1]} THEN {KNOTS[k]} + least(CASE WHEN p{k} + {root} > 0 THEN {rest} * 2 / (p{k} + {root}) ELSE 0 END, {width})"
    pick = lambda values, m: " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + f" ELSE {m} END"
    pulls = ", ".join(f"CASE turn % {len(SCHEDULES)} {pick([s[k] for s in SCHEDULES], 1)} AS p{k}" for k in range(n))
    drawn = " + ".join(f"greatest(0, least(size, demand - source_size * {k} - first))" for k in range(MOST_PASSES))
    return f"""
    WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null')) AS place FROM documents),
    totals AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) AS turn FROM sizes GROUP BY source),
    named AS (SELECT *, CASE turn % {len(WEIGHTS)} {pick([float(w) for w in WEIGHTS], 1)}::DOUBLE AS weight, {pulls}, {float(MOST_PASSES)} * source_size AS bound FROM totals),
    staged AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(bound) OVER (ORDER BY bound / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY bound / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM named),
    final AS (SELECT level AS final FROM staged WHERE level * weight <= bound ORDER BY bound / weight, turn LIMIT 1),
    targets AS (SELECT source, source_size, least(bound, final * weight)::DOUBLE AS target, {', '.join(f'p{k}::DOUBLE AS p{k}' for k in range(n))} FROM staged, final),
    queued AS (SELECT doc_id, size, source_size, target, round(target)::BIGINT AS demand, {', '.join(f'p{k}' for k in range(n))},
      coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
      FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
    taken AS (SELECT *, ({drawn})::BIGINT AS taken, greatest(0, least(size, demand - first)) AS words FROM queued),
    asked AS (SELECT *, CASE WHEN target > 0 THEN least((first + words / 2.0) / target, 1.0) ELSE 0 END * ({total}) AS asked FROM taken)
    SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(CASE {cases} ELSE {KNOTS[-1]} END, 6) END AS first_position FROM asked"""
