"""Expectations: each gives the rows that violate it, so that an empty result is a pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ExpectationError(ValueError):
    """Rows were found where none should be."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ExpectationError(f"missing columns: {missing}")


def require_none(violations: DataFrame, what: str) -> None:
    """Raise with an example if there is any row."""
    found = violations.limit(1).collect()
    if found:
        raise ExpectationError(f"{what}: for example {found[0].asDict()}")


def bad_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are null or occur more than once, with their rows and the problem."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    counts = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    return counts.withColumn("problem", F.when(null, "null_key").when(F.col("rows") > 1, "duplicate")).filter("problem is not null")


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return bad_keys(left, keys).withColumn("side", F.lit("left")).unionByName(bad_keys(right, keys).withColumn("side", F.lit("right")))


def many_to_one(right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return bad_keys(right, keys).withColumn("side", F.lit("right"))


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], cardinality: str, how: str = "inner") -> DataFrame:
    """A join whose cardinality (one_to_one or many_to_one) is checked first."""
    require_none(one_to_one(left, right, keys) if cardinality == "one_to_one" else many_to_one(right, keys), f"keys {list(keys)} aren't {cardinality}")
    return left.join(right, list(keys), how)


def outside_domain(df: DataFrame, column: str, domain: Sequence[str], nullable: bool = False) -> DataFrame:
    """Values that the domain doesn't have, with their rows."""
    known = F.col(column).cast("string").isin(*domain)
    bad = ~F.coalesce(known, F.lit(nullable))
    return df.filter(bad).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("rows"))


def broken_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule (an unknown outcome breaks it); rules that hold aren't listed."""
    sums = df.agg(*[F.sum(F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)).alias(n) for n, c in rules.items()])
    return sums.unpivot([], list(rules), "rule", "rows").filter("rows > 0")


def unbalanced(df: DataFrame, strata: Sequence[str], arm: str, arms: tuple[str, str]) -> DataFrame:
    """Strata in which the two arms have different numbers of rows."""
    counts = df.groupBy(*strata).agg(*[F.count_if(F.col(arm) == a).alias(f"n_{k}") for k, a in enumerate(arms)])
    return counts.filter("n_0 <> n_1")


def reconcile(whole: DataFrame, parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Keys that aren't in exactly one part, or are in a part only."""
    marked = parts[0].select(*keys)
    for p in parts[1:]:
        marked = marked.unionByName(p.select(*keys))
    counted = marked.groupBy(*keys).agg(F.count("*").alias("parts")).join(whole.select(*keys).distinct().withColumn("__whole", F.lit(1)), list(keys), "full_outer")
    return counted.withColumn("parts", F.coalesce("parts", F.lit(0))).filter((F.col("parts") != 1) | F.col("__whole").isNull()).drop("__whole")


def several_values(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Keys under which a column that should be constant has several values."""
    return df.groupBy(*keys).agg(F.countDistinct(column).alias("values")).filter("values > 1")


def population_hash(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, and a SHA-256 over all keys that doesn't depend on their order.

    Each row's digest is summed as four exact decimals, so no task holds all rows.
    """
    digest = F.sha2(F.concat_ws("\t", *[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]), 256)
    words = [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16, 31, 46)]
    sums = df.agg(F.count("*").alias("rows"), *[F.sum(w).alias(f"__w{k}") for k, w in enumerate(words)])
    return sums.select("rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *[F.coalesce(F.col(f"__w{k}"), F.lit(0)).cast("string") for k in range(4)]), 256).alias("hash"))


def differing_cells(left: DataFrame, right: DataFrame, keys: Sequence[str], rtol: float = 1e-6, atol: float = 1e-7) -> DataFrame:
    """Cells that differ between two tables of the same keys: numbers beyond the tolerance, other values at all, rows on one side."""
    shared = [c for c in left.columns if c not in keys and c in right.columns]
    a, b = (df.select(*keys, F.lit(True).alias(f"__in_{s}"), *[F.col(c).cast("string").alias(f"{s}_{c}") for c in shared]) for df, s in ((left, "l"), (right, "r")))
    joined = a.join(b, list(keys), "full_outer")

    def unequal(c):
        x, y = F.col(f"l_{c}"), F.col(f"r_{c}")
        nx, ny = x.try_cast("double"), y.try_cast("double")
        near = F.abs(nx - ny) <= atol + rtol * F.abs(ny)
        return ~F.coalesce(F.when(nx.isNotNull() & ny.isNotNull(), near).otherwise(x.eqNullSafe(y)), F.lit(False))

    missing = F.col("__in_l").isNull() | F.col("__in_r").isNull()
    cells = F.array(F.when(missing, F.lit("(row)")), *[F.when(~missing & unequal(c), F.lit(c)) for c in shared])
    return joined.select(*keys, F.explode(F.array_compact(cells)).alias("column"))


def required_lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The rows with the table's columns; a key that the table lacks, or has more than once, is an error. Null keys keep nulls."""
    require_none(bad_keys(table, [key]), f"{key} isn't a key of the table")
    require_none(df.filter(F.col(key).isNotNull()).select(key).distinct().join(table.select(key), key, "left_anti"), f"{key} without an entry")
    return df.join(table, key, "left")


def differing_hashes(expected: DataFrame, found: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """Keys whose digests differ between two tables, or that one of them lacks: keys and ``problem``."""
    a, b = (df.select(*keys, F.lit(True).alias(f"__in_{s}"), F.col(digest).alias(f"__{s}")) for df, s in ((expected, "a"), (found, "b")))
    joined = a.join(b, list(keys), "full_outer")
    problem = F.when(F.col("__in_b").isNull(), "missing").when(F.col("__in_a").isNull(), "unexpected").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return joined.select(*keys, problem.alias("problem")).filter("problem is not null")


def stale_hashes(df: DataFrame, keys: Sequence[str], digest: str, derived: Column) -> DataFrame:
    """Keys of rows whose stored digest isn't the one derived anew."""
    return df.filter(~F.col(digest).eqNullSafe(derived)).select(*keys)


def off_control(df: DataFrame, controls: dict[str, tuple[Column, float]]) -> DataFrame:
    """Control totals that aren't met: name, expected and found. Each control is an aggregate and its value; all are taken in one pass."""
    sums = df.agg(*[c.cast("double").alias(n) for n, (c, _) in controls.items()])
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(v)).alias("expected"), F.col(n).alias("found")) for n, (_, v) in controls.items()])
    return sums.select(F.inline(entries)).filter(~F.col("expected").eqNullSafe(F.col("found")))


def manifest_of(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each table: name, columns, rows, and a hash of all rows whatever their order."""
    rows = [df.sparkSession.range(1).select(F.lit(name).alias("name"), F.lit(",".join(df.columns)).alias("columns")).crossJoin(population_hash(df, df.columns)) for name, df in sorted(tables.items())]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def verify_manifest(manifest: DataFrame, read: Callable[[str], DataFrame]) -> DataFrame:
    """Tables of a manifest (a short table) that aren't as it says: name and problem (path, unreadable, columns, rows or hash, the first that applies).

    Names that leave the folder are never read.
    """
    spark, problems = manifest.sparkSession, []
    for entry in manifest.collect():
        name = entry["name"]
        if name.startswith("/") or ".." in name.split("/") or ":" in name:
            problems.append((name, "path"))
            continue
        try:
            df = read(name)
        except AnalysisException:
            problems.append((name, "unreadable"))
            continue
        if ",".join(df.columns) != entry["columns"]:
            problems.append((name, "columns"))
            continue
        got = population_hash(df, df.columns).first()
        if got["rows"] != entry["rows"]:
            problems.append((name, "rows"))
        elif got["hash"] != entry["hash"]:
            problems.append((name, "hash"))
    return spark.createDataFrame(problems, "name string, problem string")
