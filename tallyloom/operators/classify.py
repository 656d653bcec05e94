"""Row classifiers: ordered cascades, multi-label reasons, prefix labels, attribution."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import clean, first_line, matches_any


def first_reason(rules: dict[str, Column]) -> Column:
    """The name of the first rule that holds, in the rules' order; null if none."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])


def all_reasons(rules: dict[str, Column], separator: str = "|") -> Column:
    """Names of all rules that hold, joined in their order; empty if none."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])), separator)


def apply_cascade(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Survivors, and the removed rows with the ``reason`` they are charged to."""
    marked = df.withColumn("reason", first_reason(rules))
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def cascade_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows charged to each rule in order, 0 included, and what is left after it."""
    spark = df.sparkSession
    counts = df.groupBy(F.coalesce(first_reason(rules), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    steps = F.broadcast(spark.createDataFrame([(n, k) for k, n in enumerate(rules)] + [("kept", len(rules))], "reason string, step long"))
    named = steps.join(counts, "reason", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    other = named.select(F.col("step").alias("later"), F.col("n").alias("m"))
    left = named.join(other, F.col("later") > F.col("step"), "left").groupBy("step", "reason", "n").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("left_after"))
    return left.select("step", "reason", "n", F.when(F.col("reason") == "kept", F.col("n")).otherwise(F.col("left_after")).alias("left_after"))


def reason_histograms(df: DataFrame, reasons: str, separator: str = "|") -> tuple[DataFrame, DataFrame]:
    """Rows by combination of reasons, and by single reason."""
    combos = df.groupBy(reasons).agg(F.count("*").alias("n"))
    single = combos.withColumn("reason", F.explode(F.split(reasons, "\\" + separator))).filter("reason <> ''")
    return combos, single.groupBy("reason").agg(F.sum("n").alias("n"))


#: Conventional-commit types in order of priority.
COMMIT_TYPES = ("feat", "fix", "perf", "docs", "style", "refactor", "test", "build", "ci", "chore", "revert", "other")


def commit_type(title: Column, types: Sequence[str] = COMMIT_TYPES) -> Column:
    """The type that a title's first line starts with: ``type``, ``type(scope)`` or ``type!``, whatever the case; null without one."""
    line = clean(first_line(title))
    return first_reason({t: line.rlike(rf"(?i)^{t}(\([^)]*\))?!?(?=\W|$)") for t in types})


def task_type(title: Column, body: Column, types: Sequence[str] = COMMIT_TYPES, keywords: Sequence[str] = (r"\bperf(ormance)?\b", r"\boptimi[sz]", r"\bspeed\s?up\b", r"\blatency\b", r"\bfaster\b")) -> Column:
    """A struct of type, confidence and reason: a prefix with colon is sure, a keyword anywhere makes it perf, else other."""
    line = clean(first_line(title))
    prefix = first_reason({t: line.rlike(rf"(?i)^{t}(\([^)]*\))?!?:") for t in types})
    words = matches_any(F.concat_ws(" ", title, body), list(keywords))
    made = lambda t, c, r: F.struct(t.alias("type"), F.lit(c).alias("confidence"), F.lit(r).alias("reason"))
    return F.when(prefix.isNotNull(), made(prefix, 1.0, "prefix")).when(words, made(F.lit("perf"), 0.65, "keyword")).otherwise(made(F.lit("other"), 0.3, "default"))


def fill_missing(df: DataFrame, column: str, value: Column, method: str) -> DataFrame:
    """Classify where nothing is known yet; ``<column>_method`` says where a value came from."""
    missing = F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) == ""
    return df.withColumn(f"{column}_method", F.when(missing, method).otherwise("given")).withColumn(column, F.when(missing, value).otherwise(F.col(column)))


def automation_author(flag: Column, kind: Column, login: Column, text: Column, names: Sequence[str], markers: Sequence[str]) -> Column:
    """Which rule says that an author is an agent: flag, name, bot or marker; null for people."""
    who = F.lower(clean(login))
    return first_reason(
        {
            "flag": F.lower(clean(flag)).isin("true", "1", "yes"),
            "name": who.isin(*[n.lower() for n in names]),
            "bot": (F.lower(clean(kind)) == "bot") & reduce(lambda a, b: a | b, [F.contains(who, F.lit(n.lower())) for n in names]),
            "marker": matches_any(text, markers),
        }
    )


def only_matching(values: Column, test) -> Column:
    """Whether an array is non-empty and every element passes; blank elements fail."""
    return (F.size(values) > 0) & F.forall(values, lambda x: F.coalesce((F.trim(x) != "") & test(x), F.lit(False)))


def none_or_blank(values: Column) -> Column:
    """Whether an array is null, empty or has a blank element."""
    return values.isNull() | (F.size(values) == 0) | F.exists(values, lambda x: x.isNull() | (F.trim(x) == ""))


def path_in_list(path: Column, names: Sequence[str] = (), prefixes: Sequence[str] = (), suffixes: Sequence[str] = ()) -> Column:
    """Whether a path, trimmed and whatever its case, is one of the names or begins or ends as listed; blank paths never."""
    p = F.lower(F.trim(F.coalesce(path, F.lit(""))))
    tests = [p.isin(*[n.lower() for n in names])] if names else []
    tests += [F.startswith(p, F.lit(x.lower())) for x in prefixes] + [F.endswith(p, F.lit(x.lower())) for x in suffixes]
    return (p != "") & reduce(lambda a, b: a | b, tests, F.lit(False))


def merge_only(flag: Column, messages: Column, title: Column) -> Column:
    """Whether a change only merges: the flag if it says so, else by the joined messages or the title that begin with "merge ", or messages with "merge branch"."""
    said = F.lower(clean(flag.cast("string"))).isin("true", "1", "yes")
    text = F.lower(F.trim(F.array_join(F.coalesce(messages, F.array().cast("array<string>")), " ")))
    name = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    found = F.startswith(text, F.lit("merge ")) | F.startswith(name, F.lit("merge ")) | F.contains(text, F.lit("merge branch"))
    return F.coalesce(said, F.lit(False)) | found


def match_results(results: DataFrame, targets: DataFrame, address: str, keys: Sequence[str], by_address: Column, by_keys: Sequence[Column]) -> DataFrame:
    """Search results with the target that they are, and how it was found.

    A result that has a target's address is that target; others are matched
    by ``by_keys`` against the target's ``keys``. ``matched_by`` is address,
    keys, ambiguous (several targets, none named) or null (no target). Targets
    are looked up by joins; rows of results are kept as they are.
    """
    told = results.withColumn("__row", F.monotonically_increasing_id()).withColumn("__address", by_address)
    named = [f"__k{k}" for k in range(len(keys))]
    told = told.select("*", *[c.alias(n) for c, n in zip(by_keys, named, strict=True)])
    one = lambda on: targets.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])).groupBy(*on).agg(F.count("*").alias("__n"), F.first(F.struct(*targets.columns)).alias("__t"))
    first = one([address]).select(F.col(address).alias("__address"), F.col("__n").alias("__n1"), F.col("__t").alias("__t1"))
    second = one(list(keys)).select(*[F.col(c).alias(n) for c, n in zip(keys, named, strict=True)], F.col("__n").alias("__n2"), F.col("__t").alias("__t2"))
    met = told.join(first, "__address", "left").join(second, named, "left")
    how = F.when(F.col("__n1") == 1, "address").when(F.col("__n1") > 1, "ambiguous").when(F.col("__n2") == 1, "keys").when(F.col("__n2") > 1, "ambiguous")
    target = F.when(F.col("__n1") == 1, F.col("__t1")).when(F.col("__n1").isNull() & (F.col("__n2") == 1), F.col("__t2"))
    return met.select(*results.columns, how.alias("matched_by"), target.alias("target"))


def attribute(rows: DataFrame, matches: DataFrame, searches: DataFrame, key: str, scope: str, created: str, rules: DataFrame, end: str) -> DataFrame:
    """Attribution of rows to agents by searches that may be incomplete.

    ``rules``: rule, agent, since. ``searches``: scope, rule, complete.
    ``matches``: key, rule. A row with a match of a rule that was in force is
    that rule's agent's (the first by rule name); without a match it is
    negative only if every rule in force was searched completely in its
    scope, else unresolved. Rows without a usable date, or after ``end``, say so.
    """
    day = F.col(created).cast("string").try_cast("date")
    base = rows.withColumn("__day", day)
    known = rules.select(F.col("rule").alias("__rule"), "agent", F.col("since").cast("date").alias("__since"))
    hits = matches.join(known, F.col("rule") == F.col("__rule")).join(base.select(key, "__day"), key).filter(F.col("__day") >= F.col("__since"))
    found = hits.groupBy(key).agg(F.min(F.struct("rule", "agent")).alias("__hit"))
    # Rules in force on a day, and those of them searched completely in a scope, are counted from their dates: rows meet one list each.
    dates = known.agg(F.collect_list("__since").alias("__all"))
    done = searches.filter("complete").select(F.col(scope).alias("__scope"), F.col("rule").alias("__rule")).distinct().join(known, "__rule").groupBy("__scope").agg(F.collect_list("__since").alias("__done"))
    joined = base.join(found, key, "left").join(done, F.col(scope) == F.col("__scope"), "left").crossJoin(F.broadcast(dates))
    in_force = lambda c: F.size(F.filter(F.coalesce(c, F.array().cast("array<date>")), lambda d: d <= F.col("__day")))
    joined = joined.withColumn("__gaps", in_force("__all") - in_force("__done"))
    status = (
        F.when(F.col("__day").isNull(), "invalid_date")
        .when(F.col("__day") > F.to_date(F.lit(end)), "outside_scope")
        .when(F.col("__hit").isNotNull(), "agent")
        .when(F.coalesce("__gaps", F.lit(0)) > 0, "unresolved")
        .otherwise("negative")
    )
    named = joined.withColumn("status", status).withColumn("agent", F.when(F.col("status") == "agent", F.col("__hit.agent"))).withColumn("rule", F.when(F.col("status") == "agent", F.col("__hit.rule")))
    return named.drop("__day", "__hit", "__gaps", "__scope", "__done", "__all")


def unique_parent(df: DataFrame, taxonomy: DataFrame, child: str, parent: str) -> DataFrame:
    """The parent that the taxonomy gives a sub-label, with ``problem``: unknown, ambiguous or null."""
    one = taxonomy.groupBy(child).agg(F.countDistinct(parent).alias("__n"), F.min(parent).alias("__parent"))
    joined = df.join(F.broadcast(one) if one.limit(10_001).count() <= 10_000 else one, child, "left")
    problem = F.when(F.col("__n").isNull(), "unknown").when(F.col("__n") > 1, "ambiguous")
    return joined.withColumn("problem", problem).withColumn(parent, F.when(F.col("__n") == 1, F.col("__parent"))).drop("__n", "__parent")


def author_group(label: Column) -> Column:
    """agent or human where a label says so (agent first), else the label trimmed and lower-cased; unknown for null and blank."""
    said = F.lower(F.trim(label.cast("string")))
    return F.when(F.coalesce(said, F.lit("")) == "", "unknown").when(F.contains(said, F.lit("agent")), "agent").when(F.contains(said, F.lit("human")), "human").otherwise(said)
