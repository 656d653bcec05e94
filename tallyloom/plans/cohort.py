"""Queries of whole cohort steps: record normalisation, quality flags, attribution, replacement, summaries, contrasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.functions import values as vl
from tallyloom.operators import classify, expect, relational
from tallyloom.plans.catalog import Tables, query
from tallyloom.sources.tables import find_column, read_table
from tallyloom.plans.statistics import LOG_CHOOSE, adjusted_sql, normal_tail_sql, wilson_sql
from tallyloom.stats import intervals, multiplicity, outcomes, rank, regression, sparse

# Scans -------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000")
def pushed_filter_scan(t: Tables) -> DataFrame:
    """Two columns of the rows of one value: both reach the Parquet scan."""
    o = read_table(t.spark, t.folder, "orders", ["o_orderkey", "o_totalprice", "o_orderpriority"])
    return o.filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 200000)).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_suppkey IN (1, 3, 7)")
def in_list_scan(t: Tables) -> DataFrame:
    return read_table(t.spark, t.folder, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_suppkey"]).filter(F.col("l_suppkey").isin(1, 3, 7)).drop("l_suppkey")


@query("SELECT lower(c_mktsegment) AS repo, count(DISTINCT c_custkey) AS targets, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 AND c_custkey % 2 = 0 GROUP BY 1")
def collected_targets(t: Tables) -> DataFrame:
    """Eligible rows gathered by lower-cased group: how many, and their sorted distinct names."""
    c = t.customer.filter("c_acctbal > 0 and c_custkey % 2 = 0").join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.lower("c_mktsegment").alias("repo")).agg(F.countDistinct("c_custkey").alias("targets"), F.array_join(F.sort_array(F.collect_set("n_name")), ",").alias("names"))


@query("""WITH r AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS key, page_id % 3 AS month FROM pages), d AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY month, page_id) AS k FROM r)
SELECT page_id, month FROM d WHERE k = 1 ORDER BY month, page_id LIMIT 50""")
def deduplicated_search(t: Tables) -> DataFrame:
    """Search results over ranges: the first of each address, and the first fifty of all."""
    bare = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", "")
    r = t.pages.select("page_id", bare.alias("key"), (F.col("page_id") % 3).alias("month"))
    return relational.keep_first(r, ["key"], [F.col("month"), F.col("page_id")]).select("page_id", "month").orderBy("month", "page_id").limit(50)


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, coalesce(json_extract_string(props, '$.name'), event_type) AS name FROM events")
def nested_record_fields(t: Tables) -> DataFrame:
    """Fields of nested records, with a fallback for a missing name."""
    p = F.from_json("props", "k long, name string")
    return t.events.select("event_id", p.alias("p"), "event_type").select("event_id", "p.k", F.coalesce("p.name", "event_type").alias("name"))


@query("SELECT c_custkey, coalesce(a.v, b.v, 'none') AS found FROM customer LEFT JOIN (SELECT o_custkey AS k, 'first' AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a ON k = c_custkey LEFT JOIN (SELECT o_custkey AS k2, 'second' AS v FROM orders GROUP BY 1) b ON k2 = c_custkey")
def cached_then_fallback(t: Tables) -> DataFrame:
    """A value from the first source, else the second; rows of neither stay."""
    a = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.lit("first").alias("a")).distinct()
    b = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.lit("second").alias("b")).distinct()
    return t.customer.select("c_custkey").join(a, "c_custkey", "left").join(b, "c_custkey", "left").select("c_custkey", F.coalesce("a", "b", F.lit("none")).alias("found"))


# Predicates and flags ----------------------------------------------------------------------------


@query("""WITH w AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts FROM conversations GROUP BY 1)
SELECT conv_id, len(list_filter(roles, lambda r: NOT starts_with(r, 'a'))) = 0 AS all_assistant, len(list_filter(texts, lambda x: trim(x) = '')) > 0 AS any_blank, starts_with(lower(array_to_string(texts, ' ')), 'the ') AS starts_the,
contains(lower(array_to_string(texts, ' ')), ' and ') AS has_and FROM w""")
def array_predicates(t: Tables) -> DataFrame:
    """Predicates over a conversation's turns as arrays."""
    w = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("x")).select("conv_id", F.transform("x", lambda s: s["role"]).alias("roles"), F.transform("x", lambda s: s["text"]).alias("texts"))
    joined = F.lower(F.array_join("texts", " "))
    return w.select("conv_id", classify.only_matching(F.col("roles"), lambda r: r.startswith("a")).alias("all_assistant"), classify.none_or_blank(F.col("texts")).alias("any_blank"), joined.startswith("the ").alias("starts_the"), F.contains(joined, F.lit(" and ")).alias("has_and"))


@query("SELECT doc_id, n_chars < 300 AS short, lang <> 'en' AS foreign_text, contains(text, 'http') AS has_link, length(trim(text)) = 0 AS blank FROM documents")
def quality_flags(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", (F.col("n_chars") < 300).alias("short"), (F.col("lang") != "en").alias("foreign_text"), F.contains("text", F.lit("http")).alias("has_link"), (F.length(F.trim("text")) == 0).alias("blank"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 20 AND (l_discount > 0.08 OR l_tax > 0.07 OR l_extendedprice > 80000)")
def compound_selector(t: Tables) -> DataFrame:
    q = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 20) & ((F.col("l_discount") > 0.08) | (F.col("l_tax") > 0.07) | (F.col("l_extendedprice") > 80000))
    return t.lineitem.filter(q).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH x AS (SELECT doc_id, quality, toxic, quality = 1 AS present, quality + toxic = 1 AS typed FROM labels)
SELECT doc_id, CASE WHEN NOT present THEN 'none' WHEN NOT typed THEN 'unresolved' ELSE 'typed' END AS type, present OR toxic = 1 AS any_flag, quality = toxic AS agree FROM x""")
def nested_conditions(t: Tables) -> DataFrame:
    """A conditional overwrite, any over flags, and whether columns agree."""
    x = t.labels.withColumn("present", F.col("quality") == 1).withColumn("typed", F.col("quality") + F.col("toxic") == 1)
    any_flag = reduce(lambda a, b: a | b, [F.col("present"), F.col("toxic") == 1])
    return x.select("doc_id", F.when(~F.col("present"), "none").when(~F.col("typed"), "unresolved").otherwise("typed").alias("type"), any_flag.alias("any_flag"), relational.one_value(["quality", "toxic"]).alias("agree"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
SELECT o_orderkey, CASE WHEN n IS NULL THEN 'open' WHEN n = o_orderdate THEN 'same_day' ELSE 'valid' END AS status, CASE WHEN n > o_orderdate THEN round((epoch_us(n) - epoch_us(o_orderdate)) / 3.6e9, 6) END AS hours, CASE WHEN n > o_orderdate THEN least(round((epoch_us(n) - epoch_us(o_orderdate)) / 3.6e9, 6), 10000) END AS capped FROM o""")
def durations_with_status(t: Tables) -> DataFrame:
    """Hours to a customer's next order where they are valid, with a status, and clipped."""
    from pyspark.sql import Window

    o = t.orders.select("o_orderkey", "o_orderdate", F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("n"))
    hours = F.when(F.col("n") > F.col("o_orderdate"), F.round(vl.hours_between(F.col("o_orderdate"), F.col("n")), 6))
    status = F.when(F.col("n").isNull(), "open").when(F.col("n") == F.col("o_orderdate"), "same_day").otherwise("valid")
    return o.select("o_orderkey", status.alias("status"), hours.alias("hours"), F.when(hours.isNotNull(), F.least(hours, F.lit(10000.0))).alias("capped"))


# Classification ----------------------------------------------------------------------------------


@query("""WITH r AS (SELECT * FROM (VALUES ('click', 'A', DATE '2024-01-03'), ('error', 'B', DATE '2024-01-10')) v(rule, agent, since)), e AS (SELECT event_id AS id, user_id % 3 AS scope, event_type, ts::DATE AS day FROM events),
h AS (SELECT e.id, min(r.rule) AS rule FROM e JOIN r ON e.event_type = r.rule AND e.day >= r.since GROUP BY 1), g AS (SELECT e.id, count(*) FILTER (NOT (e.scope < 2 OR r.rule = 'click')) AS gaps FROM e JOIN r ON e.day >= r.since GROUP BY 1)
SELECT CASE WHEN e.day > DATE '2024-01-25' THEN 'outside_scope' WHEN h.rule IS NOT NULL THEN 'agent' WHEN coalesce(g.gaps, 0) > 0 THEN 'unresolved' ELSE 'negative' END AS status, count(*) AS n FROM e LEFT JOIN h ON h.id = e.id LEFT JOIN g ON g.id = e.id GROUP BY 1""")
def attribution_status(t: Tables) -> DataFrame:
    """Attribution of events by two rules, one of which wasn't searched everywhere."""
    e = t.events.select(F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("scope"), "event_type", F.to_date("ts").cast("string").alias("day"))
    rules = t.spark.createDataFrame([("click", "A", "2024-01-03"), ("error", "B", "2024-01-10")], "rule string, agent string, since string")
    searches = t.spark.createDataFrame([(s, r, s < 2 or r == "click") for s in range(3) for r in ("click", "error")], "scope long, rule string, complete boolean")
    matches = e.filter(F.col("event_type").isin("click", "error")).select("id", F.col("event_type").alias("rule"))
    return classify.attribute(e, matches, searches, "id", "scope", "day", rules, "2024-01-25").groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'flag' WHEN lower(c_mktsegment) IN ('machinery') THEN 'name' WHEN c_custkey % 4 = 0 AND contains(lower(c_mktsegment), 'house') THEN 'bot' WHEN regexp_matches(lower(c_name), '0{4,}7') THEN 'marker' END AS why FROM customer""")
def automation_rules(t: Tables) -> DataFrame:
    """Which of an ordered set of rules says that an author is automated."""
    c = t.customer
    why = classify.first_reason({"flag": F.col("c_custkey") % 11 == 0, "name": tx.label(F.col("c_mktsegment")).isin("machinery"), "bot": (F.col("c_custkey") % 4 == 0) & F.contains(F.lower("c_mktsegment"), F.lit("house")), "marker": tx.matches_any(F.col("c_name"), ["0{4,}7"])})
    return c.select("c_custkey", why.alias("why"))


@query("""WITH x AS (SELECT p_type AS child, count(DISTINCT p_brand) AS n, min(p_brand) AS b FROM part WHERE p_size < 3 GROUP BY 1)
SELECT p.p_partkey, CASE WHEN x.n = 1 THEN b END AS brand, CASE WHEN x.n IS NULL THEN 'unknown' WHEN x.n > 1 THEN 'ambiguous' END AS problem FROM part p LEFT JOIN x ON x.child = p.p_type""")
def taxonomy_parent(t: Tables) -> DataFrame:
    tax = t.part.filter("p_size < 3").select("p_type", F.col("p_brand").alias("brand"))
    return classify.unique_parent(t.part.select("p_partkey", "p_type"), tax, "p_type", "brand").select("p_partkey", "brand", "problem")


@query("""SELECT doc_id, 'Source:' || chr(10) || source || chr(10) || chr(10) || 'Labels:' || chr(10) || coalesce('quality=' || quality, '[NONE]') AS prompt FROM documents LEFT JOIN labels USING (doc_id)""")
def rendered_prompts(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    label = F.when(F.col("quality").isNotNull(), F.concat(F.lit("quality="), F.col("quality").cast("string")))
    return d.select("doc_id", F.concat_ws("\n\n", tx.section("Source", F.col("source")), tx.section("Labels", label)).alias("prompt"))


# Sets and upserts --------------------------------------------------------------------------------


@query("SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0)) AS shared, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS without_orders")
def population_overlap(t: Tables) -> DataFrame:
    a, b = t.orders.select(F.col("o_custkey").alias("k")), t.customer.select(F.col("c_custkey").alias("k"), "c_acctbal")
    shared = a.intersect(b.filter("c_acctbal < 0").select("k")).agg(F.count("*").alias("shared"))
    return shared.crossJoin(b.select("k").exceptAll(a.distinct()).agg(F.count("*").alias("without_orders")))


@query("SELECT event_id, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'view' ELSE event_type END AS event_type FROM events")
def error_replacement(t: Tables) -> DataFrame:
    """Errors that a retry has answered are replaced; ids of the retry must be error ids."""
    base = t.events.select("event_id", "event_type")
    retry = base.filter("event_type = 'error' and event_id % 2 = 0").select("event_id", F.lit("view").alias("event_type"))
    expect.require_none(relational.pending(retry, base.filter("event_type = 'error'"), ["event_id"]), "retried rows that weren't errors")
    return relational.upsert(base, retry, ["event_id"])


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type) FILTER (event_type <> 'error'))), '|') AS types FROM events GROUP BY 1")
def row_set_algebra(t: Tables) -> DataFrame:
    """Union of a user's types without one of them."""
    g = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    return g.select("user_id", F.array_join(F.sort_array(F.array_except("s", F.array(F.lit("error")))), "|").alias("types"))


@query("SELECT doc_id, concat_ws('|', CASE WHEN quality = 1 THEN 'Q' END, CASE WHEN toxic = 1 THEN 'T' END) AS flags, quality = 1 AS q_back FROM labels")
def flags_round_trip(t: Tables) -> DataFrame:
    f = t.labels.select("doc_id", vl.flags_to_text({"Q": F.col("quality") == 1, "T": F.col("toxic") == 1}).alias("flags"))
    return f.withColumn("q_back", vl.text_to_flags(F.col("flags"), ["Q", "T"])["Q"])


@query("SELECT user_id, bool_or(event_type = 'purchase') AS bought, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def any_per_group(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("bought"), F.countDistinct("event_type").alias("kinds"))


@query("""SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS "F", round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS "O" FROM lineitem GROUP BY 1""")
def pivot_means(t: Tables) -> DataFrame:
    p = t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity"))
    return p.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("F", "O")])


@query("""WITH g AS (SELECT n_regionkey AS r, string_agg(n_name, '; ' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1) SELECT r_name || ': ' || names AS line FROM g JOIN region ON r = r_regionkey""")
def rendered_taxonomy(t: Tables) -> DataFrame:
    g = relational.join_in_order(t.nation, ["n_regionkey"], "n_nationkey", F.col("n_name"), "; ")
    return g.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("r_name", F.lit(": "), "text").alias("line"))


# Benchmark tables in text ------------------------------------------------------------------------

_ROWS = "concat_ws(chr(10), '| load' || p_size || ' | ' || p_size * 10 || ' ns | base |', '| load' || p_size || ' | ' || p_size * 8 || ' ns | current |', 'no row')"


@query(f"""WITH l AS (SELECT p_partkey, unnest(string_split({_ROWS}, chr(10))) AS line FROM part), m AS (SELECT p_partkey, regexp_extract(line, '^\\| (\\w+) \\| (\\d+) ns \\| (\\w+) \\|$', 1) AS workload, regexp_extract(line, '^\\| (\\w+) \\| (\\d+) ns \\| (\\w+) \\|$', 2) AS v, regexp_extract(line, '^\\| (\\w+) \\| (\\d+) ns \\| (\\w+) \\|$', 3) AS mode FROM l)
SELECT p_partkey, workload, max(v::BIGINT) FILTER (mode = 'base') AS base, max(v::BIGINT) FILTER (mode = 'current') AS current, round((max(v::BIGINT) FILTER (mode = 'current') - max(v::BIGINT) FILTER (mode = 'base')) * 100.0 / max(v::BIGINT) FILTER (mode = 'base'), 6) AS change FROM m WHERE workload <> '' GROUP BY 1, 2""")
def parsed_table_rows(t: Tables) -> DataFrame:
    """Rows of a text table as pairs of base and current, with the change in percent."""
    s = F.col("p_size").cast("string")
    row = lambda k, mode: F.concat(F.lit("| load"), s, F.lit(" | "), (F.col("p_size") * k).cast("string"), F.lit(f" ns | {mode} |"))
    lines = t.part.select("p_partkey", F.explode(F.split(F.concat_ws("\n", row(10, "base"), row(8, "current"), F.lit("no row")), "\n")).alias("line"))
    cell = lambda k: F.regexp_extract("line", r"^\| (\w+) \| (\d+) ns \| (\w+) \|$", k)
    m = lines.select("p_partkey", cell(1).alias("workload"), cell(2).try_cast("long").alias("v"), cell(3).alias("mode")).filter("workload <> ''")
    p = m.groupBy("p_partkey", "workload").pivot("mode", ["base", "current"]).agg(F.max("v"))
    return p.withColumn("change", F.round(vl.percent_change(F.col("base").cast("double"), F.col("current").cast("double")), 6))


# Summaries and contrasts -------------------------------------------------------------------------


_MEASURES = ("price", "lines", "quantity", "discount", "tax", "days")
_BASE = """base AS (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS arm, CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS finished, o_totalprice::DOUBLE AS price, count(*)::DOUBLE AS lines, sum(l_quantity)::DOUBLE AS quantity,
max(l_discount)::DOUBLE AS discount, max(l_tax)::DOUBLE AS tax, max(date_diff('day', o_orderdate::DATE, l_shipdate::DATE))::DOUBLE AS days, o_orderpriority FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
pops AS (SELECT *, unnest(list_filter(['all', CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END, CASE WHEN price > 100000 THEN 'large' END], lambda x: x IS NOT NULL)) AS population FROM base),
long AS (SELECT population, arm, measure, value FROM (SELECT population, arm, price, lines, quantity, discount, tax, days FROM pops) UNPIVOT (value FOR measure IN (price, lines, quantity, discount, tax, days)))"""


def order_outcomes(t: Tables) -> DataFrame:
    """Orders of two arms with whether they are finished (null where it isn't known) and six measures, once for each population that they are in."""
    days = F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    base = lines.groupBy("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"), F.max("l_tax").alias("tax"), F.max(days).alias("days"))
    population = F.array_compact(F.array(F.lit("all"), F.when(F.col("o_orderpriority") == "1-URGENT", "urgent"), F.when(F.col("o_totalprice") > 100000, "large")))
    finished = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return base.select(F.explode(population).alias("population"), F.when(F.col("o_custkey") % 2 == 0, "even").otherwise("odd").alias("arm"), finished.alias("finished"), F.col("o_totalprice").alias("price"), *_MEASURES[1:])


_PLOW, _PHIGH = wilson_sql("k", "n")


@query(f"""WITH {_BASE}, c AS (SELECT population, arm, count(*) AS rows, count(finished) AS n, count(*) FILTER (finished) AS k FROM pops GROUP BY ALL),
m AS (SELECT population, arm, measure, count(*) AS n, median(value) AS estimate FROM long GROUP BY ALL), k AS (SELECT DISTINCT n, unnest(range(0, n + 1)) AS k FROM m),
u AS (SELECT n, k, sum(exp({LOG_CHOOSE.format(n='n', k='k')} - n * ln(2))) OVER (PARTITION BY n ORDER BY k) AS upto FROM k), r AS (SELECT n, min(k) AS r FROM u WHERE upto >= 0.025 * (1 - 1e-12) GROUP BY 1),
v AS (SELECT *, row_number() OVER (PARTITION BY population, arm, measure ORDER BY value) AS i FROM long)
SELECT population, arm, 'finished' AS measure, rows, n, round(k / n, 9) AS estimate, round({_PLOW}, 9) AS low, round({_PHIGH}, 9) AS high FROM c
UNION ALL SELECT population, arm, measure, rows, m.n, round(estimate, 9), round(max(value) FILTER (i = r), 9), round(max(value) FILTER (i = m.n - r + 1), 9) FROM m JOIN r USING (n) JOIN v USING (population, arm, measure) JOIN c USING (population, arm) GROUP BY population, arm, measure, rows, m.n, estimate""")
def outcome_summary(t: Tables) -> DataFrame:
    """Seven outcomes of two arms in three populations: rate or median with its interval."""
    out = outcomes.summarise(order_outcomes(t), "arm", "finished", _MEASURES, ["population"])
    return out.withColumns({c: F.round(c, 9) for c in ("estimate", "low", "high")})


_NINE = ("p", "effect", "effect_low", "effect_high", "estimate", "estimate_low", "estimate_high", "bh")


@query(f"""WITH {_BASE}, b AS (SELECT population, count(*) FILTER (arm = 'even' AND finished)::DOUBLE AS a, count(*) FILTER (arm = 'even' AND NOT finished)::DOUBLE AS b, count(*) FILTER (arm = 'odd' AND finished)::DOUBLE AS c, count(*) FILTER (arm = 'odd' AND NOT finished)::DOUBLE AS d FROM pops GROUP BY 1),
x AS (SELECT *, (a + b + c + d) * greatest(abs(a * d - b * c) - (a + b + c + d) / 2, 0) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d)) AS x, a / (a + b) AS p1, c / (c + d) AS p0, {intervals.Z} * sqrt(a * b / (a + b) ** 3 + c * d / (c + d) ** 3) AS half FROM b),
v AS (SELECT population, measure, CASE WHEN measure = 'price' THEN floor(value / 1000) ELSE value END AS value, count(*) FILTER (arm = 'even')::DOUBLE AS a, count(*) FILTER (arm = 'odd')::DOUBLE AS b FROM long GROUP BY ALL),
w AS (SELECT *, sum(b) OVER g - b AS bb, sum(a) OVER g - a AS ab, sum(a) OVER h AS n1, sum(b) OVER h AS n2 FROM v WINDOW g AS (PARTITION BY population, measure ORDER BY value), h AS (PARTITION BY population, measure)),
s AS (SELECT population, measure, n1, n2, sum(a * (bb + b / 2)) AS u, sum((a + b) ** 3 - (a + b)) AS t, sum(a * (2 * bb + b - n2) / n2) / n1 AS d, sum(a * ((2 * bb + b - n2) / n2) ** 2) AS sa, sum(b * ((n1 - a - 2 * ab) / n1) ** 2) AS sb, sum(a * (n2 - b)) AS decided FROM w GROUP BY population, measure, n1, n2),
z AS (SELECT *, greatest((abs(u - n1 * n2 / 2.0) - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1.0)))), 0) AS z,
  greatest((n2 * n2 * (sa - n1 * d * d) + n1 * n1 * (sb - n2 * d * d) - (decided - n1 * n2 * d * d)) / (n1 * n2 * (n1 - 1) * (n2 - 1)), 0) AS v,
  greatest(1, least(n1 * n2, round_even(n1 * n2 / 2.0 - {intervals.Z} * sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0), 0))) AS low FROM s),
apart AS (SELECT e.population, e.measure, e.value - o.value AS d, sum(e.a * o.b) AS n FROM v e JOIN v o USING (population, measure) WHERE e.a > 0 AND o.b > 0 GROUP BY ALL),
upto AS (SELECT *, sum(n) OVER (PARTITION BY population, measure ORDER BY d) AS k FROM apart),
shift AS (SELECT population, measure, (min(u.d) FILTER (k >= ((n1 * n2)::BIGINT + 1) // 2) + min(u.d) FILTER (k >= (n1 * n2)::BIGINT // 2 + 1)) / 2 AS estimate, min(u.d) FILTER (k >= low) AS estimate_low, min(u.d) FILTER (k >= n1 * n2 - low + 1) AS estimate_high FROM upto u JOIN z USING (population, measure) GROUP BY population, measure),
tests AS (SELECT population, 'finished' AS measure, 'chi-square' AS method, (a + b)::BIGINT AS n1, (c + d)::BIGINT AS n2, x AS statistic, 2 * {normal_tail_sql('sqrt(x)')} AS p, sqrt(x / (a + b + c + d)) AS effect, NULL::DOUBLE AS effect_low, NULL::DOUBLE AS effect_high, p1 - p0 AS estimate, p1 - p0 - half AS estimate_low, p1 - p0 + half AS estimate_high FROM x
UNION ALL SELECT population, measure, 'mann-whitney', n1::BIGINT, n2::BIGINT, u, least(1, 2 * {normal_tail_sql('z')}), 2 * u / (n1 * n2) - 1, (d - d ** 3 - {intervals.Z} * sqrt(v) * sqrt((1 - d * d) ** 2 + {intervals.Z ** 2} * v)) / (1 - d * d + {intervals.Z ** 2} * v), (d - d ** 3 + {intervals.Z} * sqrt(v) * sqrt((1 - d * d) ** 2 + {intervals.Z ** 2} * v)) / (1 - d * d + {intervals.Z ** 2} * v), estimate, estimate_low, estimate_high FROM z JOIN shift USING (population, measure)),
i AS (SELECT *, row_number() OVER (PARTITION BY population ORDER BY p, measure) AS i, count(*) OVER (PARTITION BY population)::DOUBLE AS m FROM tests),
j AS (SELECT *, min(least(1, m / i * p)) OVER (PARTITION BY population ORDER BY p DESC, measure DESC ROWS UNBOUNDED PRECEDING) AS bh FROM i)
SELECT population, measure, method, n1, n2, round(statistic, 6) AS statistic, {', '.join(f'round({c}, 9) AS {c}' for c in _NINE)} FROM j""")
def outcome_tests(t: Tables) -> DataFrame:
    """The two arms compared on all seven outcomes (prices in thousands), with the effects' intervals and the shifts, one adjusted family in each population."""
    orders = order_outcomes(t).withColumn("price", F.floor(F.col("price") / 1000))
    out = outcomes.contrasts(orders, "arm", "even", "odd", "finished", _MEASURES, ["population"])
    return out.select("population", "measure", "method", "n1", "n2", F.round("statistic", 6).alias("statistic"), *[F.round(c, 9).alias(c) for c in _NINE])


_HYPER = f"({LOG_CHOOSE.format(n='n1', k='k')} + {LOG_CHOOSE.format(n='n0', k='(m1 - k)')} - {LOG_CHOOSE.format(n='(n1 + n0)', k='m1')})"
_L1, _H1 = wilson_sql("a", "n1")
_L0, _H0 = wilson_sql("c", "n0")
_Z = intervals.Z


@query(f"""WITH e AS (SELECT isoyear(ts) || '-W' || lpad(week(ts)::VARCHAR, 2, '0') AS w, user_id % 2 = 0 AS even, event_type = 'purchase' AS buy FROM events), r AS (SELECT w, row_number() OVER (ORDER BY w) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT w FROM e)),
t AS (SELECT CASE WHEN i <= n // 2 THEN 'early' ELSE 'late' END AS half, count(*) FILTER (even AND buy)::DOUBLE AS a, count(*) FILTER (even)::DOUBLE AS n1, count(*) FILTER (NOT even AND buy)::DOUBLE AS c, count(*) FILTER (NOT even)::DOUBLE AS n0 FROM e JOIN r USING (w) GROUP BY 1),
m AS (SELECT *, a + c AS m1, a / n1 AS p1, c / n0 AS p0, {_L1} AS l1, {_H1} AS h1, {_L0} AS l0, {_H0} AS h0, (n1 + n0) * greatest(abs(a * (n0 - c) - (n1 - a) * c) - (n1 + n0) / 2, 0) ** 2 / (n1 * n0 * (a + c) * (n1 + n0 - a - c)) AS x FROM t),
f AS (SELECT half, a, n1, n0, m1, unnest(range(greatest(0, m1 - n0)::BIGINT, least(n1, m1)::BIGINT + 1)) AS k FROM m), h AS (SELECT half, k = a AS own, {_HYPER} AS l FROM f), o AS (SELECT half, max(l) FILTER (own) + ln(1 + 1e-7) AS bound FROM h GROUP BY 1),
p AS (SELECT h.half, least(1, sum(exp(l)) FILTER (l <= bound)) AS fisher_p FROM h JOIN o USING (half) GROUP BY 1), j AS (SELECT *, row_number() OVER (ORDER BY fisher_p, half) AS i, count(*) OVER ()::DOUBLE AS k FROM m JOIN p USING (half))
SELECT half, n1, n0, round(p1, 9) AS rate1, round(p0, 9) AS rate0, round(p1 - p0, 9) AS difference, round(p1 - p0 - {_Z} * sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0), 9) AS low, round(p1 - p0 + {_Z} * sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0), 9) AS high,
round(p1 - p0 - sqrt((p1 - l1) ** 2 + (h0 - p0) ** 2), 9) AS newcombe_low, round(p1 - p0 + sqrt((h1 - p1) ** 2 + (p0 - l0) ** 2), 9) AS newcombe_high, round(x, 6) AS chi_square, round(2 * {normal_tail_sql('sqrt(x)')}, 7) AS chi_p, round(fisher_p, 7) AS fisher_p,
round(max(least(1, (k - i + 1) * fisher_p)) OVER (ORDER BY fisher_p, half ROWS UNBOUNDED PRECEDING), 7) AS holm FROM j""")
def half_window_tests(t: Tables) -> DataFrame:
    """Purchases of two arms in the early and the late half of the weeks."""
    e = t.events.select(vl.iso_week(F.col("ts")).alias("w"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("arm"), (F.col("event_type") == "purchase").alias("buy"))
    out = outcomes.period_contrasts(relational.halves(e, "w"), "half", "arm", "even", "odd", "buy")
    digits = dict.fromkeys(("rate1", "rate0", "difference", "low", "high", "newcombe_low", "newcombe_high"), 9) | {"chi_square": 6} | dict.fromkeys(("chi_p", "fisher_p", "holm"), 7)
    return out.select("half", F.col("n1").cast("double").alias("n1"), F.col("n0").cast("double").alias("n0"), *[F.round(c, d).alias(c) for c, d in digits.items()])


@query()
def interaction_test(t: Tables) -> DataFrame:
    """Whether the odds of a toxic label by quality differ between English and other texts."""
    d = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").withColumn("en", (F.col("lang") == "en").cast("int"))
    terms = {"one": F.lit(1.0), "quality": F.col("quality"), "en": F.col("en"), "both": F.col("quality") * F.col("en")}
    cells = d.groupBy("quality", "en", "toxic").count().count()
    if cells < 8:  # an empty cell has no finite estimate
        return t.spark.createDataFrame([(None, None)], "ratio_of_odds double, p double")
    full = regression.fit_logistic(d, terms, F.col("toxic"))
    small = regression.fit_logistic(d, {k: v for k, v in terms.items() if k != "both"}, F.col("toxic"))
    return t.spark.createDataFrame([(full.terms()[3]["odds_ratio"], regression.likelihood_ratio(full, small)["p"])], "ratio_of_odds double, p double")


@query(f"""WITH v AS (SELECT c_mktsegment AS segment, o_totalprice AS x, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL),
w AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY segment ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bb FROM v), s AS (SELECT segment, sum(a)::DOUBLE AS n1, sum(b)::DOUBLE AS n2, sum(a * (bb + b / 2))::DOUBLE AS u, sum((a + b) ** 3 - (a + b))::DOUBLE AS t FROM w GROUP BY 1),
z AS (SELECT *, greatest((abs(u - n1 * n2 / 2.0) - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1.0)))), 0) AS z, 2 * u / (n1 * n2) - 1 AS delta FROM s), tests AS (SELECT segment, delta, least(1, 2 * {normal_tail_sql('z')}) AS p FROM z WHERE least(n1, n2) >= 5)
SELECT segment, 'tested' AS status, round(delta, 9) AS delta, round(p, 9) AS p, round(holm, 9) AS holm, round(bh, 9) AS bh, CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS size FROM {adjusted_sql('tests', 'segment')}
UNION ALL SELECT segment, 'too few', NULL, NULL, NULL, NULL, NULL FROM s WHERE least(n1, n2) < 5""")
def category_contrasts(t: Tables) -> DataFrame:
    """Prices of finished against open orders within each segment of at least five a side, with adjusted p-values, in one grouped pass."""
    j = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey").filter("o_orderstatus in ('F', 'O')")
    own = rank.with_p(rank.mann_whitney(j, "o_orderstatus", "o_totalprice", "F", "O", ["segment"]))
    fine = F.least("n1", "n2") >= 5
    df = own.select("segment", F.when(fine, "tested").otherwise("too few").alias("status"), F.when(fine, F.col("delta")).alias("delta"), F.when(fine, F.col("p")).alias("p"), F.lit("price").alias("family"))
    out = multiplicity.adjust(df, "p", ["family"], ["segment"]).drop("family").withColumn("size", vl.magnitude(F.col("delta")))
    return out.withColumns({c: F.round(c, 9) for c in ("delta", "p", "holm", "bh")})


@query()
def expected_alignment(t: Tables) -> DataFrame:
    """Whether languages and lengths go together more than when lengths are dealt anew."""
    d = t.documents.select("lang", F.least(F.floor(F.col("n_chars") / 2000), F.lit(2)).cast("int").alias("size"))
    # Each language expects one size, in turn.
    langs = d.select("lang").distinct()
    expected = langs.select("lang", ((F.row_number().over(Window.orderBy("lang")) - 1) % 3).cast("int").alias("size"))
    out = sparse.alignment_permutation(d, "lang", "size", expected)
    return t.spark.createDataFrame([tuple(out.values())], "observed double, expected double, low double, high double, p double")


@query("""WITH x AS (SELECT source, quality = 1 AS a, quality = 1 AND toxic = 0 AS b FROM labels JOIN documents USING (doc_id)) SELECT source, count(*) AS n, count(*) FILTER (a) AS with_source, count(*) FILTER (b) AS without_source, count(*) FILTER (a <> b) AS changed FROM x GROUP BY 1""")
def sensitivity_delta(t: Tables) -> DataFrame:
    """How many flags change when one piece of evidence is left out."""
    d = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    a, b = F.col("quality") == 1, (F.col("quality") == 1) & (F.col("toxic") == 0)
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(a).alias("with_source"), F.count_if(b).alias("without_source"), F.count_if(a != b).alias("changed"))


@query("""WITH u AS (SELECT user_id % 2 AS arm, user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS buys FROM events GROUP BY 1, 2)
SELECT arm, 'errors' AS dimension, count(*) AS n, count(*) FILTER (errors > 12) AS k FROM u GROUP BY 1 UNION ALL SELECT arm, 'buys', count(*), count(*) FILTER (buys > 12) FROM u GROUP BY 1""")
def per_dimension_counts(t: Tables) -> DataFrame:
    """Incidence of several flags by arm, unpivoted into one grouped pass."""
    u = t.events.groupBy((F.col("user_id") % 2).alias("arm"), "user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("buys"))
    long = u.unpivot(["arm", "user_id"], ["errors", "buys"], "dimension", "v")
    return long.groupBy("arm", "dimension").agg(F.count("*").alias("n"), F.count_if(F.col("v") > 12).alias("k"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS files, sum(l_quantity) AS churn, round(sum(l_extendedprice), 2) AS size FROM lineitem GROUP BY 1")
def patch_rollup(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("files"), F.sum("l_quantity").alias("churn"), F.round(F.sum("l_extendedprice"), 2).alias("size"))


@query("""WITH e AS (SELECT event_id, user_id, ts, 'view' AS kind FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, user_id, ts, 'click' FROM events WHERE event_type = 'click')
SELECT user_id, event_id, kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM e""")
def merged_timeline(t: Tables) -> DataFrame:
    """Two kinds of records of each user on one timeline."""
    from pyspark.sql import Window

    one = lambda k: t.events.filter(F.col("event_type") == k).select("event_id", "user_id", "ts", F.lit(k).alias("kind"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return relational.union_all(one("view"), one("click")).select("user_id", "event_id", "kind", place.alias("place"))


@query("SELECT count(*) AS snapshots FROM (SELECT DISTINCT l_linestatus FROM lineitem WHERE l_shipdate < '1995-06-01')")
def snapshot_homogeneity(t: Tables) -> DataFrame:
    """How many values a column that should be constant has."""
    return t.lineitem.filter("l_shipdate < '1995-06-01'").agg(F.countDistinct("l_linestatus").alias("snapshots"))


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice <= 0) OR (o_orderstatus = 'P' AND o_totalprice > 490000)")
def broken_invariants(t: Tables) -> DataFrame:
    """Rows that break a rule over several columns."""
    bad = ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") <= 0)) | ((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 490000))
    return t.orders.filter(bad).select("o_orderkey")


@query("SELECT count(*) AS n FROM customer")
def resolved_column(t: Tables) -> DataFrame:
    """A count over the first column that exists among candidates."""
    key = find_column(t.customer, ["customer_id", "c_custkey"])
    return t.customer.agg(F.count(key).alias("n"))


@query("""WITH x AS (SELECT e.user_id, e.event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events e) SELECT user_id, event_id FROM x WHERE k <= 2""")
def smoke_subset(t: Tables) -> DataFrame:
    return relational.top_per_group(t.events.select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")], 2).select("user_id", "event_id")


@query("""SELECT c_nationkey, count(*) AS n, round(count(*) FILTER (c_acctbal > 0) / count(*), 9) AS share, CASE WHEN count(*) FILTER (c_acctbal > 0) * 2 > count(*) THEN 'most' ELSE 'few' END AS label FROM customer GROUP BY 1""")
def stage_summary(t: Tables) -> DataFrame:
    g = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("k"))
    return g.select("c_nationkey", "n", F.round(F.col("k") / F.col("n"), 9).alias("share"), F.when(F.col("k") * 2 > F.col("n"), "most").otherwise("few").alias("label"))


@query("""WITH b AS (SELECT n_nationkey, n_name, CASE WHEN n_nationkey = 3 THEN n_regionkey + 1.0 ELSE n_regionkey * (1 + 1e-9) END AS x FROM nation)
SELECT n_nationkey, 'x' AS "column" FROM nation JOIN b USING (n_nationkey) WHERE abs(n_regionkey - x) > 1e-7 + 1e-6 * abs(x) UNION ALL SELECT a.n_nationkey, 'n_name' FROM nation a JOIN b USING (n_nationkey) WHERE a.n_name <> b.n_name""")
def golden_comparison(t: Tables) -> DataFrame:
    """Cells that differ between a table and its copy with one value changed."""
    a = t.nation.select("n_nationkey", "n_name", F.col("n_regionkey").cast("double").alias("x"))
    b = a.withColumn("x", F.when(F.col("n_nationkey") == 3, F.col("x") + 1).otherwise(F.col("x") * (1 + 1e-9)))
    return expect.differing_cells(a, b, ["n_nationkey"])


@query(f"""WITH p AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderpriority, printf('%.1f%% [%.1f%%, %.1f%%]', round(100.0 * k / n, 1), round(100 * {_PLOW}, 1), round(100 * {_PHIGH}, 1)) AS rate FROM p""")
def described_interval(t: Tables) -> DataFrame:
    """A small printed table: rates with their intervals as text."""
    g = t.orders.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count("*").alias("n"))
    w = intervals.wilson(F.col("k"), F.col("n"))
    return g.select("o_orderpriority", F.concat(tx.format_share(F.col("k") / F.col("n")), F.lit(" ["), tx.format_share(w["low"]), F.lit(", "), tx.format_share(w["high"]), F.lit("]")).alias("rate"))


