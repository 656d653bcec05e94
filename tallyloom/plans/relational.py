"""Queries of relational operators: filters, joins, aggregates, windows, sets, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.functions import values as vl
from tallyloom.operators import classify, expect, measures, sampling
from tallyloom.operators import relational as rel
from tallyloom.plans.catalog import Tables, query
from tallyloom.stats.rank import percentiles
from tallyloom.sources.tables import accept_results, month_ranges, page_requests, plan_ranges

SEED = "cohort-sample-v1"
_WEEK = "(isoyear(ts) || '-W' || lpad(week(ts)::VARCHAR, 2, '0'))"

# Sampling ----------------------------------------------------------------------------------------


def weekly_arms(t: Tables) -> tuple[DataFrame, DataFrame]:
    events = t.events.select("event_id", "user_id", "event_type", vl.iso_week(F.col("ts")).alias("stratum"))
    return events.filter("event_type = 'purchase'"), events.filter("event_type <> 'purchase'")


_MANIFEST = f"""
WITH e AS (SELECT event_id, user_id, {_WEEK} AS stratum, CASE WHEN event_type = 'purchase' THEN 'purchase' ELSE 'pool' END AS arm FROM events),
n AS (SELECT stratum, count(*) FILTER (arm = 'purchase') AS quota, count(*) FILTER (arm = 'pool') AS pool_rows FROM e GROUP BY 1),
h AS (SELECT e.*, quota, pool_rows, sha256('{SEED}' || chr(0) || user_id || chr(0) || event_id) AS selection_hash FROM e JOIN n USING (stratum)),
r AS (SELECT *, row_number() OVER (PARTITION BY arm, stratum ORDER BY selection_hash, user_id, event_id) AS selection_rank FROM h)
SELECT stratum, user_id, event_id, arm, CASE WHEN arm = 'purchase' THEN quota ELSE pool_rows END AS population, quota,
  round(CASE WHEN arm = 'purchase' THEN 1.0 ELSE least(quota, pool_rows) / pool_rows END, 9) AS inclusion, selection_hash,
  arm = 'purchase' OR selection_rank <= quota AS selected FROM r"""


@query(_MANIFEST)
def sampling_manifest(t: Tables) -> DataFrame:
    """Every event with its arm, stratum facts, hash and whether the weekly balanced sample takes it."""
    scarce, pool = weekly_arms(t)
    m = sampling.balanced_manifest(scarce, pool, ["stratum"], ["user_id", "event_id"], SEED, ("purchase", "pool"))
    return m.select("stratum", "user_id", "event_id", "arm", "population", "quota", F.round("inclusion", 9).alias("inclusion"), "selection_hash", "selected")


@query(f"SELECT stratum, user_id, event_id, arm FROM ({_MANIFEST}) WHERE selected")
def balanced_weekly_sample(t: Tables) -> DataFrame:
    """All purchases, and in each ISO week as many other events with the lowest hashes."""
    scarce, pool = weekly_arms(t)
    m = sampling.balanced_manifest(scarce, pool, ["stratum"], ["user_id", "event_id"], SEED, ("purchase", "pool"))
    return m.filter("selected").select("stratum", "user_id", "event_id", "arm")


@query(f"""WITH e AS (SELECT {_WEEK} AS stratum, event_type FROM events),
n AS (SELECT stratum, count(*) FILTER (event_type = 'purchase') AS quota, count(*) FILTER (event_type = 'view') AS pool_rows FROM e GROUP BY 1 HAVING quota + pool_rows > 0)
SELECT stratum, quota, pool_rows, round(least(quota, pool_rows) / nullif(pool_rows, 0), 9) AS inclusion, greatest(quota - pool_rows, 0) AS short FROM n""")
def sampling_shortage(t: Tables) -> DataFrame:
    """Weeks in which views alone can't match purchases."""
    scarce, _ = weekly_arms(t)
    views = t.events.filter("event_type = 'view'").select(vl.iso_week(F.col("ts")).alias("stratum"))
    return sampling.sampling_plan(scarce, views, ["stratum"]).withColumn("inclusion", F.round("inclusion", 9))


@query("""WITH o AS (SELECT o_orderpriority, o_orderkey, count(*) OVER (PARTITION BY o_orderpriority) AS population,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('audit' || chr(0) || o_orderkey), o_orderkey) AS r FROM orders),
q AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 40 WHEN '2-HIGH' THEN 30 ELSE 10 END AS quota FROM o WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW'))
SELECT o_orderpriority, o_orderkey, population, round(least(quota, population) / population, 9) AS inclusion, round(population / least(quota, population), 6) AS weight FROM q WHERE r <= quota""")
def stratified_topn_weights(t: Tables) -> DataFrame:
    """Disproportionate audit sample of orders by priority, with weights."""
    s = sampling.weighted_sample(t.orders, "o_orderpriority", {"1-URGENT": 40, "2-HIGH": 30, "5-LOW": 10}, ["o_orderkey"], "audit")
    return s.select("o_orderpriority", "o_orderkey", "population", F.round("inclusion", 9).alias("inclusion"), F.round("weight", 6).alias("weight"))


@query("""WITH e AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY sha256('arm:' || event_id), event_id) AS r FROM events)
SELECT event_type, event_id FROM e WHERE r <= 50""")
def equal_per_arm_sample(t: Tables) -> DataFrame:
    """The same number of events of each type, by lowest hash."""
    h = t.events.withColumn("h", vl.order_hash("arm", F.col("event_id"), separator=":"))
    return rel.top_per_group(h, ["event_type"], [F.col("h"), F.col("event_id")], 50).select("event_type", "event_id")


@query(f"""WITH e AS (SELECT event_id, {_WEEK} AS stratum, CASE WHEN event_type IN ('purchase', 'signup') THEN 'a' ELSE 'b' END AS arm, value < 0.4 AS broken,
  sha256('pairs' || chr(0) || event_id) AS h FROM events),
n AS (SELECT stratum, arm, count(*) FILTER (broken) AS asked FROM e GROUP BY 1, 2),
r AS (SELECT e.*, row_number() OVER (PARTITION BY e.stratum, e.arm, broken ORDER BY h DESC, event_id) AS turn FROM e)
SELECT r.event_id, r.stratum, r.arm FROM r LEFT JOIN n ON n.stratum = r.stratum AND n.arm <> r.arm WHERE NOT broken AND turn > coalesce(n.asked, 0)""")
def matched_pair_exclusion(t: Tables) -> DataFrame:
    """Each incomplete event takes an event of the other arm in its week out with it."""
    e = t.events.select("event_id", vl.iso_week(F.col("ts")).alias("stratum"), F.when(F.col("event_type").isin("purchase", "signup"), "a").otherwise("b").alias("arm"), (F.col("value") < 0.4).alias("broken"))
    e = e.withColumn("h", vl.order_hash("pairs", F.col("event_id")))
    return sampling.drop_matched_pairs(e, "stratum", "arm", "broken", "h", ["event_id"]).select("event_id", "stratum", "arm")


# Filters and classifiers -------------------------------------------------------------------------


def order_rules() -> dict:
    return {"tiny": F.col("o_totalprice") < 5000, "urgent_open": (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O"), "early": F.col("o_orderdate") < "1996-01-01", "pending": F.col("o_orderstatus") == "P"}


_REASON = "CASE WHEN o_totalprice < 5000 THEN 'tiny' WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 'urgent_open' WHEN o_orderdate < '1996-01-01' THEN 'early' WHEN o_orderstatus = 'P' THEN 'pending' END"


@query(f"SELECT o_orderkey, {_REASON} AS reason FROM orders WHERE {_REASON} IS NOT NULL")
def exclusion_cascade(t: Tables) -> DataFrame:
    """Excluded orders with the first reason that holds."""
    return classify.apply_cascade(t.orders, order_rules())[1].select("o_orderkey", "reason")


@query(f"""WITH c AS (SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM orders GROUP BY 1),
s AS (SELECT * FROM (VALUES (0, 'tiny'), (1, 'urgent_open'), (2, 'early'), (3, 'pending'), (4, 'kept')) v(step, reason)),
j AS (SELECT s.step, s.reason, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (reason))
SELECT step::BIGINT AS step, reason, n, CASE WHEN reason = 'kept' THEN n ELSE (SELECT sum(k.n) FROM j k WHERE k.step > j.step) END::BIGINT AS left_after FROM j""")
def exclusion_counts(t: Tables) -> DataFrame:
    """How many orders each rule takes, in order, and what it leaves."""
    return classify.cascade_counts(t.orders, order_rules()).withColumn("left_after", F.col("left_after").cast("long"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) < 200 THEN 'short' END, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 'digits' END,
  CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN lang <> 'en' THEN 'foreign' END], lambda x: x IS NOT NULL), '|') AS reasons FROM documents""")
def multi_reason_labels(t: Tables) -> DataFrame:
    """All reasons that hold for a document, in fixed order."""
    rules = {"short": F.length("text") < 200, "digits": F.col("text").rlike("[0-9]{4}"), "table": F.contains("text", F.lit("|")), "foreign": F.col("lang") != "en"}
    return t.documents.select("doc_id", classify.all_reasons(rules).alias("reasons"))


@query("""WITH r AS (SELECT unnest(list_filter([CASE WHEN length(text) < 200 THEN 'short' END, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 'digits' END, CASE WHEN lang <> 'en' THEN 'foreign' END], lambda x: x IS NOT NULL)) AS reason FROM documents)
SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def reason_counts(t: Tables) -> DataFrame:
    rules = {"short": F.length("text") < 200, "digits": F.col("text").rlike("[0-9]{4}"), "foreign": F.col("lang") != "en"}
    return classify.reason_histograms(t.documents.select(classify.all_reasons(rules).alias("reasons")), "reasons")[1]


_TITLES = "(SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'feat: ' WHEN 1 THEN 'Fix(core)!: ' WHEN 2 THEN 'perf ' WHEN 3 THEN 'docs(readme): ' WHEN 4 THEN 'feature ' WHEN 5 THEN 'speedup of ' ELSE '' END || p_name AS title FROM part)"


def titles(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 7
    prefix = F.when(k == 0, "feat: ").when(k == 1, "Fix(core)!: ").when(k == 2, "perf ").when(k == 3, "docs(readme): ").when(k == 4, "feature ").when(k == 5, "speedup of ").otherwise("")
    return t.part.select("p_partkey", F.concat(prefix, F.col("p_name")).alias("title"))


@query(f"""SELECT p_partkey, CASE {' '.join(f"WHEN regexp_matches(title, '^(?i:{x})([(][^)]*[)])?!?([^a-zA-Z0-9_]|$)') THEN '{x}'" for x in classify.COMMIT_TYPES)} END AS label FROM {_TITLES}""")
def conventional_title_label(t: Tables) -> DataFrame:
    """The conventional type that a title starts with."""
    return titles(t).select("p_partkey", classify.commit_type(F.col("title")).alias("label"))


@query(f"""WITH c AS (SELECT p_partkey, title, CASE {' '.join(f"WHEN regexp_matches(title, '^(?i:{x})([(][^)]*[)])?!?:') THEN '{x}'" for x in classify.COMMIT_TYPES)} END AS prefix,
  regexp_matches(lower(title), '\\bperf(ormance)?\\b|\\boptimi[sz]|\\bspeed\\s?up\\b|\\blatency\\b|\\bfaster\\b') AS words FROM {_TITLES})
SELECT p_partkey, CASE WHEN prefix IS NOT NULL THEN prefix WHEN words THEN 'perf' ELSE 'other' END AS type,
  CASE WHEN prefix IS NOT NULL THEN 1.0 WHEN words THEN 0.65 ELSE 0.3 END::DOUBLE AS confidence, CASE WHEN prefix IS NOT NULL THEN 'prefix' WHEN words THEN 'keyword' ELSE 'default' END AS reason FROM c""")
def task_type_label(t: Tables) -> DataFrame:
    """Type, confidence and reason from prefix, keyword or default."""
    return titles(t).select("p_partkey", classify.task_type(F.col("title"), F.lit("")).alias("x")).select("p_partkey", "x.*")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'filled' ELSE 'given' END AS status_method, CASE WHEN o_orderstatus = 'P' THEN 'default' ELSE o_orderstatus END AS status FROM orders""")
def fill_missing_labels(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"))
    return classify.fill_missing(o, "status", F.lit("default"), "filled").select("o_orderkey", "status_method", "status")


@query("""WITH n AS (SELECT source, count(*) AS c FROM documents GROUP BY 1)
SELECT CASE WHEN c < 52 THEN 'Other' ELSE d.source END AS source, count(*) AS n FROM documents d JOIN n USING (source) GROUP BY 1""")
def fold_rare_sources(t: Tables) -> DataFrame:
    return rel.fold_rare(t.documents.select("source"), "source", 52).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal >= 5000")
def numeric_floor(t: Tables) -> DataFrame:
    return rel.at_least(t.customer, "c_acctbal", 5000).select("c_custkey", "c_mktsegment")


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN '1997-01-01' AND '1997-06-30' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def window_and_keys(t: Tables) -> DataFrame:
    """Orders of a closed window by customers of one segment."""
    keys = rel.equals_folded(t.customer, "c_mktsegment", "machinery").select(F.col("c_custkey").alias("o_custkey"))
    return rel.in_window(t.orders, "o_orderdate", "1997-01-01", "1997-06-30", keys, "o_custkey").select("o_orderkey")


@query("SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(TIMESTAMP '2024-01-20', '%Y-%m-%d %H:%M:%S') AS window_end FROM events")
def derived_window(t: Tables) -> DataFrame:
    w = rel.time_bounds(t.events, "ts", end="2024-01-20")
    return w.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in w.columns])


# Joins -------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS b FROM pages),
c AS (SELECT page_id, lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) || substr(b, length(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) + 1) AS address FROM n)
SELECT page_id, address FROM c""")
def url_canonical(t: Tables) -> DataFrame:
    return t.pages.select("page_id", vl.page_address(F.col("url")).alias("address"))


@query("""WITH c AS (SELECT page_id, regexp_replace(lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')), '^https?://', '') AS a FROM pages)
SELECT page_id FROM c WHERE page_id % 2 = 0 AND a NOT IN (SELECT a FROM c WHERE page_id % 2 = 1)""")
def left_anti_url(t: Tables) -> DataFrame:
    """Even pages whose address no odd page has."""
    normal = lambda c: F.regexp_replace(F.lower(vl.page_address(c)), "^https?://", "")
    even, odd = t.pages.filter("page_id % 2 = 0"), t.pages.filter("page_id % 2 = 1")
    return rel.without_known(even, odd, ["url"], ["url"], normal).select("page_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def left_semi_keys(t: Tables) -> DataFrame:
    keys = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(keys, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_pending(t: Tables) -> DataFrame:
    """Customers without an order yet."""
    return rel.pending(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, 'NEW', round(c_acctbal * 2, 2) FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey + 1000000, 'NEW', 0.0 FROM customer WHERE c_custkey < 10""")
def upsert_replace(t: Tables) -> DataFrame:
    """Customers after an upsert of changed and new ones."""
    base = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    changed = base.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment"), F.round(F.col("c_acctbal") * 2, 2).alias("c_acctbal"))
    fresh = base.filter("c_custkey < 10").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"))
    return rel.upsert(base, changed.unionByName(fresh), ["c_custkey"])


@query("""SELECT CASE WHEN l.doc_id IS NULL THEN 'left_only' WHEN d.doc_id IS NULL THEN 'right_only' ELSE 'both' END AS side, count(*) AS n
FROM (SELECT doc_id FROM documents WHERE doc_id % 3 > 0) d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def outer_indicator(t: Tables) -> DataFrame:
    joined = rel.outer_with_side(t.documents.filter("doc_id % 3 > 0").select("doc_id"), t.labels.select("doc_id"), ["doc_id"])
    return joined.groupBy("side").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(a.k, b.k) AS k, concat_ws('|', a.x, b.x) AS x FROM (SELECT n_nationkey AS k, n_name AS x FROM nation WHERE n_nationkey < 20) a
FULL JOIN (SELECT n_nationkey AS k, lower(n_name) AS x FROM nation WHERE n_nationkey > 10) b ON a.k = b.k""")
def outer_text_concat(t: Tables) -> DataFrame:
    a = t.nation.filter("n_nationkey < 20").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("x"))
    b = t.nation.filter("n_nationkey > 10").select(F.col("n_nationkey").alias("k"), F.lower("n_name").alias("x"))
    return rel.outer_text(a, b, ["k"], "x", "|")


@query("""SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def four_way_label_join(t: Tables) -> DataFrame:
    """Orders through customer and nation to region; the unique sides are checked first."""
    nation = expect.checked_join(t.nation.withColumnRenamed("n_regionkey", "r_regionkey"), t.region, ["r_regionkey"], "many_to_one")
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query("""WITH f AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders)
SELECT c_custkey, o_orderkey AS first_order FROM customer LEFT JOIN f ON c_custkey = o_custkey AND r = 1""")
def lookup_first_join(t: Tables) -> DataFrame:
    """Each customer with the first order."""
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("first_order"), "o_orderdate")
    return rel.look_up(t.customer.select("c_custkey"), orders, ["c_custkey"], [F.col("o_orderdate"), F.col("first_order")]).select("c_custkey", "first_order")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment <> 'MACHINERY' AND o.big THEN 'BIG' ELSE c_mktsegment END AS c_mktsegment
FROM customer LEFT JOIN (SELECT o_custkey, true AS big FROM orders GROUP BY 1 HAVING max(o_totalprice) > 450000) o ON o_custkey = c_custkey""")
def override_join(t: Tables) -> DataFrame:
    big = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("m")).filter("m > 450000").withColumn("better", F.lit("BIG"))
    return rel.override(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", big, ["c_custkey"], "better", F.col("c_mktsegment") == "MACHINERY")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS at FROM events WHERE event_type = 'click'), v AS (SELECT user_id, event_id AS view_id, epoch_us(ts) AS s, epoch_us(ts) + 1800000000 AS f FROM events WHERE event_type = 'view')
SELECT e.event_id, v.view_id FROM e JOIN v ON e.user_id = v.user_id AND e.at >= v.s AND e.at < v.f""")
def range_join_views(t: Tables) -> DataFrame:
    """Clicks within half an hour after a view of the same user, by bins."""
    clicks = t.events.filter("event_type = 'click'").select("user_id", "event_id", F.unix_micros("ts").alias("at"))
    views = t.events.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.unix_micros("ts").alias("s"), (F.unix_micros("ts") + 1_800_000_000).alias("f"))
    return rel.range_join(clicks, views, ["user_id"], "at", "s", "f", 1_800_000_000).select("event_id", "view_id")


# Aggregates --------------------------------------------------------------------------------------


@query("SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM documents GROUP BY 1")
def value_counts_share(t: Tables) -> DataFrame:
    return measures.value_counts(t.documents, "lang").withColumn("share", F.round("share", 9))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT l_suppkey) AS suppliers, max(l_tax) AS max_tax
FROM lineitem GROUP BY 1, 2""")
def group_summary(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("l_suppkey").alias("suppliers"), F.max("l_tax").alias("max_tax")
    )


@query("""SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS least, round(quantile_cont(o_totalprice, 0.25), 4) AS q25,
round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.75), 4) AS q75, max(o_totalprice) AS greatest FROM orders GROUP BY 1""")
def describe_prices(t: Tables) -> DataFrame:
    d = measures.describe(t.orders, ["o_orderpriority"], "o_totalprice")
    return d.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


@query("SELECT l_returnflag, round(median(l_quantity), 4) AS median, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1")
def quantiles_by_group(t: Tables) -> DataFrame:
    at = lambda k: F.round(F.get("quantiles", F.lit(k)), 4)
    middle = percentiles(t.lineitem, ["l_returnflag"], "l_quantity", (0.5,)).select("l_returnflag", at(0).alias("median"))
    tails = percentiles(t.lineitem, ["l_returnflag"], "l_extendedprice", (0.1, 0.9)).select("l_returnflag", at(0).alias("p10"), at(1).alias("p90"))
    return middle.join(tails, "l_returnflag")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE trim(text) <> '' GROUP BY 1")
def ordered_concat(t: Tables) -> DataFrame:
    """Each conversation as one text, turns in order."""
    return rel.join_in_order(t.conversations, ["conv_id"], "turn", F.concat("role", F.lit(": "), "text"))


@query("SELECT conv_id, string_agg('turn=' || turn || ' | role=' || role, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def record_render(t: Tables) -> DataFrame:
    return rel.join_in_order(t.conversations, ["conv_id"], "turn", rel.render_records(["turn", "role"]), "\n")


@query("SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ' | ' ORDER BY c_mktsegment) AS c_mktsegment FROM customer GROUP BY 1")
def distinct_joined_segments(t: Tables) -> DataFrame:
    return rel.distinct_joined(t.customer, ["c_nationkey"], "c_mktsegment")


@query("""SELECT source, count(*) AS total, l.lang AS lang, count(*) FILTER (d.lang = l.lang) AS n, round(count(*) FILTER (d.lang = l.lang) / count(*), 9) AS share
FROM documents d, (SELECT DISTINCT lang FROM documents) l GROUP BY source, l.lang""")
def label_shares_by_source(t: Tables) -> DataFrame:
    return measures.label_shares(t.documents, ["source"], "lang", ["de", "en", "es", "fr"]).withColumn("share", F.round("share", 9))


@query("""WITH b AS (SELECT l_suppkey, l_partkey, avg(l_quantity) AS q FROM lineitem WHERE l_shipdate < '1998-01-01' GROUP BY 1, 2), a AS (SELECT l_suppkey, l_partkey, avg(l_quantity) AS q FROM lineitem WHERE l_shipdate >= '1998-01-01' GROUP BY 1, 2)
SELECT b.l_suppkey, count(*) AS items, round(avg(b.q), 6) AS q_before, round(avg(a.q), 6) AS q_after, round(avg(a.q) - avg(b.q), 6) AS q_delta, round((avg(a.q) - avg(b.q)) * 100 / nullif(avg(b.q), 0), 6) AS q_percent FROM b JOIN a USING (l_suppkey, l_partkey) GROUP BY 1""")
def paired_before_after(t: Tables) -> DataFrame:
    """Mean quantities of parts that a supplier shipped in both periods."""
    mean = lambda c: t.lineitem.filter(c).groupBy("l_suppkey", "l_partkey").agg(F.avg("l_quantity").alias("q"))
    out = measures.paired_change(mean(F.col("l_shipdate") < "1998-01-01"), mean(F.col("l_shipdate") >= "1998-01-01"), ["l_suppkey"], "l_partkey", ["q"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("q_")})


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(DISTINCT turn) = 4)")
def complete_case_having(t: Tables) -> DataFrame:
    return measures.complete_cases(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], "turn", 4)


@query("""SELECT lang, count(DISTINCT d.doc_id) AS sampled, count(DISTINCT d.doc_id) FILTER (n_chars >= 500) AS eligible, count(DISTINCT d.doc_id) FILTER (n_chars >= 500 AND quality IS NOT NULL) AS labelled, count(DISTINCT d.doc_id) FILTER (n_chars >= 500 AND quality = 1) AS included
FROM documents d LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def coverage_funnel(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id", "left")
    big = F.col("n_chars") >= 500
    return measures.funnel(d, ["lang"], "doc_id", {"sampled": F.lit(True), "eligible": big, "labelled": big & F.col("quality").isNotNull(), "included": big & (F.col("quality") == 1)})


@query("""WITH u AS (SELECT user_id, least(count(*) FILTER (event_type = 'error'), 12) AS k FROM events GROUP BY 1), c AS (SELECT k AS bin, count(*) AS n FROM u GROUP BY 1)
SELECT range::INTEGER AS bin, coalesce(n, 0) AS n, round(coalesce(n / sum(n) OVER (), 0), 9) AS share FROM range(13) LEFT JOIN c ON bin = range""")
def capped_histogram(t: Tables) -> DataFrame:
    """Users by number of errors, 12 and more together."""
    users = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("k"))
    return measures.capped_histogram(users, "k", 12).withColumn("share", F.round("share", 9))


@query("""WITH x AS (SELECT quality = 1 AS p, toxic = 0 AS a, 1.0 + doc_id % 5 AS w FROM labels),
s AS (SELECT count(*) AS n, coalesce(sum(w) FILTER (p AND a), 0) AS tp, coalesce(sum(w) FILTER (p AND NOT a), 0) AS fp, coalesce(sum(w) FILTER (NOT p AND a), 0) AS fn, coalesce(sum(w) FILTER (NOT p AND NOT a), 0) AS tn FROM x)
SELECT n, tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tn::DOUBLE AS tn, round((tp / (tp + fp))::DOUBLE, 9) AS precision, round((tp / (tp + fn))::DOUBLE, 9) AS recall, round((2 * tp / (2 * tp + fp + fn))::DOUBLE, 9) AS f1 FROM s""")
def weighted_confusion(t: Tables) -> DataFrame:
    x = t.labels.select((F.col("quality") == 1).alias("p"), (F.col("toxic") == 0).alias("a"), (F.lit(1.0) + F.col("doc_id") % 5).alias("w"))
    out = measures.confusion(x, "p", "a", F.col("w"))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM c) SELECT user_id, event_type, n FROM r WHERE k = 1""")
def mode_first_seen(t: Tables) -> DataFrame:
    """Each user's most frequent event type; of equals the one seen first."""
    return measures.most_common(t.events, ["user_id"], "event_type", "event_id")


@query("""SELECT s AS o_orderstatus, count(o_orderkey) AS n FROM (VALUES ('O'), ('F'), ('P'), ('X')) v(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY 1""")
def fixed_domain_counts(t: Tables) -> DataFrame:
    return measures.fixed_counts(t.orders, "o_orderstatus", ["O", "F", "P", "X"])


@query("""SELECT role, count(*) AS requests, sum(length(text)) ::BIGINT AS tokens_in, (sum(turn))::BIGINT AS tokens_out, round((sum(length(text)) * 0.1 + sum(turn) * 0.6) / 1e6, 9) AS cost FROM conversations GROUP BY 1""")
def token_cost_rollup(t: Tables) -> DataFrame:
    c = t.conversations.select("role", F.length("text").alias("i"), F.col("turn").alias("o"))
    return measures.token_cost(c, ["role"], "i", "o", 0.1, 0.6).withColumn("cost", F.round("cost", 9))


@query("""SELECT coalesce(source, 'All') AS source, count(*) AS n, count(*) FILTER (q) AS gain, count(*) FILTER (x) AS other, count(*) FILTER (q AND x) AS both, count(*) FILTER (q AND NOT x) AS gain_only,
round(count(*) FILTER (q AND NOT x) / nullif(count(*) FILTER (q), 0), 9) AS gain_only_share FROM (SELECT source, quality = 1 AS q, toxic = 1 AS x FROM labels JOIN documents USING (doc_id)) GROUP BY GROUPING SETS ((source), ())""")
def co_reporting_rates(t: Tables) -> DataFrame:
    d = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select("source", (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("x"))
    return measures.co_reporting(d, "source", "q", "x").withColumn("gain_only_share", F.round("gain_only_share", 9))


# Windows -----------------------------------------------------------------------------------------


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS k FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey FROM r WHERE k <= 2")
def topn_per_group(t: Tables) -> DataFrame:
    top = rel.top_per_group(t.lineitem, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey")], 2)
    return top.select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey")
def keep_first_dedup(t: Tables) -> DataFrame:
    return rel.keep_first(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT DISTINCT l_returnflag, l_quantity, count(*) OVER (PARTITION BY l_returnflag, l_quantity) AS n, round(cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity), 9) AS share FROM lineitem")
def ecdf(t: Tables) -> DataFrame:
    return rel.ecdf(t.lineitem, "l_quantity", ["l_returnflag"]).withColumn("share", F.round("share", 9))


@query("SELECT DISTINCT l_quantity, count(*) OVER (PARTITION BY l_quantity) AS n, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS mid_rank FROM lineitem")
def mid_ranks(t: Tables) -> DataFrame:
    return rel.mid_ranks(t.lineitem, "l_quantity")


@query("""WITH i AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + 7200000000 AS e FROM events),
m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM i),
g AS (SELECT *, sum(CASE WHEN r IS NULL OR s >= r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS merged FROM g GROUP BY user_id, k""")
def interval_merge(t: Tables) -> DataFrame:
    """Users' activity as merged two-hour intervals."""
    i = t.events.select("user_id", F.unix_micros("ts").alias("s"), (F.unix_micros("ts") + 7_200_000_000).alias("e"))
    return rel.merge_intervals(i, ["user_id"], "s", "e")


@query(f"""WITH e AS (SELECT {_WEEK} AS stratum FROM events), s AS (SELECT stratum, dense_rank() OVER (ORDER BY stratum) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT stratum FROM e))
SELECT stratum, CASE WHEN k <= n // 2 THEN 'early' ELSE 'late' END AS half, count(*) AS n FROM e JOIN s USING (stratum) GROUP BY 1, 2""")
def window_halves(t: Tables) -> DataFrame:
    e = t.events.select(vl.iso_week(F.col("ts")).alias("stratum"))
    return rel.halves(e, "stratum").groupBy("stratum", "half").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3)::BIGINT AS batch FROM conversations")
def fixed_batches(t: Tables) -> DataFrame:
    return rel.fixed_batches(t.conversations.select("conv_id", "turn"), ["conv_id"], [F.col("turn")], 3)


@query("""WITH RECURSIVE c AS (SELECT conv_id, length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS k FROM conversations),
f AS (SELECT conv_id, k, 0 AS batch, 1 AS rows, s AS size FROM c WHERE k = 1 UNION ALL SELECT c.conv_id, c.k, CASE WHEN rows < 3 AND size + s <= 1500 THEN batch ELSE batch + 1 END, CASE WHEN rows < 3 AND size + s <= 1500 THEN rows + 1 ELSE 1 END,
CASE WHEN rows < 3 AND size + s <= 1500 THEN size + s ELSE s END FROM f JOIN c ON c.conv_id = f.conv_id AND c.k = f.k + 1) SELECT conv_id, batch::BIGINT AS batch, max(rows)::BIGINT AS rows, max(size)::BIGINT AS size FROM f GROUP BY ALL""")
def capacity_batches(t: Tables) -> DataFrame:
    """Turns packed in order into batches of at most 3 turns and 1500 characters."""
    c = t.conversations.select("conv_id", "turn", F.length("text").cast("long").alias("chars"))
    return rel.capacity_batches(c, ["conv_id"], ["turn"], "chars", 3, 1500)


@query("SELECT event_id, format('case-{:05d}', row_number() OVER (PARTITION BY event_type ORDER BY event_id)) AS case_id FROM events")
def sequential_ids(t: Tables) -> DataFrame:
    """Numbers within each type, without a task that sorts a whole type."""
    numbered = rel.numbered(t.events.select("event_id", "event_type"), ["event_type"], "event_id", "n")
    return numbered.select("event_id", F.format_string("case-%05d", "n").alias("case_id"))


# Sets, reshaping, ranges -------------------------------------------------------------------------


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left' ELSE 'right' END AS only_in FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 10 > 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def key_set_difference(t: Tables) -> DataFrame:
    return rel.key_difference(t.orders.select(F.col("o_custkey").alias("k")), t.customer.filter("c_custkey % 10 > 0").select(F.col("c_custkey").alias("k")), ["k"])


@query("SELECT k, min(s) AS source FROM (SELECT c_nationkey AS k, 'customer' AS s FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier UNION ALL SELECT n_nationkey, 'nation' FROM nation) GROUP BY 1")
def union_first_source(t: Tables) -> DataFrame:
    one = lambda df, c, s: df.select(F.col(c).alias("k"), F.lit(s).alias("source"))
    frames = [one(t.customer, "c_nationkey", "customer"), one(t.nation, "n_nationkey", "nation"), one(t.supplier, "s_nationkey", "supplier")]
    return rel.union_first(frames, ["k"], [F.col("source")])


@query("""SELECT r AS o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P", count(*) FILTER (o_orderstatus = 'X') AS "X"
FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('9-NONE')) v(r) LEFT JOIN orders ON o_orderpriority = r GROUP BY 1""")
def crosstab_counts(t: Tables) -> DataFrame:
    return rel.cross_counts(t.orders, "o_orderpriority", "o_orderstatus", ["1-URGENT", "2-HIGH", "3-MEDIUM", "9-NONE"], ["F", "O", "P", "X"])


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_returnflag)::BIGINT AS total, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 9) AS share FROM lineitem GROUP BY 1, 2""")
def crosstab_shares(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return rel.share_of(counts, "n", ["l_returnflag"]).withColumn("share", F.round("share", 9))


@query("""SELECT coalesce(o_orderstatus, 'All') AS o_orderstatus, coalesce(o_orderpriority, 'All') AS o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (1, 2)""".replace("CUBE (1, 2)", "CUBE (orders.o_orderstatus, orders.o_orderpriority)"))
def crosstab_margins(t: Tables) -> DataFrame:
    return rel.with_margins(t.orders, "o_orderstatus", "o_orderpriority")


@query("""SELECT s.event_type AS arm, u.bucket AS bucket, count(e.event_id) AS n, any_value(s.total) AS total, round(count(e.event_id) / any_value(s.total), 9) AS share
FROM (SELECT event_type, count(*) AS total FROM events GROUP BY 1) s CROSS JOIN (VALUES ('0'), ('1'), ('2'), ('7')) u(bucket)
LEFT JOIN events e ON e.event_type = s.event_type AND (e.user_id % 5)::VARCHAR = u.bucket GROUP BY 1, 2""")
def long_distribution(t: Tables) -> DataFrame:
    e = t.events.select(F.col("event_type").alias("arm"), (F.col("user_id") % 5).cast("string").alias("bucket"))
    return rel.distribution(e, "arm", "bucket", ["0", "1", "2", "7"]).withColumn("share", F.round("share", 9))


@query("""SELECT doc_id, name, value::INTEGER AS value FROM (UNPIVOT labels ON quality, toxic INTO NAME name VALUE value)""")
def unpivot_labels(t: Tables) -> DataFrame:
    return t.labels.unpivot(["doc_id"], ["quality", "toxic"], "name", "value")


@query("""SELECT coalesce(lang, 'All') AS lang, count(*) AS n, round(avg(quality), 9) AS quality_share, round(avg(toxic), 9) AS toxic_share, round(avg(CASE WHEN quality + toxic > 0 THEN 1 ELSE 0 END), 9) AS any_share, round(avg(quality + toxic), 9) AS mean_flags
FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), ())""")
def grouping_sets_profile(t: Tables) -> DataFrame:
    d = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    out = rel.profile(d, "lang", ["quality", "toxic"])
    return out.withColumns({c: F.round(c, 9) for c in ("quality_share", "toxic_share", "any_share", "mean_flags")})


@query("""WITH m AS (SELECT unnest(generate_series(DATE '2023-11-01', DATE '2024-02-01', INTERVAL 1 MONTH))::DATE AS m)
SELECT strftime(m, '%Y-%m') AS month, strftime(greatest(m, DATE '2023-11-15'), '%Y-%m-%d') AS first_day, strftime(least(last_day(m), DATE '2024-02-10'), '%Y-%m-%d') AS last_day FROM m""")
def month_range_plan(t: Tables) -> DataFrame:
    m = month_ranges(t.spark, "2023-11-15", "2024-02-10")
    return m.select("month", F.date_format("first_day", "yyyy-MM-dd").alias("first_day"), F.date_format("last_day", "yyyy-MM-dd").alias("last_day"))


@query("""WITH RECURSIVE n AS (SELECT ts::DATE AS d, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1), days AS (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM n),
c AS (SELECT d, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (ORDER BY d) AS upto FROM days LEFT JOIN n USING (d)), r AS (SELECT min(d) AS a, max(d) AS b FROM c
UNION ALL SELECT CASE s WHEN 0 THEN a ELSE (a + ((b - a) // 2 + 1)::INTEGER)::DATE END, CASE s WHEN 0 THEN (a + ((b - a) // 2)::INTEGER)::DATE ELSE b END FROM r JOIN c x ON x.d = r.a JOIN c y ON y.d = r.b, (VALUES (0), (1)) v(s) WHERE y.upto - x.upto + x.n > 1000 AND a < b)
SELECT strftime(a, '%Y-%m-%d') AS first_day, strftime(b, '%Y-%m-%d') AS last_day, (y.upto - x.upto + x.n)::BIGINT AS rows, y.upto - x.upto + x.n > 1000 AS capped FROM r JOIN c x ON x.d = r.a JOIN c y ON y.d = r.b WHERE y.upto - x.upto + x.n <= 1000 OR a = b""")
def capped_range_plan(t: Tables) -> DataFrame:
    """Days of events in ranges of at most 1000 rows."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return plan_ranges(t.events, "ts", 1000).select(day("first_day"), day("last_day"), "rows", "capped")


@query("""SELECT l_suppkey, p::INTEGER AS page, least(100, n - (p - 1) * 100)::BIGINT AS rows_on_page FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), LATERAL (SELECT unnest(range(1, (ceil(n / 100))::BIGINT + 1)) AS p)""")
def paged_listing(t: Tables) -> DataFrame:
    totals = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return page_requests(totals, "n", 100).select("l_suppkey", "page", "rows_on_page")


@query("""WITH r AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0), x AS (SELECT o_custkey AS id, bool_and(o_orderstatus = 'P') AS failed FROM orders GROUP BY 1)
SELECT CASE WHEN r.id IS NULL THEN 'unknown' WHEN x.id IS NULL THEN 'missing' WHEN failed THEN 'failed' ELSE 'completed' END AS outcome, count(*) AS n FROM r FULL JOIN x USING (id) GROUP BY 1""")
def batch_result_outcomes(t: Tables) -> DataFrame:
    """Results against requests: completed, failed, unknown and missing."""
    requested = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    results = t.orders.select(F.col("o_custkey").alias("id"), "o_orderkey", "o_orderstatus")
    parts = accept_results(results, requested, "id", F.col("o_orderstatus") == "P")
    out = None
    for name, df in parts.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("outcome"), "n")
        out = n if out is None else out.unionByName(n)
    return out.filter("n > 0")


# Scalars -----------------------------------------------------------------------------------------


@query("""SELECT doc_id, length(trim(text)) AS chars, len(regexp_extract_all(text, '[^ \t\n\r\f\x0b]+'))::BIGINT AS words, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '…' ELSE text END AS short, string_split_regex(text, '\r\n|[\n\r]')[1] AS first_line FROM documents""")
def text_metrics(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.documents.select("doc_id", F.length(F.trim(x)).cast("long").alias("chars"), tx.word_count(x).alias("words"), tx.truncate(x, 40).alias("short"), tx.first_line(x).alias("first_line"))


@query("""SELECT event_id, isoyear(ts) || '-W' || lpad(week(ts)::VARCHAR, 2, '0') AS week, strftime(ts, '%Y-%m') AS month, year(ts) || '-Q' || quarter(ts) AS quarter, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9, 6) AS hours FROM events""")
def time_keys(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.select("event_id", vl.iso_week(ts).alias("week"), vl.month(ts).alias("month"), vl.quarter(ts).alias("quarter"), F.round(vl.hours_between(F.lit("2024-01-01"), ts), 6).alias("hours"))


@query("""WITH x AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN 'n/a' WHEN 2 THEN '' WHEN 3 THEN ' TRUE ' WHEN 4 THEN '-3' ELSE '2.5' END AS v FROM part)
SELECT p_partkey, try_cast(nullif(trim(v), '') AS DOUBLE) AS number, CASE WHEN try_cast(nullif(trim(v), '') AS DOUBLE) > 0 AND floor(try_cast(nullif(trim(v), '') AS DOUBLE)) = try_cast(nullif(trim(v), '') AS DOUBLE) THEN try_cast(nullif(trim(v), '') AS DOUBLE)::BIGINT END AS whole,
lower(trim(v)) IN ('true', '1', 'yes') AS truth, nullif(lower(trim(v)), '') AS label FROM x""")
def coercions(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 6
    v = F.when(k == 0, F.col("p_partkey").cast("string")).when(k == 1, "n/a").when(k == 2, "").when(k == 3, " TRUE ").when(k == 4, "-3").otherwise("2.5")
    return t.part.select("p_partkey", v.alias("v")).select("p_partkey", vl.number(F.col("v")).alias("number"), vl.positive_integer(F.col("v")).alias("whole"), vl.truth(F.col("v")).alias("truth"), tx.label(F.col("v")).alias("label"))


@query("SELECT c_custkey, sha256('c_mktsegment=''' || c_mktsegment || '''' || chr(10) || 'c_nationkey=''' || c_nationkey || '''') AS hash FROM customer")
def row_hashes(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", vl.row_hash(["c_nationkey", "c_mktsegment"]).alias("hash"))


@query("""WITH h AS (SELECT sha256(o_orderkey || chr(9) || o_custkey) AS h FROM orders), s AS (SELECT count(*) AS rows, sum(('0x' || h[1:15])::BIGINT)::VARCHAR AS a, sum(('0x' || h[16:30])::BIGINT)::VARCHAR AS b, sum(('0x' || h[31:45])::BIGINT)::VARCHAR AS c, sum(('0x' || h[46:60])::BIGINT)::VARCHAR AS d FROM h)
SELECT rows, sha256(rows || '|' || a || '|' || b || '|' || c || '|' || d) AS hash FROM s""")
def population_hash(t: Tables) -> DataFrame:
    """One order-independent hash of all order keys."""
    return expect.population_hash(t.orders, ["o_orderkey", "o_custkey"])


@query("SELECT page_id, length(html) - length(replace(html, '<li>', '')) AS x, ((length(html) - length(replace(html, '<li>', ''))) // 4)::BIGINT AS items FROM pages".replace("length(html) - length(replace(html, '<li>', '')) AS x, ", ""))
def literal_occurrences(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.occurrences(F.col("html"), F.lit("<li>")).alias("items"))


def _visible_sql(markup: str) -> str:
    """The same steps in SQL; the pattern that refers back to the tag is one for each tag."""
    steps = [("<!--.*?-->", " ", "gs"), ("<script\\b.*?</script\\s*>", " ", "gis"), ("<style\\b.*?</style\\s*>", " ", "gis"), ("<[^>]*>", " ", "gs"), ("!?\\[([^\\]]*)\\]\\([^)]*\\)", "\\1", "g"), ("[*_`~]{1,3}", "", "g"),
             ("(?m)^\\s{0,3}#{1,6}\\s+", "", "g"), ("&nbsp;", " ", "g"), ("&lt;", "<", "g"), ("&gt;", ">", "g"), ("&quot;", '"', "g"), ("&amp;", "&", "g"), ("[\\s\\x0b\\x85\\p{Z}]+", " ", "g")]
    for pattern, by, flags in steps:
        markup = f"regexp_replace({markup}, '{pattern}', '{by}', '{flags}')"
    return f"trim({markup})"


@query(f"SELECT page_id, {_visible_sql('html')} AS text FROM pages")
def visible_page_text(t: Tables) -> DataFrame:
    """The visible text of all pages."""
    return t.pages.select("page_id", tx.visible_text(F.col("html")).alias("text"))


# Expectations ------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows, 'duplicate' AS problem FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return expect.bad_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("SELECT event_type AS value, count(*) AS rows FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY 1")
def domain_violations(t: Tables) -> DataFrame:
    return expect.outside_domain(t.events, "event_type", ["view", "click", "purchase"])


@query("""WITH x AS (SELECT sum(CASE WHEN l_quantity > 0 THEN 0 ELSE 1 END) AS positive, sum(CASE WHEN l_discount <= 0.05 THEN 0 ELSE 1 END) AS small_discount FROM lineitem)
SELECT rule, rows::BIGINT AS rows FROM (UNPIVOT x ON positive, small_discount INTO NAME rule VALUE rows) WHERE rows > 0""")
def rule_violations(t: Tables) -> DataFrame:
    return expect.broken_rules(t.lineitem, {"positive": F.col("l_quantity") > 0, "small_discount": F.col("l_discount") <= 0.05})


@query("SELECT l_suppkey, count(*) FILTER (l_linestatus = 'F') AS n_0, count(*) FILTER (l_linestatus = 'O') AS n_1 FROM lineitem GROUP BY 1 HAVING n_0 <> n_1")
def unbalanced_strata(t: Tables) -> DataFrame:
    return expect.unbalanced(t.lineitem, ["l_suppkey"], "l_linestatus", ("F", "O"))
