"""Queries of audits: replayed summaries, results looked at again, labelled samples, frozen requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import audits, classify
from tallyloom.plans.catalog import Tables, query

_TWO_OF = "({k} % {a} = 0)::INT + ({k} % {b} = 0)::INT + ({k} % {c} = 0)::INT >= 2"


@query(f"""WITH e AS (SELECT user_id, event_type, user_id % 2 AS arm, count(*) AS n, bool_or({_TWO_OF.format(k="event_id", a=3, b=4, c=5)}) AS ok FROM events GROUP BY ALL),
o AS (SELECT CASE WHEN grouping(arm) = 1 THEN 'All' ELSE arm::VARCHAR END AS arm, count(*)::DOUBLE AS items, sum(n)::DOUBLE AS occ, count(*) FILTER (ok)::DOUBLE AS tp, count(*) FILTER (NOT ok)::DOUBLE AS fp FROM e GROUP BY GROUPING SETS ((arm), ())),
l AS (SELECT (o_custkey % 2)::VARCHAR AS arm, CASE WHEN {_TWO_OF.format(k="o_orderkey", a=2, b=3, c=5)} THEN 'tradeoff' ELSE 'joint_improvement' END AS measure FROM orders),
m AS (SELECT c_custkey % 3 = 0 AS t, c_custkey % 4 < 2 AS p, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 4 END::DOUBLE AS w, c_mktsegment AS s FROM customer WHERE c_custkey % 7 > 0),
c AS (SELECT arm, coalesce(sum(x) FILTER (p AND t), 0) AS tp, coalesce(sum(x) FILTER (p AND NOT t), 0) AS fp, coalesce(sum(x) FILTER (NOT p AND t), 0) AS fn, coalesce(sum(x) FILTER (NOT p AND NOT t), 0) AS tn FROM (SELECT 'raw' AS arm, 1::DOUBLE AS x, p, t FROM m UNION ALL SELECT 'weighted', w, p, t FROM m) GROUP BY arm)
SELECT 'occurrences' AS audit, arm, unnest(['items', 'occurrences', 'true_positive', 'false_positive', 'precision']) AS measure, unnest([items, occ, tp, fp, tp / items]) AS value FROM o
UNION ALL SELECT 'labels', arm, measure, count(*)::DOUBLE FROM l GROUP BY ALL UNION ALL SELECT 'labels', 'All', measure, count(*)::DOUBLE FROM l GROUP BY ALL
UNION ALL SELECT 'sample', arm, unnest(['tp', 'fp', 'fn', 'tn', 'precision', 'recall', 'f1']), unnest([tp, fp, fn, tn, tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn)]) FROM c
UNION ALL SELECT 'sample', 'All', 'sample_n', count(*)::DOUBLE FROM customer UNION ALL SELECT 'sample', 'All', 'decided_n', count(*)::DOUBLE FROM m
UNION ALL SELECT 'sample', c_mktsegment, 'sampled', count(*)::DOUBLE FROM customer GROUP BY ALL""")
def audit_replay(t: Tables) -> DataFrame:
    """Three audits from stored votes and labels, as one table of measures."""
    k = F.col("event_id")
    votes = t.events.select("user_id", "event_type", "event_id", (F.col("user_id") % 2).alias("arm"), (k % 3 == 0).alias("a"), (k % 4 == 0).alias("b"), (k % 5 == 0).alias("c"))
    said = lambda n: F.when(F.col("o_orderkey") % n == 0, "tradeoff").otherwise("joint_improvement")
    labels = t.orders.select("o_orderkey", (F.col("o_custkey") % 2).alias("arm"), said(2).alias("a"), said(3).alias("b"), said(5).alias("c"))
    c = F.col("c_custkey")
    manual = F.when(c % 7 == 0, "uncertain").when(c % 3 == 0, "performance").otherwise("not_performance")
    even = c % 2 == 0
    sample = t.customer.select("c_custkey", manual.alias("manual"), (c % 4 < 2).alias("perf"), "c_mktsegment", F.when(even, 2.0).otherwise(4.0).alias("weight"), F.when(even, 0.5).otherwise(0.25).alias("probability"))
    return audits.replay(
        audits.occurrence_audit(votes, ["user_id", "event_type"], "event_id", "arm", ["a", "b", "c"]),
        audits.label_audit(labels, ["o_orderkey"], "arm", ["a", "b", "c"], ("tradeoff", "joint_improvement")),
        audits.sample_audit(sample, ["c_custkey"], "manual", "performance", "not_performance", "uncertain", "perf", "c_mktsegment", "weight", "probability"),
    )


@query("""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND text IS NOT NULL THEN 'classified' ELSE 'error' END AS previous_status,
coalesce(contains(replace(text, '*', ''), CASE doc_id % 3 WHEN 2 THEN 'zz' ELSE '' END || replace(substr(text, 1, 20), '*', '')), FALSE) AS ok FROM documents)
SELECT doc_id, previous_status, CASE WHEN ok THEN 'classified' ELSE 'error' END AS status, CASE WHEN NOT ok THEN 'quote' END AS problem FROM x""")
def revalidated_results(t: Tables) -> DataFrame:
    """Stored results whose quotes may differ by emphasis only, looked at again: some that had failed now hold."""
    k, start = F.col("doc_id"), F.substring("text", 1, 20)
    requests = t.documents.select("doc_id", "text", F.sha2("text", 256).alias("prompt_sha256"))
    quote = F.when(k % 3 == 0, start).when(k % 3 == 1, F.concat(F.lit("**"), start, F.lit("**"))).otherwise(F.concat(F.lit("zz"), start))
    status = F.when((k % 3 == 0) & F.col("text").isNotNull(), "classified").otherwise("error")
    stored = t.documents.select("doc_id", F.sha2("text", 256).alias("prompt_sha256"), F.concat(F.lit("D"), k % 4).alias("label"), quote.alias("quote"), status.alias("classification_status"))
    plain = lambda c: F.replace(F.col(c), F.lit("*"), F.lit(""))
    return audits.revalidate(stored, requests, ["doc_id"], ["prompt_sha256"], "classification_status", {"label": F.col("label").isin("D0", "D1", "D2", "D3"), "quote": F.contains(plain("text"), plain("quote"))})


@query("""SELECT doc_id, lang, 'P' || (doc_id % 5) AS pattern, toxic, CASE doc_id % 4 WHEN 0 THEN 'description|comments' WHEN 1 THEN 'code_diff' WHEN 2 THEN 'pipeline' ELSE '' END AS sources
FROM documents JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE toxic IS NOT NULL GROUP BY 1) USING (doc_id) WHERE doc_id % 5 > 0""")
def labelled_sample(t: Tables) -> DataFrame:
    """The labelled documents with two sets of labels and their sources by keyword; those without a pattern go."""
    k = F.col("doc_id")
    second = t.labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = t.documents.select("doc_id", F.concat(F.lit("P"), k % 5).alias("pattern"))
    loose = F.when(k % 4 == 0, "['PR Comments' 'Description']").when(k % 4 == 1, "Code diff").when(k % 4 == 2, "CI pipeline")
    rows = audits.labelled_sample(t.documents.select("doc_id", "lang"), second, "doc_id", first, second, "pattern", "toxic", "P0")
    return rows.withColumn("sources", audits.keyword_sources(loose, {"description": "description", "comment": "comments", "pipeline": "pipeline", "code diff": "code_diff"}))


@query("""WITH o AS (SELECT conv_id AS doc_id, list_sort(list(DISTINCT conv_id || ':' || turn || '=' || role)) AS ids FROM conversations GROUP BY 1)
SELECT doc_id, sha256('Text:' || chr(10) || coalesce(text, '')) AS prompt_sha256, 6 + length(coalesce(text, '')) AS prompt_chars, coalesce(len(ids), 0) AS activation_count, coalesce(array_to_string(ids, '|'), '') AS occurrence_ids
FROM documents LEFT JOIN o USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM labels)""")
def frozen_requests(t: Tables) -> DataFrame:
    """Requests for the frozen sample (the labelled documents) with their occurrences packed."""
    selected = t.labels.select("doc_id")
    frozen = t.documents.select("doc_id", "text").join(selected, "doc_id", "left_semi")
    status = t.documents.select("doc_id", F.lit("complete").alias("turns_status"))
    turns = t.conversations.select(F.col("conv_id").alias("doc_id"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("occurrence"), "role")
    prompt = F.concat(F.lit("Text:\n"), F.coalesce("text", F.lit("")))
    return audits.frozen_requests(selected, frozen, status, turns, ["doc_id"], F.col("turns_status") == "complete", "occurrence", "role", prompt, 10_000_000)


@query("SELECT CASE user_id % 5 WHEN 0 THEN 'agent' WHEN 1 THEN 'human' WHEN 2 THEN 'bot' ELSE 'unknown' END AS author_group, count(*) AS n FROM events GROUP BY 1")
def author_groups(t: Tables) -> DataFrame:
    """Events by kind of author, from loosely written labels."""
    u = F.col("user_id") % 5
    label = F.when(u == 0, " AI Agent ").when(u == 1, "Human").when(u == 2, "BOT").when(u == 3, "  ")
    return t.events.groupBy(classify.author_group(label).alias("author_group")).agg(F.count("*").alias("n"))
