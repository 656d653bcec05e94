"""Queries of evidence work: sources and sinks round trips, look-ups, manifests, quotes, claim corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import quotes, tokens
from tallyloom.functions import text as tx
from tallyloom.functions import values as vl
from tallyloom.operators import claims, classify, corrections, expect, measures, relational, votes
from tallyloom.plans.catalog import Tables, query
from tallyloom.plans.statistics import _VOTES, made_votes
from tallyloom.plans.texts import with_sentence
from tallyloom.session import Scratch
from tallyloom.sources import sinks
from tallyloom.sources.tables import conform, read_any, read_fragments

# Sources and sinks: written, read back ------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_acctbal::DOUBLE AS c_acctbal, c_acctbal / 3 AS third FROM customer")
def csv_round_trip(t: Tables) -> DataFrame:
    """A table through CSV: numbers come back bit for bit."""
    path = Scratch(t.spark, "csv").new_path("customer") + ".csv"
    df = t.customer.select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), (F.col("c_acctbal").cast("double") / 3).alias("third"))
    sinks.write_csv(df, path)
    return read_any(t.spark, path, df.schema)


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def fragment_tables(t: Tables) -> DataFrame:
    """Nested JSON documents written and read as a flat table with the document's fields in front."""
    path = Scratch(t.spark, "fragments").new_path("docs")
    record = T.StructType([T.StructField("l_linenumber", t.lineitem.schema["l_linenumber"].dataType), T.StructField("l_quantity", t.lineitem.schema["l_quantity"].dataType)])
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("lines"))
    t.orders.select("o_orderkey").join(lines, "o_orderkey").write.json(path)
    return read_fragments(t.spark, path, {"lines": record}, T.StructType([t.orders.schema["o_orderkey"]]))["lines"]


@query("SELECT CASE WHEN o_totalprice > 100000 THEN 'kept' ELSE 'excluded' END AS decision, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM orders")
def three_way_output(t: Tables) -> DataFrame:
    """Rows written by decision in one pass, and the counts that the files hold."""
    path = Scratch(t.spark, "decisions").new_path("orders")
    counts = sinks.write_decisions(t.orders.select("o_orderkey", "o_totalprice"), F.col("o_totalprice") > 100000, path)
    return t.spark.createDataFrame(list(counts.items()), "decision string, n long")


@query("SELECT n_nationkey, n_name, n_regionkey, upper(n_name) || ':' || n_regionkey AS tag FROM nation")
def appended_columns(t: Tables) -> DataFrame:
    """A table with a column appended, written whole and read back."""
    path = Scratch(t.spark, "enriched").new_path("nation")
    sinks.write_enriched(t.nation.select("n_nationkey", "n_name", "n_regionkey"), {"tag": F.concat_ws(":", F.upper("n_name"), F.col("n_regionkey").cast("string"))}, path)
    return read_any(t.spark, path + "/") if path.endswith(".parquet") else t.spark.read.parquet(path)


@query("SELECT c_custkey AS id, NULL::VARCHAR AS agent, c_acctbal::DOUBLE AS balance FROM customer")
def conformed_columns(t: Tables) -> DataFrame:
    """Columns as declared: missing ones null, others dropped, in order."""
    want = T.StructType([T.StructField("id", T.LongType()), T.StructField("agent", T.StringType()), T.StructField("balance", T.DoubleType())])
    return conform(t.customer.withColumnRenamed("c_custkey", "id").withColumnRenamed("c_acctbal", "balance"), want)


# Predicates and values ----------------------------------------------------------------------------


@query("SELECT count(*) FILTER (lower(c_mktsegment) = 'machinery') AS machinery, 0::BIGINT AS other FROM customer")
def folded_equality(t: Tables) -> DataFrame:
    """Rows equal to a value whatever the case, and of a column that isn't there."""
    a = relational.equals_folded(t.customer, "c_mktsegment", "MachinerY").agg(F.count("*").alias("machinery"))
    return a.crossJoin(relational.equals_folded(t.customer, "no_such_column", "x").agg(F.count("*").alias("other")))


@query("SELECT count(*) FILTER (c_acctbal > 0) AS kept, count(*) FILTER (NOT coalesce(c_acctbal > 0, FALSE)) AS removed FROM customer")
def split_counts(t: Tables) -> DataFrame:
    kept, removed = relational.split_rows(t.customer, F.col("c_acctbal") > 0)
    return kept.agg(F.count("*").alias("kept")).crossJoin(removed.agg(F.count("*").alias("removed")))


@query("SELECT l_orderkey, l_linenumber, l_returnflag = 'A' AND l_linestatus = 'A' AS all_a, l_linestatus = 'O' AS all_o FROM lineitem")
def all_complete(t: Tables) -> DataFrame:
    """Whether all of several columns hold one value."""
    return t.lineitem.select("l_orderkey", "l_linenumber", relational.all_equal(["l_returnflag", "l_linestatus"], "A").alias("all_a"), relational.all_equal(["l_linestatus"], "O").alias("all_o"))


@query("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN TRUE ELSE starts_with(m, 'merge ') OR contains(m, 'merge branch') OR starts_with(lower(title), 'merge ') END AS merges
FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'merge x fix y' WHEN 1 THEN 'fix y then merge branch main' ELSE 'fix y' END AS m, CASE WHEN page_id % 7 = 0 THEN 'Merge pull' ELSE 'Fix' END AS title FROM pages)""")
def merge_only_flags(t: Tables) -> DataFrame:
    """Changes that only merge: by flag, by messages, by title."""
    k = F.col("page_id")
    lit = lambda *v: F.array(*[F.lit(x) for x in v])
    messages = F.when(k % 3 == 0, lit("Merge x", "fix y")).when(k % 3 == 1, lit("fix y", "then MERGE branch main")).otherwise(lit("fix y"))
    flag, title = F.when(k % 5 == 0, "yes"), F.when(k % 7 == 0, "Merge pull").otherwise("Fix")
    return t.pages.select("page_id", classify.merge_only(flag, messages, title).alias("merges"))


@query("""SELECT page_id, path = '/dockerfile' OR starts_with(path, '/a') OR ends_with(path, '.html') OR ends_with(path, '7') AS listed FROM (SELECT page_id, lower(regexp_extract(url, '^[^:]*://[^/]*(/[^?#]*)', 1)) AS path FROM pages)""")
def path_list_flags(t: Tables) -> DataFrame:
    """Paths in a list of names, prefixes and suffixes."""
    path = F.regexp_extract("url", r"^[^:]*://[^/]*(/[^?#]*)", 1)
    return t.pages.select("page_id", classify.path_in_list(path, ["/Dockerfile"], ["/A"], [".html", "7"]).alias("listed"))


@query("SELECT c_custkey, 'org/' || lower(replace(c_name, '#', '-')) AS name FROM customer")
def repository_names(t: Tables) -> DataFrame:
    """Names parsed from addresses and from plain names."""
    plain = F.concat(F.lit("Org/"), F.replace("c_name", F.lit("#"), F.lit("-")))
    given = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("https://host.example/"), plain, F.lit(".git"))).otherwise(plain)
    return t.customer.select("c_custkey", F.lower(vl.repository_name(given)).alias("name"))


@query("SELECT doc_id, CASE WHEN a IS NULL OR b IS NULL OR a = b THEN coalesce(a, b) END AS agreed FROM (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN lang END AS a, CASE WHEN doc_id % 2 > 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END END AS b FROM documents)")
def agreed_identity(t: Tables) -> DataFrame:
    """One value from two sources; null where they differ."""
    k = F.col("doc_id")
    return t.documents.select("doc_id", vl.agreed(F.when(k % 3 > 0, F.col("lang")), F.when(k % 2 > 0, F.when(k % 5 == 0, "xx").otherwise(F.col("lang")))).alias("agreed"))


@query("SELECT event_id, CASE WHEN event_id % 4 > 0 THEN epoch_us(date_trunc('second', ts)) - CASE WHEN event_id % 4 = 1 THEN 7200000000 ELSE 0 END END AS micros FROM events")
def parsed_timestamps(t: Tables) -> DataFrame:
    """Times from text with and without zone, bad text null."""
    said = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 4
    text = F.when(k == 0, "not a time").when(k == 1, F.concat(said, F.lit("+02:00"))).when(k == 2, F.concat(said, F.lit("Z"))).otherwise(said)
    return t.events.select("event_id", F.unix_micros(vl.utc(text)).alias("micros"))


@query("SELECT n_nationkey, 'a' || n_nationkey || '|b' AS cells, 'b' AS ordered FROM nation")
def list_cells(t: Tables) -> DataFrame:
    """Lists from cells of several spellings, and members in a domain's order."""
    a = F.concat(F.lit("a"), F.col("n_nationkey").cast("string"))
    cell = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("['"), a, F.lit("', 'b']"))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit('["'), a, F.lit('","b",""]'))).otherwise(F.concat(a, F.lit(", b, ,")))
    parsed = vl.text_list(cell)
    return t.nation.select("n_nationkey", F.array_join(parsed, "|").alias("cells"), F.array_join(vl.in_domain_order(parsed, ["c", "b"]), "|").alias("ordered"))


@query("SELECT n_nationkey, to_json({'name': n_name, 'half': CASE WHEN n_regionkey > 0 THEN n_regionkey / 2 END, 'keys': [n_nationkey, n_regionkey]})::VARCHAR AS cell FROM nation")
def portable_cells(t: Tables) -> DataFrame:
    """Nested values as JSON: what isn't a finite number is null."""
    value = F.struct(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey") / 2).otherwise(F.lit(float("nan"))).alias("half"), F.array(F.col("n_nationkey").cast("int"), F.col("n_regionkey").cast("int")).alias("keys"))
    df = t.nation.select("n_nationkey", value.alias("v"))
    return df.select("n_nationkey", vl.portable(F.col("v"), df.schema["v"].dataType).alias("cell"))


@query("SELECT doc_id, trim(regexp_replace(substr(text, 3, 20), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS around FROM documents")
def text_context(t: Tables) -> DataFrame:
    """Ten characters on either side of the fourteenth, on one line (spans that begin near the start are cut there)."""
    return t.documents.select("doc_id", tx.context(F.col("text"), F.lit(12), F.lit(12), 10).alias("around"))


@query("SELECT o_orderkey, round(least(greatest(o_totalprice, lo), hi), 6) AS clipped FROM orders, (SELECT quantile_cont(o_totalprice, 0.05) AS lo, quantile_cont(o_totalprice, 0.95) AS hi FROM orders)")
def clipped_values(t: Tables) -> DataFrame:
    """Prices clipped to two quantiles."""
    return measures.clip_quantiles(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 0.05, 0.95, "clipped").select("o_orderkey", F.round("clipped", 6).alias("clipped"))


# Look-ups, binding, matching ----------------------------------------------------------------------


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def required_lookup_join(t: Tables) -> DataFrame:
    """A look-up in which a missing key would be an error."""
    table = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return expect.required_lookup(t.customer.select("c_custkey", "c_nationkey"), table, "c_nationkey").select("c_custkey", "n_name")


@query("WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer), b AS (SELECT c_name, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) SELECT c_custkey, c_name FROM a JOIN b USING (i)")
def bound_columns(t: Tables) -> DataFrame:
    """Two frames bound side by side by position."""
    right = t.customer.select("c_name", (F.col("c_custkey") * 10).alias("place"))
    return relational.bind_columns(t.customer.select("c_custkey"), right, "c_custkey", "place").drop("place")


@query("""WITH r AS (SELECT page_id, 'http://x.example/item/' || (page_id % 40) AS a, page_id % 60 AS k, page_id % 3 AS g FROM pages), p AS (SELECT n_nationkey AS id, 'http://x.example/item/' || n_nationkey AS address, n_nationkey + 20 AS number, n_nationkey % 3 AS grp FROM nation)
SELECT page_id, CASE WHEN x.id IS NOT NULL THEN 'address' WHEN y.id IS NOT NULL THEN 'keys' END AS matched_by, coalesce(x.id, y.id)::BIGINT AS id FROM r LEFT JOIN p x ON x.address = r.a LEFT JOIN p y ON y.number = r.k AND y.grp = r.g""")
def matched_results(t: Tables) -> DataFrame:
    """Search results matched to targets, by address, else by keys."""
    k = F.col("page_id")
    results = t.pages.select("page_id", F.concat(F.lit("http://x.example/item/"), (k % 40).cast("string")).alias("a"), (k % 60).alias("k"), (k % 3).alias("g"))
    n = F.col("n_nationkey").cast("long")
    targets = t.nation.select(n.alias("id"), F.concat(F.lit("http://x.example/item/"), n.cast("string")).alias("address"), (n + 20).alias("number"), (n % 3).alias("grp"))
    return classify.match_results(results, targets, "address", ["number", "grp"], F.col("a"), [F.col("k"), F.col("g")]).select("page_id", "matched_by", "target.id")


@query(f"""WITH v AS (SELECT * FROM {_VOTES}) SELECT doc_id, string_agg(voter || '=' || parent || '|' || child, '; ' ORDER BY voter) AS said FROM v GROUP BY 1 HAVING count(DISTINCT parent || '|' || child) > 1""")
def vote_mismatches(t: Tables) -> DataFrame:
    """Documents on which the voters differ, with what each said."""
    return votes.mismatches(made_votes(t), ["doc_id"], "voter", ["parent", "child"])


# Manifests, hashes, controls ----------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('../nation', 'path'), ('customer', 'rows'), ('nation', 'hash'), ('region', 'columns')) v(name, problem)")
def manifest_problems(t: Tables) -> DataFrame:
    """A manifest checked against tables of which some were changed since."""
    tables = {n: getattr(t, n) for n in ("customer", "nation", "region", "supplier")}
    manifest = expect.manifest_of(tables).unionByName(expect.manifest_of({"../nation": t.nation}))
    # Since then customers were left out, a name and a column were changed.
    changed = tables | {"customer": t.customer.filter("c_custkey > 1"), "nation": t.nation.withColumn("n_name", F.lower("n_name")), "region": t.region.withColumnRenamed("r_name", "name")}
    return expect.verify_manifest(manifest, changed.__getitem__)


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 4 THEN 'missing' WHEN n_nationkey = 25 THEN 'unexpected' ELSE 'changed' END AS problem FROM (SELECT n_nationkey FROM nation UNION ALL SELECT 25) WHERE n_nationkey IN (3, 4, 25)")
def changed_input_hashes(t: Tables) -> DataFrame:
    """Inputs whose hashes differ between two runs, and keys of one run only."""
    hashed = lambda df: df.select("n_nationkey", vl.row_hash(["n_name", "n_regionkey"]).alias("digest"))
    later = t.nation.withColumn("n_name", F.when(F.col("n_nationkey") == 3, "other").otherwise(F.col("n_name"))).filter("n_nationkey <> 4")
    more = t.nation.filter("n_nationkey = 0").withColumn("n_nationkey", F.lit(25).cast(t.nation.schema["n_nationkey"].dataType))
    return expect.differing_hashes(hashed(t.nation), hashed(later.unionByName(more)), ["n_nationkey"], "digest")


@query("SELECT event_id FROM events WHERE event_type = 'error'")
def stale_stored_hashes(t: Tables) -> DataFrame:
    """Rows whose stored hash isn't the one derived anew."""
    stored = t.events.select("event_id", "event_type", vl.order_hash("v1", F.when(F.col("event_type") == "error", "old").otherwise(F.col("event_type"))).alias("digest"))
    return expect.stale_hashes(stored, ["event_id"], "digest", vl.order_hash("v1", F.col("event_type")))


@query("SELECT 'regions' AS name, 4.0::DOUBLE AS expected, count(DISTINCT n_regionkey)::DOUBLE AS found FROM nation")
def control_totals(t: Tables) -> DataFrame:
    """Control totals that aren't met."""
    return expect.off_control(t.nation, {"nations": (F.count("*"), 25), "regions": (F.countDistinct("n_regionkey"), 4)})


@query("SELECT o_orderkey, 0::BIGINT AS parts FROM orders WHERE o_orderstatus = 'P'")
def reconciled_keys(t: Tables) -> DataFrame:
    """Keys that are not in exactly one part of a split."""
    o = t.orders.select("o_orderkey", "o_orderstatus")
    return expect.reconcile(o, [o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'")], ["o_orderkey"]).select("o_orderkey", F.col("parts").cast("long").alias("parts"))


@query("SELECT c_nationkey, count(DISTINCT c_mktsegment) AS values FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def several_inputs(t: Tables) -> DataFrame:
    """Keys whose inputs should be equal and aren't."""
    return expect.several_values(t.customer, ["c_nationkey"], "c_mktsegment")


# Quotes and claim corpora -------------------------------------------------------------------------

_LEAD = "^[A-Za-z]+ [A-Za-z]+ [A-Za-z]+"


@query(f"SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE lead END AS original, CASE WHEN doc_id % 10 = 0 THEN 'missing' END AS problem FROM (SELECT doc_id, regexp_extract(text, '{_LEAD}') AS lead FROM documents) WHERE lead <> ''")
def aligned_quotes(t: Tables) -> DataFrame:
    """First words of documents, quoted with emphasis and other spacing (a tenth of them misquoted), as they stand in the text."""
    lead = F.regexp_extract("text", _LEAD, 0)
    d = t.documents.select("doc_id", "text", lead.alias("lead")).filter("lead <> ''")
    quote = F.concat(F.lit("**"), F.replace("lead", F.lit(" "), F.lit("__ \n ")), F.when(F.col("doc_id") % 10 == 0, " @@misquoted").otherwise(""), F.lit("** "))
    records = d.select("doc_id", "text").unionByName(d.select("doc_id", F.lit("another record").alias("text")))
    return quotes.align_quotes(d.select("doc_id", quote.alias("quote")), records, ["doc_id"], "quote", "text").select("doc_id", "original", "problem")


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<![a-z][^>]*>', ' ', 'g'),
'(?i)</?(?:li|ul|ol|p|div|pre|br|table|thead|tbody|tr|td|th|details|summary)(?:[\s/][^>]*)?>', ' ', 'g'), '(?i)</?(?:code|strong|em|b|i|span|a)(?:[\s/][^>]*)?>', '', 'g'), '\*\*|__|`+', '', 'g'), '(?i)</?[a-z][a-z0-9:-]*(?:\s[^>]*|/)?>', ' ', 'g'),
'&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g')) AS rendered, 0::BIGINT AS misplaced FROM pages""")
def rendered_pages(t: Tables) -> DataFrame:
    """Pages as they are rendered, and how many of the pieces that stand for themselves aren't where the table of places says."""
    source = t.pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    met = quotes.rendered(source, "page_id", "html").withColumnRenamed("key", "page_id").join(source, "page_id")
    off = F.filter("places", lambda p: p["same"] & (F.substring("rendered", p["at"] + 1, p["end"] - p["begin"]) != F.substring("html", p["begin"] + 1, p["end"] - p["begin"])))
    return met.withColumn("misplaced", F.size(off).cast("long")).select("page_id", F.trim("rendered").alias("rendered"), "misplaced")


@query()
def page_quotes(t: Tables) -> DataFrame:
    """Ten words of each rendered page's middle, found again in the pages' sources, with the markup that stands within them."""
    words = F.split(F.trim("rendered"), " ")
    quote = F.array_join(F.slice(words, F.greatest(F.lit(1), F.floor(F.size(words) / 2)).cast("int"), 10), " ")
    asked = quotes.rendered(t.pages, "page_id", "html").select(F.col("key").alias("page_id"), quote.alias("quote")).filter("quote <> ''")
    return quotes.align_quotes(asked, t.pages.select("page_id", "html"), ["page_id"], "quote", "html", "document").select("page_id", "quote", "original", "spellings", "problem")


_SOURCES = ("description", "issue_comments", "review_comments", "commit_messages", "ci_metadata", "code_diff")


def corpus_pieces(t: Tables) -> DataFrame:
    """Documents as pieces of six sources of records."""
    k = F.col("doc_id")
    source = F.element_at(F.array(*[F.lit(s) for s in _SOURCES]), (k % 6 + 1).cast("int"))
    return t.documents.select(F.floor(k / 12).alias("record"), source.alias("source"), k.alias("place"), with_sentence("doc_id").alias("text"))


@query("""WITH p AS (SELECT doc_id // 12 AS record, ['description', 'issue_comments', 'review_comments', 'commit_messages', 'ci_metadata', 'code_diff'][doc_id % 6 + 1] AS source, length(text) + 1 + length(coalesce(['Latency dropped from 120 ms to 45 ms.', 'Throughput rose to 1,200 req/s under load.', 'Memory usage reduced by 40%.', 'This should make it 3x faster.', 'Build time went from 12 min to 5 min.', 'Overall performance improved by 15%.', 'The bundle is 250 kb smaller.'][doc_id % 8 + 1], '')) AS n FROM documents),
c AS (SELECT record, source, sum(n) + count(*) - 1 AS chars FROM p GROUP BY ALL) SELECT record, source, coalesce(chars, 0)::BIGINT AS chars FROM (SELECT DISTINCT record FROM p) CROSS JOIN (SELECT DISTINCT source FROM p) LEFT JOIN c USING (record, source)""")
def corpus_sizes(t: Tables) -> DataFrame:
    """Characters of each record's sources, 0 where one is missing."""
    p = corpus_pieces(t)
    joined = relational.join_in_order(p, ["record", "source"], "place", F.col("text"), "\n")
    return claims.corpus_sizes(joined, p.select("record").distinct(), ["record"], "source", "text")


@query()
def corpus_first_claims(t: Tables) -> DataFrame:
    """The first claim of each record, source and dimension, with its snippet."""
    return claims.corpus_claims(corpus_pieces(t), ["record"], "source", "place", "text", "code_diff")[1]


@query()
def corpus_rollup(t: Tables) -> DataFrame:
    """Each record's dimensions, with and without the diff."""
    return claims.corpus_claims(corpus_pieces(t), ["record"], "source", "place", "text", "code_diff")[0]


@query()
def claim_quotes(t: Tables) -> DataFrame:
    """Claims with their places in the raw text and the raw words between cue and quantity."""
    texts = t.documents.select("doc_id", with_sentence("doc_id").alias("text"))
    return claims.extract_claims(texts, "doc_id", "text", quotes=True).withColumnRenamed("key", "doc_id")


@query("""WITH p AS (SELECT doc_id // 12 AS record, ['description', 'issue_comments', 'review_comments', 'commit_messages', 'ci_metadata', 'code_diff'][doc_id % 6 + 1] AS source, doc_id AS place, length(text) + 1 + length(coalesce(['Latency dropped from 120 ms to 45 ms.', 'Throughput rose to 1,200 req/s under load.', 'Memory usage reduced by 40%.', 'This should make it 3x faster.', 'Build time went from 12 min to 5 min.', 'Overall performance improved by 15%.', 'The bundle is 250 kb smaller.'][doc_id % 8 + 1], '')) AS n FROM documents)
SELECT record, source, place, row_number() OVER w AS number, (sum(n + 1) OVER w - 1 - n)::BIGINT AS begin, (sum(n + 1) OVER w - 1)::BIGINT AS "end" FROM p WINDOW w AS (PARTITION BY record, source ORDER BY place)""")
def record_boundaries(t: Tables) -> DataFrame:
    """Where each record stands in its joined source."""
    return claims.record_boundaries(corpus_pieces(t), ["record"], "source", "place", "text")


@query()
def claim_records(t: Tables) -> DataFrame:
    """Cue and quantity of every claim of the corpus, by the records that they stand in."""
    return claims.claim_records(corpus_pieces(t), ["record"], "source", "place", "text").drop("claim")


@query()
def corpus_bots(t: Tables) -> DataFrame:
    """The roll-up with the texts of bots (every fifth piece) kept apart from the others."""
    pieces = corpus_pieces(t).withColumn("bot", F.col("place") % 5 == 0)
    return claims.corpus_claims(pieces, ["record", "bot"], "source", "place", "text", "code_diff")[0]


def candidate_configurations() -> dict[str, claims.Configuration]:
    """The built-in dimensions, and with candidates added one by one and together."""
    load = ({"X1": r"\b(?:load|loads|loaded)\b"}, {"X1": ["rate", "time", "pct"]})
    size = ({"X2": r"\b(?:smaller|larger|size)\b"}, {"X2": ["bytes", "pct"]})
    trend = ({"X3": r"\b(?:dropped|rose|went)\b"}, {"X3": ["from_to", "rate", "time"]})
    base = claims.DEFAULT
    all_three = base.with_dimensions(load[0] | size[0] | trend[0], load[1] | size[1] | trend[1])
    return {"built-in": base, "with load": base.with_dimensions(*load), "with size": base.with_dimensions(*size), "with trend": base.with_dimensions(*trend), "with all": all_three}


@query()
def configuration_coverage(t: Tables) -> DataFrame:
    """What dimensions of one's own add to the built-in ones, by language: five configurations, texts read once."""
    texts = t.documents.select("doc_id", "lang", with_sentence("doc_id").alias("text"))
    return claims.coverage_by(texts, "doc_id", "text", "lang", candidate_configurations(), "built-in")


_PHRASES = ("Faster build times, lower memory", "cache hit rate; I/O", "higher throughput (ILP)", "CPU cycles and cache line use", "energy cost under load", "nothing of the kind")
_EXPECTED = ("D3|D7", "D5", "D2", "D4", "D8|D9", "")


@query(f"SELECT p_partkey, {list(_EXPECTED)}[p_partkey % 6 + 1] AS expected FROM part")
def expected_dimension_labels(t: Tables) -> DataFrame:
    """The dimensions that phrases speak of, narrow phrases before broad ones."""
    phrase = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return t.part.select("p_partkey", claims.expected_dimensions(phrase).alias("expected"))


# Corrections, retries, exports --------------------------------------------------------------------

_CORRECTED = """c AS (SELECT doc_id, text, 'D' || (doc_id % 3) AS old, CASE WHEN doc_id % 28 = 0 THEN 'D9' ELSE 'D' || (doc_id % 3) END AS from_label, CASE WHEN doc_id % 20 = 0 THEN 'other' ELSE text END AS shown, CASE WHEN doc_id % 12 = 4 THEN '@@misquoted' ELSE substr(text, 1, 5) END AS quote FROM documents WHERE doc_id % 4 = 0 AND text <> ''),
j AS (SELECT doc_id, CASE WHEN from_label <> old THEN 'another label' WHEN shown <> text THEN 'no such record' WHEN NOT contains(text, quote) THEN 'no evidence' END AS problem FROM c)"""


def corrections_of(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels of documents, corrections of a quarter of them (some without their evidence), and the documents as records."""
    k = F.col("doc_id")
    d = t.documents.filter("text <> ''")
    labels = t.documents.select("doc_id", F.lit("a").alias("item"), F.concat(F.lit("D"), (k % 3).cast("string")).alias("dimension"))
    own = F.concat(F.lit("D"), (k % 3).cast("string"))
    asked = d.filter(k % 4 == 0).select(
        "doc_id", F.lit("a").alias("item"), F.when(k % 28 == 0, "D9").otherwise(own).alias("from_label"), F.lit("D7").alias("to_label"), F.lit("read anew").alias("rationale"),
        F.sha2(F.when(k % 20 == 0, "other").otherwise(F.col("text")), 256).alias("record_sha256"), F.array(F.when(k % 12 == 4, "@@misquoted").otherwise(F.substring("text", 1, 5))).alias("quotes"),
    )
    return labels, asked, d.select("doc_id", "text")


@query(f"WITH {_CORRECTED} SELECT doc_id, problem FROM j")
def judged_corrections(t: Tables) -> DataFrame:
    """What speaks against each audited correction: its label, its record by digest, its quotes."""
    labels, asked, records = corrections_of(t)
    return corrections.judged_corrections(asked, labels, records, ["doc_id"], "item", "dimension", "text", [f"D{k}" for k in range(10)]).select("doc_id", "problem")


@query(f"WITH {_CORRECTED} SELECT doc_id, CASE WHEN j.doc_id IS NOT NULL AND problem IS NULL THEN 'D7' ELSE 'D' || (doc_id % 3) END AS dimension, j.doc_id IS NOT NULL AND problem IS NULL AS corrected FROM documents LEFT JOIN j USING (doc_id)")
def corrected_labels(t: Tables) -> DataFrame:
    """Labels after the corrections that carry their evidence."""
    labels, asked, records = corrections_of(t)
    judged = corrections.judged_corrections(asked, labels, records, ["doc_id"], "item", "dimension", "text", [f"D{k}" for k in range(10)])
    return corrections.correct_labels(labels, judged, ["doc_id"], "item", "dimension").select("doc_id", "dimension", "corrected")


@query("SELECT event_id, CASE WHEN event_type = 'error' AND event_id % 2 = 0 AND event_id % 6 > 0 THEN 'view' ELSE event_type END AS event_type FROM events")
def bound_error_replacement(t: Tables) -> DataFrame:
    """Errors replaced by retries of the same input; a third of the retries were given another one."""
    base = t.events.select("event_id", "event_type", F.sha2(F.concat_ws(":", "event_id", "user_id"), 256).alias("asked"))
    k = F.col("event_id")
    retry = base.filter((k % 2 == 0) & (F.col("event_type") == "error")).select("event_id", F.lit("view").alias("event_type"), F.when(k % 6 == 0, "other").otherwise(F.col("asked")).alias("asked"))
    return corrections.replace_errors(base, retry, ["event_id"], F.col("event_type") == "error", "asked").select("event_id", "event_type")


@query("SELECT '| n_nationkey | n_name |' AS value UNION ALL SELECT '| --- | --- |' UNION ALL SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' FROM nation")
def markdown_table(t: Tables) -> DataFrame:
    """A table as lines of Markdown."""
    return sinks.markdown_lines(t.nation.select("n_nationkey", "n_name"), ["n_nationkey"])


@query(r"SELECT '\begin{tabular}{ll}' AS value UNION ALL SELECT '\hline' FROM range(3) UNION ALL SELECT 'n\_nationkey & n\_name \\' UNION ALL SELECT n_nationkey || ' & ' || replace(n_name, '_', '\_') || ' \\' FROM nation UNION ALL SELECT '\end{tabular}'")
def latex_table(t: Tables) -> DataFrame:
    """A table as lines of a LaTeX tabular."""
    return sinks.latex_lines(t.nation.select("n_nationkey", "n_name"), ["n_nationkey"])


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS arm FROM orders")
def export_projection(t: Tables) -> DataFrame:
    """A projection for export: declared columns, one row a key, known arms only, in a stable order."""
    out = t.orders.select("o_orderkey", "o_orderstatus", F.when(F.col("o_custkey") % 2 == 0, "even").otherwise("odd").alias("arm"))
    expect.require_none(expect.bad_keys(out, ["o_orderkey"]), "o_orderkey isn't a key")
    expect.require_none(out.filter(~F.col("arm").isin("even", "odd")), "unknown arms")
    return out.orderBy("arm", "o_orderkey")


@query("""WITH x AS (SELECT doc_id % 500 AS id, doc_id, CASE doc_id % 7 WHEN 0 THEN '  ' WHEN 1 THEN 'Excluded' ELSE ' ' || upper(lang) || ' ' END AS said FROM documents), k AS (SELECT *, lower(trim(said)) AS label FROM x WHERE trim(said) <> '' AND lower(trim(said)) <> 'excluded')
SELECT id, label FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id) = 1""")
def clean_labels(t: Tables) -> DataFrame:
    """Labels trimmed and lower-cased, blank and excluded ones dropped, the first of each id."""
    k = F.col("doc_id")
    said = F.when(k % 7 == 0, "  ").when(k % 7 == 1, "Excluded").otherwise(F.concat(F.lit(" "), F.upper("lang"), F.lit(" ")))
    rows = t.documents.select((k % 500).alias("id"), "doc_id", tx.label(said).alias("label")).filter("label is not null and label <> 'excluded'")
    return relational.keep_first(rows, ["id"], [F.col("doc_id")]).select("id", "label")


@query("SELECT doc_id, sha256(doc_id || chr(9) || source) AS row_sha256, sha256('Text:' || chr(10) || CASE WHEN trim(text) = '' THEN '[NONE]' ELSE regexp_replace(text, '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+|[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+$', '', 'g') END) AS prompt_sha256, sha256('v1|D0|D1') AS contract_sha256 FROM documents".replace("\\\\", "\\"))
def request_manifest(t: Tables) -> DataFrame:
    """A row for each request: the hashes of its row, its prompt and its contract."""
    return t.documents.select("doc_id", F.sha2(F.concat_ws("\t", F.col("doc_id").cast("string"), "source"), 256).alias("row_sha256"), F.sha2(tx.section("Text", F.col("text")), 256).alias("prompt_sha256"), F.sha2(F.lit("v1|D0|D1"), 256).alias("contract_sha256"))


@query("SELECT doc_id, quality AS consensus, coalesce(n, 0) AS matches FROM documents LEFT JOIN (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT conv_id AS doc_id, count(*) AS n FROM conversations GROUP BY 1) USING (doc_id)")
def review_frame(t: Tables) -> DataFrame:
    """Evidence with its consensus and the number of its matches, 0 where there are none; no row is lost."""
    consensus = relational.keep_first(t.labels, ["doc_id"], [F.col("quality")]).select("doc_id", F.col("quality").alias("consensus"))
    matches = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("matches"))
    return t.documents.select("doc_id").join(consensus, "doc_id", "left").join(matches, "doc_id", "left").na.fill(0, ["matches"])


@query("SELECT 'nation' AS name, count(*) AS rows, 'n_nationkey,n_name,n_regionkey' AS columns, TRUE AS allowed FROM nation UNION ALL SELECT 'region', count(*), 'r_regionkey,r_name', TRUE FROM region UNION ALL SELECT 'labels', count(*), 'doc_id,quality,toxic', FALSE FROM labels")
def table_inspection(t: Tables) -> DataFrame:
    """Rows and columns of tables, and whether the allowlist has them."""
    out = None
    for name in ("nation", "region", "labels"):
        df = getattr(t, name)
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(",".join(df.columns)).alias("columns"), F.lit(name in ("nation", "region", "orders")).alias("allowed"))
        out = row if out is None else out.unionByName(row)
    return out


#: A small table of merges: all bytes, and some pairs of frequent letters.
_PAIRS = "th he in er an re on at en nd the ing and ent tion ion to or is it as es ed ar te ti io de la ch ie ei un der que".split()


@query()
def truncated_texts(t: Tables) -> DataFrame:
    """Documents cut after fifty byte-pair tokens, and how many they have."""
    ranks = {bytes([k]): k for k in range(256)} | {p.encode(): 256 + k for k, p in enumerate(_PAIRS)}
    return t.documents.select("doc_id", tokens.token_counts(F.col("text"), ranks).alias("tokens"), tokens.truncate_tokens(F.col("text"), 50, ranks).alias("cut"))
