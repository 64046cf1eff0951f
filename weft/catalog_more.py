"""Queries of smaller operators: queues, identities, routing, reviews, gates; importing this adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import H2, _matched, query, t
from .functions import hashing, text
from .operators import protect, state
from .operators import transactions as tx
from .plans import planner
from .sources import discovery
from .streaming import queue


def _entries(spark, sf):
    o = t(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing")
    return o.select((F.col("o_custkey") % 40).alias("repository_id"), F.col("o_orderkey").cast("string").alias("key"), status.alias("status"), (F.col("o_totalprice") % 1000).cast("long").alias("available_at"))


QUEUED = "q AS (SELECT o_custkey % 40 AS repository_id, o_orderkey::VARCHAR AS key, floor(o_totalprice % 1000)::BIGINT AS available_at FROM orders WHERE o_orderstatus = 'O')"


@query(f"WITH {QUEUED} SELECT repository_id, key, available_at FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY available_at, key) AS n FROM q WHERE available_at <= 500) WHERE n = 1")
def queue_due(spark, sf):
    return queue.due(_entries(spark, sf), 500, ["repository_id"]).select("repository_id", "key", "available_at")


@query(f"WITH {QUEUED} SELECT key, available_at FROM q WHERE available_at <= 500 ORDER BY available_at, key LIMIT 1")
def queue_next(spark, sf):
    return queue.due(_entries(spark, sf), 500).select("key", "available_at")


@query("""WITH r AS (SELECT user_id % 30 AS external_id, event_type AS state, event_id % 500 AS event_key, event_id AS tm FROM events),
l AS (SELECT *, lag(state) OVER (PARTITION BY external_id ORDER BY tm, event_key::VARCHAR) AS before FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY external_id, event_key ORDER BY tm) AS rn, count(*) OVER (PARTITION BY external_id, event_key) AS c FROM l)
SELECT external_id::VARCHAR AS external_id, event_key::VARCHAR AS event_key, coalesce(before, 'none') AS from_state, state AS to_state FROM n WHERE c = 1 AND NOT (external_id % 3 = 0 AND event_key % 4 = 0)""")
def pull_request_events(spark, sf):
    """Events of keys that come once; those that are stored are left alone."""
    e, ext, key = t(spark, sf, "events"), (F.col("user_id") % 30).cast("string"), (F.col("event_id") % 500).cast("string")
    asked = e.select(F.lit(1).cast("long").alias("repository_id"), F.lit("g").alias("provider"), ext.alias("external_id"), F.lit("c").alias("head_revision"), F.col("event_type").alias("state"), key.alias("event_key"), F.col("event_id").alias("at"))
    pulls = spark.range(30).select(F.lit(1).cast("long").alias("repository_id"), F.lit("g").alias("provider"), F.col("id").cast("string").alias("external_id"), F.lit("c").alias("head_revision"), F.lit("none").alias("state"), F.lit(0).cast("long").alias("at"))
    known = spark.range(0, 30, 3).crossJoin(spark.range(0, 500, 4).withColumnRenamed("id", "k")).select(F.lit(1).cast("long").alias("repository_id"), F.lit("g").alias("provider"), F.col("id").cast("string").alias("external_id"), F.col("k").cast("string").alias("event_key"), F.lit("").alias("from_state"), F.lit("").alias("to_state"), F.lit(0).cast("long").alias("at"))
    rows = tx.record_pulls({"pull_requests": pulls, "pr_events": known}, asked)["pr_events"]
    once = asked.groupBy("external_id", "event_key").agg(F.count("*").alias("c")).filter("c = 1").drop("c")
    return rows.join(once, ["external_id", "event_key"], "left_semi").select("external_id", "event_key", "from_state", "to_state")


@query("""SELECT event_type AS stage, count(*) AS n, CASE event_type WHEN 'view' THEN 'a1' WHEN 'click' THEN 'a2' ELSE 'a3' END AS agent FROM events GROUP BY ALL""")
def agent_routing(spark, sf):
    agent = discovery.agent_for(F.col("event_type"), {"view": "a1", "click": "a2", "translate": "a3"}, "none")
    return t(spark, sf, "events").groupBy(F.col("event_type").alias("stage"), agent.alias("agent")).agg(F.count("*").alias("n"))


@query("""SELECT 'src/' || source || '/' || doc_id AS path, CASE WHEN source = 'src1' THEN doc_id::VARCHAR END AS relpath, instr(source, '1') > 0 AS has_one, length(source) - instr(reverse(source), 'r') AS last_r FROM documents""")
def relative_paths(spark, sf):
    path = F.concat_ws("/", F.lit("src"), "source", F.col("doc_id").cast("string"))
    return t(spark, sf, "documents").select(path.alias("path"), text.strip_prefix(path, "src/src1").alias("relpath"), F.col("source").contains("1").alias("has_one"), text.rfind(F.col("source"), "r").cast("long").alias("last_r"))


ROUTES = [discovery.Rule("one", ("src1/*.md",), single=True), discovery.Rule("two", ("src2/[0-9].md",), single=True), discovery.Rule("three", ("none/*",), single=True), discovery.Rule("four", ("i18n/src3/**",))]


@query("""WITH f AS (SELECT source || '/' || doc_id || '.md' AS path FROM documents), n AS (SELECT 'one' AS rule, count(*) FILTER (regexp_matches(path, '^src1/[^/]*[.]md$')) AS n FROM f UNION ALL SELECT 'two', count(*) FILTER (regexp_matches(path, '^src2/[0-9][.]md$')) FROM f UNION ALL SELECT 'three', 0)
SELECT rule, n FROM n WHERE n <> 1""")
def single_rules(spark, sf):
    files = t(spark, sf, "documents").select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"))
    return discovery.single_violations(discovery.route(files, ROUTES, strict=False), ROUTES)


@query("""SELECT 'i18n/' || source || '/' || doc_id AS target FROM documents WHERE source = 'src3'""")
def rediscovered_targets(spark, sf):
    targets = t(spark, sf, "documents").select(F.concat_ws("/", F.lit("i18n"), "source", F.col("doc_id").cast("string")).alias("target"))
    return discovery.rediscovered(targets, ROUTES)


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ' Ok ' ELSE event_type END AS output, event_id % 2 = 0 AS blocking FROM events)
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'approved' WHEN blocking THEN 'replaced' ELSE 'warned' END AS verdict, CASE WHEN event_id % 3 = 0 OR NOT blocking THEN 'text' ELSE output END AS text FROM r""")
def review_verdicts(spark, sf):
    n = F.col("event_id")
    verdict, kept = planner.review(F.when(n % 3 == 0, " Ok ").otherwise(F.col("event_type")), n % 2 == 0, F.lit("text"))
    return t(spark, sf, "events").select("event_id", verdict.alias("verdict"), kept.alias("text"))


@query(f"""SELECT c_custkey, substr(sha256(c_name), 1, 16) AS short, 'sync:' || c_custkey || ':ja:r1:p:c' AS run, 'unit-' || substr({H2("'json-pointer-v1'", "c_name", "c_mktsegment")}, 1, 24) AS pointer,
 '{{"kind":"' || c_mktsegment || '","path":"' || c_name || '"}}' AS memory, sha256('{{"c_name":"' || c_name || '","c_mktsegment":""}}') AS own FROM customer""")
def identity_functions(spark, sf):
    name, kind = F.col("c_name"), F.col("c_mktsegment")
    return t(spark, sf, "customer").select(
        "c_custkey", hashing.short_id(name).alias("short"), hashing.invocation_key(F.col("c_custkey").cast("string"), *[F.lit(x) for x in ("ja", "r1", "p", "c")]).alias("run"), hashing.json_pointer_id(name, kind).alias("pointer"),
        hashing.memory_key(path=name, kind=kind).alias("memory"), hashing.self_hash(["c_name", "c_mktsegment"], ["c_mktsegment"]).alias("own"),
    )


@query("""SELECT page_id, len(c) AS n, list_sort(c) = list_sort(d) AS same FROM (SELECT page_id, regexp_extract_all(html, '<[a-z0-9]+') AS c, regexp_extract_all(CASE WHEN page_id % 2 = 0 THEN html ELSE html || '<b' END, '<[a-z0-9]+') AS d FROM pages)""")
def multiset_equality(spark, sf):
    found = lambda c: F.regexp_extract_all(c, F.lit("<[a-z0-9]+"), F.lit(0))
    a, b = found(F.col("html")), found(F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.concat("html", F.lit("<b"))))
    return t(spark, sf, "pages").select("page_id", F.size(a).cast("long").alias("n"), protect.same_multiset(a, b).alias("same"))


@query("""SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at_utc, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6, 3) AS elapsed FROM events""")
def event_times(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return t(spark, sf, "events").select("event_id", F.unix_millis(ts).alias("ms"), text.rfc3339(ts).alias("at_utc"), text.elapsed(F.lit("2024-01-01").cast("timestamp"), ts).alias("elapsed"))


@query("""WITH n AS (SELECT user_id AS work_item, event_type AS dedupe_key, event_id AS id FROM events WHERE event_id % 2 = 1), o AS (SELECT DISTINCT user_id AS work_item, event_type AS dedupe_key FROM events WHERE event_id % 2 = 0 AND value > 8),
f AS (SELECT work_item, dedupe_key, min(id) AS id FROM n GROUP BY ALL) SELECT f.* FROM f LEFT JOIN o USING (work_item, dedupe_key) WHERE o.work_item IS NULL""")
def attempt_replay(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("work_item"), F.col("event_type").alias("dedupe_key"), F.col("event_id").alias("id"), "value")
    return state.insert_absent(e.filter("id % 2 = 0 and value > 8"), e.filter("id % 2 = 1").drop("value"), ["work_item", "dedupe_key"], "id").select("work_item", "dedupe_key", "id")


@query("""SELECT o_orderkey AS path, sha256(o_orderpriority) AS content_hash FROM orders WHERE o_orderstatus <> 'F'""")
def restored_files(spark, sf):
    """Every target that is not as it should be is put back, whatever stands there."""
    o = t(spark, sf, "orders")
    desired = o.select(F.col("o_orderkey").alias("path"), F.sha2("o_orderpriority", 256).alias("content_hash"))
    seen = o.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("path"), F.sha2(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("edited"), 256).alias("content_hash"))
    return planner.restored(desired, seen)


@query("""SELECT doc_id, 'verified' AS state FROM documents WHERE lang = 'fr'""")
def batch_gate(spark, sf):
    """A batch without an error passes whole; one with an error is empty."""
    d = t(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("lang").isin("fr", "de"), "verified").otherwise("skipped").alias("state"))
    found = spark.createDataFrame([("fr", "warning"), ("de", "error")], "lang string, severity string")
    parts = [planner.batch(d.filter(F.col("lang") == x), found.filter(F.col("lang") == x)) for x in ("fr", "de")]
    return parts[0].union(parts[1]).select("doc_id", "state")


@query("""SELECT o_custkey AS run, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS tasks FROM orders GROUP BY o_custkey""")
def restored_order(spark, sf):
    """Results that came in any order, in the order of their tasks again."""
    tasks = t(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.struct("o_orderdate", "o_orderkey").alias("ordinal"), F.col("o_orderkey").cast("string").alias("output"))
    return tasks.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "output"))), lambda x: x["output"]), ",").alias("tasks"))


@query(rf"""WITH e AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS start_at, event_type FROM events) SELECT start_at, event_type, count(*) AS n FROM e GROUP BY ALL""")
def hourly_counts(spark, sf):
    """An extra: the stream's tumbling windows over the table as a batch."""
    return t(spark, sf, "events").groupBy(F.window(F.col("ts"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start_at"), "event_type", "n")


@query("""SELECT lang, kind, count(*) AS n FROM (SELECT doc_id, lang FROM documents) d JOIN (SELECT doc_id, 'line' AS kind FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) WHERE regexp_matches(s, '\\S')) USING (doc_id) GROUP BY ALL""")
def lines_by_language(spark, sf):
    matched = _matched(spark, sf).select("doc_id", F.lit("line").alias("kind"))
    return matched.join(t(spark, sf, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang", "kind").agg(F.count("*").alias("n"))
