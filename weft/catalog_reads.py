"""Queries of the named reads; importing this adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import PREVIOUS, UNITS, _previous, _states, _units, query, t
from .functions import text
from .plans import reads

STATES = "s AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'merged' WHEN '2-HIGH' THEN 'pr_open' WHEN '3-MEDIUM' THEN 'push_pending' WHEN '4-NOT SPECIFIED' THEN 'superseded' ELSE 'prepared' END AS state FROM orders)"
ATTEMPTS = """a AS (SELECT user_id AS work_item, event_id AS id, CASE WHEN event_type IN ('view', 'click') THEN 'succeeded' ELSE 'failed' END AS status, '{"output":"' || event_id % 97 || '"}' AS response, event_type AS error, event_id % 5 AS bound, event_id % 97 AS answer, value FROM events)"""


def _attempts(spark, sf):
    e, n = t(spark, sf, "events"), F.col("event_id")
    return e.select(
        F.col("user_id").alias("work_item"), n.alias("id"), F.when(F.col("event_type").isin("view", "click"), "succeeded").otherwise("failed").alias("status"),
        F.concat(F.lit('{"output":"'), (n % 97).cast("string"), F.lit('"}')).alias("response"), F.col("event_type").alias("error"), (n % 5).alias("bound"), "value",
    )


@query("""WITH v AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' AND o_totalprice > 1000 DESC, o_orderkey DESC) AS n FROM orders)
SELECT c_custkey AS unit_id, o_orderkey AS version, o_orderpriority AS text, coalesce(o_orderstatus = 'F' AND o_totalprice > 1000, false) AS trusted FROM customer LEFT JOIN v ON o_custkey = c_custkey AND n = 1""")
def unit_history(spark, sf):
    versions = t(spark, sf, "orders").select(F.col("o_custkey").alias("unit_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"), (F.col("o_totalprice") > 1000).alias("active"), (F.col("o_orderstatus") == "F").alias("trusted"))
    return reads.unit_history(t(spark, sf, "customer").select(F.col("c_custkey").alias("unit_id")), versions)


@query(f"""WITH {ATTEMPTS} SELECT work_item, id AS attempt_id, answer::VARCHAR AS output, error FROM (SELECT *, row_number() OVER (PARTITION BY work_item ORDER BY id DESC) AS n FROM a WHERE status = 'failed') WHERE n = 1""")
def failed_attempts(spark, sf):
    return reads.failed_context(_attempts(spark, sf))


@query(f"""WITH {ATTEMPTS} SELECT work_item, id, answer::VARCHAR AS output, bound = c_nationkey % 5 AS "current" FROM a JOIN customer ON c_custkey = work_item WHERE status = 'succeeded'""")
def successful_attempts(spark, sf):
    work = t(spark, sf, "customer").select(F.col("c_custkey").alias("work_item"), (F.col("c_nationkey") % 5).cast("long").alias("document"))
    return reads.successes(_attempts(spark, sf), work)


@query(f"""WITH {ATTEMPTS}, g AS (SELECT work_item AS unit_id, id AS attempt_id, answer::VARCHAR AS text FROM a WHERE status = 'succeeded' AND bound = 2 AND (id % 3 <> 0 OR id % 2 = 1) AND value > 3 AND id % 97 = id % 89)
SELECT unit_id, max(attempt_id) AS attempt_id, arg_max(text, attempt_id) AS text FROM g GROUP BY unit_id""")
def recoverable_candidates(spark, sf):
    a, n = _attempts(spark, sf), F.col("id")
    made = a.select("id", "status", F.col("bound").cast("string").alias("policy"), F.when(n % 3 == 0, "deterministic").otherwise("model").alias("agent"), (n % 2).cast("string").alias("model"), F.get_json_object("response", "$.output").alias("output"))
    return reads.recoverable(a.select(F.col("work_item").alias("unit_id"), n.alias("attempt_id"), (n % 89).cast("string").alias("text"), (F.col("value") > 3).alias("selected")), made, "2", "1")


@query("""SELECT event_id, user_id FROM events WHERE (event_type = 'view' OR user_id % 4 = 1) AND event_id % 3 <> 0""")
def review_attempts(spark, sf):
    n = F.col("event_id")
    key = F.concat(n.cast("string"), F.when(n % 3 == 0, ":translate").when(n % 3 == 1, ":revision").otherwise(":proofread"))
    rows = t(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("run_id"), (F.col("user_id") % 4).cast("string").alias("invocation"), key.alias("dedupe_key"))
    return reads.review_attempts(rows, "view", "1").select("event_id", "user_id")


@query("""WITH f AS (SELECT l_orderkey AS id, min(l_partkey) AS p FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE p END AS version, o_orderpriority AS policy FROM orders LEFT JOIN f ON f.id = o_orderkey)
SELECT id, version, coalesce(p_brand, policy) AS policy FROM b LEFT JOIN (SELECT p_partkey, p_brand FROM part WHERE p_size > 25) ON p_partkey = version""")
def attempt_provenance(spark, sf):
    attempts = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("version"), F.col("o_orderpriority").alias("policy"))
    versions = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("attempt_id"), F.col("l_partkey").alias("version"))
    audits = t(spark, sf, "part").filter("p_size > 25").select(F.col("p_partkey").alias("version"), F.col("p_size").alias("at"), F.col("p_brand").alias("policy"))
    return reads.provenance(attempts, versions, audits)


@query("""SELECT o_orderkey AS content, count(l_orderkey) = 0 OR (count(*) FILTER (l_returnflag <> 'R') > 0 AND count(*) FILTER (l_returnflag <> 'R' AND l_quantity >= 40) = 0) AS compatible FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def canonical_compatible(spark, sf):
    links = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("content"), (F.col("l_returnflag") != "R").alias("active"), (F.col("l_quantity") < 40).alias("valid"))
    return reads.compatible(t(spark, sf, "orders").select(F.col("o_orderkey").alias("content")), links)


@query("""SELECT page_id, page_id % 3 <> 0 AND page_id % 5 <> 0 AS matches FROM pages""")
def content_matches(spark, sf):
    n = F.col("page_id")
    kept = t(spark, sf, "pages").select("page_id", "url", F.col("html").alias("content"), F.sha2(F.concat("html", F.when(n % 5 == 0, "x").otherwise("")), 256).alias("content_hash"))
    return reads.content_matches(kept, kept.filter(n % 3 != 0), ["page_id", "url", "content", "content_hash"]).select("page_id", "matches")


@query(f"""WITH {STATES}, m AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY state = 'merged' DESC, o_orderkey DESC) AS n FROM s WHERE state <> 'superseded')
SELECT o_custkey, o_orderkey AS manifest, l_linenumber AS path, l_partkey AS content FROM m JOIN lineitem ON l_orderkey = o_orderkey WHERE n = 1""")
def publication_snapshot(spark, sf):
    state = F.when(F.col("state") == "commit_created", "superseded").otherwise(F.col("state"))
    manifests = _states(spark, sf).select("o_custkey", F.col("o_orderkey").alias("id"), state.alias("state"))
    files = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("manifest"), F.col("l_linenumber").alias("path"), F.col("l_partkey").alias("content"))
    return reads.snapshot(manifests, files, ["o_custkey"]).select("o_custkey", "manifest", "path", "content")


@query("""WITH p AS (SELECT l_orderkey AS publication, l_partkey AS path, count(*) AS n, min(l_suppkey % 4) AS r0, max(l_suppkey % 4) AS r1 FROM lineitem GROUP BY 1, 2)
SELECT publication, bool_and(coalesce(n = 1 AND (p_size > 8 OR path % 7 = p_size % 7), false)) AS ok, min(r0) = max(r1) AS uniform FROM p LEFT JOIN part ON p_partkey = path GROUP BY 1""")
def publication_files(spark, sf):
    k = F.col("l_partkey")
    big = t(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.when(F.col("p_size") > 8, F.col("p_partkey") % 7).otherwise(F.col("p_size") % 7).cast("long").alias("shape"), F.lit(1).alias("n_units"))
    files = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("publication"), k.alias("path"), (F.col("l_suppkey") % 4).alias("revision"), (k % 7).alias("shape"), F.lit(1).alias("n_units"))
    return reads.publishable(files, big)


@query("""SELECT c_custkey AS publication, CASE WHEN count(o_orderkey) = 0 THEN 'unchanged' WHEN bool_and(o_totalprice > 20000) THEN 'verified' ELSE 'superseded' END AS assessment FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def merge_assessment(spark, sf):
    verdicts = t(spark, sf, "orders").select(F.col("o_custkey").alias("publication"), (F.col("o_totalprice") > 20000).alias("good"))
    return reads.assessed(t(spark, sf, "customer").select(F.col("c_custkey").alias("publication")), verdicts)


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = o_custkey % 10 + 1)""")
def retired_intents(spark, sf):
    pending = t(spark, sf, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", (F.col("o_custkey") % 10 + 1).alias("hash"))
    intents = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("hash"))
    return reads.retired(pending, intents, ["o_orderkey", "hash"]).select("o_orderkey")


@query("""WITH w AS (SELECT o_orderkey AS content, o_custkey AS unit_id, o_orderpriority AS text FROM orders), v AS (SELECT user_id AS unit_id, CASE event_type WHEN 'view' THEN '1-URGENT' WHEN 'click' THEN '2-HIGH' WHEN 'purchase' THEN '5-LOW' ELSE event_type END AS text, event_id AS version, value FROM events),
c AS (SELECT w.*, version, row_number() OVER (PARTITION BY content, w.unit_id, w.text ORDER BY version % 7 = content % 7 DESC, version DESC) AS n FROM w JOIN v ON v.unit_id = w.unit_id AND v.text = w.text WHERE value > 8),
m AS (SELECT unit_id, text, bool_or(value > 4) AS t FROM v WHERE value <= 8 GROUP BY ALL)
SELECT w.*, c.version, CASE WHEN c.version IS NOT NULL THEN 'linked' WHEN t THEN 'trusted_tm' WHEN NOT t THEN 'candidate_tm' ELSE 'other' END AS provenance
FROM w LEFT JOIN c ON c.content = w.content AND n = 1 LEFT JOIN m ON m.unit_id = w.unit_id AND m.text = w.text""")
def resolved_links(spark, sf):
    wanted = t(spark, sf, "orders").select(F.col("o_orderkey").alias("content"), F.col("o_custkey").alias("unit_id"), F.col("o_orderpriority").alias("text"))
    kind = F.col("event_type")
    said = F.when(kind == "view", "1-URGENT").when(kind == "click", "2-HIGH").when(kind == "purchase", "5-LOW").otherwise(kind)
    e = t(spark, sf, "events").select(F.col("user_id").alias("unit_id"), said.alias("text"), F.col("event_id").alias("version"), "value")
    versions = e.filter("value > 8").drop("value")
    linked = wanted.join(versions, ["unit_id", "text"]).filter("version % 7 = content % 7").select("content", "version")
    return reads.resolved_links(wanted, versions, linked, e.filter("value <= 8").select("unit_id", "text", (F.col("value") > 4).alias("trusted")))


@query(rf"""WITH {PREVIOUS}, a AS (SELECT doc_id, count(*) AS n FROM units GROUP BY 1), b AS (SELECT doc_id, count(*) AS n FROM previous WHERE m <> '2' GROUP BY 1)
SELECT u.doc_id, u.ordinal, u.norm = p.norm AS same FROM units u JOIN previous p ON p.doc_id = u.doc_id AND p.ordinal = u.ordinal AND p.m <> '2' WHERE u.doc_id IN (SELECT a.doc_id FROM a JOIN b ON a.doc_id = b.doc_id AND a.n = b.n)""".replace("m <> '3' AS trusted FROM marked", "m <> '3' AS trusted, m FROM marked"))
def positional_pairs(spark, sf):
    units = _units(spark, sf)
    mark = F.substring(F.sha2("norm", 256), 1, 1)
    old = _previous(units.filter(mark != "2")).select("doc_id", "ordinal", F.col("norm").alias("old"))
    return reads.positional(units, old, ["doc_id"], "ordinal").select("doc_id", "ordinal", (F.col("norm") == F.col("old")).alias("same"))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS x FROM lineitem WHERE l_quantity > 8), b AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS x FROM lineitem WHERE l_discount > 0.02),
d AS (SELECT coalesce(a.k, b.k) AS k, bool_or(a.k IS NULL) AS less, bool_or(b.k IS NULL) AS more FROM a FULL JOIN b ON a.k = b.k AND a.x = b.x GROUP BY 1)
SELECT k, CASE WHEN less AND more THEN 'differs' WHEN more THEN 'superset' WHEN less THEN 'subset' ELSE 'equal' END AS relation FROM d""")
def link_set_relations(spark, sf):
    part = lambda w: t(spark, sf, "lineitem").filter(w).select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("x"))
    return reads.set_relations(part("l_quantity > 8"), part("l_discount > 0.02"), ["k"])


@query("""WITH l AS (SELECT n_nationkey + 1 AS version, n_name AS name, sha256(n_name) AS checksum FROM nation), a AS (SELECT version, CASE WHEN version = 9 THEN 'x' ELSE name END AS name, checksum FROM l WHERE version NOT IN (4, 12))
SELECT version, 'gap' AS fault FROM a WHERE version > 1 AND version - 1 NOT IN (SELECT version FROM a) UNION ALL SELECT version, 'differs' FROM a WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.version = a.version AND l.name = a.name AND l.checksum = a.checksum)""")
def ledger_faults(spark, sf):
    known = t(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("version"), F.col("n_name").alias("name"), F.sha2("n_name", 256).alias("checksum"))
    applied = known.filter("version not in (4, 12)").withColumn("name", F.when(F.col("version") == 9, "x").otherwise(F.col("name")))
    return reads.ledger_faults(applied, known)


@query("""SELECT event_id, event_id % 3 <> 0 AS hash_ok, json_valid(CASE WHEN event_id % 4 = 0 THEN props || '}' ELSE props END) AS json_ok FROM events""")
def format_checks(spark, sf):
    n = F.col("event_id")
    hashed = F.sha2(F.col("event_type"), 256)
    return t(spark, sf, "events").select("event_id", reads.fingerprint_ok(F.when(n % 3 == 0, F.substring(hashed, 1, 63)).otherwise(hashed)).alias("hash_ok"), reads.json_ok(F.when(n % 4 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))).alias("json_ok"))


@query(f"""WITH g AS (SELECT page_id, regexp_extract_all(html, '{text.TAG}') AS tags, html FROM pages) SELECT page_id, len(tags) AS n_tags, len(list_distinct(tags)) AS n_distinct, len(regexp_extract_all(html, '</[A-Za-z][^<>]*>')) AS n_closing FROM g""")
def html_protect(spark, sf):
    tags = text.html_tags(F.col("html"))
    return t(spark, sf, "pages").select("page_id", tags.alias("tags")).select("page_id", F.size("tags").cast("long").alias("n_tags"), F.size(F.array_distinct("tags")).cast("long").alias("n_distinct"), F.size(F.filter("tags", lambda x: x.startswith("</"))).cast("long").alias("n_closing"))


@query(rf"""WITH {UNITS}, p AS (SELECT doc_id, ordinal, unnest(regexp_extract_all(source, '{text.PLACEHOLDER}')) AS value FROM units) SELECT doc_id, ordinal, value, count(*) AS n FROM p GROUP BY ALL""")
def placeholder_multisets(spark, sf):
    return _units(spark, sf).select("doc_id", "ordinal", F.explode(text.placeholders(F.col("source"))).alias("value")).groupBy("doc_id", "ordinal", "value").agg(F.count("*").alias("n"))
