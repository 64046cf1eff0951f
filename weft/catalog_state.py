"""Queries of the business transactions and of the reads beside them; importing this adds them to the catalog.

State tables are derived from the test tables, alike in both engines: customers are runs, repositories and units, orders are
entries and files, events are requests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, t
from .functions import hashing, text
from .operators import matching, state
from .operators import transactions as tx
from .plans import planner, reads
from .sources import discovery

FP = "0123456789abcdef" * 4


def _id(*xs: str) -> str:
    """`transactions.id_of` in SQL, for parts that are not null."""
    return "substr(sha256(" + " || ".join(f"octet_length(encode(({x})::VARCHAR)) || ':' || ({x})::VARCHAR" for x in xs) + "), 1, 16)"


def none(kind: str):
    return F.lit(None).cast(kind)


@query(f"""WITH q AS (SELECT user_id, max(event_id) AS tm FROM events WHERE event_id % 7 <> 0 GROUP BY user_id),
r AS (SELECT 'inv' || user_id AS invocation_key, tm, c_custkey FROM q LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 3 = 0)
SELECT CASE WHEN c_custkey IS NULL THEN {_id("'run'", "invocation_key")} ELSE 'r' || c_custkey END AS run_id, invocation_key, 'running' AS status, CASE WHEN c_custkey IS NULL THEN tm ELSE 1 END AS started_at, tm AS heartbeat_at, NULL::BIGINT AS finished_at FROM r""")
def txn_begin_runs(spark, sf):
    c, e = t(spark, sf, "customer"), t(spark, sf, "events")
    runs = c.filter("c_custkey % 3 = 0").select(F.concat(F.lit("r"), "c_custkey").alias("run_id"), F.col("c_nationkey").cast("long").alias("repository_id"), F.concat(F.lit("inv"), "c_custkey").alias("invocation_key"), F.lit(FP).alias("policy"), F.lit("{}").alias("metadata"), F.lit("ok").alias("status"), F.lit(1).cast("long").alias("started_at"), F.lit(2).cast("long").alias("heartbeat_at"), F.lit(3).cast("long").alias("finished_at"))
    policy = F.when(F.col("event_id") % 7 == 0, F.lit("not one")).otherwise(F.lit(FP))
    asked = e.select(F.lit(1).cast("long").alias("repository_id"), F.concat(F.lit("inv"), "user_id").alias("invocation_key"), policy.alias("policy"), F.lit("{}").alias("metadata"), F.col("event_id").alias("at"))
    return tx.begin_runs(runs, asked).rows["runs"].select("run_id", "invocation_key", "status", "started_at", "heartbeat_at", "finished_at")


REQUESTS = """q AS (SELECT event_id AS tm, user_id AS unit_id, (user_id % 50)::VARCHAR AS work_item_id, (event_id % 400)::VARCHAR AS dedupe_key, CASE event_type WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS status,
 CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'a' END AS agent, (event_id % 89)::VARCHAR AS said, (CASE WHEN event_id % 13 = 0 THEN event_id % 83 ELSE event_id % 89 END)::VARCHAR AS text FROM events WHERE event_id % 4 <> 0),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY work_item_id, dedupe_key ORDER BY tm) AS rn FROM q) WHERE rn = 1),
o AS (SELECT work_item_id, dedupe_key, arg_min(status, tm) AS old_status, arg_min(said, tm) AS old_said, count(*) OVER (PARTITION BY work_item_id) AS known FROM (
 SELECT event_id AS tm, (user_id % 50)::VARCHAR AS work_item_id, (event_id % 400)::VARCHAR AS dedupe_key, CASE event_type WHEN 'click' THEN 'failed' ELSE 'succeeded' END AS status, (event_id % 89)::VARCHAR AS said FROM events WHERE event_id % 4 = 0) GROUP BY work_item_id, dedupe_key),
g AS (SELECT f.*, old_status, old_said, CASE WHEN status <> 'succeeded' THEN 'STATUS' WHEN agent = ' ' THEN 'AGENT' WHEN said <> text THEN 'OUTPUT' WHEN c_custkey IS NULL THEN 'UNIT' WHEN old_status IS NOT NULL AND (old_status <> 'succeeded' OR old_said <> said) THEN 'CONFLICT' END AS refusal
 FROM f LEFT JOIN o USING (work_item_id, dedupe_key) LEFT JOIN customer ON c_custkey = unit_id)"""


def _candidate_tables(spark, sf):
    e = t(spark, sf, "events")
    n = F.col("event_id")
    said = F.to_json(F.struct((n % 89).cast("string").alias("output")))
    base = e.select(n.alias("at"), F.col("user_id").alias("unit_id"), (F.col("user_id") % 50).cast("string").alias("work_item_id"), (n % 400).cast("string").alias("dedupe_key"), "event_type", said.alias("response"), F.lit("ja").alias("locale"),
                    *[F.lit("x").alias(c) for c in tx.IDENTITY[1:]], *[F.lit(FP).alias(c) for c in ("provider_fingerprint", "prompt_hash", "policy")], none("string").alias("error"), F.when(n % 11 == 0, " ").otherwise("a").alias("agent"))
    asked = base.filter("at % 4 <> 0").withColumns({"status": F.when(F.col("event_type") == "error", "failed").otherwise("succeeded"), "candidate_key": F.col("dedupe_key"), "text": F.when(F.col("at") % 13 == 0, F.col("at") % 83).otherwise(F.col("at") % 89).cast("string"), "score": F.lit(0.5), "provenance": F.lit("model")}).drop("event_type")
    old = base.filter("at % 4 = 0").groupBy("work_item_id", "dedupe_key").agg(F.min_by(F.struct("at", "event_type", "response"), "at").alias("r"))
    old = old.select("work_item_id", "dedupe_key", "r.*").select(F.concat(F.lit("a"), "at").alias("attempt_id"), "work_item_id", "dedupe_key", F.row_number().over(state.Window.partitionBy("work_item_id").orderBy("at")).cast("long").alias("attempt_no"), F.when(F.col("event_type") == "click", "failed").otherwise("succeeded").alias("status"), "response", "at")
    sources = t(spark, sf, "customer").select(F.col("c_custkey").alias("unit_id"), F.concat(F.lit("uv"), "c_custkey").alias("unit_version_id"), F.col("c_nationkey").cast("long").alias("repository_id"), F.col("c_mktsegment").alias("source_hash"), F.lit("r1").alias("source_revision"), F.lit("").alias("context_key"))
    candidates = spark.createDataFrame([], "unit_id long, locale string, candidate_key string, text string, attempt_id string, score double, selected boolean")
    versions = spark.createDataFrame([], "version_id string, unit_version_id string, locale string, text string, provenance string, validation string, review string, publication string, policy string, attempt_id string, superseded_at long")
    memory = spark.createDataFrame([], "memory_id string, repository_id long, unit_id long, version_id string, locale string, source_hash string, source_revision string, context_key string, text string, tier string, provenance string, policy string, at long, superseded_at long")
    return {"attempts": old, "candidates": candidates, "versions": versions, "memory": memory, "sources": sources}, asked


@query(f"""WITH {REQUESTS}, n AS (SELECT g.*, coalesce(known, 0) AS known, row_number() OVER (PARTITION BY g.work_item_id ORDER BY tm, g.dedupe_key) AS nth FROM g LEFT JOIN (SELECT DISTINCT work_item_id, known FROM o) k ON k.work_item_id = g.work_item_id WHERE refusal IS NULL AND old_status IS NULL)
SELECT work_item_id, dedupe_key, {_id("'attempt'", "work_item_id", "dedupe_key")} AS attempt_id, known + nth AS attempt_no, tm FROM n""")
def txn_record_attempts(spark, sf):
    tables, asked = _candidate_tables(spark, sf)
    return tx.record_candidates(tables, asked).rows["attempts"].select("work_item_id", "dedupe_key", "attempt_id", "attempt_no", F.col("at").alias("tm"))


@query(f"""WITH {REQUESTS} SELECT work_item_id, dedupe_key, coalesce(refusal, CASE WHEN old_status IS NULL THEN 'inserted' ELSE 'replayed' END) AS outcome FROM g""")
def txn_attempt_receipts(spark, sf):
    tables, asked = _candidate_tables(spark, sf)
    staged = tx.record_candidates(tables, asked)
    done = staged.receipts.select("work_item_id", "dedupe_key", F.when(F.col("inserted"), "inserted").otherwise("replayed").alias("outcome"))
    return done.union(staged.refused.select("work_item_id", "dedupe_key", "refusal"))


@query(f"""WITH {REQUESTS}, s AS (SELECT unit_id, candidate_key, text, top FROM (SELECT unit_id, dedupe_key AS candidate_key, arg_max(text, tm) AS text, max(tm) AS last FROM g WHERE refusal IS NULL GROUP BY ALL) x
 JOIN (SELECT unit_id, arg_max(dedupe_key, tm) AS top FROM g WHERE refusal IS NULL GROUP BY ALL) y USING (unit_id)) SELECT unit_id, candidate_key, text, candidate_key = top AS selected FROM s""")
def txn_selected_candidates(spark, sf):
    tables, asked = _candidate_tables(spark, sf)
    return tx.record_candidates(tables, asked).rows["candidates"].select("unit_id", "candidate_key", "text", "selected")


@query(f"""WITH {REQUESTS} SELECT c_nationkey::BIGINT AS repository_id, c_mktsegment AS source_hash, arg_max(text, tm) AS text, arg_max(unit_id, tm) AS unit_id, 'candidate' AS tier FROM g JOIN customer ON c_custkey = unit_id WHERE refusal IS NULL GROUP BY ALL""")
def txn_candidate_memory(spark, sf):
    tables, asked = _candidate_tables(spark, sf)
    return tx.record_candidates(tables, asked).rows["memory"].select("repository_id", "source_hash", "text", "unit_id", "tier")


VERSIONS = "version_id string, unit_version_id string, locale string, text string, provenance string, validation string, review string, publication string, policy string, attempt_id string, superseded_at long"


def _memory(spark, sf):
    o = t(spark, sf, "orders")
    tier = F.when(F.col("o_orderstatus") == "F", "trusted").when(F.col("o_orderstatus") == "O", "candidate").otherwise("history")
    return o.select(F.concat(F.lit("m"), "o_orderkey").alias("memory_id"), (F.col("o_custkey") % 5).alias("repository_id"), F.col("o_custkey").alias("unit_id"), F.concat(F.lit("v"), F.col("o_orderkey")).alias("version_id"), F.lit("ja").alias("locale"), F.col("o_orderkey").cast("string").alias("source_hash"), F.lit("r1").alias("source_revision"), F.lit("").alias("context_key"), F.col("o_orderpriority").alias("text"), tier.alias("tier"), F.lit("model").alias("provenance"), F.lit(FP).alias("policy"), F.col("o_orderkey").alias("at"), F.when(F.col("o_orderstatus") == "P", F.lit(1)).cast("long").alias("superseded_at"))


def _versions(spark, sf):
    o = t(spark, sf, "orders")
    values = {"version_id": F.concat(F.lit("v"), "o_orderkey"), "unit_version_id": F.concat(F.lit("uv"), "o_custkey"), "locale": F.lit("ja"), "text": F.col("o_orderpriority"), "validation": F.lit("passed"), "attempt_id": F.concat(F.lit("a"), (F.col("o_orderkey") % 300).cast("string")), "superseded_at": F.when(F.col("o_orderstatus") == "P", F.lit(1)).cast("long")}
    return o.select(*[values.get(n, F.lit("x")).alias(n) for n in (c.split()[0] for c in VERSIONS.split(", "))])


@query("""SELECT 'versions' AS "table", 'v' || o_orderkey AS id, 'quarantined' AS state, o_orderkey % 300 % 90 + 1000 AS closed_at FROM orders WHERE o_orderkey % 300 < 90
UNION ALL SELECT 'memory', 'm' || o_orderkey, 'history', o_orderkey % 300 % 90 + 1000 FROM orders WHERE o_orderkey % 300 < 90 AND o_orderstatus <> 'P'
UNION ALL SELECT 'attempts', 'a' || n, 'cancelled', n + 1000 FROM (SELECT unnest(range(0, 90)) AS n) WHERE n % 2 = 0
UNION ALL SELECT 'candidates', n || ':superseded:a' || n, 'false', n + 1000 FROM (SELECT unnest(range(0, 90)) AS n)""")
def txn_retire_attempts(spark, sf):
    n = F.col("id")
    attempts = spark.range(300).select(F.concat(F.lit("a"), n).alias("attempt_id"), n.cast("string").alias("dedupe_key"), F.when(n % 2 == 0, "succeeded").otherwise("failed").alias("status"), none("string").alias("error"), (n + 1000).alias("at"))
    candidates = spark.range(300).select(n.alias("unit_id"), n.cast("string").alias("candidate_key"), F.concat(F.lit("a"), n).alias("attempt_id"), F.lit(True).alias("selected"))
    asked = spark.range(90).select(F.concat(F.lit("a"), n).alias("attempt_id"), (n + 1000).alias("at"))
    rows = tx.retire({"attempts": attempts, "candidates": candidates, "versions": _versions(spark, sf), "memory": _memory(spark, sf)}, asked).rows
    out = rows["versions"].select(F.lit("versions").alias("table"), F.col("version_id").alias("id"), F.col("validation").alias("state"), F.col("superseded_at").alias("closed_at"))
    out = out.union(rows["memory"].select(F.lit("memory"), "memory_id", "tier", "superseded_at")).union(rows["attempts"].select(F.lit("attempts"), "attempt_id", "status", "at"))
    return out.union(rows["candidates"].select(F.lit("candidates"), "candidate_key", F.col("selected").cast("string"), F.substring("attempt_id", 2, 9).cast("long") + 1000))


@query("""WITH g AS (SELECT * FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 4 <> 1 AND o_totalprice <= 50000)
SELECT 'versions' AS "table", 'v' || o_orderkey AS id, 'quarantined' AS state FROM g UNION ALL SELECT 'memory', 'm' || o_orderkey, 'history' FROM g""")
def txn_quarantine(spark, sf):
    o = t(spark, sf, "orders")
    scope = t(spark, sf, "customer").filter("c_custkey % 4 <> 1").select(F.concat(F.lit("uv"), "c_custkey").alias("unit_version_id"), F.lit("ja").alias("locale"))
    valid = o.filter("o_totalprice > 50000").select(F.concat(F.lit("v"), "o_orderkey").alias("version_id"))
    rows = tx.quarantine({"versions": _versions(spark, sf), "memory": _memory(spark, sf)}, valid, scope, 9).rows
    return rows["versions"].select(F.lit("versions").alias("table"), F.col("version_id").alias("id"), F.col("validation").alias("state")).union(rows["memory"].select(F.lit("memory"), "memory_id", "tier"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN '1-URGENT' ELSE l_shipdate::VARCHAR END AS text FROM lineitem WHERE l_partkey % 6 <> 0),
q AS (SELECT l_orderkey, arg_max(text, {'n': l_linenumber, 't': text}) AS text, max(l_linenumber) AS tm FROM l GROUP BY l_orderkey),
n AS (SELECT q.*, o_orderstatus, o_orderkey FROM q JOIN orders ON o_orderkey = l_orderkey WHERE NOT (o_orderstatus = 'F' AND text = o_orderpriority))
SELECT l_orderkey::VARCHAR AS source_hash, text, 'trusted' AS tier, NULL::BIGINT AS superseded_at FROM n UNION ALL SELECT l_orderkey::VARCHAR, o_orderpriority, 'history', tm FROM n JOIN orders USING (o_orderkey) WHERE n.o_orderstatus = 'F'""")
def txn_trust(spark, sf):
    said = F.when(F.col("l_quantity") > 25, "1-URGENT").otherwise(F.col("l_shipdate").cast("string"))
    asked = t(spark, sf, "lineitem").join(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("o_custkey") % 5).alias("repository_id"), F.col("o_custkey").alias("unit_id"), F.when(F.col("l_partkey") % 6 != 0, F.concat(F.lit("uv"), "o_custkey")).alias("unit_version_id"), F.lit("ja").alias("locale"), F.col("l_orderkey").cast("string").alias("source_hash"),
        F.lit("r1").alias("source_revision"), F.lit("").alias("context_key"), said.alias("text"), F.lit("person").alias("provenance"), F.lit(FP).alias("policy"), F.col("l_linenumber").cast("long").alias("at"),
    )
    return tx.trust({"versions": _versions(spark, sf), "memory": _memory(spark, sf)}, asked).rows["memory"].select("source_hash", "text", "tier", "superseded_at")


def _outbox(spark, sf):
    o = t(spark, sf, "orders")
    status, path = F.col("o_orderstatus"), F.concat(F.lit("p"), (F.col("o_custkey") % 40).cast("string"))
    values = {
        "outbox_id": F.concat(F.lit("o"), "o_orderkey"), "work_item_id": F.concat(F.lit("w"), "o_orderkey"), "run_id": F.lit("r"), "repository_id": F.lit(1).cast("long"), "document_id": F.lit("d"), "locale": F.lit("ja"), "path": path,
        "dedupe_key": F.concat(F.lit("k"), "o_orderkey"), "payload": F.lit("{}"), "state": F.when(status == "F", "done").when(status == "O", "pending").otherwise("processing"), "owner": F.when(status == "P", F.lit("materialize:1")),
        "owner_alive": F.when(status == "P", F.col("o_totalprice") > 200000), "lease_expires_at": none("long"), "available_at": F.lit(0).cast("long"), "last_error": none("string"), "completed_at": none("long"),
    }
    return o.select(*[values[c.split()[0]].alias(c.split()[0]) for c in tx.OUTBOX.split(", ")])


SCHEDULED = """q AS (SELECT 'p' || (c_custkey % 60) AS path, max(c_custkey) AS tm FROM customer GROUP BY 1),
b AS (SELECT o_orderkey, 'p' || (o_custkey % 40) AS path, o_orderstatus AS s, o_totalprice FROM orders),
r AS (SELECT path, tm, CASE WHEN tm % 10 = 3 THEN 'RUN' WHEN tm % 10 = 4 THEN 'JSON' WHEN tm % 10 = 5 THEN 'INTENT' WHEN EXISTS (SELECT 1 FROM b WHERE b.path = q.path AND s = 'P' AND o_totalprice > 200000) THEN 'BUSY' END AS refusal FROM q)"""


def _scheduled(spark, sf):
    at, path = F.col("c_custkey"), F.concat(F.lit("p"), (F.col("c_custkey") % 60).cast("string"))
    asked = t(spark, sf, "customer").select(
        F.when(at % 10 == 3, "nobody").otherwise("r").alias("run_id"), F.lit(1).cast("long").alias("repository_id"), F.lit("d").alias("document_id"), F.lit("ja").alias("locale"), path.alias("path"), F.concat(F.lit("n"), at.cast("string")).alias("dedupe_key"),
        F.when(at % 10 == 4, "{").otherwise(F.to_json(F.struct(F.concat(F.lit("n"), at.cast("string")).alias("effect_key")))).alias("work_input"), F.to_json(F.struct(F.lit(1).alias("repository_id"), F.when(at % 10 == 5, "ko").otherwise("ja").alias("locale"), path.alias("path"))).alias("payload"), at.alias("at"),
    )
    box = _outbox(spark, sf)
    work = box.select("work_item_id", "run_id", none("string").alias("unit_id"), "document_id", "locale", F.lit("materialization").alias("kind"), F.lit("{}").alias("input"), F.lit("pending").alias("status"), none("string").alias("result"), F.lit(0).cast("long").alias("created_at"))
    runs = spark.createDataFrame([("r", 1)], "run_id string, repository_id long")
    documents = spark.createDataFrame([("d", 1)], "document_id string, repository_id long")
    return tx.schedule({"outbox": box, "work_items": work, "runs": runs, "documents": documents}, asked)


@query(f"""WITH {SCHEDULED} SELECT 'n' || tm AS dedupe_key, 'pending' AS state, NULL::VARCHAR AS last_error, NULL::BIGINT AS completed_at FROM r WHERE refusal IS NULL
UNION ALL SELECT 'k' || o_orderkey, 'done', '{tx.DONE}', tm FROM b JOIN r USING (path) WHERE refusal IS NULL AND s <> 'F'""")
def txn_schedule(spark, sf):
    return _scheduled(spark, sf).rows["outbox"].select("dedupe_key", "state", "last_error", "completed_at")


@query(f"""WITH {SCHEDULED} SELECT 'n' || tm AS dedupe_key, refusal FROM r WHERE refusal IS NOT NULL""")
def txn_schedule_refused(spark, sf):
    return _scheduled(spark, sf).refused.select("dedupe_key", "refusal")


@query(f"""WITH {SCHEDULED} SELECT status, count(*) AS n FROM (SELECT 'pending' AS status FROM r WHERE refusal IS NULL UNION ALL SELECT 'cancelled' FROM b JOIN r USING (path) WHERE refusal IS NULL AND s <> 'F') GROUP BY 1""")
def txn_schedule_work(spark, sf):
    return _scheduled(spark, sf).rows["work_items"].groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT 'k' || (o_orderkey // 3) AS base, o_orderkey AS id, o_orderkey % 3 AS nth, CASE WHEN o_orderkey % 3 = 2 AND o_orderstatus <> 'F' THEN 'pending' ELSE 'done' END AS state FROM orders),
l AS (SELECT base, max(id) AS last FROM b WHERE state = 'done' GROUP BY base) SELECT 'k' || c_custkey AS base_key, 'k' || c_custkey || coalesce(':after:o' || last, '') AS dedupe_key FROM customer LEFT JOIN l ON base = 'k' || c_custkey""")
def txn_effect_keys(spark, sf):
    n = F.col("o_orderkey")
    base = F.concat(F.lit("k"), F.floor(n / 3).cast("string"))
    before = F.lag(n).over(state.Window.partitionBy(base).orderBy(n))
    box = t(spark, sf, "orders").select(F.concat(F.lit("o"), n).alias("outbox_id"), F.when(before.isNull(), base).otherwise(F.concat(base, F.lit(":after:o"), before.cast("string"))).alias("dedupe_key"), F.when((n % 3 == 2) & (F.col("o_orderstatus") != "F"), "pending").otherwise("done").alias("state"))
    return tx.effect_keys(t(spark, sf, "customer").select(F.concat(F.lit("k"), "c_custkey").alias("base_key")), box).select("base_key", "dedupe_key")


MOVES = "m AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'merged' WHEN '2-HIGH' THEN 'pr_open' WHEN '3-MEDIUM' THEN 'push_pending' WHEN '4-NOT SPECIFIED' THEN 'superseded' ELSE 'commit_created' END AS state FROM orders)"


@query(f"""WITH {MOVES}, t AS (SELECT o_custkey, arg_max({{'k': o_orderkey, 's': state}}, ((state <> 'superseded')::INT, (state = 'merged')::INT, 'm' || o_orderkey)) AS r FROM m GROUP BY 1)
SELECT 'm' || r.k AS manifest_id, 'pr_open' AS state FROM t JOIN customer ON c_custkey = o_custkey WHERE r.s IN ('commit_created', 'push_pending') AND c_nationkey % 2 = 0""")
def txn_publication_moves(spark, sf):
    names = {"1-URGENT": "merged", "2-HIGH": "pr_open", "3-MEDIUM": "push_pending", "4-NOT SPECIFIED": "superseded"}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    manifests = t(spark, sf, "orders").select(F.concat(F.lit("m"), "o_orderkey").alias("manifest_id"), F.lit(1).cast("long").alias("repository_id"), F.lit("r").alias("run_id"), F.lit("ja").alias("locale"), F.lit("r1").alias("source_revision"), F.col("o_custkey").cast("string").alias("commit"), F.lit(FP).alias("policy"), F.concat(F.lit("a"), "o_orderkey").alias("authorization_key"), F.coalesce(table[F.col("o_orderpriority")], F.lit("commit_created")).alias("state"), F.col("o_orderkey").alias("at"))
    asked = t(spark, sf, "customer").select(F.lit(1).cast("long").alias("repository_id"), F.lit("ja").alias("locale"), F.col("c_custkey").cast("string").alias("commit"), none("string").alias("authorization_key"), F.when(F.col("c_nationkey") % 2 == 0, "pr_open").otherwise("merged").alias("new_state"))
    return tx.move_publications(manifests, asked).rows["manifests"].select("manifest_id", "state")


@query("""WITH s AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'adopted' WHEN 'O' THEN 'pr_open' ELSE 'human_edit' END AS move FROM orders)
SELECT 'f' || o_orderkey AS file_id, CASE move WHEN 'pr_open' THEN 'published' ELSE move END AS state, CASE move WHEN 'pr_open' THEN 'pr_open' ELSE 'p' END AS publication_state, CASE move WHEN 'adopted' THEN 'approved' WHEN 'human_edit' THEN 'needs_review' ELSE 'r' END AS review_state,
 CASE move WHEN 'adopted' THEN 'trusted' ELSE 't' END AS trust_tier, CASE move WHEN 'pr_open' THEN 'old' ELSE 'new' END AS materialized_hash FROM s""")
def txn_file_moves(spark, sf):
    o, s = t(spark, sf, "orders"), F.col("o_orderstatus")
    first = {"file_id": F.concat(F.lit("f"), "o_orderkey"), "repository_id": F.lit(1).cast("long"), "materialized_hash": F.lit("old"), "publication_state": F.lit("p"), "review_state": F.lit("r"), "trust_tier": F.lit("t")}
    files = o.select(*[first.get(c, F.lit("x")).alias(c) for c in (x.split()[0] for x in tx.FILES.split(", "))])
    moves = o.select(F.concat(F.lit("f"), "o_orderkey").alias("file_id"), F.when(s == "F", "adopted").when(s == "O", "pr_open").otherwise("human_edit").alias("move"), F.lit("new").alias("new_hash"))
    return tx.move_files(files, moves).select("file_id", "state", "publication_state", "review_state", "trust_tier", "materialized_hash")


@query("""SELECT event_type AS kind, 'w' || user_id AS owner FROM events WHERE NOT (event_type = 'view' AND event_id % 2 = 0) AND event_id % 5 = 0""".replace("event_type AS kind", "'LEASE' AS fault") + """
UNION ALL SELECT 'WORKER', o FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'strange' ELSE 'publish:' || o_orderkey END AS o, o_totalprice, o_orderkey FROM orders WHERE o_orderstatus = 'P') WHERE NOT (o <> 'strange' AND o_totalprice > 100000)""")
def idle_check(spark, sf):
    n = F.col("event_id")
    leases = t(spark, sf, "events").filter("event_id % 5 = 0").select(F.when(F.col("event_type") == "view", "repository").otherwise("worker").alias("kind"), F.concat(F.lit("w"), "user_id").alias("owner"), (n % 2 != 0).alias("owner_alive"))
    k = F.col("o_orderkey")
    box = t(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "P", "processing").otherwise("done").alias("state"), F.when(k % 3 == 0, "strange").otherwise(F.concat(F.lit("publish:"), k.cast("string"))).alias("owner"), (F.col("o_totalprice") <= 100000).alias("owner_alive"))
    return tx.idle_faults(leases, [box])


@query("""WITH u AS (SELECT l_orderkey AS document_id, l_linenumber AS ordinal, l_orderkey || '-' || l_linenumber AS unit_key, l_partkey::VARCHAR AS source_hash, l_returnflag <> 'R' AS active FROM lineitem)
SELECT o_custkey % 5 AS repository_id, 'p' || o_orderkey AS path, ordinal, unit_key FROM u JOIN orders ON o_orderkey = document_id WHERE active AND o_orderstatus <> 'P' AND o_orderkey % 4 <> 0 AND u.source_hash::BIGINT % 9 <> 0""")
def unchanged_units(spark, sf):
    o, l = t(spark, sf, "orders"), t(spark, sf, "lineitem")
    key = F.col("o_orderkey")
    documents = o.select(key.alias("document_id"), (F.col("o_custkey") % 5).alias("repository_id"), F.concat(F.lit("p"), key.cast("string")).alias("path"), F.when(key % 2 == 0, "r1").alias("source_revision"), key.cast("string").alias("content_hash"), F.when(F.col("o_orderstatus") == "P", F.lit(1)).alias("deleted_at"))
    wanted = o.select((F.col("o_custkey") % 5).alias("repository_id"), F.concat(F.lit("p"), key.cast("string")).alias("path"), F.when(key % 4 != 0, key.cast("string")).otherwise("other").alias("content_hash"))
    name = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    units = l.select(name.alias("unit_id"), name.alias("unit_key"), F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").cast("string").alias("source_hash"), F.lit("s").alias("source_text"), (F.col("l_returnflag") != "R").alias("active"))
    versions = l.filter("l_partkey % 9 <> 0").select(name.alias("unit_id"), F.when(F.col("l_orderkey") % 2 == 0, "r1").otherwise("").alias("source_revision"), F.col("l_partkey").cast("string").alias("source_hash"), F.lit("s").alias("source_text"))
    return reads.unchanged_units(units, documents, versions, wanted)


@query("""SELECT o_custkey % 5 AS repository_id, o_orderkey::VARCHAR AS source_hash, o_orderpriority AS text FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 60000""")
def trusted_translations(spark, sf):
    o = t(spark, sf, "orders")
    candidates = o.select(F.col("o_custkey").alias("unit_id"), F.when(F.col("o_totalprice") > 60000, F.col("o_orderpriority")).otherwise("x").alias("text"), F.lit("").alias("context_key"), F.lit(True).alias("trusted"), F.lit(True).alias("valid"), F.col("o_orderkey").cast("string").alias("source_hash"))
    memory = _memory(spark, sf).withColumn("unit_id", F.concat_ws("/", F.col("unit_id").cast("string"), "source_hash"))
    return reads.trusted_translations(memory, candidates.withColumn("unit_id", F.concat_ws("/", F.col("unit_id").cast("string"), "source_hash"))).select("repository_id", "source_hash", "text")


@query("""WITH a AS (SELECT event_id AS id, user_id, CASE WHEN event_type IN ('view', 'click') THEN 'succeeded' ELSE 'failed' END AS status, event_id % 5 AS policy, event_id % 3 = 0 AS det, event_id % 2 AS model FROM events),
g AS (SELECT a.*, c_nationkey AS run FROM a JOIN customer ON c_custkey = user_id WHERE status = 'succeeded' AND policy = 2 AND (NOT det OR model = 1)),
v AS (SELECT 'any' AS scope, * FROM g UNION ALL SELECT 'run', * FROM g WHERE run = 7 UNION ALL SELECT 'invocation', * FROM g WHERE run % 4 = 1) SELECT scope, user_id AS unit_id, max(id) AS attempt_id FROM v GROUP BY ALL""")
def recoverable_scopes(spark, sf):
    n, e = F.col("event_id"), t(spark, sf, "events")
    attempts = e.select(n.alias("id"), F.col("user_id").alias("work_item"), F.when(F.col("event_type").isin("view", "click"), "succeeded").otherwise("failed").alias("status"), (n % 5).cast("string").alias("policy"), F.when(n % 3 == 0, "deterministic").otherwise("model").alias("agent"), (n % 2).cast("string").alias("model"), F.lit("t").alias("output"))
    candidates = e.select(F.col("user_id").alias("unit_id"), n.alias("attempt_id"), F.lit("t").alias("text"), F.lit(True).alias("selected"))
    work = t(spark, sf, "customer").select(F.col("c_custkey").alias("work_item"), F.col("c_nationkey").cast("string").alias("run_id"))
    runs = t(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("run_id"), (F.col("n_nationkey") % 4).cast("string").alias("invocation"))
    out = None
    for scope, where in (("any", {}), ("run", {"run": "7"}), ("invocation", {"invocation": "1"})):
        part = reads.recoverable_within(candidates, attempts, work, runs, "2", "1", **where).select(F.lit(scope).alias("scope"), "unit_id", "attempt_id")
        out = part if out is None else out.union(part)
    return out


@query("""SELECT user_id AS work_item, event_id::VARCHAR AS dedupe_key, CASE event_type WHEN 'view' THEN 'succeeded' WHEN 'click' THEN 'failed' WHEN 'purchase' THEN 'timed_out' ELSE 'strange' END AS status, event_type IN ('view', 'click', 'purchase') AS known FROM events""")
def attempt_statuses(spark, sf):
    kind = F.col("event_type")
    status = F.when(kind == "view", "succeeded").when(kind == "click", "failed").when(kind == "purchase", "timed_out").otherwise("strange")
    return reads.attempt_status(t(spark, sf, "events").select(F.col("user_id").alias("work_item"), F.col("event_id").cast("string").alias("dedupe_key"), status.alias("status")))


@query("""SELECT o_orderkey AS content_version_id, o_orderpriority AS identity FROM orders WHERE o_orderkey % 3 <> 0""")
def document_intents(spark, sf):
    o, k = t(spark, sf, "orders"), F.col("o_orderkey")
    intents = o.select(k.alias("content_version_id"), k.alias("intent_id"), F.col("o_orderpriority").alias("identity")).union(o.select(k, k + 1_000_000_000, F.lit("older")))
    return reads.document_intents(o.select(k.alias("content_version_id"), F.when(k % 3 == 0, -k - 1).otherwise(k).alias("intent_id")), intents)


@query("""SELECT c_custkey, 'doc' || c_custkey AS path, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS document_id FROM customer""")
def document_ids(spark, sf):
    k, c = F.col("c_custkey"), t(spark, sf, "customer")
    documents = c.filter(k % 8 != 0).select(k.cast("long").alias("repository_id"), F.concat(F.lit("doc"), k.cast("string")).alias("path"), k.alias("document_id"), F.when(k % 4 == 0, F.lit(1)).alias("deleted_at"))
    return reads.document_ids(documents, c.select(k.cast("long").alias("repository_id"), F.concat(F.lit("doc"), k.cast("string")).alias("path"))).select(F.col("repository_id").alias("c_custkey"), "path", "document_id")


@query("""SELECT event_id, p_brand FROM events JOIN part ON p_partkey = json_extract_string(props, '$.k')::BIGINT""")
def json_key_join(spark, sf):
    return reads.json_joined(t(spark, sf, "events"), "props", "k", t(spark, sf, "part"), "p_partkey").select("event_id", "p_brand")


@query("""SELECT o_orderkey AS id, o_custkey % 7 = o_orderkey % 7 AND o_orderstatus = 'F' AS compatible FROM orders""")
def identity_checks(spark, sf):
    o = t(spark, sf, "orders")
    own = hashing.self_hash(["o_custkey"], [])
    claimed = F.when(F.col("o_orderstatus") == "F", own).otherwise(F.when(F.col("o_orderstatus") == "O", F.lit("x")))
    return o.select(F.col("o_orderkey").alias("id"), reads.identity_compatible(claimed, own, F.col("o_custkey") % 7, F.col("o_orderkey") % 7).alias("compatible"))


@query("""SELECT c_custkey AS unit_id, arg_max(o_orderkey, (o_orderstatus = 'F', o_orderkey)) AS candidate_id FROM customer JOIN orders ON o_custkey = c_custkey
WHERE (o_orderstatus = 'F' OR (o_custkey % 3 <> 0 AND (o_orderkey % 5 = 1 OR o_orderkey % 7 = 2 OR o_orderkey % 11 = 0) AND o_orderkey % 2 = 0)) GROUP BY c_custkey HAVING c_custkey % 6 <> 1""".replace("(o_orderstatus = 'F', o_orderkey)", "((o_orderstatus = 'F')::INT, o_orderkey)"))
def eligible_candidates(spark, sf):
    o, k = t(spark, sf, "orders"), F.col("o_orderkey")
    rows = o.select(F.col("o_custkey").alias("unit_id"), k.alias("candidate_id"), F.lit("t").alias("text"), (F.col("o_orderstatus") == "F").alias("trusted"), (k % 2).cast("string").alias("policy"), none("string").alias("model"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("current_unit_id"), (k % 5).cast("string").alias("run_id"), (k % 7).cast("string").alias("invocation"), F.when(k % 11 == 0, "h").alias("hint"))
    picked = matching.reusable(matching.eligible(rows, "1", "2"), "0", [])
    receipts = t(spark, sf, "customer").select(F.col("c_custkey").alias("unit_id"), F.concat(F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, ":proofread").otherwise(":revision")).alias("dedupe_key"), (F.col("c_custkey") % 3 != 1).alias("compatible"))
    return matching.reviewed(picked, receipts, ["revision"]).select("unit_id", "candidate_id")


@query("""SELECT o_orderpriority AS format, count(*) AS documents, count(*) FILTER (NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30)) AS passed_through FROM orders GROUP BY 1""")
def format_counts(spark, sf):
    documents = t(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").alias("format"))
    return planner.format_counts(documents, t(spark, sf, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("path")))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'm' || c_custkey END, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, '') AS key FROM customer""")
def memory_kinds(spark, sf):
    k = F.col("c_custkey")
    context = F.to_json(F.struct(F.when(k % 3 == 0, F.concat(F.lit("m"), k.cast("string"))).alias("memory_key"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("kind")))
    return t(spark, sf, "customer").select("c_custkey", planner.kind_of(context).alias("key"))


@query("""WITH b AS (SELECT n_nationkey AS k, CASE n_nationkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'pt-BR' WHEN 2 THEN 'a..b' WHEN 3 THEN 'x y' ELSE 'zh_TW.1' END AS lang, CASE n_nationkey % 7 WHEN 0 THEN 'i18n' WHEN 1 THEN '-{lang}' WHEN 2 THEN 'i18n//{lang}' WHEN 3 THEN 'a/{lang}.lock' WHEN 4 THEN 'a@{{lang}' WHEN 5 THEN 'b/{lang}/' ELSE 'i18n/{lang}' END AS pattern FROM nation)
SELECT k, CASE WHEN lang IN ('pt-BR', 'zh_TW.1') AND k % 7 = 6 THEN 'i18n/' || lang END AS branch FROM b""")
def branch_names(spark, sf):
    k = F.col("n_nationkey")
    pick = lambda n, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (n + 1).cast("int"))
    lang, pattern = pick(k % 5, ["", "pt-BR", "a..b", "x y", "zh_TW.1"]), pick(k % 7, ["i18n", "-{lang}", "i18n//{lang}", "a/{lang}.lock", "a@{{lang}", "b/{lang}/", "i18n/{lang}"])
    return t(spark, sf, "nation").select(k.alias("k"), text.branch(pattern, lang).alias("branch"))


@query("""SELECT c_custkey AS task_id, 'v1' || chr(10) || 'Resource: ' || name || chr(10) || chr(10) || 'Do ' || name || '.' || chr(10) || 'Source language: en' || chr(10) || 'Target language: ja' || chr(10) || 'Task ID: ' || c_custkey || chr(10) || 'Protected tokens: a, b' || chr(10) || 'ctx'
 || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || chr(10) || '--- PREVIOUS SOURCE ---' || chr(10) || 'old' || chr(10) || '--- END PREVIOUS SOURCE ---' || chr(10) || chr(10) || '--- PREVIOUS TRANSLATION ---' || chr(10) || 'alt' || chr(10) || '--- END PREVIOUS TRANSLATION ---' ELSE '' END
 || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || chr(10) || 'Findings:' || chr(10) || '- C: m' || chr(10) ELSE '' END || chr(10) || chr(10) || '--- SOURCE ---' || chr(10) || c_name || chr(10) || '--- END SOURCE ---' AS prompt
FROM (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN 'repair' WHEN c_custkey % 2 = 0 THEN 'revise' ELSE 'translate' END AS name FROM customer)""")
def prompts(spark, sf):
    k = F.col("c_custkey")
    finding = F.array(F.struct(F.lit("C").alias("code"), F.lit("m").alias("message")))
    old = lambda x: F.when(k % 2 == 0, x)
    tasks = t(spark, sf, "customer").select(k.alias("task_id"), F.when(k % 5 == 0, "repair").otherwise("translate").alias("stage"), F.lit("en").alias("source_language"), F.lit("ja").alias("target_language"), F.array(F.lit("a"), F.lit("b")).alias("tokens"), F.lit("ctx").alias("context"), old("old").alias("previous_source"), old("alt").alias("previous_translation"), F.when(k % 3 == 0, finding).otherwise(F.slice(finding, 1, 0)).alias("findings"), F.col("c_name").alias("source"))
    return tasks.select("task_id", planner.prompt("v1", {n: f"Do {n}." for n in ("translate", "revise", "repair")}).alias("prompt"))


@query("""SELECT l_orderkey, min('p' || l_linenumber) AS path, sha256('[' || string_agg('{"path":"p' || l_linenumber || '","content_hash":"' || l_partkey || '"}', ',' ORDER BY 'p' || l_linenumber, l_partkey::VARCHAR) || ']') AS manifest FROM lineitem GROUP BY 1""")
def project_checks(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_orderkey", F.concat(F.lit("p"), "l_linenumber").alias("path"), F.col("l_partkey").cast("string").alias("content_hash"))
    return planner.project_check(rows, ["l_orderkey"])


@query("""SELECT n_name, regexp_matches('i18n/' || n_name, '^i18n/(ALGERIA|CHINA)(/|$)') AS reserved, lower(n_name) = 'china' AS equal FROM nation""")
def path_rules(spark, sf):
    n = t(spark, sf, "nation")
    return n.select("n_name", text.reserved(F.concat(F.lit("i18n/"), "n_name"), ["i18n/ALGERIA", "i18n/CHINA"]).alias("reserved"), text.ascii_equal(F.col("n_name"), F.lit("cHiNa")).alias("equal"))


@query("""SELECT o_orderkey AS path FROM orders WHERE o_orderstatus = 'F' ORDER BY 1""")
def snapshot_listing(spark, sf):
    files = t(spark, sf, "orders").select(F.col("o_orderstatus").alias("revision"), F.col("o_orderkey").alias("path"))
    return discovery.ordered(discovery.snapshot(files, "F")).select("path")
