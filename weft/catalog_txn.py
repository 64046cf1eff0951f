"""Queries of the business transactions that write several tables: every row that a transaction stages, in all its tables, with the
requests it refused; importing this adds them to the catalog.

State is derived from the test tables, alike in both engines: documents and their lines are documents and units, a label means that a
document came in earlier, orders are canonical files with their entries, customers are publications.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import query, t
from .catalog_state import FP, VERSIONS, none
from .operators import state
from .operators import transactions as tx
from .streaming.tables import Tables

WORK = "work_item_id string, run_id string, unit_id string, document_id string, locale string, kind string, input string, status string, result string, created_at long"
MEMORY = "memory_id string, repository_id long, unit_id string, version_id string, locale string, source_hash string, source_revision string, context_key string, text string, tier string, provenance string, policy string, at long, superseded_at long"
CONTENTS = "content_version_id string, file_id string, source_revision string, content_hash string, content string"


def staged_rows(staged: tx.Staged, *refused: str) -> DataFrame:
    """All that is staged as (table, entry): an entry is its row's values in the order of the table; of refused requests the given columns."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    told = [df.select(F.lit(name).alias("table"), F.concat_ws("|", *[value(c) for c in df.columns]).alias("entry")) for name, df in staged.rows.items()]
    if staged.refused is not None:
        told.append(staged.refused.select(F.lit("refused").alias("table"), F.concat_ws("|", *[value(c) for c in (*refused, "refusal")]).alias("entry")))
    return reduce(DataFrame.union, told)


def table(df: DataFrame, schema: str, **values: Column) -> DataFrame:
    """df in the columns of a table: the given values, else the column of that name, else null."""
    fields = [f.split() for f in schema.split(", ")]
    return df.select(*[(values[c] if c in values else F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields])


def _rows(name: str, source: str, *values: str) -> str:
    """`staged_rows` of one table in SQL."""
    told = ", ".join(f"coalesce(({v})::VARCHAR, '-')" for v in values)
    return f"SELECT '{name}' AS \"table\", concat_ws('|', {told}) AS entry FROM {source}"


def _id(*xs: str) -> str:
    """`transactions.id_of` in SQL, nulls included."""
    return "substr(sha256(" + " || ".join(f"coalesce(octet_length(encode(({x})::VARCHAR)) || ':' || ({x})::VARCHAR, '-')" for x in xs) + "), 1, 16)"


# Documents and their lines. A labelled document came in before, a toxic one was deleted since but has its first line's new version and work.

PREPARED = f"""lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT documents.*, quality, toxic, lab.doc_id IS NOT NULL AS known, coalesce(source, '') || '/' || documents.doc_id || '.md' AS path, 'run-' || lang AS run_id,
 CASE WHEN n_chars > 20000 THEN '{{' ELSE '{{}}' END AS metadata, {_id("'document'", "1", "coalesce(source, '') || '/' || documents.doc_id || '.md'")} AS document_id FROM documents LEFT JOIN lab ON lab.doc_id = documents.doc_id),
u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM d),
x AS (SELECT d.*, line, n, 'l' || n AS unit_key, {_id("'unit'", "document_id", "'l' || n")} AS unit_id,
 CASE WHEN line <> '' THEN '{{"source_revision":"' || CASE WHEN quality = 0 THEN 'r1' ELSE 'r2' END || '","path":"' || path || '","unit":"l' || n || '"}}' END AS enqueue FROM d JOIN u USING (doc_id))"""


def _documents(spark, sf) -> DataFrame:
    labels = t(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).withColumn("known", F.lit(True))
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return t(spark, sf, "documents").join(labels, "doc_id", "left").select(
        "doc_id", "lang", "text", "n_chars", "quality", "toxic", "known", F.concat(F.lit("run-"), "lang").alias("run_id"), F.lit(1).cast("long").alias("repository_id"), path.alias("path"), F.lit("ja").alias("locale"), F.lit("r2").alias("source_revision"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.when(F.col("n_chars") > 20000, "{").otherwise("{}").alias("metadata"), F.col("doc_id").alias("at"), tx.id_of(F.lit("document"), F.lit(1), path).alias("document_id"),
    )


def _lines(docs: DataFrame) -> DataFrame:
    key = F.concat(F.lit("l"), F.col("n").cast("string"))
    revision = F.when(F.col("quality") == 0, "r1").otherwise("r2")
    work = F.to_json(F.struct(revision.alias("source_revision"), "path", key.alias("unit")))
    lines = docs.select("*", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return lines.select("*", key.alias("unit_key"), F.col("n").alias("ordinal"), F.col("line").alias("source_text"), F.sha2("line", 256).alias("source_hash"), F.lit("{}").alias("context"), F.when(F.col("line") != "", work).alias("enqueue"), tx.id_of(F.lit("unit"), F.col("document_id"), key).alias("unit_id"))


def _document_tables(spark, docs: DataFrame, lines: DataFrame) -> dict[str, DataFrame]:
    runs = docs.filter("run_id is not null").select("run_id", "lang").distinct().select("run_id", F.when(F.col("lang") == "de", 2).otherwise(1).cast("long").alias("repository_id"))
    known, first = docs.filter("known"), lines.filter("known and n = 0")
    version = lambda revision, hashed: tx.id_of(F.lit("unit_version"), F.col("unit_id"), revision, hashed)
    old, again = F.lit("old"), first.filter("toxic = 1")
    versions = "unit_version_id string, unit_id string, source_revision string, source_hash string, source_text string, context string"
    return {
        "runs": runs,
        "documents": table(known, "document_id string, repository_id long, path string, source_revision string, content_hash string, metadata string, created_at long, deleted_at long", source_revision=F.lit("r1"), content_hash=old, created_at=F.lit(1), deleted_at=F.when(F.col("toxic") == 1, 2)),
        "units": table(first, "unit_id string, document_id string, unit_key string, ordinal int, source_text string, source_hash string, context string, active boolean, created_at long", source_text=old, source_hash=old, active=F.lit(False), created_at=F.lit(1)),
        "unit_versions": table(first, versions, unit_version_id=version(F.lit("r1"), old), source_revision=F.lit("r1"), source_hash=old, source_text=old).union(table(again, versions, unit_version_id=version(F.lit("r2"), F.col("source_hash")))),
        "work_items": table(again.filter("enqueue is not null").withColumns({"document_id": none("string"), "kind": F.lit("pipeline"), "input": F.col("enqueue")}), WORK, work_item_id=tx.work_id(), status=F.lit("pending"), created_at=F.lit(1)),
    }


@query(f"""WITH {PREPARED},
r AS (SELECT d.*, CASE WHEN lang IS NULL OR lang = 'de' THEN 'RUN' WHEN metadata = '{{' THEN 'METADATA' WHEN quality = 0 AND EXISTS (SELECT 1 FROM x WHERE x.doc_id = d.doc_id AND enqueue IS NOT NULL) THEN 'WORK' END AS refusal FROM d),
g AS (SELECT x.* FROM x JOIN r USING (doc_id) WHERE refusal IS NULL)
{_rows("documents", "r WHERE refusal IS NULL", "document_id", "1", "path", "'r2'", "sha256(coalesce(text, ''))", "metadata", "CASE WHEN known THEN 1 ELSE doc_id END", "NULL")}
UNION ALL {_rows("units", "g", "unit_id", "document_id", "unit_key", "n", "line", "sha256(line)", "'{}'", "true", "CASE WHEN known AND n = 0 THEN 1 ELSE doc_id END")}
UNION ALL {_rows("unit_versions", "g WHERE NOT (coalesce(toxic, 0) = 1 AND n = 0)", _id("'unit_version'", "unit_id", "'r2'", "sha256(line)"), "unit_id", "'r2'", "sha256(line)", "line", "'{}'")}
UNION ALL {_rows("work_items", "g WHERE enqueue IS NOT NULL AND NOT (coalesce(toxic, 0) = 1 AND n = 0)", _id("'work'", "run_id", "unit_id", "NULL", "'ja'", "'pipeline'", "enqueue"), "run_id", "unit_id", "NULL", "'ja'", "'pipeline'", "enqueue", "'pending'", "NULL", "doc_id")}
UNION ALL {_rows("refused", "r WHERE refusal IS NOT NULL", "path", "refusal")}""")
def txn_prepare(spark, sf):
    docs = _documents(spark, sf)
    lines = _lines(docs)
    asked = docs.select("run_id", "repository_id", "path", "locale", "source_revision", "content_hash", "metadata", "at")
    units = lines.select("repository_id", "path", "unit_key", "ordinal", "source_text", "source_hash", "context", "enqueue")
    return staged_rows(tx.prepare(_document_tables(spark, docs, lines), asked, units), "path")


TARGET = "coalesce(text, '') || '!'"
PLACE = ("1", "'ja'", "source_hash", "''")


@query(f"""WITH {PREPARED},
r AS (SELECT d.*, {_id("'file'", "1", "'ja'", "'ja/' || path")} AS file_id, sha256({TARGET}) AS target_hash, CASE WHEN n_chars < 40 THEN 'POLICY' WHEN toxic = 1 THEN 'HASH' WHEN lang IS NULL OR lang = 'de' THEN 'RUN' WHEN metadata = '{{' THEN 'METADATA' END AS refusal FROM d),
g AS (SELECT x.*, sha256(line) AS source_hash FROM x JOIN r USING (doc_id) WHERE refusal IS NULL),
f AS (SELECT *, {_id("'content'", "file_id", "'r2'", "target_hash")} AS content_id, '{{"status":"adopted","content_hash":"' || target_hash || '"}}' AS said FROM r WHERE refusal IS NULL),
h AS (SELECT 'm' || doc_id AS memory_id, unit_id, 'v' || doc_id AS version_id, sha256(line) AS source_hash, CASE WHEN toxic = 1 THEN 'old' ELSE line || '?' END AS text FROM x WHERE quality = 1 AND n = 0),
w AS (SELECT source_hash, line || '?' AS text, doc_id AS tm, unit_id FROM (SELECT *, row_number() OVER (PARTITION BY source_hash ORDER BY doc_id DESC, unit_id DESC) AS nth FROM g) WHERE nth = 1),
n AS (SELECT w.*, {_id("'trusted'", *PLACE, "text", "tm")} AS version_id, {_id("'memory'", "'trusted'", *PLACE, "tm")} AS memory_id FROM w WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.source_hash = w.source_hash AND h.text = w.text))
{_rows("documents", "f", "document_id", "1", "path", "'r2'", "sha256(coalesce(text, ''))", "metadata", "CASE WHEN known THEN 1 ELSE doc_id END", "NULL")}
UNION ALL {_rows("units", "g", "unit_id", "document_id", "unit_key", "n", "line", "source_hash", "'{}'", "true", "CASE WHEN known AND n = 0 THEN 1 ELSE doc_id END")}
UNION ALL {_rows("unit_versions", "g", _id("'unit_version'", "unit_id", "'r2'", "source_hash"), "unit_id", "'r2'", "source_hash", "line", "'{}'")}
UNION ALL {_rows("work_items", "f, (SELECT unnest(['assembly', 'materialization']) AS kind)", _id("'work'", "run_id", "NULL", "document_id", "'ja'", "kind", "metadata"), "run_id", "NULL", "document_id", "'ja'", "kind", "metadata", "'succeeded'", "said", "doc_id")}
UNION ALL {_rows("versions", "n", "version_id", _id("'unit_version'", "unit_id", "'r2'", "source_hash"), "'ja'", "text", "'trusted_tm'", "'passed'", "'approved'", "'candidate'", f"'{FP}'", "NULL", "NULL")}
UNION ALL {_rows("memory", "n", "memory_id", "1", "unit_id", "version_id", "'ja'", "source_hash", "'r2'", "''", "text", "'trusted'", "'human_adopted'", f"'{FP}'", "tm", "NULL")}
UNION ALL {_rows("memory", "h JOIN n USING (source_hash)", "h.memory_id", "1", "h.unit_id", "h.version_id", "'ja'", "source_hash", "'r1'", "''", "h.text", "'history'", "'model'", f"'{FP}'", "1", "tm")}
UNION ALL {_rows("files", "f", "file_id", "1", "'ja'", "'ja/' || path", "content_id", "'r2'", TARGET, "target_hash", "target_hash", "'adopted'", "'exact'", "'human'", "'passed'", "'approved'", "'candidate'", "'trusted'")}
UNION ALL {_rows("content_versions", "f", "content_id", "file_id", "'r2'", "target_hash", TARGET)}
UNION ALL {_rows("refused", "r WHERE refusal IS NOT NULL", "path", "refusal")}""")
def txn_adopt(spark, sf):
    docs = _documents(spark, sf)
    lines = _lines(docs)
    target = F.concat(F.coalesce("text", F.lit("")), F.lit("!"))
    asked = docs.select(
        "run_id", "repository_id", "path", "locale", "source_revision", "content_hash", "metadata", "at", F.concat(F.lit("ja/"), "path").alias("target_path"), target.alias("content"),
        F.when(F.col("toxic") == 1, "bad").otherwise(F.sha2(target, 256)).alias("target_hash"), F.when(F.col("n_chars") < 40, "none").otherwise(FP).alias("policy"),
    )
    said = F.concat("line", F.lit("?"))
    units = lines.select("repository_id", "path", "unit_key", "ordinal", "source_text", "source_hash", "context", said.alias("target_text"), F.lit("").alias("context_key"))
    tables = _document_tables(spark, docs, lines)
    tables["memory"] = table(lines.filter("quality = 1 and n = 0"), MEMORY, memory_id=F.concat(F.lit("m"), "doc_id"), version_id=F.concat(F.lit("v"), "doc_id"), source_revision=F.lit("r1"), context_key=F.lit(""), text=F.when(F.col("toxic") == 1, "old").otherwise(said), tier=F.lit("trusted"), provenance=F.lit("model"), policy=F.lit(FP), at=F.lit(1))
    # neither a version nor a file is there yet; a document's toxic first line has its version, but its request is refused
    tables |= {name: spark.createDataFrame([], schema) for name, schema in (("versions", VERSIONS), ("files", tx.FILES), ("content_versions", CONTENTS))}
    return staged_rows(tx.adopt(tables, asked, units), "path")


# Orders as canonical files, each with an entry and its work.

FILE = ("'f' || o_orderkey", "1", "'ja'", "'p' || o_orderkey", "'cv' || o_orderkey", "'r1'", "'c' || o_orderkey", "digest")
ENTRY = ("'o' || o_orderkey", "'w' || o_orderkey", "'r'", "1", "'d'", "'ja'", "'p' || o_orderkey", "'k' || o_orderkey", "payload", "'done'")
ENTRIES = """b AS (SELECT *, sha256('c' || o_orderkey) AS digest, o_totalprice > 400000 AS stale, CASE o_orderpriority WHEN '1-URGENT' THEN 'write' ELSE 'discard' END AS operation FROM orders),
e AS (SELECT *, '{"operation":"' || operation || '","canonical_content_version_id":"cv' || o_orderkey || '","canonical_file_id":"f' || o_orderkey || '","content_hash":"' || CASE WHEN stale THEN 'stale' ELSE digest END || '"}' AS payload FROM b)"""


def _entries(spark, sf) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Orders with what requests name, and the tables: done entries (F), ones in work by the customer (O), pending ones (P)."""
    led = lambda mark, c="o_orderkey": F.concat(F.lit(mark), F.col(c).cast("string"))
    o = t(spark, sf, "orders").withColumns({
        "outbox_id": led("o"), "work_item_id": led("w"), "file_id": led("f"), "content_version_id": led("cv"), "path": led("p"), "content": led("c"), "dedupe_key": led("k"), "repository_id": F.lit(1).cast("long"), "locale": F.lit("ja"), "run_id": F.lit("r"),
        "document_id": F.lit("d"), "source_revision": F.lit("r1"), "at": F.col("o_orderkey"), "holder": led("materialize:", "o_custkey"),
    }).withColumn("content_hash", F.sha2("content", 256))
    status = F.col("o_orderstatus")
    operation = F.when(F.col("o_orderpriority") == "1-URGENT", "write").otherwise("discard")
    payload = F.to_json(F.struct(operation.alias("operation"), F.col("content_version_id").alias("canonical_content_version_id"), F.col("file_id").alias("canonical_file_id"), F.when(F.col("o_totalprice") > 400000, "stale").otherwise(F.col("content_hash")).alias("content_hash")))
    fresh = {"state": "verified", "freshness": "exact", "provenance": "generated", "validation_state": "passed", "review_state": "unreviewed", "publication_state": "candidate", "trust_tier": "candidate"}
    return o, {
        "files": table(o, tx.FILES, **{c: F.lit(v) for c, v in fresh.items()}),
        "outbox": table(o, tx.OUTBOX, payload=payload, state=F.when(status == "F", "done").when(status == "O", "processing").otherwise("pending"), owner=F.when(status == "O", F.col("holder")), owner_alive=F.lit(True), lease_expires_at=F.lit(99), available_at=F.lit(0)),
        "work_items": table(o, WORK, kind=F.lit("materialization"), input=F.lit("{}"), status=F.lit("pending"), created_at=F.lit(0)),
    }


@query(f"""WITH {ENTRIES},
q AS (SELECT *, CASE o_orderpriority WHEN '2-HIGH' THEN NULL WHEN '4-NOT SPECIFIED' THEN 'human_edit' ELSE 'materialized' END AS move, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'edited' WHEN o_orderpriority = '5-LOW' AND o_totalprice < 100000 THEN 'other' ELSE digest END AS new_hash FROM e),
r AS (SELECT *, CASE WHEN o_orderstatus <> 'O' OR o_orderpriority = '1-URGENT' THEN 'OWNER' WHEN move IS NOT NULL AND stale THEN 'CONTENT' WHEN move = 'materialized' AND new_hash <> digest THEN 'BYTES' WHEN o_totalprice < 20000 THEN 'RESULT' END AS refusal FROM q),
g AS (SELECT * FROM r WHERE refusal IS NULL)
{_rows("files", "g WHERE move IS NOT NULL", *FILE, "new_hash", "move", "'exact'", "'generated'", "'passed'", "CASE move WHEN 'human_edit' THEN 'needs_review' ELSE 'unreviewed' END", "'candidate'", "'candidate'")}
UNION ALL {_rows("work_items", "g", "'w' || o_orderkey", "'r'", "NULL", "'d'", "'ja'", "'materialization'", "'{}'", "CASE o_orderpriority WHEN '2-HIGH' THEN 'failed' ELSE 'succeeded' END", "'{}'", "0")}
UNION ALL {_rows("outbox", "g", *ENTRY, "NULL", "true", "NULL", "0", "NULL", "o_orderkey")}
UNION ALL {_rows("refused", "r WHERE refusal IS NOT NULL", "'o' || o_orderkey", "refusal")}""")
def txn_settle(spark, sf):
    o, tables = _entries(spark, sf)
    is_ = lambda p: F.col("o_orderpriority") == p
    asked = o.select(
        "outbox_id", F.when(is_("1-URGENT"), "thief").otherwise(F.col("holder")).alias("owner"), "work_item_id", "file_id", F.when(is_("4-NOT SPECIFIED"), "human_edit").when(~is_("2-HIGH"), "materialized").alias("move"),
        F.when(is_("4-NOT SPECIFIED"), "edited").when(is_("5-LOW") & (F.col("o_totalprice") < 100000), "other").otherwise(F.col("content_hash")).alias("new_hash"), (~is_("2-HIGH")).alias("succeeded"),
        F.when(F.col("o_totalprice") < 20000, "{").otherwise("{}").alias("result"), "at",
    )
    return staged_rows(tx.settle(tables, asked), "outbox_id")


@query(f"""WITH {ENTRIES}, r AS (SELECT *, CASE WHEN o_orderstatus <> 'P' OR operation <> 'discard' OR stale OR (o_orderpriority = '5-LOW' AND o_totalprice < 100000) THEN 'RECEIPT' END AS refusal FROM e),
g AS (SELECT * FROM r WHERE refusal IS NULL)
{_rows("files", "g", *FILE, "digest", "'materialized'", "'exact'", "'generated'", "'passed'", "'unreviewed'", "'candidate'", "'candidate'")}
UNION ALL {_rows("work_items", "g", "'w' || o_orderkey", "'r'", "NULL", "'d'", "'ja'", "'materialization'", "'{}'", "'succeeded'", """'{"status":"discarded","content_hash":"' || digest || '"}'""", "0")}
UNION ALL {_rows("outbox", "g", *ENTRY, "NULL", "true", "99", "0", "NULL", "o_orderkey")}
UNION ALL {_rows("refused", "r WHERE refusal IS NOT NULL", "'o' || o_orderkey", "refusal")}""")
def txn_complete_discard(spark, sf):
    o, tables = _entries(spark, sf)
    strange = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_totalprice") < 100000)
    asked = o.select("outbox_id", F.when(strange, "another").otherwise(F.col("work_item_id")).alias("work_item_id"), "file_id", "content_hash", "at")
    return staged_rows(tx.complete_discard(tables, asked), "outbox_id")


@query(f"""WITH {ENTRIES},
p AS (SELECT *, CASE WHEN c_mktsegment = 'BUILDING' THEN 'MANIFEST' END AS refusal FROM customer WHERE c_acctbal > 0),
g AS (SELECT e.*, c_custkey FROM e JOIN p ON c_custkey = o_custkey WHERE refusal IS NULL),
m AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS top FROM g WHERE o_orderstatus <> 'P')
{_rows("manifests", "p WHERE refusal IS NULL", "'mf' || c_custkey", "1", "'r'", "'ja'", "'r1'", "'c' || c_custkey", f"'{FP}'", "'a' || c_custkey", "'merged'", "0")}
UNION ALL {_rows("files", "g WHERE NOT stale", *FILE, "NULL", "'merged'", "'exact'", "'generated'", "'passed'", "'approved'", "'merged'", "'trusted'")}
UNION ALL {_rows("memory", "m WHERE top OR o_orderstatus = 'F'", "'m' || o_orderkey", "1", "'u' || o_custkey", "'v' || o_orderkey", "'ja'", "'h' || o_custkey", "'r1'", "''", "'t' || o_orderkey", "CASE WHEN top THEN 'trusted' ELSE 'history' END", "'model'", f"'{FP}'", "o_orderkey", "CASE WHEN NOT top THEN o_custkey END")}
UNION ALL {_rows("refused", "p WHERE refusal IS NOT NULL", "'c' || c_custkey", "refusal")}""")
def txn_promote(spark, sf):
    o, tables = _entries(spark, sf)
    c = t(spark, sf, "customer").withColumns({"commit": F.concat(F.lit("c"), "c_custkey"), "repository_id": F.lit(1).cast("long"), "locale": F.lit("ja"), "at": F.col("c_custkey")})
    led = lambda mark, k: F.concat(F.lit(mark), F.col(k).cast("string"))
    tables["manifests"] = table(c, tx.MANIFESTS, manifest_id=led("mf", "c_custkey"), run_id=F.lit("r"), source_revision=F.lit("r1"), policy=F.lit(FP), authorization_key=led("a", "c_custkey"), state=F.when(F.col("c_mktsegment") == "BUILDING", "superseded").otherwise("pr_open"), at=F.lit(0))
    tables["manifest_files"] = o.select(led("mf", "o_custkey").alias("manifest_id"), "content_version_id", "file_id", "content_hash")
    # what was published of a dear order is no longer its current content, so the file stays as it is
    newer = F.when(F.col("o_totalprice") > 400000, "newer").otherwise(F.col("content_version_id"))
    tables["files"] = tables["files"].join(o.select("file_id", newer.alias("now")), "file_id").withColumn("content_version_id", F.col("now")).select(*tables["files"].columns)
    tables["links"] = o.select("content_version_id", led("v", "o_orderkey").alias("version_id"))
    tier = F.when(F.col("o_orderstatus") == "F", "trusted").otherwise("candidate")
    tables["memory"] = table(o, MEMORY, memory_id=led("m", "o_orderkey"), unit_id=led("u", "o_custkey"), version_id=led("v", "o_orderkey"), source_hash=led("h", "o_custkey"), context_key=F.lit(""), text=led("t", "o_orderkey"), tier=tier, provenance=F.lit("model"), policy=F.lit(FP), superseded_at=F.when(F.col("o_orderstatus") == "P", 1))
    return staged_rows(tx.promote(tables, c.filter("c_acctbal > 0").select("repository_id", "locale", "commit", "at")), "commit")


PULLS = "repository_id long, provider string, external_id string, head_revision string, state string, at long"
PULL_EVENTS = "repository_id long, provider string, external_id string, event_key string, from_state string, to_state string, at long"


@query(f"""WITH v AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events)
{_rows("pr_events", "v", "1", "'g'", "user_id", "'e' || event_id", "was", "event_type", "event_id")} UNION ALL {_rows("pull_requests", "v WHERE nth = 1", "1", "'g'", "user_id", "'c' || event_id", "event_type", "event_id")}""")
def stream_pull_requests(spark, sf):
    """Events as a stream of pull requests' states into tables; the stream is then started again, which must change nothing."""
    path = state.shared_folder(spark, "pulls")
    key = ["repository_id", "provider", "external_id"]
    held = Tables(spark, f"{path}/state", {"pull_requests": PULLS, "pr_events": PULL_EVENTS}, {"pull_requests": key, "pr_events": [*key, "event_key"]}).create()
    events = t(spark, sf, "events")
    # a stream takes a single file only where its path is a pattern
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parque[t]")
    n = F.col("event_id")
    asked = stream.select(F.lit(1).cast("long").alias("repository_id"), F.lit("g").alias("provider"), F.col("user_id").cast("string").alias("external_id"), F.concat(F.lit("c"), n.cast("string")).alias("head_revision"), F.col("event_type").alias("state"), F.concat(F.lit("e"), n.cast("string")).alias("event_key"), n.alias("at"))
    for _ in range(2):
        held.follow(asked, tx.record_pulls, f"{path}/checkpoint").awaitTermination()
    rows = {"pr_events": held.versions("pr_events").drop("n"), "pull_requests": held.current("pull_requests").select(*[f.split()[0] for f in PULLS.split(", ")])}
    return staged_rows(tx.Staged(rows))
