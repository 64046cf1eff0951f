"""Queries over the test tables that show each operator at work, with the SQL that says the same.

A previous revision of the corpus is derived from the current one by the digests of its lines, alike in both engines:
a line whose digest begins with 0 was not there, one with 1 read differently (an x in front), and one with 2 stood ten places later.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import hashing, text
from .operators import filesets, matching, protect, running, segment, state
from .plans import planner, report
from .sources import discovery
from .streaming import queue

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _units(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return segment.prose_units(t(spark, sf, "documents"), *more)


# The same units in SQL: (doc_id, ordinal, source, norm).
UNITS = r"""
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS source, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS ordinal, source, trim(regexp_replace(source, '\s+', ' ', 'g')) AS norm FROM lines WHERE regexp_matches(source, '\S'))"""
FP = "substr(sha256('Paragraph' || chr(0) || norm), 1, 16)"
H2 = lambda *xs: "sha256(" + " || ".join(f"unhex(lpad(hex(octet_length(encode({x}))), 16, '0')) || encode({x})" for x in xs) + ")"


@query(rf"""WITH {UNITS} SELECT doc_id, count(*) AS n_units, sum(length(norm))::BIGINT AS n_chars, max(length(norm))::BIGINT AS longest FROM units GROUP BY doc_id""")
def unit_segments(spark, sf):
    n = F.char_length("norm").cast("long")
    return _units(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_units"), F.sum(n).alias("n_chars"), F.max(n).alias("longest"))


@query(rf"""WITH {UNITS}, f AS (SELECT lang, {FP} AS fp FROM units JOIN documents USING (doc_id)), g AS (SELECT lang, fp, count(*) AS n FROM f GROUP BY ALL)
SELECT lang, sum(n)::BIGINT AS n_units, count(*) AS n_distinct, min(fp) AS least_fp, max(fp) AS greatest_fp FROM g GROUP BY lang""")
def unit_fingerprints(spark, sf):
    by = segment.fingerprinted(_units(spark, sf, "lang")).groupBy("lang", "fp").agg(F.count("*").alias("n"))
    return by.groupBy("lang").agg(F.sum("n").alias("n_units"), F.count("*").alias("n_distinct"), F.min("fp").alias("least_fp"), F.max("fp").alias("greatest_fp"))


@query(rf"""WITH {UNITS} SELECT {FP} AS fp, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM units GROUP BY 1 HAVING count(*) > 1""")
def duplicate_units(spark, sf):
    # a row for each unit and document first, so that a frequent unit's documents are not gathered
    by = segment.fingerprinted(_units(spark, sf)).groupBy("fp", "doc_id").agg(F.count("*").alias("m"))
    return by.groupBy("fp").agg(F.sum("m").alias("n"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query(rf"""WITH {UNITS}, f AS (SELECT doc_id, ordinal, {FP} AS fp FROM units),
n AS (SELECT *, printf('md-%s-%02d', fp, row_number() OVER (PARTITION BY doc_id, fp ORDER BY ordinal) - 1) AS unit_id FROM f)
SELECT doc_id, ordinal, unit_id, 'unit-' || substr({H2("doc_id::VARCHAR", "unit_id", "ordinal::VARCHAR")}, 1, 24) AS stable_id FROM n""")
def unit_ids(spark, sf):
    return segment.with_ids(segment.fingerprinted(_units(spark, sf))).select("doc_id", "ordinal", "unit_id", "stable_id")


@query(rf"""SELECT 'documents' AS origin, p AS value, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{text.PLACEHOLDER}')) AS p FROM documents) GROUP BY ALL
UNION ALL SELECT 'pages', p, count(*) FROM (SELECT unnest(regexp_extract_all(html, '{text.PLACEHOLDER}')) AS p FROM pages) GROUP BY ALL""")
def placeholder_values(spark, sf):
    out = None
    for name, column in (("documents", "text"), ("pages", "html")):
        values = t(spark, sf, name).select(F.explode(text.placeholders(F.col(column))).alias("value"))
        part = values.groupBy("value").agg(F.count("*").alias("n")).select(F.lit(name).alias("origin"), "value", "n")
        out = part if out is None else out.union(part)
    return out


@query(rf"""WITH {UNITS}, p AS (SELECT doc_id, ordinal, regexp_extract_all(source, '{text.PLACEHOLDER}') AS vs FROM units),
q AS (SELECT doc_id, ordinal, unnest(vs) AS value, generate_subscripts(vs, 1) - 1 AS i FROM p)
SELECT doc_id, ordinal, i::INT AS i, value, printf('@@WEFT_PLACEHOLDER_%04d_%s@@', i, substr(sha256(value), 1, 16)) AS token FROM q""")
def token_mint(spark, sf):
    return protect.spans(_units(spark, sf))


@query(rf"""WITH {UNITS} SELECT doc_id, count(*) AS n_units, count(*) AS n_restored, 0::BIGINT AS n_findings
FROM units WHERE len(regexp_extract_all(source, '{text.PLACEHOLDER}')) > 0 GROUP BY doc_id""")
def token_round_trip(spark, sf):
    tokens = protect.tokens_of(F.col("source"))
    units = _units(spark, sf).withColumn("tokens", tokens).filter(F.size("tokens") > 0).withColumn("masked", protect.tokenize(F.col("source"), F.col("tokens")))
    back, bad = protect.restore(F.col("masked"), F.col("tokens")) == F.col("source"), F.size(protect.unit_findings(F.col("source"), F.col("masked"), F.col("tokens")))
    return units.groupBy("doc_id").agg(F.count("*").alias("n_units"), F.sum(back.cast("long")).alias("n_restored"), F.sum(bad.cast("long")).alias("n_findings"))


@query("""WITH s AS (SELECT l_orderkey AS k, l_linenumber AS nth, l_partkey % 40 AS a, l_partkey % 40 + 1 + l_suppkey % 12 AS b FROM lineitem),
w AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b DESC, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT k, nth, a AS "start", b AS "end", coalesce(a < reach, false) AS crossing FROM w WHERE reach IS NULL OR b > reach""")
def interval_normalize(spark, sf):
    spans = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("nth"), (F.col("l_partkey") % 40).alias("start"), (F.col("l_partkey") % 40 + 1 + F.col("l_suppkey") % 12).alias("end"))
    return protect.normalize(spans, ["k"])


def _previous(units: DataFrame) -> DataFrame:
    mark = F.substring(F.sha2("norm", 256), 1, 1)
    old = units.withColumn("_m", mark).filter("_m <> '0'")
    edit = lambda c: F.when(F.col("_m") == "1", F.concat(F.lit("x"), c)).otherwise(F.col(c))
    return old.select("doc_id", F.when(F.col("_m") == "2", F.col("ordinal") + 10).otherwise(F.col("ordinal")).alias("ordinal"), edit("source").alias("source"), edit("norm").alias("norm"), (F.col("_m") != "3").alias("trusted"))


PREVIOUS = rf"""{UNITS}, marked AS (SELECT *, substr(sha256(norm), 1, 1) AS m FROM units),
previous AS (SELECT doc_id, CASE WHEN m = '2' THEN ordinal + 10 ELSE ordinal END AS ordinal, CASE WHEN m = '1' THEN 'x' || source ELSE source END AS source,
 CASE WHEN m = '1' THEN 'x' || norm ELSE norm END AS norm, m <> '3' AS trusted FROM marked WHERE m <> '0')"""
MATCHED = rf"""{PREVIOUS}, once AS (SELECT doc_id, norm, count(*) AS n, min(ordinal) AS p_ordinal, min(source) AS p_source, bool_and(trusted) AS p_trusted FROM previous GROUP BY ALL),
matched AS (SELECT u.doc_id, u.ordinal, CASE WHEN n IS NULL THEN 'no_text_match' WHEN n > 1 THEN 'ambiguous' WHEN p_ordinal = u.ordinal THEN 'exact' ELSE 'moved' END AS kind,
 coalesce(n = 1 AND p_trusted AND u.source = p_source, false) AS trusted_reuse FROM units u LEFT JOIN once o ON u.doc_id = o.doc_id AND u.norm = o.norm)"""


def _matched(spark, sf) -> DataFrame:
    units = _units(spark, sf)
    return matching.by_text(_previous(units), units)


@query(f"WITH {MATCHED} SELECT * FROM matched")
def match_by_text(spark, sf):
    return _matched(spark, sf)


@query(f"""WITH {MATCHED}, b AS (SELECT doc_id, bool_or(kind = 'ambiguous') AS bad FROM matched GROUP BY doc_id)
SELECT kind, bad AS dropped, count(*) AS n FROM matched JOIN b USING (doc_id) GROUP BY ALL""")
def match_whole_documents(spark, sf):
    return matching.by_documents(_matched(spark, sf)).groupBy("kind", "dropped").agg(F.count("*").alias("n"))


@query()
def match_in_order(spark, sf):
    """The whole sequential rule; its results are tested against a plain reading of it."""
    whole = lambda df: df.withColumns({"unit_kind": F.lit("Paragraph"), "context": F.lit(""), "stable_id": hashing.stable_id(F.col("doc_id"), F.col("norm"), F.col("ordinal"))})
    units = _units(spark, sf)
    return matching.in_order(whole(_previous(units)), whole(units.withColumn("trusted", F.lit(True))))


# SQL counts edits in bytes: every character beyond ASCII becomes one of the control characters first, so that both count characters.
@query(f"""WITH {MATCHED}, odd AS (SELECT string_agg(c, '' ORDER BY c) AS a, string_agg(chr(n), '' ORDER BY c) AS b FROM (SELECT c, (row_number() OVER (ORDER BY c) + 13)::INT AS n
  FROM (SELECT DISTINCT unnest(string_split(norm, '')) AS c FROM (SELECT norm FROM units UNION ALL SELECT norm FROM previous)) WHERE unicode(c) > 127)),
c AS (SELECT doc_id, ordinal, translate(norm, a, b) AS x FROM units u JOIN matched m USING (doc_id, ordinal), odd WHERE kind = 'no_text_match'),
p AS (SELECT doc_id, ordinal, translate(norm, a, b) AS y FROM previous, odd),
near AS (SELECT c.doc_id, c.ordinal, p.ordinal AS p_ordinal, x, y, greatest(length(x), length(y)) AS longer FROM c JOIN p ON c.doc_id = p.doc_id
  WHERE abs(length(x) - length(y)) <= {1 - text.LEAST_SIMILARITY!r} * greatest(length(x), length(y)) + 1e-9),
s AS (SELECT doc_id, ordinal, p_ordinal, {text.TEXT_WEIGHT}::DOUBLE * (1::DOUBLE - levenshtein(y, x)::DOUBLE / longer) + {text.PLACE_WEIGHT}::DOUBLE / (1::DOUBLE + abs(p_ordinal - ordinal)) AS score FROM near),
r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS next FROM s WHERE score >= {text.FUZZY_FLOOR}::DOUBLE WINDOW w AS (PARTITION BY doc_id, ordinal ORDER BY score DESC, p_ordinal))
SELECT doc_id, ordinal, p_ordinal, round(score, 9) AS score, coalesce(score - next < {text.MARGIN}::DOUBLE, false) AS ambiguous FROM r WHERE rank = 1""")
def match_fuzzy(spark, sf):
    # read several times, and split and normalised once
    units = state.keep(_units(spark, sf).drop("source"))
    old = _previous(units.withColumn("source", F.col("norm")))
    found = matching.fuzzy(old, matching.unmatched(old, units))
    state.drop(units)
    return found


@query("""WITH c AS (SELECT role, turn, text, row_number() OVER (PARTITION BY role, turn ORDER BY conv_id) AS rn, conv_id FROM conversations),
p AS (SELECT role, turn, row_number() OVER (PARTITION BY role, turn ORDER BY conv_id) AS rn, CASE WHEN substr(sha256(text), 1, 1) = '1' THEN text || '.' ELSE text END AS p_text FROM conversations WHERE substr(sha256(text), 1, 1) <> '0')
SELECT c.role, c.turn, c.conv_id, CASE WHEN p_text IS NULL THEN 'new' WHEN text = p_text THEN 'exact' ELSE 'fuzzy' END AS kind, coalesce(text = p_text, false) AS trusted_reuse
FROM c LEFT JOIN p ON c.role = p.role AND c.turn = p.turn AND c.rn = p.rn""")
def match_keyed(spark, sf):
    rows = t(spark, sf, "conversations").withColumnRenamed("text", "source")
    mark = F.substring(F.sha2("source", 256), 1, 1)
    old = rows.filter(mark != "0").withColumn("source", F.when(mark == "1", F.concat("source", F.lit("."))).otherwise(F.col("source"))).withColumn("trusted", F.lit(True))
    return matching.keyed(old, rows, ["role", "turn"], "conv_id").select("role", "turn", "conv_id", "kind", "trusted_reuse")


@query(f"""WITH {MATCHED}, s AS (SELECT lang, count(DISTINCT doc_id) AS documents, count(*) FILTER (NOT trusted_reuse AND kind <> 'ambiguous') AS open,
 count(*) FILTER (trusted_reuse) AS reused, count(*) FILTER (kind = 'ambiguous') AS conflicts FROM matched JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, documents, least(open, 40) AS pending, reused, conflicts, greatest(open - 40, 0) AS deferred FROM s""")
def plan_summary(spark, sf):
    plan = _matched(spark, sf).join(t(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return planner.summary(plan, ["lang"], 40)


@query(f"""WITH {MATCHED}, p AS (SELECT *, row_number() OVER (ORDER BY doc_id, ordinal) AS n FROM matched WHERE NOT trusted_reuse)
SELECT doc_id, ordinal, kind, n <= 40 AS scheduled FROM p""")
def plan_budget(spark, sf):
    return planner.budgeted(_matched(spark, sf).filter("not trusted_reuse"), ["doc_id", "ordinal"], 40).select("doc_id", "ordinal", "kind", "scheduled")


@query(f"""WITH {MATCHED}, p AS (SELECT lang, doc_id, ordinal, trusted_reuse, sum((NOT trusted_reuse)::INT) OVER (PARTITION BY lang ORDER BY doc_id, ordinal) AS n FROM matched JOIN documents USING (doc_id))
SELECT lang, doc_id, ordinal, trusted_reuse, trusted_reuse OR n <= 40 AS enqueue FROM p""")
def plan_enqueued(spark, sf):
    plan = _matched(spark, sf).join(t(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return planner.enqueued(plan, ["lang"], ["doc_id", "ordinal"], running.pieces("doc_id", 256), 40, True).select("lang", "doc_id", "ordinal", "trusted_reuse", "enqueue")


@query("""WITH s AS (SELECT o_orderkey AS id, sha256(o_orderpriority) AS canonical, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE sha256(o_orderstatus) END AS materialized,
 CASE o_orderstatus WHEN 'F' THEN sha256(o_orderpriority) WHEN 'O' THEN sha256(o_orderstatus) END AS actual FROM orders)
SELECT id, actual IS DISTINCT FROM canonical AND actual IS DISTINCT FROM materialized AS human_edit,
 CASE WHEN actual IS NOT DISTINCT FROM canonical THEN 'already_current' WHEN actual IS NOT DISTINCT FROM materialized THEN 'written' ELSE 'human_edit' END AS outcome FROM s""")
def human_edits(spark, sf):
    status = F.col("o_orderstatus")
    s = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.sha2("o_orderpriority", 256).alias("canonical"), F.when(status != "P", F.sha2(status, 256)).alias("materialized"), F.when(status == "F", F.sha2("o_orderpriority", 256)).when(status == "O", F.sha2(status, 256)).alias("actual"))
    a, c, m = F.col("actual"), F.col("canonical"), F.col("materialized")
    return s.select("id", planner.human_edit(a, c, m).alias("human_edit"), planner.write_outcome(c, m, a).alias("outcome"))


@query("""WITH b AS (SELECT url AS path, min(page_id) AS h FROM pages WHERE length(html) > 1500 GROUP BY url), n AS (SELECT url AS path, max(page_id) AS h FROM pages WHERE length(html) < 6000 GROUP BY url)
SELECT coalesce(b.path, n.path) AS path, CASE WHEN b.path IS NULL THEN 'add' WHEN n.path IS NULL THEN 'delete' WHEN b.h <> n.h THEN 'modify' ELSE 'same' END AS change FROM b FULL JOIN n ON b.path = n.path""")
def tree_changes(spark, sf):
    pages = t(spark, sf, "pages")
    side = lambda keep, f: pages.filter(keep).groupBy(F.col("url").alias("path")).agg(f("page_id").alias("content_hash"))
    return planner.changes(side(F.char_length("html") > 1500, F.min), side(F.char_length("html") < 6000, F.max))


@query("""SELECT o_custkey, max(o_orderkey) AS newest, arg_max(o_orderpriority, o_orderkey) AS priority, count(*) AS n FROM orders GROUP BY o_custkey""")
def history_latest(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("newest"), F.max_by("o_orderpriority", "o_orderkey").alias("priority"), F.count("*").alias("n"))


@query("""SELECT c_custkey, o_orderkey, o_orderpriority FROM customer LEFT JOIN
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderdate DESC, o_orderkey DESC) AS n FROM orders) o ON c_custkey = o_custkey AND n = 1""")
def candidate_top1(spark, sf):
    orders = t(spark, sf, "orders")
    first = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc(F.col("o_orderstatus") == "F"), F.desc("o_orderdate"), F.desc("o_orderkey")))
    top = orders.withColumn("n", first).filter("n = 1").select("o_custkey", "o_orderkey", "o_orderpriority")
    return t(spark, sf, "customer").join(top, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_orderpriority")


@query("""WITH s AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'merged' WHEN '2-HIGH' THEN 'pr_open' WHEN '3-MEDIUM' THEN 'push_pending' WHEN '4-NOT SPECIFIED' THEN 'commit_created' ELSE 'prepared' END AS state FROM orders)
SELECT o_custkey, arg_max(state, (CASE state WHEN 'merged' THEN 5 WHEN 'pr_open' THEN 4 WHEN 'push_pending' THEN 3 WHEN 'commit_created' THEN 2 ELSE 1 END, o_orderkey)) AS state FROM s GROUP BY o_custkey""")
def strongest_state(spark, sf):
    return state.strongest(_states(spark, sf), ["o_custkey"], "state", "o_orderkey")


def _states(spark, sf) -> DataFrame:
    names = {"1-URGENT": "merged", "2-HIGH": "pr_open", "3-MEDIUM": "push_pending", "4-NOT SPECIFIED": "commit_created"}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return t(spark, sf, "orders").withColumn("state", F.coalesce(table[F.col("o_orderpriority")], F.lit("prepared")))


@query("""SELECT id, origin, price FROM (SELECT o_orderkey AS id, 'memory' AS origin, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT -l_orderkey, 'attempt', sum(l_extendedprice) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY l_orderkey) WHERE origin = 'memory' OR id <> 0""".replace("sum(l_extendedprice)", "round(max(l_extendedprice), 2)"))
def union_candidates(spark, sf):
    memory = t(spark, sf, "orders").filter("o_orderstatus = 'F'")
    tries = t(spark, sf, "lineitem").join(memory, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").groupBy("l_orderkey").agg(F.round(F.max("l_extendedprice"), 2).alias("price"))
    both = memory.select(F.col("o_orderkey").alias("id"), F.lit("memory").alias("origin"), F.col("o_totalprice").alias("price")).unionByName(tries.select((-F.col("l_orderkey")).alias("id"), F.lit("attempt").alias("origin"), "price"))
    return both.filter("origin = 'memory' or id <> 0")


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def semi_and_anti(spark, sf):
    orders, c = t(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey")
    return t(spark, sf, "customer").join(orders.filter("o_orderstatus = 'F'"), c, "left_semi").join(orders.filter("o_orderpriority = '1-URGENT'"), c, "left_anti").select("c_custkey", "c_mktsegment")


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.08)
SELECT k, 'left' AS side FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'right' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def manifest_difference(spark, sf):
    part = lambda w: t(spark, sf, "lineitem").filter(w).select(F.col("l_partkey").alias("k")).distinct()
    return state.symmetric_difference(part("l_quantity > 45"), part("l_discount > 0.08"))


@query("""SELECT c_custkey, count(o_orderkey) AS n_links, count(o_orderkey) = 0 AS unlinked FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def zero_link_groups(spark, sf):
    n = t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t(spark, sf, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_links"), F.col("n").isNull().alias("unlinked"))


@query("""SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt_no FROM events""")
def attempt_numbers(spark, sf):
    return state.attempt_numbers(t(spark, sf, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


OUTCOMES = """o AS (SELECT event_type AS language, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'partial' ELSE 'ok' END AS status,
 count(DISTINCT user_id) AS documents, count(*) FILTER (value > 5) AS calls, count(*) AS attempts, count(*) FILTER (value > 50) AS failures FROM events GROUP BY 1)"""


def _outcomes(spark, sf) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", "error").when(kind == "click", "partial").otherwise("ok")
    return t(spark, sf, "events").groupBy(kind.alias("language"), status.alias("status")).agg(F.countDistinct("user_id").alias("documents"), F.count_if(F.col("value") > 5).alias("calls"), F.count("*").alias("attempts"), F.count_if(F.col("value") > 50).alias("failures"))


@query(f"""WITH {OUTCOMES} SELECT arg_min(status, CASE status WHEN 'error' THEN 0 WHEN 'needs_human' THEN 1 WHEN 'partial' THEN 2 ELSE 3 END) AS status, count(*) AS languages, sum(documents)::BIGINT AS documents,
sum(calls)::BIGINT AS calls, sum(attempts)::BIGINT AS attempts, greatest(sum(attempts) - sum(calls), 0)::BIGINT AS retries, sum(failures)::BIGINT AS failures FROM o""")
def report_totals(spark, sf):
    return report.totals(_outcomes(spark, sf))


@query(f"""WITH {OUTCOMES} SELECT '# Report' || chr(10) || chr(10) || '| language | status | documents | calls | failures |' || chr(10) || '| - | - | - | - | - |' || chr(10) ||
string_agg('| ' || language || ' | ' || status || ' | ' || documents || ' | ' || calls || ' | ' || failures || ' |', chr(10) ORDER BY language) AS report FROM o""")
def report_markdown(spark, sf):
    return report.as_markdown(_outcomes(spark, sf))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max((ts, event_id)).event_id AS seq, arg_max(value, (ts, event_id)) AS value, min(ts) AS created_at FROM
(SELECT ts, event_id, user_id, event_type, value FROM events) GROUP BY user_id""".replace("max((ts, event_id)).event_id", "max(event_id)").replace("(ts, event_id)", "event_id"))
def upsert_latest(spark, sf):
    e = t(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), "event_type", "value", F.col("ts").alias("created_at"))
    return state.upsert(e.filter("value <= 20"), e.filter("not (value <= 20) or value is null"), ["user_id"], "seq", "created_at")


@query("""SELECT user_id, event_type, min(event_id) AS seq FROM events n WHERE value > 20 AND NOT EXISTS (SELECT 1 FROM events o WHERE o.value <= 3 AND o.user_id = n.user_id AND o.event_type = n.event_type) GROUP BY ALL""")
def insert_if_absent(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("seq"), "value")
    return state.insert_absent(e.filter("value <= 3"), e.filter("value > 20").drop("value"), ["user_id", "event_type"], "seq")


@query("""SELECT event_id, user_id, event_type, ts, lead(ts) OVER w AS superseded_at, lead(ts) OVER w IS NULL AS active FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""")
def scd2_history(spark, sf):
    return state.history(t(spark, sf, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "event_id")


@query("""SELECT event_id, user_id, event_type, from_state FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM events) WHERE from_state IS DISTINCT FROM event_type""")
def event_transitions(spark, sf):
    return queue.transitions(t(spark, sf, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id"], "event_type", ["ts", "event_id"]).drop("ts")


def _log(spark, sf, kinds: dict[str, str], other: str) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    e = t(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.coalesce(table[F.col("event_type")], F.lit(other)).alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.concat(F.lit("w"), (F.floor("value") % 3).cast("string")).alias("owner"), F.lit(3_600_000).cast("long").alias("ttl"), F.col("props").alias("payload"))


EVENT_LOG = "l AS (SELECT user_id::VARCHAR AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type, epoch_us(ts) // 1000 AS tm, 'w' || (floor(value)::BIGINT % 3) AS o, props FROM events)"


# One step of the recursion for each event of a key, all keys side by side.
@query(f"""WITH RECURSIVE {EVENT_LOG}, e AS (SELECT *, CASE event_type WHEN 'view' THEN 'enqueue' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'retry' ELSE 'claim' END AS kind FROM l),
s AS (SELECT DISTINCT key, 0::BIGINT AS n, 'pending' AS status, NULL::VARCHAR AS owner, 0::BIGINT AS attempts, 0::BIGINT AS available_at, NULL::BIGINT AS expires_at, NULL::VARCHAR AS payload FROM e
UNION ALL SELECT key, n, CASE act WHEN 'claim' THEN 'processing' WHEN 'complete' THEN 'done' WHEN 'retry' THEN 'pending' ELSE status END, CASE act WHEN 'claim' THEN o WHEN 'complete' THEN NULL WHEN 'retry' THEN NULL ELSE owner END,
 CASE act WHEN 'claim' THEN attempts + 1 ELSE attempts END, CASE act WHEN 'first' THEN tm WHEN 'retry' THEN tm + {queue.RETRY_MS} ELSE available_at END, CASE act WHEN 'claim' THEN tm + {queue.LEASE_MS} WHEN 'complete' THEN NULL WHEN 'retry' THEN NULL ELSE expires_at END, CASE act WHEN 'first' THEN props ELSE payload END
 FROM (SELECT s.*, e.n AS n2, e.tm, e.o, e.props, CASE WHEN status = 'done' THEN 'none' WHEN kind = 'enqueue' THEN CASE WHEN s.n = 0 THEN 'first' ELSE 'none' END
  WHEN kind = 'claim' THEN CASE WHEN (status = 'pending' OR expires_at <= e.tm) AND available_at <= e.tm THEN 'claim' ELSE 'none' END WHEN status = 'processing' AND owner = e.o THEN kind ELSE 'none' END AS act
  FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1) x(key, n1, status, owner, attempts, available_at, expires_at, payload, n, tm, o, props, act))
SELECT key, status, owner, attempts, available_at, expires_at, payload FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1""")
def queue_fold(spark, sf):
    return queue.fold_queue(_log(spark, sf, {"view": "enqueue", "click": "claim", "purchase": "complete", "error": "retry"}, "claim"))


@query(f"""WITH RECURSIVE {EVENT_LOG}, e AS (SELECT *, CASE event_type WHEN 'click' THEN 'renew' WHEN 'error' THEN 'release' ELSE 'acquire' END AS kind FROM l),
s AS (SELECT DISTINCT key, 0::BIGINT AS n, NULL::VARCHAR AS owner, 0::BIGINT AS token, 0::BIGINT AS expires_at, 0::BIGINT AS refused FROM e
UNION ALL SELECT key, n, CASE act WHEN 'acquire' THEN o ELSE owner END, token + (act = 'acquire' AND NOT mine)::BIGINT, CASE act WHEN 'acquire' THEN tm + 3600000 WHEN 'renew' THEN tm + 3600000 WHEN 'release' THEN tm ELSE expires_at END, refused + (act = 'refuse')::BIGINT
 FROM (SELECT s.key, e.n, owner, token, expires_at, refused, e.tm, e.o, coalesce(owner = e.o, false) AS mine, CASE WHEN kind = 'acquire' THEN CASE WHEN owner IS NOT NULL AND expires_at > e.tm AND owner <> e.o THEN 'refuse' ELSE 'acquire' END
  WHEN coalesce(owner = e.o, false) AND expires_at > e.tm THEN kind ELSE 'refuse' END AS act FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1) x)
SELECT key, owner, token, expires_at, refused FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1""")
def lease_fencing(spark, sf):
    return queue.fold_leases(_log(spark, sf, {"click": "renew", "error": "release"}, "acquire"))


@query("""SELECT event_id, user_id, CASE WHEN event_id < max(event_id) OVER (PARTITION BY user_id) THEN 'superseded' ELSE 'pending' END AS status FROM events""")
def queue_supersede(spark, sf):
    return queue.supersede_older(t(spark, sf, "events").select("event_id", "user_id", F.lit("pending").alias("status")), ["user_id"], "event_id")


PATHS = "p AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/+$', '') AS path FROM pages WHERE url LIKE '%://%')"


def _paths(spark, sf) -> DataFrame:
    return t(spark, sf, "pages").filter(F.col("url").contains("://")).select(F.regexp_replace(F.regexp_extract("url", "://([^?#]*)", 1), "/+$", "").alias("path")).distinct()


@query(f"WITH {PATHS} SELECT a.path AS a, b.path AS b FROM p a JOIN p b ON a.path = b.path OR starts_with(a.path, b.path || '/') OR starts_with(b.path, a.path || '/')")
def path_overlaps(spark, sf):
    return discovery.overlaps(_paths(spark, sf), _paths(spark, sf))


RULES = [discovery.Rule("docs", ("src[0-4]/**/*.md",), target="i18n/{lang}/{relpath}"), discovery.Rule("guides", ("src1*/**/*.md",), ("**/en/*.md",), target="guides/{lang}/{relpath}"), discovery.Rule("readme", ("README.md",), single=True, target="README.{lang}.md")]


@query("""WITH f AS (SELECT source || '/' || lang || '/' || doc_id || '.md' AS path, source, lang FROM documents), r AS (SELECT path, CASE WHEN regexp_matches(source, '^src[0-4]$') THEN 'docs' WHEN regexp_matches(source, '^src1') AND lang <> 'en' THEN 'guides' END AS rule FROM f)
SELECT path, rule, l.lang AS lang, CASE rule WHEN 'docs' THEN 'i18n/' ELSE 'guides/' END || l.lang || '/' || path AS target, true AS safe, NULL::VARCHAR AS error FROM (
 SELECT path, rule FROM r WHERE rule IS NOT NULL) r, (VALUES ('ja'), ('ko')) l(lang)""".replace("CASE WHEN regexp_matches(source, '^src[0-4]$') THEN 'docs'", "CASE WHEN regexp_matches(source, '^src[0-4]$') THEN 'docs'").replace("NULL::VARCHAR AS error", "CASE WHEN regexp_matches(path, '^src1/') AND NOT regexp_matches(path, '/en/[^/]*$') THEN 'MULTIPLE-RULES' END AS error"))
def source_routing(spark, sf):
    files = t(spark, sf, "documents").select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"))
    languages = spark.createDataFrame([("ja",), ("ko",)], "lang string")
    return discovery.targets(discovery.route(files, RULES, strict=False), languages).select("path", "rule", "lang", "target", "safe", "error")


@query("""WITH RECURSIVE e AS (SELECT r_name AS parent, n_name AS child FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'root', r_name FROM region),
c AS (SELECT 'root' AS node UNION SELECT child FROM c JOIN e ON parent = node) SELECT node FROM c""")
def fk_closure(spark, sf):
    region, nation = t(spark, sf, "region"), t(spark, sf, "nation")
    edges = region.join(nation, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child")).union(region.select(F.lit("root"), "r_name"))
    return state.closure(edges, "root")


@query("""SELECT 'price' AS rule, count(*) FILTER (NOT coalesce(o_totalprice > 1000, false)) AS n FROM orders UNION ALL SELECT 'status', count(*) FILTER (NOT coalesce(o_orderstatus IN ('F', 'O'), false)) FROM orders
UNION ALL SELECT 'orphan', count(*) FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'duplicate', count(*) FROM (SELECT o_custkey, o_orderdate FROM orders GROUP BY ALL HAVING count(*) > 1)""")
def integrity_checks(spark, sf):
    orders = t(spark, sf, "orders")
    rules = {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("F", "O")}
    broken = state.violations(orders, rules).groupBy("rule").agg(F.count("*").alias("m"))
    listed = spark.createDataFrame([(r,) for r in rules], "rule string").join(broken, "rule", "left").select("rule", F.coalesce("m", F.lit(0)).alias("n"))
    lost = state.orphans(t(spark, sf, "lineitem"), "l_orderkey", orders, "o_orderkey").agg(F.lit("orphan").alias("rule"), F.count("*").alias("n"))
    twice = state.duplicates(orders, ["o_custkey", "o_orderdate"]).agg(F.lit("duplicate").alias("rule"), F.count("*").alias("n"))
    return listed.union(lost).union(twice)


@query("""WITH k AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'candidate' WHEN 'O' THEN 'materialized' ELSE 'human_edited' END AS state, CASE WHEN o_orderpriority < '2' THEN 'verify' WHEN o_orderpriority < '3' THEN 'publish' WHEN o_orderpriority < '4' THEN 'adopt' WHEN o_orderpriority < '5' THEN 'edit' ELSE 'discard' END AS event FROM orders)
SELECT state, event, CASE WHEN state = 'candidate' AND event = 'verify' THEN 'verified' WHEN state = 'materialized' AND event = 'publish' THEN 'published' WHEN state = 'materialized' AND event = 'edit' THEN 'human_edited'
 WHEN state = 'human_edited' AND event = 'adopt' THEN 'adopted' WHEN state = 'human_edited' AND event = 'discard' THEN 'materialized' END AS next, count(*) AS n FROM k GROUP BY ALL""")
def canonical_transitions(spark, sf):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    k = t(spark, sf, "orders").select(F.when(s == "F", "candidate").when(s == "O", "materialized").otherwise("human_edited").alias("state"), F.when(p < "2", "verify").when(p < "3", "publish").when(p < "4", "adopt").when(p < "5", "edit").otherwise("discard").alias("event"))
    return k.withColumn("next", state.transition(F.col("state"), F.col("event"))).groupBy("state", "event", "next").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id AS task_id, arg_max({'t': event_type, 'v': value}, event_id) AS r FROM events GROUP BY 1)
SELECT c_custkey AS task_id, CASE WHEN r IS NULL THEN 'missing' WHEN r.t IN ('view', 'click') AND r.v > 2 THEN 'candidate' WHEN r.t IN ('view', 'click') THEN 'invalid' WHEN r.t = 'purchase' THEN 'timed_out' ELSE 'failed' END AS outcome FROM customer LEFT JOIN r ON task_id = c_custkey""")
def attempt_outcomes(spark, sf):
    kind = F.col("event_type")
    results = t(spark, sf, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), kind.isin("view", "click").alias("ok"), (kind == "purchase").alias("timed_out"), F.col("props").alias("output"), (F.col("value") > 2).alias("valid"))
    return planner.outcomes(t(spark, sf, "customer").select(F.col("c_custkey").alias("task_id")), results).select("task_id", "outcome")


@query(f"""WITH {MATCHED}, d AS (SELECT doc_id, bool_or(NOT trusted_reuse AND kind = 'moved') AS f, bool_or(NOT trusted_reuse) AS s FROM matched GROUP BY doc_id)
SELECT doc_id, CASE WHEN f THEN 'failed' WHEN s THEN 'skipped' ELSE 'verified' END AS state FROM d""")
def verified_documents(spark, sf):
    units = _matched(spark, sf).select("doc_id", F.when(F.col("trusted_reuse"), F.lit("text")).alias("translation"), (F.col("kind") == "moved").alias("scheduled"))
    return planner.verified(units)


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem) SELECT l_orderkey, sha256('[' || string_agg('{"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || ']') AS manifest FROM l GROUP BY l_orderkey""")
def manifest_hashes(spark, sf):
    return filesets.manifests(t(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], ["l_linenumber", "l_partkey"])


@query()
def document_units(spark, sf):
    """Documents as Markdown and events' properties as JSON, through the scanners."""
    md = t(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.lit("markdown").alias("format"), F.col("text").cast("binary").alias("bytes"))
    js = t(spark, sf, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("path"), F.lit("json").alias("format"), F.col("props").cast("binary").alias("bytes"))
    return segment.document_units(md.union(js))


@query("""SELECT 100 * length(p) AS k, least(200 * pow(2, least(length(p), 4)), 30000)::BIGINT AS delay, p LIKE '%~_other' ESCAPE '~' OR regexp_matches(p, '_(zero|one|two|few|many|other|plural|ordinal|[0-9]+)$') OR contains(p, '_ordinal_') AS plural, count(*) AS n
FROM (SELECT event_type || '_' || (event_id % 10) AS p FROM events) GROUP BY ALL""")
def scalar_rules(spark, sf):
    p = t(spark, sf, "events").select(F.concat_ws("_", "event_type", (F.col("event_id") % 10).cast("string")).alias("p"))
    n = F.char_length("p")
    return p.groupBy((100 * n).cast("long").alias("k"), text.backoff_ms(n).alias("delay"), text.plural_key(F.col("p")).alias("plural")).agg(F.count("*").alias("n"))


@query("""WITH tm AS (SELECT o_custkey AS unit_id, o_orderkey AS id, o_orderpriority AS text, o_orderstatus = 'F' AS trusted FROM orders WHERE o_orderstatus IN ('F', 'O')),
att AS (SELECT user_id AS unit_id, -event_id AS id, event_type AS text, false AS trusted FROM events e WHERE value > 10 AND NOT EXISTS (SELECT 1 FROM tm WHERE tm.unit_id = e.user_id)),
u AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY trusted DESC, id DESC) AS n FROM (SELECT * FROM tm UNION ALL SELECT * FROM att))
SELECT c_custkey AS unit_id, n_name AS locale, coalesce(id, 0) AS id, text, coalesce(trusted, false) AS trusted FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN u ON unit_id = c_custkey AND n = 1""")
def translation_candidates(spark, sf):
    orders = t(spark, sf, "orders").filter(F.col("o_orderstatus").isin("F", "O"))
    memory = orders.select(F.col("o_custkey").alias("unit_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"), (F.col("o_orderstatus") == "F").alias("trusted"))
    tries = t(spark, sf, "events").filter("value > 10").select(F.col("user_id").alias("unit_id"), (-F.col("event_id")).alias("id"), F.col("event_type").alias("text"), F.lit(False).alias("trusted"))
    tries = tries.join(memory.select("unit_id"), "unit_id", "left_anti")
    first = state.latest(memory.unionByName(tries), ["unit_id"], ["trusted", "id"])
    units = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("unit_id"), F.col("n_name").alias("locale"))
    return units.join(first, "unit_id", "left").select("unit_id", "locale", F.coalesce("id", F.lit(0)).alias("id"), "text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
