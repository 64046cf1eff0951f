"""Queries of what held at a time, of file sets and of routing by many rules; importing this adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, t
from .operators import filesets, history
from .sources import discovery

VERSIONS = "v AS (SELECT o_custkey AS c, o_orderdate AS d, max(o_orderkey) AS k, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1, 2)"


@query(f"""WITH {VERSIONS} SELECT o_orderkey, v.k AS previous, v.p AS text, v.d AS at_found FROM orders ASOF LEFT JOIN v ON o_custkey = c AND o_orderdate > d""")
def history_as_of(spark, sf):
    """Each order with the last one of its customer that is earlier; of several at one time, the greatest key."""
    o = t(spark, sf, "orders")
    rows = o.select("o_orderkey", F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("at"))
    entries = o.select(F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("previous"), F.col("o_orderpriority").alias("text"))
    return history.as_of(rows, entries, ["c"], "at", F.date_trunc("month", "at"), ("previous",), earlier=True).select("o_orderkey", "previous", "text", "at_found")


@query("""WITH e AS (SELECT user_id, ts, event_type, (event_id % 3)::VARCHAR AS locale, CASE WHEN event_id % 5 > 0 THEN (event_id % 2)::VARCHAR END AS contract, event_id, value FROM events),
v AS (SELECT * FROM e WHERE event_type = 'view' AND coalesce(value > 3, false)), c AS (SELECT unnest(['0', '1']) AS k), w AS (SELECT user_id, locale, k, ts, arg_max(event_id, event_id) AS id FROM v JOIN c ON contract IS NULL OR contract = k GROUP BY ALL),
n AS (SELECT user_id, locale, ts, max(event_id) AS id FROM v WHERE contract IS NULL GROUP BY ALL), m AS (SELECT user_id, locale, ts, max(event_id) AS id FROM e WHERE event_type = 'click' GROUP BY ALL), u AS (SELECT * FROM e WHERE event_type NOT IN ('view', 'click')),
a AS (SELECT u.*, w.id AS vid FROM u ASOF LEFT JOIN w ON u.user_id = w.user_id AND u.locale = w.locale AND u.contract = w.k AND u.ts > w.ts),
b AS (SELECT a.*, n.id AS nid FROM a ASOF LEFT JOIN n ON a.user_id = n.user_id AND a.locale = n.locale AND a.ts > n.ts),
d AS (SELECT b.*, m.id AS mid FROM b ASOF LEFT JOIN m ON b.user_id = m.user_id AND b.locale = m.locale AND b.ts > m.ts)
SELECT event_id, CASE WHEN coalesce(vid, CASE WHEN contract IS NULL THEN nid END) IS NOT NULL THEN 'version' WHEN mid IS NOT NULL THEN 'memory' END AS origin, 't' || coalesce(vid, CASE WHEN contract IS NULL THEN nid END, mid) AS previous FROM d""")
def previous_texts(spark, sf):
    """Events as units, versions (views) and memory (clicks) of users, in three locales and under two contracts or none."""
    n = F.col("event_id")
    e = t(spark, sf, "events").select(F.col("user_id").alias("unit_id"), (n % 3).cast("string").alias("locale"), F.when(n % 5 > 0, (n % 2).cast("string")).alias("contract"), F.col("ts").alias("at"), n.alias("id"), F.concat(F.lit("t"), n.cast("string")).alias("text"), F.coalesce(F.col("value") > 3, F.lit(False)).alias("active"), "event_type")
    units = e.filter("event_type not in ('view', 'click')").select("unit_id", "locale", "at", "contract", F.col("id").alias("event_id"))
    return history.previous_texts(units, e.filter("event_type = 'view'"), e.filter("event_type = 'click'")).select("event_id", "origin", "previous")


@query("""WITH m AS (SELECT o_custkey AS c, o_orderdate AS d, max(o_orderkey) AS k FROM orders GROUP BY 1, 2), a AS (SELECT DISTINCT o_custkey AS c, o_orderdate + INTERVAL 100 DAY AS d FROM orders),
j AS (SELECT a.c, a.d, m.k FROM a ASOF JOIN m ON a.c = m.c AND a.d >= m.d) SELECT j.c, j.d AS at, j.k AS manifest, l_linenumber AS path, l_partkey AS content FROM j JOIN orders ON o_orderkey = j.k JOIN lineitem ON l_orderkey = j.k WHERE o_orderstatus <> 'F'""")
def publication_as_of(spark, sf):
    """What was published of each customer a hundred days after each order."""
    o = t(spark, sf, "orders")
    asked = o.select(F.col("o_custkey").alias("c"), (F.col("o_orderdate") + F.expr("INTERVAL 100 DAY")).alias("at"))
    manifests = o.select(F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("manifest"), F.when(F.col("o_orderstatus") == "F", "superseded").otherwise("merged").alias("state"))
    files = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("manifest"), F.col("l_linenumber").alias("path"), F.col("l_partkey").alias("content"))
    return history.files_as_of(asked, manifests, files, ["c"])


def _sides(spark, sf):
    """The files of five orders in six, and what a replay brings: four orders in five, every seventh one with some contents changed."""
    li = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("manifest"), F.col("l_linenumber").alias("path"), F.col("l_partkey").alias("content"))
    m, c = F.col("manifest"), F.col("content")
    return li.filter(m % 6 != 1), li.filter(m % 5 != 0).withColumn("content", F.when((m % 7 == 0) & (c % 3 == 0), -c).otherwise(c))


SIDES = "s AS (SELECT l_orderkey AS manifest, l_linenumber AS path, l_partkey AS content FROM lineitem), a AS (SELECT * FROM s WHERE manifest % 6 <> 1), b AS (SELECT manifest, path, CASE WHEN manifest % 7 = 0 AND content % 3 = 0 THEN -content ELSE content END AS content FROM s WHERE manifest % 5 <> 0)"


@query(f"""WITH {SIDES}, x AS (SELECT manifest, list_sort(list((path, content))) AS l FROM a GROUP BY 1), y AS (SELECT manifest, list_sort(list((path, content))) AS l FROM b GROUP BY 1)
SELECT y.manifest, CASE WHEN x.manifest IS NULL THEN 'new' WHEN x.l = y.l THEN 'replay' ELSE 'conflict' END AS outcome FROM y LEFT JOIN x USING (manifest)""")
def file_set_replays(spark, sf):
    return filesets.replayed(*_sides(spark, sf), ["manifest"], ["path", "content"])


@query(f"""WITH {SIDES}, x AS (SELECT *, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT *, count(*) AS n FROM b GROUP BY ALL)
SELECT manifest, path, content, coalesce(x.n, 0) AS n_a, coalesce(y.n, 0) AS n_b FROM x FULL JOIN y USING (manifest, path, content) WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)""")
def file_set_differences(spark, sf):
    return filesets.differences(*_sides(spark, sf), ["manifest"], ["path", "content"])


# 10,000 rules: one for each source, language and last digit.
MANY = [discovery.Rule(f"{s}-{lang}-{d}", (f"{s}/{lang}/*{d}.md", f"{s}/{lang}/**/[0-9]{d}.md")) for s in (f"src{i}" for i in range(100)) for lang in ("en", "de", "fr", "es", "zh", "ja", "ru", "pt", "it", "ko") for d in range(10)]
MANY_LANGS = "('en', 'de', 'fr', 'es', 'zh', 'ja', 'ru', 'pt', 'it', 'ko')"


@query(f"""SELECT source || '/' || lang || '/' || doc_id || '.md' AS path, source || '-' || lang || '-' || doc_id % 10 AS rule, 'i18n/{{lang}}/{{relpath}}' AS template, NULL::VARCHAR AS error FROM documents WHERE regexp_matches(source, '^src[0-9][0-9]?$') AND lang IN {MANY_LANGS}""")
def routing_by_many_rules(spark, sf):
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return discovery.route(t(spark, sf, "documents").select(path.alias("path")), MANY, strict=False).select("path", "rule", "template", "error")
