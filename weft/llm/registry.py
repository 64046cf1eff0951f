"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, license_scan, lm_scoring, mixing, ngram_join, personal_data, prefix_trie, quality_rules, secret_scan, substring_dedup, token_counts, url_filter
from .kit import Scratch, table

WEIGHTS = {"src0": 2.0, "src1": 0.5, mixing.DEFAULT: 1.0}
MIX_SIZE, MIX_SEED = 1.0, 1


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(sf_dir, "documents", spark))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(sf_dir, "documents", spark)
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan.scan(docs.select("doc_id", "text", path.alias("path")), Scratch(spark))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(sf_dir, "documents", spark), Scratch(spark))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in, the first batch is brought again, all counts are revised to another way of counting and texts of under 50 words are taken out."""
    scratch, text = Scratch(spark), F.col("text")
    docs = table(sf_dir, "documents", spark)
    # the counts that the tokenizers report, once; the batches are made of them
    counted = scratch.keep(docs.select("source", "lang", token_counts.words(text).alias("one"), token_counts.pieces(text).alias("two")))
    rollup = token_counts.Rollup(spark, f"{scratch.base}-rollup")
    one, two = F.col("one"), F.col("two")
    for version, first, then in (("words", one, two), ("pieces", two, two)):
        rollup.apply(f"{version}-insert", token_counts.changes(counted, version, None, first))
        rollup.apply(f"{version}-insert", token_counts.changes(counted, version, None, first))
        rollup.apply(f"{version}-revise", token_counts.changes(counted, version, first, then))
        rollup.apply(f"{version}-delete", token_counts.changes(counted.filter(one < 50), version, then, None))
    rollup.compact()
    return rollup.totals()


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(sf_dir, "pages", spark)
    return url_filter.judge(pages, url_filter.insecure(pages), scratch=Scratch(spark))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(sf_dir, "documents", spark), Scratch(spark))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(sf_dir, "documents", spark), Scratch(spark))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find(table(sf_dir, "documents", spark))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(sf_dir, "documents", spark), table(sf_dir, "benchmark", spark))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(sf_dir, "documents", spark), WEIGHTS, MIX_SIZE, MIX_SEED)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    # places in preorder follow hashes, of which SQL knows nothing
    return prefix_trie.query(table(sf_dir, "conversations", spark), Scratch(spark)).drop("position", "subtree_end")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.masks(table(sf_dir, "documents", spark), table(sf_dir, "labels", spark), Scratch(spark)))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digests(personal_data.find(table(sf_dir, "documents", spark).select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_license_scans, op3_suffix_array_dedup, op4_token_counts, op5_ngram_jaccard_join, op6_secret_scans, op7_url_filters, op8_benchmark_decontamination, op9_lm_scoring, op10_mixing, op11_prefix_trie, op12_filter_audit, op13_personal_data)}


OP10_SQL = f"""
WITH n AS (SELECT source, count(*) AS n, CASE WHEN source = 'src0' THEN 2.0::DOUBLE WHEN source = 'src1' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM documents GROUP BY source),
r AS (SELECT source, CASE WHEN (SELECT sum(w) FROM n) > 0 THEN {MIX_SIZE}::DOUBLE * (SELECT sum(n)::BIGINT FROM n) * w / (SELECT sum(w) FROM n) / n ELSE 0 END AS rate FROM n),
d AS (SELECT documents.*, rate, md5(coalesce(text, '')) AS h, coalesce(doc_id::VARCHAR, '') AS i, greatest(1, ceil(rate / {mixing.PIECE}))::INT AS pieces FROM documents JOIN r ON documents.source IS NOT DISTINCT FROM r.source WHERE rate > 0),
u AS (SELECT *, list_transform(range(1, pieces + 1), lambda j: ((('0x' || substr(md5('draw{MIX_SEED}|' || j || '|' || i || '|' || h), 1, 12))::BIGINT)::DOUBLE + 0.5) / {float(1 << 48)}) AS us, rate / pieces AS m FROM d),
t AS (SELECT j AS k, sum(ln(x)) OVER (ORDER BY j) AS lnfact FROM (SELECT unnest(range(0, {mixing.TERMS + 1})) AS j, greatest(1, unnest(range(0, {mixing.TERMS + 1}))) AS x)),
c AS (SELECT source, any_value(m) AS m FROM u GROUP BY source),
cdf AS (SELECT source, k, sum(exp(-m + k * ln(m) - lnfact)) OVER (PARTITION BY source ORDER BY k) AS c FROM c, t),
steps AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
drawn AS (SELECT u.*, list_sum(list_transform(us, lambda x: len(list_filter(cs[1:{mixing.TERMS}], lambda y: y < x)))) AS n FROM u JOIN steps ON u.source IS NOT DISTINCT FROM steps.source)
SELECT doc_id, text, lang, source, n_chars, copy_no::INT AS copy_no, md5('order{MIX_SEED}|' || i || '|' || h || '|' || copy_no) AS mix_key
FROM (SELECT *, unnest(range(1, n::BIGINT + 1)) AS copy_no FROM drawn WHERE n > 0)
"""


WORDS_SQL = "len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))"
PIECES_SQL = """(length(regexp_replace(coalesce(text, ''), '[A-Za-z0-9\\x{80}-\\x{10FFFF} \\t\\n\\x0B\\f\\r]', '', 'g'))
    + len(list_filter(string_split_regex(coalesce(text, ''), '[^A-Za-z0-9\\x{80}-\\x{10FFFF}]+'), lambda w: w <> '')))"""
OP4_SQL = f"""
WITH d AS (SELECT source, lang, {WORDS_SQL} AS one, {PIECES_SQL} AS two FROM documents),
v AS (SELECT source, lang, unnest(['words', 'pieces']) AS tokenizer_version, one, two FROM d)
SELECT source, lang, tokenizer_version, count(*) - count(*) FILTER (one < 50) AS n_docs,
       coalesce(sum(two) FILTER (one >= 50), 0)::BIGINT AS n_tokens, count(*) AS n_inserts,
       count(*) FILTER (one < 50) AS n_deletes, count(*) AS n_revisions
FROM v GROUP BY ALL HAVING count(*) FILTER (one >= 50) > 0
"""
_REST = "(CASE WHEN position('://' in url) > 0 THEN substr(url, position('://' in url) + 3) ELSE '' END)"
OP7_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce({_REST}, '') AS rest FROM pages),
q AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
l AS (SELECT host, NOT bool_or(coalesce(url LIKE 'https:%', false)) AS listed FROM q GROUP BY host),
r AS (SELECT q.*, CASE
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM q)
SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN l ON r.host = l.host
"""


# CRC-32 by its bits: a byte is mixed in, then eight shifts (-1 in the list of steps).
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, o: CASE WHEN o >= 0 THEN xor(crc, o) ELSE xor(crc >> 1, CASE WHEN crc % 2 = 1 THEN 3988292384 ELSE 0 END) END))"""
OP11_SQL = f"""
WITH RECURSIVE t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS nth, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, c - c % 100 AS base, max(nth) AS n, ({_CRC}) % 6 AS h FROM t GROUP BY c),
m AS (SELECT k.*, least(k.h, coalesce(b.n, 0)) AS p FROM k LEFT JOIN k b ON b.c = k.base),
r AS (SELECT m.c, nth AS depth, role, text FROM m JOIN t ON t.c = m.base WHERE nth <= h UNION ALL SELECT m.c, p + nth - h, role, text FROM m JOIN t ON t.c = m.c WHERE nth > h),
path AS (SELECT c, 0 AS depth, 0 AS chars, sha256('') AS parent, 'root' AS node FROM k
  UNION ALL SELECT r.c, r.depth, length(r.text), path.node, sha256(path.node || '|' || length(r.role) || '|' || r.role || '|' || r.text) FROM path JOIN r ON r.c = path.c AND r.depth = path.depth + 1),
f AS (SELECT c, max(depth) AS n FROM path GROUP BY c),
nodes AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM path GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes GROUP BY parent),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (node)),
below AS (SELECT a.node, sum((w.n_children = 0)::INT) AS n_leaves, sum((w.n_convs - 1) * w.chars) AS saved_tokens FROM whole w JOIN path a ON a.c = w.conv_id AND a.depth <= w.depth GROUP BY a.node),
ended AS (SELECT node, sha256(string_agg(path.c::VARCHAR, ',' ORDER BY path.c)) AS ends FROM path JOIN f ON f.c = path.c AND f.n = path.depth GROUP BY node)
SELECT w.conv_id, w.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM whole w JOIN below USING (node) LEFT JOIN ended USING (node) LEFT JOIN whole p ON p.node = w.parent
"""
OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS ws FROM documents),
m AS (SELECT part, (CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END)
        || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
        || (CASE WHEN coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) THEN 'E' ELSE '' END) AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM d LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, CASE WHEN step = 1 THEN '[0]' ELSE '[' || substr(filter_order, 1, step - 1) || ']' END AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, x, sum(n) FILTER (NOT contains(fails, x) AND NOT gone) AS kept, sum(n) FILTER (contains(fails, x) AND NOT gone) AS removed,
        sum(n) FILTER (contains(fails, x) AND gone) AS redundant, sum(n) FILTER (fails = x) AS unique_fails, sum(good) FILTER (contains(fails, x) AND NOT gone) AS good_lost,
        sum(toxic) FILTER (contains(fails, x) AND NOT gone) AS toxic_lost
      FROM (SELECT *, regexp_matches(fails, before) AS gone FROM cells, s) GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_token_counts": OP4_SQL, "op7_url_filters": OP7_SQL, "op10_mixing": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_filter_audit": OP12_SQL}
