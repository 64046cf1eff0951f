"""Which files are documents, by which rule, and where their translations go. Paths only: contents join later."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ancestors, reserved, safe_target, target_path

FORMATS = {"md": "markdown", "markdown": "markdown", "json": "json"}


@dataclass(frozen=True)
class Rule:
    """A source set: globs, the directory that relative paths start at, and the target template."""

    name: str
    include: tuple[str, ...] = ("**/*.md", "*.md")
    exclude: tuple[str, ...] = ()
    prefix: str = ""
    target: str = "i18n/{lang}/{relpath}"
    format: str = "markdown"
    single: bool = False
    meta: dict = field(default_factory=dict, hash=False)


def glob_regex(glob: str) -> str:
    """A glob as an anchored regular expression: * and ? stay within a component, ** crosses them."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and (end := glob.find("]", i + 1)) > 0:
            inner = glob[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]", end + 1
            continue
        if c == "{" and (end := glob.find("}", i)) > 0:
            out, i = out + "(?:" + "|".join(re.escape(x) for x in glob[i + 1 : end].split(",")) + ")", end + 1
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        i += 1
    return f"^{out}$"


def matches(path, rule: Rule):
    """Whether one rule takes a path; for many rules see `rule_hits`."""
    any_of = lambda globs: "|".join(f"(?:{glob_regex(g)})" for g in globs)
    inside = path.rlike(any_of(rule.include))
    return inside & ~path.rlike(any_of(rule.exclude)) if rule.exclude else inside


def fixed_parts(glob: str) -> tuple[str, str]:
    """The directories that a glob begins with, and the extension that it ends with; empty where it leaves them open."""
    parts = glob.split("/")
    wild = next((i for i, x in enumerate(parts) if re.search(r"[*?\[{]", x)), len(parts))
    tail = re.split(r"[*?\]}\[{]", parts[-1])[-1]
    return "/".join(parts[:wild]), tail[tail.rindex(".") :] if "." in tail else ""


def rule_trie(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """A row for each include of each rule: (at, ending, rule, pattern, but), `at` being the directory that all its paths lie below."""
    rows = [(*fixed_parts(g), i, glob_regex(g), "|".join(f"(?:{glob_regex(x)})" for x in r.exclude) or None) for i, r in enumerate(rules) for g in r.include]
    return _listed(spark, rows, at=pa.string(), ending=pa.string(), _i=pa.int32(), _pattern=pa.string(), _but=pa.string())


def _listed(spark: SparkSession, rows: list[tuple], **types: pa.DataType) -> DataFrame:
    """Configuration as a local relation: Spark knows its size and sends it out only if it is small."""
    table = pa.table([pa.array([r[i] for r in rows], x) for i, x in enumerate(types.values())], names=list(types))
    return spark.createDataFrame(table)


def rule_hits(paths: DataFrame, rules: list[Rule]) -> DataFrame:
    """(path, _n, _i) of those of paths(path) that rules match: how many do, and the first of them by place.

    Each path meets the rules that begin with one of its directories and end as it does, by an equi-join; only those
    patterns are tried. The plan is the same for any number of rules.
    """
    name = F.element_at(F.split("path", "/"), -1)
    open_or_own = F.array_distinct(F.array(F.lit(""), F.regexp_extract(name, r"(\.[^.]*)$", 1)))
    above = F.array_distinct(F.concat(F.array(F.lit("")), ancestors(F.col("path"))))
    met = paths.select("path").distinct().withColumn("at", F.explode(above)).withColumn("ending", F.explode(open_or_own)).join(rule_trie(paths.sparkSession, rules), ["at", "ending"])
    fits = F.expr("path rlike _pattern") & ~F.coalesce(F.expr("path rlike _but"), F.lit(False))
    # a rule may have several includes that match
    seen = met.filter(fits).select("path", "_i").distinct()
    return seen.groupBy("path").agg(F.count("*").alias("_n"), F.min("_i").alias("_i"))


def route(files: DataFrame, rules: list[Rule], strict: bool = True) -> DataFrame:
    """files(path, ...) that a rule matches, with its name, format, relpath and template.

    A path that more than one rule matches is an error; so are a format that the extension denies, a path outside
    the rule's prefix, and a single-file rule that matches not exactly one. These are looked for
    before anything else is done, by a job while the plan is made; with strict=False they are a column, and no job runs.
    """
    rows = [(i, r.name, r.format, r.target, r.prefix) for i, r in enumerate(rules)]
    listed = _listed(files.sparkSession, rows, _i=pa.int32(), rule=pa.string(), format=pa.string(), template=pa.string(), _prefix=pa.string())
    hits = rule_hits(files, rules).join(listed, "_i")
    below = F.substr("path", F.char_length("_prefix") + 2)
    rel = F.when(F.col("_prefix") == "", F.col("path")).when(F.startswith("path", F.concat("_prefix", F.lit("/"))), below)
    found = files.join(hits, "path").select(*files.columns, "rule", "format", "template", "_n", rel.alias("relpath"))
    kinds = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    error = (
        F.when(F.col("_n") > 1, "MULTIPLE-RULES")
        .when(~F.coalesce(kinds[F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))] == F.col("format"), F.lit(False)), "FORMAT")
        .when(F.col("relpath").isNull(), "OUTSIDE-PREFIX")
    )
    out = found.withColumn("error", error).drop("_n")
    if not strict:
        return out
    if bad := out.filter("error is not null").select("error", "path").head(1):
        raise ValueError(f"{bad[0]['error']}: {bad[0]['path']}")
    return out.drop("error")


def single_violations(routed: DataFrame, rules: list[Rule]) -> DataFrame:
    """Single-file rules that do not match exactly one file."""
    singles = routed.sparkSession.createDataFrame([(r.name,) for r in rules if r.single], "rule string")
    return singles.join(routed.groupBy("rule").agg(F.count("*").alias("n")), "rule", "left").filter(F.coalesce("n", F.lit(0)) != 1).select("rule", F.coalesce("n", F.lit(0)).alias("n"))


def targets(routed: DataFrame, languages: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """Every document in every language of languages(lang), a configured list, with its target and whether that is safe: ordinary, and not below a path of `kept`."""
    both = routed.crossJoin(F.broadcast(languages))
    out = both.withColumn("target", target_path(F.col("template"), F.col("lang"), F.col("relpath")))
    return out.withColumn("safe", safe_target(F.col("target")) & ~reserved(F.col("target"), list(kept)))


def revision(refs: DataFrame, name: str) -> str:
    """The snapshot that refs(name, revision) says a name stands for; 40 hex digits or more stand for themselves."""
    if re.fullmatch("[0-9a-f]{40,}", name):
        return name
    got = refs.filter(F.col("name") == name).select("revision").distinct().head(2)
    if len(got) != 1 or not re.fullmatch("[0-9a-f]{40,}", got[0][0] or ""):
        raise ValueError(f"{name!r} does not name one snapshot")
    return got[0][0]


def snapshot(files: DataFrame, at: str) -> DataFrame:
    """Files(revision, path, ...) of one snapshot; the filter reaches the scan."""
    return files.filter(F.col("revision") == at)


def ordered(documents: DataFrame) -> DataFrame:
    """In the order of their paths, by bytes; a range partitioning and a sort within."""
    return documents.orderBy("path")


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, b) of left(path) and right(path) of which one is the other or lies above it.

    Paths are exploded to their ancestors, which makes this two equi-joins and no theta join.
    """
    a, b = left.select(F.col("path").alias("a")), right.select(F.col("path").alias("b"))
    up = a.withColumn("at", F.explode(ancestors(F.col("a")))).join(b, F.col("at") == F.col("b")).select("a", "b")
    down = b.withColumn("at", F.explode(ancestors(F.col("b")))).join(a, F.col("at") == F.col("a")).filter("a <> b").select("a", "b")
    return up.union(down)


def rediscovered(targets_: DataFrame, rules: list[Rule]) -> DataFrame:
    """Targets that a source rule would take for documents in the next run."""
    hits = rule_hits(targets_.select(F.col("target").alias("path")), rules)
    return targets_.join(hits.select(F.col("path").alias("target")), "target", "left_semi").select(*targets_.columns)


def read_files(spark, path: str, glob: str = "*") -> DataFrame:
    """Files under a directory as (path, bytes, content_hash), by Spark's own reader."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("content").alias("bytes"), F.sha2("content", 256).alias("content_hash"))


def agent_for(stage, routing: dict[str, str], default: str):
    """The agent of a stage: its own, else that of translation, else the default."""
    table = F.create_map(*[F.lit(x) for kv in routing.items() for x in kv]) if routing else F.create_map().cast("map<string,string>")
    return F.coalesce(table[stage], table[F.lit("translate")], F.lit(default))
