"""Named reads over the state tables: equi-joins, and maxima of structs where a top-1 is asked for.

Every read answers for all keys at once; a point lookup is a filter on its result, which reaches the scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import state

REVIEWS = (":revision", ":proofread")
# What an attempt can have come to.
ATTEMPT_STATES = ("succeeded", "failed", "timed_out", "cancelled")


def unit_history(units: DataFrame, versions: DataFrame) -> DataFrame:
    """units(unit_id, ...) with the text of the newest active trusted version(unit_id, id, text, active, trusted), else of the newest one."""
    best = F.struct((F.col("active") & F.col("trusted")).alias("trusted"), "id", "text")
    top = versions.groupBy("unit_id").agg(F.max(best).alias("_v"))
    return units.join(top, "unit_id", "left").select(*units.columns, F.col("_v.id").alias("version"), F.col("_v.text").alias("text"), F.coalesce("_v.trusted", F.lit(False)).alias("trusted"))


def failed_context(attempts: DataFrame) -> DataFrame:
    """The newest failed attempt of each work item, of attempts(work_item, id, status, response, error), with its output if there is one."""
    last = attempts.filter("status <> 'succeeded'").groupBy("work_item").agg(F.max(F.struct("id", "response", "error")).alias("_a"))
    return last.select("work_item", F.col("_a.id").alias("attempt_id"), F.get_json_object("_a.response", "$.output").alias("output"), F.col("_a.error").alias("error"))


def successes(attempts: DataFrame, work: DataFrame) -> DataFrame:
    """Successful attempts(work_item, id, status, response, bound) with their output; `current` says whether they were made for the document that work(work_item, document) names now."""
    done = attempts.filter("status = 'succeeded' and response is not null").join(work, "work_item")
    return done.select("work_item", "id", F.coalesce(F.get_json_object("response", "$.output"), F.lit("")).alias("output"), F.col("bound").eqNullSafe(F.col("document")).alias("current"))


def recoverable(candidates: DataFrame, attempts: DataFrame, policy: str, repair: str) -> DataFrame:
    """Selected candidates(unit_id, attempt_id, text, selected) whose attempt(id, status, policy, agent, model, output) succeeded under the policy.

    Those of the deterministic agent count for this version of it only. The text has to be what the attempt durably answered.
    """
    good = attempts.filter((F.col("status") == "succeeded") & (F.col("policy") == policy) & ((F.col("agent") != "deterministic") | (F.col("model") == repair)))
    on = (F.col("attempt_id") == F.col("id")) & (F.col("text") == F.col("output"))
    return candidates.filter("selected").join(good.select("id", "output"), on).groupBy("unit_id").agg(F.max(F.struct("attempt_id", "text")).alias("_c")).select("unit_id", "_c.*")


def recoverable_within(candidates: DataFrame, attempts: DataFrame, work: DataFrame, runs: DataFrame, policy: str, repair: str, run: str | None = None, invocation: str | None = None) -> DataFrame:
    """`recoverable` for attempts(..., work_item) of one run, of one invocation, or of any: work(work_item, run_id), runs(run_id, invocation)."""
    of = attempts.join(work.select("work_item", "run_id"), "work_item")
    if run is not None:
        of = of.filter(F.col("run_id") == run)
    if invocation is not None:
        of = of.join(runs.filter(F.col("invocation") == invocation).select("run_id"), "run_id", "left_semi")
    return recoverable(candidates, of, policy, repair)


def attempt_status(attempts: DataFrame) -> DataFrame:
    """(work_item, dedupe_key, status, known): a status that is none of the domain's is not known."""
    return attempts.select("work_item", "dedupe_key", "status", F.coalesce(F.col("status").isin(*ATTEMPT_STATES), F.lit(False)).alias("known"))


def selected_candidates(candidates: DataFrame) -> DataFrame:
    """The text selected for each unit and locale; two selections of one are a fault and both are shown."""
    return candidates.filter("selected").select("unit_id", "locale", "text")


def unchanged_units(units: DataFrame, documents: DataFrame, versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Unit keys, in order, of the documents whose content wanted(repository_id, path, content_hash) says has not changed.

    Units must be active, their documents not deleted, and a version(unit_id, source_revision, source_hash, source_text) must
    hold what the unit says at the document's revision.
    """
    live = documents.filter("deleted_at is null").join(wanted, ["repository_id", "path", "content_hash"], "left_semi")
    of = units.filter("active").join(live.select("document_id", "repository_id", "path", F.coalesce("source_revision", F.lit("")).alias("source_revision")), "document_id")
    held = of.join(versions.select("unit_id", "source_revision", "source_hash", "source_text"), ["unit_id", "source_revision", "source_hash", "source_text"], "left_semi")
    return held.select("repository_id", "path", "ordinal", "unit_key")


def hinted(current: DataFrame, unchanged: DataFrame) -> DataFrame:
    """Adds `hint` to current(path, stable_id): the stable id itself where the unit was there when its document was last seen, else null."""
    known = unchanged.select("path", F.col("unit_key").alias("stable_id")).distinct().withColumn("hint", F.col("stable_id"))
    return current.join(known, ["path", "stable_id"], "left")


def trusted_translations(memory: DataFrame, candidates: DataFrame) -> DataFrame:
    """Text of each place's open trusted entry, if a valid trusted candidate(unit_id, text, context_key, trusted, valid) still says the same."""
    open_ = memory.filter("tier = 'trusted' and superseded_at is null")
    good = candidates.filter("trusted and valid").select("unit_id", "text", "context_key").distinct()
    return open_.join(good, ["unit_id", "text", "context_key"], "left_semi").select("repository_id", "locale", "source_hash", "context_key", "text")


def canonical_files(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Files of wanted(repository_id, locale, path), null where there is none."""
    return wanted.join(files, ["repository_id", "locale", "path"], "left")


def document_intents(selection: DataFrame, intents: DataFrame) -> DataFrame:
    """The identity selected for each content: the selection must name an intent of that very content."""
    return selection.join(intents, ["content_version_id", "intent_id"]).select("content_version_id", "identity")


def identity_compatible(request_identity: Column, request_hash: Column, mapping: Column, current: Column) -> Column:
    """Whether a stored identity is true to itself and maps the document as the current one does."""
    return F.coalesce((request_identity == request_hash) & (mapping == current), F.lit(False))


def document_ids(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """document_id of wanted(repository_id, path), null for deleted and unknown ones."""
    return wanted.join(documents.filter("deleted_at is null").select("repository_id", "path", "document_id"), ["repository_id", "path"], "left")


def json_joined(entries: DataFrame, column: str, field: str, other: DataFrame, key: str) -> DataFrame:
    """Entries with the rows whose key their JSON names: the field is a column before the join, so it is an equi-join."""
    return entries.withColumn("_j", F.get_json_object(column, f"$.{field}")).join(other.withColumn("_j", F.col(key).cast("string")), "_j").drop("_j")


def review_attempts(attempts: DataFrame, run: str | None = None, invocation: str | None = None) -> DataFrame:
    """Attempts whose key ends as reviews' keys do, of the run or of the invocation; of all if neither is given."""
    mine = F.lit(run is None and invocation is None)
    for column, value in (("run_id", run), ("invocation", invocation)):
        if value is not None:
            mine = mine | F.coalesce(F.col(column) == value, F.lit(False))
    ends = F.lit(False)
    for suffix in REVIEWS:
        ends = ends | F.endswith("dedupe_key", F.lit(suffix))
    return attempts.filter(mine & ends)


def provenance(attempts: DataFrame, versions: DataFrame, audits: DataFrame) -> DataFrame:
    """attempts(id, version, policy), each with its version or else the first one made for it, and an audit's policy in place of its own."""
    first = versions.groupBy(F.col("attempt_id").alias("id")).agg(F.min("version").alias("_first"))
    said = audits.groupBy("version").agg(F.max(F.struct("at", "policy")).alias("_s")).select("version", F.col("_s.policy").alias("_policy"))
    bound = attempts.join(first, "id", "left").withColumn("version", F.coalesce("version", "_first")).join(said, "version", "left")
    return bound.select("id", "version", F.coalesce("_policy", "policy").alias("policy"))


def compatible(contents: DataFrame, links: DataFrame) -> DataFrame:
    """Whether all active versions linked to each content are valid; not if links exist and none is active. links(content, active, valid)."""
    seen = links.groupBy("content").agg(F.bool_or("active").alias("_any"), F.bool_and(~F.col("active") | F.coalesce("valid", F.lit(False))).alias("_all"))
    return contents.join(seen, "content", "left").select(*contents.columns, F.coalesce(F.col("_any") & F.col("_all"), F.lit(True)).alias("compatible"))


def content_matches(files: DataFrame, versions: DataFrame, key: list[str]) -> DataFrame:
    """Whether each file is stored with all columns of the key, bytes and their hash included."""
    stored = versions.select(*key).distinct().withColumn("_stored", F.lit(True))
    return files.join(stored, key, "left").withColumn("matches", F.coalesce("_stored", F.lit(False)) & (F.sha2("content", 256) == F.col("content_hash"))).drop("_stored")


def snapshot(manifests: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """Files(manifest, ...) of the eligible manifest(id, state) of each key: the merged one, else the newest that nothing superseded."""
    top = manifests.filter("state <> 'superseded'").groupBy(*key).agg(F.max(F.struct(F.col("state") == "merged", "id")).getField("id").alias("manifest"))
    return top.join(files, "manifest")


def publishable(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(publication, ok, uniform) of files(publication, path, revision, shape, n_units): each path once, each with a source(path, shape, n_units) alike.

    uniform says whether all files come from one revision.
    """
    # a path's rows are combined first, so that no publication's paths are gathered; what a path holds counts only where it is one row
    rows = state.spread(files, "publication", "path").groupBy("publication", "path").agg(F.count("*").alias("n"), F.min("revision").alias("r0"), F.max("revision").alias("r1"), F.max("shape").alias("s"), F.max("n_units").alias("u"))
    wanted = rows.select("publication", "path", "r0", "r1", F.when(F.col("n") == 1, F.struct("s", "u")).alias("is"))
    both = state.spread(wanted, "path", like=files).join(sources.select("path", F.struct("shape", "n_units").alias("was")), "path", "left")
    alike = F.coalesce(F.col("is") == F.col("was"), F.lit(False))
    return both.groupBy("publication").agg(F.bool_and(alike).alias("ok"), (F.min("r0") == F.max("r1")).alias("uniform"))


def assessed(publications: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Whether a merged publication is verified, superseded or, without files, unchanged; verdicts(publication, good) is a row a file."""
    by = verdicts.groupBy("publication").agg(F.bool_and(F.coalesce("good", F.lit(False))).alias("_good"))
    said = F.when(F.col("_good").isNull(), "unchanged").when(F.col("_good"), "verified").otherwise("superseded")
    return publications.join(by, "publication", "left").withColumn("assessment", said).drop("_good")


def retired(pending: DataFrame, intents: DataFrame, key: list[str]) -> DataFrame:
    """Pending entries that no current intent agrees with."""
    return pending.join(intents.select(*key).distinct(), key, "left_anti")


def resolved_links(wanted: DataFrame, versions: DataFrame, linked: DataFrame, memory: DataFrame) -> DataFrame:
    """The version each wanted(content, unit_id, text) binds: a passed one that the content is linked to, else the newest passed one.

    versions(unit_id, text, version), linked(content, version), memory(unit_id, text, trusted). Without a version one is to be
    made, and `provenance` says from what: trusted_tm, candidate_tm or other.
    """
    old = wanted.join(versions, ["unit_id", "text"]).join(linked.select("content", "version").distinct().withColumn("_l", F.lit(True)), ["content", "version"], "left")
    top = old.groupBy("content", "unit_id", "text").agg(F.max(F.struct(F.col("_l").isNotNull(), "version")).getField("version").alias("version"))
    tier = memory.groupBy("unit_id", "text").agg(F.bool_or("trusted").alias("_t"))
    made = F.when(F.col("version").isNotNull(), "linked").when(F.col("_t"), "trusted_tm").when(~F.col("_t"), "candidate_tm").otherwise("other")
    return wanted.join(top, ["content", "unit_id", "text"], "left").join(tier, ["unit_id", "text"], "left").withColumn("provenance", made).drop("_t")


def positional(source: DataFrame, target: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """Pairs of equal places, in those keys only in which both sides have equally many rows."""
    count = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    even = count(source, "_a").join(count(target, "_b"), key).filter("_a = _b").select(*key)
    return source.join(even, key, "left_semi").join(target, [*key, ordinal])


def set_relations(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """equal, superset, subset or differs for each key's set of other columns; compared row by row, no set is gathered."""
    # the two are one table of marked rows, so neither is sorted to be joined; a row with a null equals none of the other side
    marked = a.select("*", F.lit(1).alias("_side")).union(b.select(*a.columns, F.lit(2).alias("_side")))
    rows = state.spread(marked, *a.columns).groupBy(*a.columns).agg(F.bit_or("_side").alias("_sides"))
    odd = reduce(Column.__or__, [F.col(c).isNull() for c in a.columns]) & (F.col("_sides") == 3)
    seen = rows.groupBy(*key).agg(F.bool_or((F.col("_sides") == 2) | odd).alias("less"), F.bool_or((F.col("_sides") == 1) | odd).alias("more"))
    return seen.select(*key, F.when(F.col("less") & F.col("more"), "differs").when(F.col("more"), "superset").when(F.col("less"), "subset").otherwise("equal").alias("relation"))


def ledger_faults(applied: DataFrame, known: DataFrame) -> DataFrame:
    """Faults of a ledger of (version, name, checksum): versions that follow no other, and ones that are not as known."""
    before = applied.select((F.col("version") + 1).alias("version"))
    gaps = applied.filter("version > 1").join(before, "version", "left_anti").select("version", F.lit("gap").alias("fault"))
    strange = applied.join(known, ["version", "name", "checksum"], "left_anti").select("version", F.lit("differs").alias("fault"))
    return gaps.union(strange)


def fingerprint_ok(x: Column) -> Column:
    return F.coalesce(x.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def json_ok(x: Column) -> Column:
    """Whether x is one JSON value and nothing else; the parser itself overlooks what follows a value, hence the two frames."""
    in_list = F.try_parse_json(F.concat(F.lit("["), x, F.lit("]"))).try_cast("array<variant>")
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), x, F.lit("}")))
    return F.coalesce((F.size(in_list) == 1) & in_object.isNotNull(), F.lit(False))
