"""Business transactions over state tables: what a set of requests would write, table by table, as one staged commit.

Every function takes current state tables (see `state.latest`) and a table of requests, checks each request by the rules
that guard it, and returns a `Staged`: rows to append to each table, whole rows that replace those of the same key, and the
requests refused, each with the first rule it broke. Nothing of a refused request is written; nothing is updated in
place. `sources.store.Store.commit` writes all tables of a `Staged` under one batch id, or none.

Requests of one call are handled as a set, by joins on their keys; where several meet on one key, `at` orders them. Ids are
hashes of the natural keys, so a batch that is brought again stages the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import state
from ..plans.reads import fingerprint_ok, json_ok

DONE = "superseded by newer canonical content"
TRUSTED_PLACE = ["repository_id", "locale", "source_hash", "context_key"]
IDENTITY = ["agent", "provider", "model", "adapter", "prompt_version"]


@dataclass
class Staged:
    rows: dict[str, DataFrame] = field(default_factory=dict)
    refused: DataFrame | None = None
    receipts: DataFrame | None = None


def id_of(*parts: Column) -> Column:
    """An id by the natural key: 16 hex digits of a hash of the parts, each led by its length, null unlike empty."""
    led = [F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.substring(F.sha2(F.concat(*led), 256), 1, 16)


def digest_of(*parts: Column) -> Column:
    """128 bits of the parts, told apart as in `id_of`."""
    led = [F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.unhex(F.substring(F.sha2(F.concat(*led), 256), 1, 32))


def guarded(requests: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Requests that keep all rules, and the others with the first one they break; a rule that is null is broken."""
    first = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()], F.lit(None).cast("string"))
    marked = requests.withColumn("refusal", first)
    return marked.filter("refusal is null").drop("refusal"), marked.filter("refusal is not null")


def changed(rows: DataFrame, **values: Column) -> DataFrame:
    """Rows with some columns replaced, and only the columns they had."""
    return rows.select(*[values[c].alias(c) if c in values else F.col(c) for c in rows.columns])


def _newest(requests: DataFrame, key: list[str]) -> DataFrame:
    return state.latest(requests, key, ["at"])


def _known(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """The columns of a table under names led by its own, as one struct to be joined."""
    return df.select(*[F.col(c).alias(f"{name}_{c}") for c in columns])


# Runs


def begin_runs(runs: DataFrame, requests: DataFrame) -> Staged:
    """runs(run_id, repository_id, invocation_key, policy, metadata, status, started_at, heartbeat_at, finished_at): a known invocation runs on, another begins."""
    good, refused = guarded(requests, {"POLICY": fingerprint_ok(F.col("policy")), "METADATA": json_ok(F.col("metadata"))})
    good = _newest(good, ["invocation_key"])
    old = runs.join(good.select("invocation_key", "at"), "invocation_key")
    again = changed(old, status=F.lit("running"), heartbeat_at=F.col("at"), finished_at=F.lit(None).cast("long")).select(*runs.columns)
    new = good.join(runs.select("invocation_key"), "invocation_key", "left_anti").select(
        id_of(F.lit("run"), F.col("invocation_key")).alias("run_id"), "repository_id", "invocation_key", "policy", "metadata", F.lit("running").alias("status"),
        F.col("at").alias("started_at"), F.col("at").alias("heartbeat_at"), F.lit(None).cast("long").alias("finished_at"),
    ).select(*runs.columns)
    rows = again.unionByName(new)
    return Staged({"runs": rows}, refused, rows.select("invocation_key", "run_id"))


def finish_runs(runs: DataFrame, requests: DataFrame) -> Staged:
    """requests(run_id, new_status, at)."""
    both = runs.join(_newest(requests, ["run_id"]), "run_id")
    rows = changed(both, status=F.col("new_status"), heartbeat_at=F.col("at"), finished_at=F.col("at")).select(*runs.columns)
    return Staged({"runs": rows}, requests.join(runs.select("run_id"), "run_id", "left_anti").withColumn("refusal", F.lit("RUN")))


def of_run(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds `run_ok`: whether the run belongs to the repository that the request names."""
    known = runs.select("run_id", "repository_id").withColumn("run_ok", F.lit(True))
    return requests.join(known, ["run_id", "repository_id"], "left").withColumn("run_ok", F.coalesce("run_ok", F.lit(False)))


# Attempts, candidates and memory


def attempt_rules() -> dict[str, Column]:
    """What every attempt has to name."""
    rules = {c.upper(): F.length(F.trim(F.col(c))) > 0 for c in IDENTITY}
    return rules | {c.upper(): fingerprint_ok(F.col(c)) for c in ("provider_fingerprint", "prompt_hash", "policy")}


def record_candidates(tables: dict[str, DataFrame], requests: DataFrame) -> Staged:
    """Successful attempts with the candidate, version and memory entry that each selects.

    tables: attempts(attempt_id, work_item_id, dedupe_key, attempt_no, status, response, at, ...), candidates(unit_id, locale,
    candidate_key, text, attempt_id, score, selected), versions(version_id, unit_version_id, locale, text, provenance,
    validation, review, publication, policy, attempt_id, superseded_at), memory(memory_id, repository_id, unit_id,
    version_id, locale, source_hash, source_revision, context_key, text, tier, provenance, policy, at, superseded_at) and
    sources(unit_id, unit_version_id, repository_id, source_hash, source_revision, context_key).
    requests: an attempt's columns with unit_id, locale, candidate_key, text, score, provenance. A key that is
    there keeps its attempt, and must have succeeded with the same response.
    """
    attempts, candidates, versions, memory = (tables[n] for n in ("attempts", "candidates", "versions", "memory"))
    key = ["work_item_id", "dedupe_key"]
    known = attempts.select(*key, F.col("attempt_id").alias("old_id"), F.col("status").alias("old_status"), F.col("response").alias("old_response"))
    first = state.insert_absent(requests.limit(0).select(*key), requests, key, "at")
    both = first.join(known, key, "left").join(tables["sources"], "unit_id", "left")
    output = F.get_json_object("response", "$.output")
    good, refused = guarded(both, {"STATUS": F.col("status") == "succeeded", **attempt_rules(), "RESPONSE": json_ok(F.col("response")), "OUTPUT": output == F.col("text"), "UNIT": F.col("unit_version_id").isNotNull(),
                                   "CONFLICT": F.col("old_id").isNull() | ((F.col("old_status") == "succeeded") & F.col("old_response").eqNullSafe(F.col("response")))})
    good = good.withColumn("attempt_id", F.coalesce("old_id", id_of(F.lit("attempt"), F.col("work_item_id"), F.col("dedupe_key"))))
    fresh = state.attempt_numbers(good.filter("old_id is null"), ["work_item_id"], ["at", "dedupe_key"], attempts)
    # the newest request of a unit and locale is the one selected
    chosen = state.latest(good, ["unit_id", "locale"], ["at", "candidate_key"])
    mine = ["unit_id", "locale", "candidate_key"]
    made = state.latest(good, mine, ["at"]).join(chosen.select(*mine).withColumn("top", F.lit(True)), mine, "left")
    made = made.select(*[F.coalesce("top", F.lit(False)).alias(c) if c == "selected" else F.col(c) for c in candidates.columns])
    rest = candidates.filter("selected").join(chosen.select("unit_id", "locale"), ["unit_id", "locale"], "left_semi").join(made.select(*mine), mine, "left_anti")
    none = F.lit(None).cast("long")
    version = {
        "version_id": id_of(F.lit("version"), F.col("attempt_id")), "validation": F.lit("passed"), "review": F.lit("unreviewed"), "publication": F.lit("candidate"), "superseded_at": none,
    }
    of_attempt = versions.filter("attempt_id is not null").groupBy("attempt_id").agg(F.min("version_id").alias("old_version"))
    bound = state.latest(good, ["attempt_id"], ["at"]).join(of_attempt, "attempt_id", "left")
    new_versions = bound.filter("old_version is null").select(*[version.get(c, F.col(c)).alias(c) for c in versions.columns])
    place = ["repository_id", "locale", "source_hash", "context_key"]
    open_ = memory.filter("tier = 'candidate' and superseded_at is null").select(*place, F.col("memory_id").alias("old_memory"))
    entry = state.latest(bound.withColumn("version_id", F.coalesce("old_version", version["version_id"])), place, ["at"]).join(open_, place, "left")
    values = {"memory_id": F.coalesce("old_memory", id_of(F.lit("memory"), F.lit("candidate"), *[F.col(c) for c in place], F.col("version_id"))), "tier": F.lit("candidate"), "superseded_at": none}
    entries = entry.select(*[values.get(c, F.col(c)).alias(c) for c in memory.columns])
    rows = {"attempts": fresh.select(*attempts.columns), "candidates": made.unionByName(changed(rest, selected=F.lit(False))), "versions": new_versions, "memory": entries}
    return Staged(rows, refused.select(*requests.columns, "refusal"), good.select(*key, "attempt_id", F.col("old_id").isNull().alias("inserted")))


def retire(tables: dict[str, DataFrame], requests: DataFrame) -> Staged:
    """Takes back attempts of requests(attempt_id, at): their keys become free, what they made is quarantined or history."""
    asked = requests.groupBy("attempt_id").agg(F.max("at").alias("asked_at"))
    attempts, candidates, versions, memory = (tables[n] for n in ("attempts", "candidates", "versions", "memory"))
    late = lambda c: F.concat(F.col(c), F.lit(":superseded:"), F.col("attempt_id").cast("string"))
    tried = attempts.filter("status = 'succeeded'").join(asked, "attempt_id")
    tried = changed(tried, dedupe_key=late("dedupe_key"), status=F.lit("cancelled"), error=F.lit("stored output rejected by current document contract"))
    # candidates are told apart by their key, so an old key is closed as well as the new one opened
    picked = candidates.join(asked, "attempt_id")
    picked = changed(picked, selected=F.lit(False), candidate_key=late("candidate_key"))
    gone = versions.join(asked, "attempt_id")
    out = {"attempts": tried.select(*attempts.columns), "candidates": picked.select(*candidates.columns)}
    return Staged(out | _close(versions, memory, gone.withColumn("close_at", F.col("asked_at"))))


def _close(versions: DataFrame, memory: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """Versions `gone` as quarantined, and their open memory as history, at close_at."""
    shut = gone.select("version_id", "close_at").distinct()
    held = memory.filter("superseded_at is null").join(shut, "version_id")
    return {
        "versions": changed(gone, validation=F.lit("quarantined"), superseded_at=F.col("close_at")).select(*versions.columns),
        "memory": changed(held, tier=F.lit("history"), superseded_at=F.col("close_at")).select(*memory.columns),
    }


def quarantine(tables: dict[str, DataFrame], valid: DataFrame, scope: DataFrame, at: int) -> Staged:
    """Closes open versions of scope(unit_version_id, locale) that valid(version_id) does not name."""
    versions = tables["versions"]
    open_ = versions.filter("superseded_at is null").join(scope.select("unit_version_id", "locale").distinct(), ["unit_version_id", "locale"], "left_semi")
    gone = open_.join(valid.select("version_id").distinct(), "version_id", "left_anti").withColumn("close_at", F.lit(at).cast("long"))
    return Staged(_close(versions, tables["memory"], gone))


def trust(tables: dict[str, DataFrame], requests: DataFrame) -> Staged:
    """Trusted memory from requests(repository_id, unit_id, unit_version_id, locale, source_hash, source_revision, context_key, text, provenance, policy, at): a
    text that is trusted already stays, another becomes history and is followed by the new one with a version of its own."""
    versions, memory = tables["versions"], tables["memory"]
    place = TRUSTED_PLACE
    good, refused = guarded(requests, {"UNIT": F.col("unit_version_id").isNotNull(), "POLICY": fingerprint_ok(F.col("policy"))})
    good = _newest(good, place)
    held = memory.filter("tier = 'trusted' and superseded_at is null")
    new = good.join(held.select(*place, "text"), [*place, "text"], "left_anti")
    old = held.join(new.select(*place, F.col("at").alias("new_at")), place)
    made = trusted_rows(tables, new)
    return Staged({"versions": made["versions"], "memory": _history(old, memory).unionByName(made["memory"])}, refused)


def _history(old: DataFrame, memory: DataFrame) -> DataFrame:
    """Entries that others follow at `new_at`."""
    return changed(old, tier=F.lit("history"), superseded_at=F.col("new_at")).select(*memory.columns)


def trusted_rows(tables: dict[str, DataFrame], new: DataFrame) -> dict[str, DataFrame]:
    """The versions and entries of memory that newly trusted texts make."""
    versions, memory = tables["versions"], tables["memory"]
    place = [F.col(c) for c in TRUSTED_PLACE]
    values = {
        "version_id": id_of(F.lit("trusted"), *place, F.col("text"), F.col("at")), "memory_id": id_of(F.lit("memory"), F.lit("trusted"), *place, F.col("at")), "tier": F.lit("trusted"),
        "validation": F.lit("passed"), "review": F.lit("approved"), "publication": F.lit("candidate"), "superseded_at": F.lit(None).cast("long"), "attempt_id": F.lit(None).cast("string"),
    }
    made = new.select(*[(F.lit("trusted_tm") if c == "provenance" else values.get(c, F.col(c) if c in new.columns else F.lit(None))).alias(c) for c in versions.columns])
    return {"versions": made, "memory": new.select(*[values.get(c, F.col(c)).alias(c) for c in memory.columns])}


# Documents and work


def prepare(tables: dict[str, DataFrame], documents: DataFrame, units: DataFrame) -> Staged:
    """Documents and their units come in with the work they ask for.

    tables: runs, documents(document_id, repository_id, path, source_revision, content_hash, metadata, created_at, deleted_at),
    units(unit_id, document_id, unit_key, ordinal, source_text, source_hash, context, active, created_at),
    unit_versions(unit_version_id, unit_id, source_revision, source_hash, source_text, context), work_items(work_item_id, run_id,
    unit_id, document_id, locale, kind, input, status, result, created_at).
    documents: run_id, repository_id, path, locale, source_revision, content_hash, metadata, at; units: repository_id, path, unit_key,
    ordinal, source_text, source_hash, context, enqueue (the work's input, or null). A request whose unit has work
    for another revision, path or unit is refused as a whole.
    """
    good, refused = _prepared(tables, documents, units)
    facts = _unit_facts(tables, good, units)
    texts = _with_texts(units, facts)
    state.drop(facts)
    rows, of = _staged_units(tables, good, texts)
    work = of.filter("enqueue is not null").select("run_id", "unit_id", F.lit(None).cast("string").alias("document_id"), "locale", F.lit("pipeline").alias("kind"), F.col("enqueue").alias("input"), "at")
    return Staged(rows | {"work_items": enqueued(tables["work_items"], work)}, refused.select(*documents.columns, "refusal"), of.select("repository_id", "path", "unit_key", "unit_id", "document_id"))


def _prepared(tables: dict[str, DataFrame], documents: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that may come in, with their document's id, and the others; kept, as both are read again. Of units nothing but what their work names is shuffled."""
    place = ["repository_id", "path"]
    asked = of_run(documents, tables["runs"])
    if "enqueue" in units.columns:
        named = lambda c: F.get_json_object("enqueue", f"$.{c}")
        fits = F.coalesce((named("path") == F.col("path")) & (named("unit") == F.col("unit_key")), F.lit(False))
        said = units.filter("enqueue is not null").select(*place, F.when(fits, named("source_revision")).alias("said")).distinct()
        strange = said.join(documents.select(*place, "source_revision"), place).filter(~F.coalesce(F.col("said") == F.col("source_revision"), F.lit(False)))
        asked = asked.join(strange.select(*place).distinct().withColumn("odd", F.lit(True)), place, "left")
    else:
        asked = asked.withColumn("odd", F.lit(None).cast("boolean"))
    rules = {"RUN": F.col("run_ok"), "METADATA": json_ok(F.col("metadata")), "WORK": F.col("odd").isNull()}
    both = [df.select(*documents.columns, r.alias("refusal")) for df, r in zip(guarded(asked, rules), (F.lit(None).cast("string"), F.col("refusal")), strict=True)]
    both = state.keep(both[0].union(both[1]).withColumn("document_id", _document_id()))
    return both.filter("refusal is null").drop("refusal"), both.filter("refusal is not null").drop("document_id")


def _document_id() -> Column:
    return id_of(F.lit("document"), F.col("repository_id"), F.col("path"))


def _unit_id() -> Column:
    return id_of(F.lit("unit"), _document_id(), F.col("unit_key"))


def _version_id() -> Column:
    return id_of(F.lit("unit_version"), F.col("unit_id"), F.col("source_revision"), F.col("source_hash"))


def _spot() -> Column:
    return digest_of(*[F.col(c) for c in TRUSTED_PLACE])


def _whole(columns: list[str]) -> Column:
    """Whether none is null: such rows equal no others in a join."""
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])


def _unit_key(units: DataFrame) -> Column:
    """Tells units apart by all that facts are about."""
    return digest_of(*[F.col(c) for c in ("repository_id", "path", "unit_key", "source_hash", "context_key", "target_text") if c in units.columns])


def _unit_facts(tables: dict[str, DataFrame], good: DataFrame, units: DataFrame) -> DataFrame:
    """What is known of each unit of a good request, by `key`, without its texts: ids, when it came in first (`was`), whether its version is there (`seen`)."""
    place, of_request = ["repository_id", "path"], [c for c in ("run_id", "locale", "source_revision", "policy", "at") if c in good.columns]
    target = [digest_of(F.col("target_text")).alias("target")] if "target_text" in units.columns else []
    slim = units.select(*place, _unit_key(units).alias("key"), "source_hash", *[c for c in ("context_key",) if c in units.columns], *target, _unit_id().alias("unit_id"))
    of = slim.join(good.select(*place, *of_request), place).withColumn("unit_version_id", _version_id())
    if target:
        of = of.withColumns({"spot": _spot(), "whole": _whole(TRUSTED_PLACE), "fact": digest_of(F.hex("key"), *[F.col(c) for c in of_request])})
    of = of.drop("repository_id", "path", "source_hash", "context_key")
    of = of.groupBy(*of.columns).agg((F.count("*") > 1).alias("twice"))
    known = of.join(tables["units"].select("unit_id", F.col("created_at").alias("was")), "unit_id", "left")
    there = tables["unit_versions"].select("unit_version_id").distinct().withColumn("seen", F.lit(True))
    return state.keep(known.join(there, "unit_version_id", "left"))


def _with_texts(units: DataFrame, facts: DataFrame) -> DataFrame:
    """Units with their facts; kept, for each table is made of it and a text is to be shuffled once."""
    of = units.withColumn("key", _unit_key(units)).join(facts.drop("unit_id"), "key").drop("key")
    # what is not trusted anew needs no target
    return state.keep(of.withColumn("target_text", F.when(F.col("won"), F.col("target_text"))) if "won" in facts.columns else of)


def _staged_units(tables: dict[str, DataFrame], good: DataFrame, texts: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Rows of documents, units and unit_versions, and the units with their ids."""
    old, none = tables["documents"], F.lit(None).cast("long")
    first = good.join(old.select("document_id", F.col("created_at").alias("was")), "document_id", "left")
    doc_rows = first.select(*[{"created_at": F.coalesce("was", "at"), "deleted_at": none}.get(c, F.col(c)).alias(c) for c in old.columns])
    of = texts.withColumns({"document_id": _document_id(), "unit_id": _unit_id()})
    unit_rows = of.select(*[{"created_at": F.coalesce("was", "at"), "active": F.lit(True)}.get(c, F.col(c)).alias(c) for c in tables["units"].columns])
    version_rows = of.filter("seen is null").select(*tables["unit_versions"].columns)
    return {"documents": doc_rows, "units": unit_rows, "unit_versions": version_rows}, of


def work_id() -> Column:
    return id_of(F.lit("work"), F.col("run_id"), F.col("unit_id"), F.col("document_id"), F.col("locale"), F.col("kind"), F.col("input"))


def enqueued(work_items: DataFrame, work: DataFrame) -> DataFrame:
    """work(run_id, unit_id or document_id, locale, kind, input, at) that is not there yet, as pending rows."""
    new = work.withColumn("work_item_id", work_id()).dropDuplicates(["work_item_id"]).join(work_items.select("work_item_id"), "work_item_id", "left_anti")
    return new.select(*[{"status": F.lit("pending"), "result": F.lit(None).cast("string"), "created_at": F.col("at")}.get(c, F.col(c)).alias(c) for c in work_items.columns])


def begin_verification(tables: dict[str, DataFrame], requests: DataFrame) -> Staged:
    """Work of kind assembly or project_check for requests(run_id, document_id, locale, kind, input, at)."""
    good, refused = guarded(requests, {"KIND": F.col("kind").isin("assembly", "project_check"), "INPUT": json_ok(F.col("input"))})
    work = good.withColumn("unit_id", F.lit(None).cast("string"))
    return Staged({"work_items": enqueued(tables["work_items"], work)}, refused, work.select(work_id().alias("work_item_id"), *requests.columns))


def complete_verification(tables: dict[str, DataFrame], requests: DataFrame, found: DataFrame) -> Staged:
    """requests(work_item_id, result_kind, result, at) with found(work_item_id, fingerprint, code, message): work without findings that is not rejected has succeeded.

    findings(work_item_id, fingerprint, severity, code, message, resolved_at) are upserted as open errors.
    """
    work, findings = tables["work_items"], tables["findings"]
    expected = F.when(F.col("result_kind").isin("assembled", "rejected"), "assembly").when(F.col("result_kind") == "checked", "project_check")
    asked = requests.withColumnRenamed("result", "new_result").join(work, "work_item_id", "left").join(found.groupBy("work_item_id").agg(F.count("*").alias("n_found")), "work_item_id", "left")
    good, refused = guarded(asked, {"DOCUMENT": F.col("document_id").isNotNull(), "KIND": F.col("kind") == expected, "RESULT": json_ok(F.col("new_result"))})
    ok = F.col("n_found").isNull() & (F.col("result_kind") != "rejected")
    done = changed(good, status=F.when(ok, "succeeded").otherwise("failed"), result=F.col("new_result")).select(*work.columns)
    rows = found.join(good.select("work_item_id"), "work_item_id", "left_semi").dropDuplicates(["work_item_id", "fingerprint"])
    rows = rows.select(*[{"severity": F.lit("error"), "resolved_at": F.lit(None).cast("long")}.get(c, F.col(c)).alias(c) for c in findings.columns])
    return Staged({"work_items": done, "findings": rows}, refused.select("work_item_id", "refusal"))


# Files written to the target tree

OUTBOX = "outbox_id string, work_item_id string, run_id string, repository_id long, document_id string, locale string, path string, dedupe_key string, payload string, state string, owner string, owner_alive boolean, lease_expires_at long, available_at long, last_error string, completed_at long"


def effect_keys(requests: DataFrame, outbox: DataFrame) -> DataFrame:
    """Adds dedupe_key to requests(base_key): base, or the key after the last finished one of its chain.

    A chain is base, base:after:<id of base>, base:after:<id of that> and so on; the first key that is not there or not done is free.
    """
    base = F.regexp_extract("dedupe_key", "^(.*?)(:after:[^:]*)?$", 1)
    after = F.regexp_extract("dedupe_key", ":after:([^:]*)$", 1)
    chain = outbox.filter("state = 'done'").select(base.alias("base_key"), F.when(after != "", after).alias("after_id"), "outbox_id")
    # of a chain's finished entries the last is the one that no other follows
    followed = chain.filter("after_id is not null").select("base_key", F.col("after_id").alias("outbox_id"))
    last = chain.join(followed, ["base_key", "outbox_id"], "left_anti").groupBy("base_key").agg(F.max("outbox_id").alias("last_id"))
    return requests.join(last, "base_key", "left").withColumn("dedupe_key", F.when(F.col("last_id").isNull(), F.col("base_key")).otherwise(F.concat("base_key", F.lit(":after:"), "last_id"))).drop("last_id")


def schedule(tables: dict[str, DataFrame], requests: DataFrame) -> Staged:
    """Intents to write a file, requests(run_id, repository_id, document_id, locale, path, dedupe_key, work_input, payload, at).

    tables: runs, documents, work_items, outbox (OUTBOX). Older entries of the same repository, locale and path that are not
    done give way and their work is cancelled, unless one of them has a live owner; a key that is there must name the same
    intent and not be done. A request names its repository, locale, path and key in its payload and input.
    """
    outbox, work = tables["outbox"], tables["work_items"]
    place = ["repository_id", "locale", "path"]
    asked = of_run(_newest(requests, place), tables["runs"])
    asked = asked.join(tables["documents"].select("document_id", "repository_id").withColumn("doc_ok", F.lit(True)), ["document_id", "repository_id"], "left")
    was = outbox.select("dedupe_key", F.struct("repository_id", "document_id", "locale", "path").alias("was"), F.col("state").alias("was_state"), F.col("outbox_id").alias("was_id"), F.col("work_item_id").alias("was_work"))
    asked = asked.join(was, "dedupe_key", "left")
    older = outbox.filter("state <> 'done'").join(asked.select(*place, F.col("dedupe_key").alias("new_key"), F.col("at").alias("new_at")), place).filter("dedupe_key <> new_key")
    live = (F.col("state") == "processing") & F.coalesce("owner_alive", F.lit(False))
    asked = asked.join(older.filter(live).select(*place).distinct().withColumn("busy", F.lit(True)), place, "left")
    says = lambda c, p: F.get_json_object(c, f"$.{p}")
    same = F.col("was").isNull() | (F.col("was") == F.struct("repository_id", "document_id", "locale", "path"))
    fits = F.coalesce("doc_ok", F.lit(False)) & (says("payload", "repository_id") == F.col("repository_id").cast("string")) & (says("payload", "locale") == F.col("locale")) & (says("payload", "path") == F.col("path")) & (says("work_input", "effect_key") == F.col("dedupe_key"))
    good, refused = guarded(asked, {"RUN": F.col("run_ok"), "JSON": json_ok(F.col("payload")) & json_ok(F.col("work_input")), "CONFLICT": same, "TERMINAL": ~F.col("was_state").eqNullSafe(F.lit("done")), "INTENT": fits, "BUSY": F.col("busy").isNull()})
    gone = older.join(good.select(*place), place, "left_semi")
    null = lambda t: F.lit(None).cast(t)
    ended = changed(gone, state=F.lit("done"), owner=null("string"), lease_expires_at=null("long"), last_error=F.lit(DONE), completed_at=F.col("new_at")).select(*outbox.columns)
    cancelled = changed(work.join(gone.select("work_item_id").distinct(), "work_item_id", "left_semi"), status=F.lit("cancelled"))
    intent = good.select("*", null("string").alias("unit_id"), F.lit("materialization").alias("kind"), F.col("work_input").alias("input"))
    intent = intent.withColumn("work_item_id", F.coalesce("was_work", work_id())).withColumn("outbox_id", F.coalesce("was_id", id_of(F.lit("outbox"), F.col("dedupe_key"))))
    fresh = intent.filter("was_id is null")
    values = {"state": F.lit("pending"), "owner": null("string"), "owner_alive": null("boolean"), "lease_expires_at": null("long"), "available_at": F.col("at"), "last_error": null("string"), "completed_at": null("long")}
    entries = fresh.select(*[values.get(c, F.col(c)).alias(c) for c in outbox.columns])
    rows = {"work_items": cancelled.unionByName(enqueued(work, fresh.select("run_id", "unit_id", "document_id", "locale", "kind", "input", "at"))), "outbox": ended.unionByName(entries)}
    return Staged(rows, refused.select(*requests.columns, "refusal"), intent.select("dedupe_key", "work_item_id", "outbox_id"))


# What a file's states become; None leaves a state as it is.
FILE_MOVES = {
    "materialized": {"state": "materialized"},
    "human_edit": {"state": "human_edit", "review_state": "needs_review"},
    "adopted": {"state": "adopted", "freshness": "exact", "provenance": "human", "validation_state": "passed", "review_state": "approved", "trust_tier": "trusted"},
    "commit_created": {"publication_state": "commit_created"},
    "push_pending": {"publication_state": "push_pending"},
    "pr_open": {"state": "published", "publication_state": "pr_open"},
    "merged": {"state": "merged", "publication_state": "merged", "review_state": "approved", "trust_tier": "trusted"},
    "superseded": {"publication_state": "superseded", "trust_tier": "history"},
}
FILES = "file_id string, repository_id long, locale string, path string, content_version_id string, source_revision string, content string, content_hash string, materialized_hash string, state string, freshness string, provenance string, validation_state string, review_state string, publication_state string, trust_tier string"


def move_files(files: DataFrame, moves: DataFrame) -> DataFrame:
    """Files of moves(file_id, move, new_hash) as they are after it; the first three moves also note what was seen in the tree."""
    return _moved(files.join(moves, "file_id")).select(*files.columns)


def _moved(both: DataFrame) -> DataFrame:
    out = {c: F.coalesce(*[F.when(F.col("move") == m, F.lit(v[c])) for m, v in FILE_MOVES.items() if c in v], F.col(c)) for c in {c for v in FILE_MOVES.values() for c in v}}
    out["materialized_hash"] = F.when(F.col("move").isin("materialized", "human_edit", "adopted"), F.col("new_hash")).otherwise(F.col("materialized_hash"))
    return changed(both, **out)


def persist_files(tables: dict[str, DataFrame], requests: DataFrame, hashed: bool = False) -> Staged:
    """Canonical contents, requests(repository_id, locale, path, source_revision, content, content_hash, at); content_versions(content_version_id,
    file_id, source_revision, content_hash, content) are immutable: other bytes under a hash that is there are refused. With `hashed`, requests and
    rows have their content's SHA-256 in its place, so that contents are not shuffled."""
    told = (lambda c: c) if hashed else (lambda c: F.sha2(c, 256))
    files, versions = tables["files"], tables["content_versions"]
    named = _newest(requests, ["repository_id", "locale", "path"]).withColumn("file_id", id_of(F.lit("file"), F.col("repository_id"), F.col("locale"), F.col("path")))
    named = named.withColumn("content_version_id", id_of(F.lit("content"), F.col("file_id"), F.col("source_revision"), F.col("content_hash")))
    asked = named.join(versions.select("content_version_id", (F.sha2("content", 256) if hashed else F.col("content")).alias("stored")), "content_version_id", "left")
    good, refused = guarded(asked, {"HASH": fingerprint_ok(F.col("content_hash")) & (told(F.col("content")) == F.col("content_hash")), "IMMUTABLE": F.col("stored").isNull() | (F.col("stored") == F.col("content"))})
    old = files.select("file_id", *[F.col(c).alias(f"was_{c}") for c in files.columns if c not in good.columns])
    begin = {"state": "verified", "freshness": "exact", "provenance": "generated", "validation_state": "passed", "review_state": "unreviewed", "publication_state": "candidate", "trust_tier": "candidate"}
    rows = good.join(old, "file_id", "left").select(*[F.col(c) if c in good.columns else F.lit(begin[c]).alias(c) if c in begin else F.col(f"was_{c}").alias(c) for c in files.columns])
    return Staged({"files": rows, "content_versions": good.filter("stored is null").select(*versions.columns)}, refused.select(*requests.columns, "refusal"), good.select("repository_id", "locale", "path", "file_id", "content_version_id"))


def settle(tables: dict[str, DataFrame], requests: DataFrame) -> Staged:
    """Ends materializations: requests(outbox_id, owner, work_item_id, file_id, move, new_hash, succeeded, result, at); a null move leaves the file.

    Refused unless the owner still holds the entry, the entry is for that file, and a move finds the very content that was scheduled.
    """
    outbox, files, work = tables["outbox"], tables["files"], tables["work_items"]
    mine = (F.col("entry.owner") == F.col("owner")) & (F.col("entry.work_item_id") == F.col("work_item_id"))
    asked = _with_entries(requests, outbox.filter("state = 'processing'"), mine)
    says = lambda p: F.get_json_object("entry.payload", f"$.{p}")
    owned = reduce(Column.__and__, [F.col(f"entry.{c}") == F.col(f"file.{c}") for c in ("path", "locale", "repository_id")])
    bound = (says("canonical_content_version_id") == F.col("file.content_version_id")) & (says("canonical_file_id") == F.col("file_id")) & (says("content_hash") == F.col("file.content_hash"))
    seen = (F.col("move") != "materialized") | (F.col("new_hash") == F.col("file.content_hash"))
    good, refused = _judged(asked, files, {"OWNER": owned, "CONTENT": F.col("move").isNull() | bound, "BYTES": F.col("move").isNull() | seen, "RESULT": json_ok(F.col("result"))})
    ended = {"status": F.when(F.col("succeeded"), "succeeded").otherwise("failed"), "result": F.col("new_result")}
    null = lambda t: F.lit(None).cast(t)
    return Staged({
        "files": _moved(good.filter("move is not null").select("file.*", "move", "new_hash")).select(*files.columns),
        "work_items": changed(work.join(good.select("work_item_id", "succeeded", F.col("result").alias("new_result")), "work_item_id"), **ended).select(*work.columns),
        "outbox": changed(good.select("entry.*", "at"), state=F.lit("done"), owner=null("string"), lease_expires_at=null("long"), completed_at=F.col("at")).select(*outbox.columns),
    }, refused.select(*requests.columns, "refusal"))


def _with_entries(requests: DataFrame, held: DataFrame, mine: Column) -> DataFrame:
    """Requests with the entry of `held` that each names, as a struct that is null unless it is `mine`; kept, so that only requests with an entry look for their file."""
    entries = held.select(F.col("outbox_id").alias("_id"), F.struct(*[F.col(c) for c in held.columns]).alias("entry"))
    both = requests.join(entries, F.col("outbox_id") == F.col("_id"), "left").drop("_id")
    return state.keep(both.withColumn("entry", F.when(mine, F.col("entry"))))


def _judged(asked: DataFrame, files: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Requests of `_with_entries` that keep all rules, with their `entry` and `file`, and the others; one without an entry breaks the first."""
    of = files.select(F.col("file_id").alias("_id"), F.struct(*[F.col(c) for c in files.columns]).alias("file"))
    found = asked.filter("entry is not null").join(of, F.col("file_id") == F.col("_id"), "left").drop("_id")
    good, bad = guarded(found, rules)
    marked = state.keep(good.withColumn("refusal", F.lit(None).cast("string")).union(bad.withColumns({"entry": F.lit(None), "file": F.lit(None)})))
    alone = asked.filter("entry is null").withColumn("refusal", F.lit(next(iter(rules))))
    rest = [c for c in asked.columns if c != "entry"]
    return marked.filter("refusal is null").drop("refusal"), marked.filter("refusal is not null").select(*rest, "refusal").union(alone.select(*rest, "refusal"))


def begin_discard(tables: dict[str, DataFrame], requests: DataFrame) -> Staged:
    """Intents to put canonical bytes back: requests(run_id, repository_id, document_id, file_id, content_version_id, locale, path, content_hash, observed_hash, at)."""
    of = tables["files"].select("file_id", "content_version_id", "repository_id", "locale", "path", "content_hash").withColumn("current", F.lit(True))
    asked = requests.join(of, ["file_id", "content_version_id", "repository_id", "locale", "path", "content_hash"], "left")
    good, refused = guarded(asked, {"CONTENT": F.col("current")})
    base = F.concat_ws(":", F.lit("discard"), F.col("repository_id").cast("string"), "locale", "path", "content_version_id")
    keyed = effect_keys(good.withColumn("base_key", base), tables["outbox"])
    payload = F.to_json(F.struct("repository_id", "locale", "path", F.col("file_id").alias("canonical_file_id"), F.col("content_version_id").alias("canonical_content_version_id"), "content_hash", F.lit("discard").alias("operation"), F.col("observed_hash").alias("expected_hash")))
    intents = keyed.select("run_id", "repository_id", "document_id", "locale", "path", "dedupe_key", F.to_json(F.struct(F.col("dedupe_key").alias("effect_key"), F.lit("discard").alias("operation"))).alias("work_input"), payload.alias("payload"), "at")
    staged = schedule(tables, intents)
    return Staged(staged.rows, refused.select("file_id", "refusal").union(staged.refused.join(of, ["repository_id", "locale", "path"]).select("file_id", "refusal")), staged.receipts)


def complete_discard(tables: dict[str, DataFrame], requests: DataFrame) -> Staged:
    """requests(outbox_id, work_item_id, file_id, content_hash, at): the entry must still be pending, a discard, and for the file's current content."""
    outbox, files, work = tables["outbox"], tables["files"], tables["work_items"]
    says = lambda p: F.get_json_object("entry.payload", f"$.{p}")
    mine = (F.col("entry.work_item_id") == F.col("work_item_id")) & (says("operation") == "discard") & (says("canonical_file_id") == F.col("file_id")) & (says("content_hash") == F.col("content_hash"))
    asked = _with_entries(requests, outbox.filter("state = 'pending'"), mine)
    good, refused = _judged(asked, files, {"RECEIPT": says("canonical_content_version_id") == F.col("file.content_version_id")})
    said = F.to_json(F.struct(F.lit("discarded").alias("status"), F.col("content_hash")))
    return Staged({
        "files": _moved(good.select("file.*", F.lit("materialized").alias("move"), F.col("content_hash").alias("new_hash"))).select(*files.columns),
        "work_items": changed(work.join(good.select("work_item_id", said.alias("said")), "work_item_id"), status=F.lit("succeeded"), result=F.col("said")).select(*work.columns),
        "outbox": changed(good.select("entry.*", "at"), state=F.lit("done"), completed_at=F.col("at")).select(*outbox.columns),
    }, refused.select(*requests.columns, "refusal"))


def adopt(tables: dict[str, DataFrame], documents: DataFrame, units: DataFrame) -> Staged:
    """A person's target becomes canonical: documents as of `prepare` with target_path, content, target_hash; units with target_text and context_key.

    Document, units, trusted memory, canonical file and the finished work of both kinds are one commit; a document whose policy or
    content is refused leaves none of them.
    """
    # all is decided on requests that have their content's SHA-256 in its place, and on units without their texts
    slim = state.keep(documents.withColumn("content", F.sha2("content", 256)))
    target = lambda df: df.select("repository_id", "locale", F.col("target_path").alias("path"), "source_revision", "content", F.col("target_hash").alias("content_hash"), "at")
    unfit = persist_files(tables, target(slim), hashed=True).refused.select("repository_id", "locale", F.col("path").alias("target_path"), "source_revision", F.col("content_hash").alias("target_hash"), "refusal").distinct()
    asked = slim.join(unfit, ["repository_id", "locale", "target_path", "source_revision", "target_hash"], "left")
    asked = asked.withColumn("refusal", F.when(~fingerprint_ok(F.col("policy")), "POLICY").otherwise(F.col("refusal")))
    fit, unready = _prepared(tables, asked.filter("refusal is null").select(*slim.columns), units.drop("enqueue"))
    refused = state.keep(asked.filter("refusal is not null").unionByName(unready).select("repository_id", "path", "refusal"))
    good = state.keep(fit.join(refused.select("repository_id", "path"), ["repository_id", "path"], "left_anti"))
    facts = _unit_facts(tables, good, units.drop("enqueue"))
    held = tables["memory"].filter("tier = 'trusted' and superseded_at is null")
    newest = facts.groupBy("spot").agg(F.max(F.struct("at", "unit_id", "unit_version_id", "source_revision", "target", "policy", "fact", "whole")).alias("top")).select("spot", "top.at", "top.target", "top.fact", "top.whole")
    said = held.filter(_whole([*TRUSTED_PLACE, "text"])).select(_spot().alias("spot"), digest_of(F.col("text")).alias("target"))
    new = state.keep(newest.join(said, ["spot", "target"], "left_anti"))
    told = state.keep(facts.join(new.select("fact", F.lit(True).alias("won")), "fact", "left").drop("fact", "target", "whole"))
    state.drop(facts)
    texts = _with_texts(units.drop("enqueue"), told)
    state.drop(told)
    rows, of = _staged_units(tables, good, texts)
    won = of.filter("won").drop("won", "seen", "was")
    trusted = trusted_rows(tables, won.filter("not twice").unionByName(won.filter("twice").dropDuplicates(["spot"])).withColumns({"text": F.col("target_text"), "provenance": F.lit("human_adopted")}))
    old = held.filter(_whole(TRUSTED_PLACE)).withColumn("spot", _spot()).join(new.filter("whole").select("spot", F.col("at").alias("new_at")), "spot")
    memory = {"versions": trusted["versions"], "memory": _history(old, tables["memory"]).unionByName(trusted["memory"])}
    kept = persist_files(tables, target(good), hashed=True)
    files = _with_contents(kept, documents)
    result = F.to_json(F.struct(F.lit("adopted").alias("status"), F.col("target_hash").alias("content_hash")))
    work = good.withColumn("kind", F.explode(F.array(F.lit("assembly"), F.lit("materialization")))).select("run_id", F.lit(None).cast("string").alias("unit_id"), "document_id", "locale", "kind", F.col("metadata").alias("input"), "at", result.alias("said"))
    done = enqueued(tables["work_items"], work.drop("said")).join(work.select(work_id().alias("work_item_id"), "said"), "work_item_id")
    done = changed(done, status=F.lit("succeeded"), result=F.col("said")).select(*tables["work_items"].columns)
    moved = files.withColumns({"move": F.lit("adopted"), "new_hash": F.col("content_hash")})
    fresh = files.filter("fresh").select(*tables["content_versions"].columns)
    return Staged(rows | memory | {"files": _moved(moved).select(*tables["files"].columns), "content_versions": fresh, "work_items": done}, refused, kept.receipts)


def _with_contents(kept: Staged, requests: DataFrame) -> DataFrame:
    """Files of `persist_files` on hashed contents with the contents of requests(repository_id, locale, target_path, source_revision, content, ...); `fresh`: whether the content is not stored yet."""
    named = lambda path, content: digest_of(F.col("repository_id"), F.col("locale"), F.col(path), F.col("source_revision"), content)
    of = kept.rows["files"].join(kept.rows["content_versions"].select("content_version_id", F.lit(True).alias("fresh")), "content_version_id", "left")
    wanted = of.withColumn("name", named("path", F.col("content"))).drop("content")
    # a request may be listed twice
    both = requests.select(named("target_path", F.sha2("content", 256)).alias("name"), "content").join(wanted, "name").dropDuplicates(["name"])
    return state.keep(both.drop("name"))


# Publications

MANIFESTS = "manifest_id string, repository_id long, run_id string, locale string, source_revision string, commit string, policy string, authorization_key string, state string, at long"


def authorize(tables: dict[str, DataFrame], requests: DataFrame, files: DataFrame) -> Staged:
    """Records what may be published: requests(repository_id, run_id, locale, source_revision, commit, policy, authorization_key, at) with files(authorization_key,
    content_version_id, file_id, content_hash). A manifest that is there must have the same files, and manifests of one commit the same as one another."""
    manifests, bound = tables["manifests"], tables["manifest_files"]
    place, of_file = ["repository_id", "locale", "authorization_key"], ["content_version_id", "file_id", "content_hash"]
    asked = of_run(requests, tables["runs"].join(requests.select("run_id", "policy").distinct(), ["run_id", "policy"], "left_semi")).withColumn("manifest_id", id_of(F.lit("manifest"), *[F.col(c) for c in place]))
    # a set is compared by its number of files and the sum of their hashes; no set is gathered
    sets = lambda df, by, name: df.groupBy(by).agg(F.struct(F.count("*").alias("n"), F.sum(F.xxhash64(*of_file).cast("decimal(38,0)")).alias("s")).alias(name), F.countDistinct(*of_file).alias(f"{name}_n"))
    asked = asked.join(sets(files, "authorization_key", "new_set"), "authorization_key", "left").join(sets(bound, "manifest_id", "old_set").drop("old_set_n"), "manifest_id", "left")
    other = manifests.join(sets(bound, "manifest_id", "other_set").drop("other_set_n"), "manifest_id", "left").select("repository_id", "locale", "commit", F.col("manifest_id").alias("other_id"), F.col("source_revision").alias("other_revision"), "other_set")
    clash = asked.join(other, ["repository_id", "locale", "commit"]).filter("other_id <> manifest_id").filter(~(F.col("other_set").eqNullSafe(F.col("new_set")) & (F.col("other_revision") == F.col("source_revision")))).select("manifest_id").distinct().withColumn("clash", F.lit(True))
    asked = asked.join(clash, "manifest_id", "left")
    filled = lambda c: F.length(F.col(c)) > 0
    good, refused = guarded(asked, {"KEY": filled("authorization_key"), "POLICY": fingerprint_ok(F.col("policy")), "COMMIT": filled("commit"), "FILES": F.col("new_set.n") > 0, "TWICE": F.col("new_set.n") == F.col("new_set_n"), "RUN": F.col("run_ok"),
                                     "CONFLICT": F.col("old_set").isNull() | F.col("old_set").eqNullSafe(F.col("new_set")), "SNAPSHOT": F.col("clash").isNull()})
    new = good.join(manifests.select("manifest_id"), "manifest_id", "left_anti")
    rows = new.select(*[F.lit("commit_created").alias(c) if c == "state" else F.col(c) for c in manifests.columns])
    return Staged({"manifests": rows, "manifest_files": files.join(new.select("authorization_key", "manifest_id"), "authorization_key").select(*bound.columns)}, refused.select(*requests.columns, "refusal"), good.select(*place, "manifest_id"))


def move_publications(manifests: DataFrame, requests: DataFrame) -> Staged:
    """requests(repository_id, locale, commit, authorization_key or null, new_state): the state of the eligible manifest goes forward only, and not at all from an end."""
    by = ["repository_id", "locale", "commit"]
    wanted = requests.withColumnRenamed("authorization_key", "only_key").withColumn("request_no", F.monotonically_increasing_id())
    found = wanted.join(manifests, by, "left").filter(F.col("only_key").isNull() | F.col("authorization_key").isNull() | (F.col("only_key") == F.col("authorization_key")))
    rank = F.struct(F.col("state") != "superseded", F.col("state") == "merged", "manifest_id")
    top = found.filter("manifest_id is not null").groupBy("request_no").agg(F.max_by("manifest_id", rank).alias("manifest_id"))
    asked = wanted.join(top, "request_no", "left")
    quiet = F.col("only_key").isNotNull() & (F.col("new_state") == "superseded")
    good, refused = guarded(asked, {"STATE": F.col("new_state").isin("commit_created", "push_pending", "pr_open", "superseded"), "MANIFEST": F.col("manifest_id").isNotNull() | quiet})
    steps = good.filter("manifest_id is not null").select("manifest_id", "new_state").join(manifests.select("manifest_id", F.col("state").alias("old_state")), "manifest_id").filter((F.col("old_state") != F.col("new_state")) & state.may_move(F.col("old_state"), F.col("new_state")))
    far = state.strongest(steps.withColumnRenamed("new_state", "to").withColumn("n", F.lit(0)), ["manifest_id"], "to", "n", state.PROGRESS)
    rows = changed(manifests.join(far, "manifest_id"), state=F.col("to")).select(*manifests.columns)
    return Staged({"manifests": rows}, refused.select(*[c for c in wanted.columns if c != "request_no"], "refusal"))


def publication_owner(requests: DataFrame, outbox: DataFrame) -> DataFrame:
    """Adds `owns`: whether the owner holds the processing entry with the repository, locale and key that the request names."""
    held = outbox.filter("state = 'processing'").select("outbox_id", "owner", "repository_id", "locale", F.col("dedupe_key").alias("authorization_key")).withColumn("owns", F.lit(True))
    return requests.join(held, ["outbox_id", "owner", "repository_id", "locale", "authorization_key"], "left").withColumn("owns", F.coalesce("owns", F.lit(False)))


def persist_publications(tables: dict[str, DataFrame], requests: DataFrame, files: DataFrame) -> Staged:
    """Candidates of publications: as of `authorize` with outbox_id, owner, payload, new_state; the owner's entry takes the payload, which names the same commit, run, language, revision and policy."""
    asked = publication_owner(requests, tables["publication_outbox"])
    says = lambda p: F.get_json_object("payload", f"$.{p}")
    same = (says("commit") == F.col("commit")) & (says("run_id") == F.col("run_id")) & (says("language") == F.col("locale")) & (says("source_revision") == F.col("source_revision")) & (says("policy_fingerprint") == F.col("policy"))
    stored = tables["content_versions"].select("content_version_id", "file_id", "content_hash").withColumn("stored", F.lit(True))
    loose = files.join(stored, ["content_version_id", "file_id", "content_hash"], "left").filter("stored is null").select("authorization_key").distinct().withColumn("loose", F.lit(True))
    good, refused = guarded(asked.join(loose, "authorization_key", "left"), {"OWNER": F.col("owns"), "PAYLOAD": same, "BYTES": F.col("loose").isNull()})
    staged = authorize(tables, good.select(*[c for c in requests.columns if c not in ("outbox_id", "owner", "payload", "new_state")]), files)
    passed = good.join(staged.receipts, ["repository_id", "locale", "authorization_key"])
    every = state.latest(tables["manifests"].withColumn("n", F.lit(0)).unionByName(staged.rows["manifests"].withColumn("n", F.lit(1))), ["manifest_id"], ["n"]).select(*tables["manifests"].columns)
    moved = move_publications(every, passed.select("repository_id", "locale", "commit", "authorization_key", "new_state"))
    rows = state.latest(staged.rows["manifests"].withColumn("n", F.lit(0)).unionByName(moved.rows["manifests"].withColumn("n", F.lit(1))), ["manifest_id"], ["n"]).select(*tables["manifests"].columns)
    outbox = tables["publication_outbox"]
    entries = changed(outbox.join(passed.select("outbox_id", F.col("payload").alias("new_payload")), "outbox_id"), payload=F.col("new_payload")).select(*outbox.columns)
    no = refused.select("authorization_key", "refusal").union(staged.refused.select("authorization_key", "refusal"))
    return Staged(staged.rows | {"manifests": rows, "publication_outbox": entries}, no, staged.receipts)


def record_pulls(tables: dict[str, DataFrame], requests: DataFrame) -> dict[str, DataFrame]:
    """pull_requests(repository_id, provider, external_id, head_revision, state, at) upserted, and pr_events(..., event_key, from_state, to_state, at) appended once each."""
    pulls, events = tables["pull_requests"], tables["pr_events"]
    key = ["repository_id", "provider", "external_id"]
    was = pulls.select(*key, F.col("state").alias("from_state"))
    back = F.lag("state").over(Window.partitionBy(*key).orderBy("at", "event_key"))
    told = requests.withColumn("before", back).join(was, key, "left").select(*key, "event_key", F.coalesce("before", "from_state").alias("from_state"), F.col("state").alias("to_state"), "at")
    new = told.dropDuplicates([*key, "event_key"]).join(events.select(*key, "event_key"), [*key, "event_key"], "left_anti").select(*events.columns)
    return {"pull_requests": _newest(requests, key).select(*pulls.columns), "pr_events": new}


def settle_publications(tables: dict[str, DataFrame], requests: DataFrame) -> Staged:
    """Ends publications: requests(outbox_id, owner, repository_id, locale, authorization_key, commit, new_state, head_revision, at); the entry's payload names the commit, and so does a pull request's head."""
    outbox = tables["publication_outbox"]
    asked = publication_owner(requests, outbox).join(outbox.select("outbox_id", F.get_json_object("payload", "$.commit").alias("durable")), "outbox_id", "left")
    good, refused = guarded(asked, {"OWNER": F.col("owns"), "COMMIT": F.col("durable").eqNullSafe(F.col("commit")), "HEAD": F.col("head_revision").isNull() | F.col("head_revision").eqNullSafe(F.col("commit"))})
    moved = move_publications(tables["manifests"], good.filter("commit is not null and new_state is not null").select("repository_id", "locale", "commit", "authorization_key", "new_state"))
    null = lambda t: F.lit(None).cast(t)
    done = changed(outbox.join(good.select("outbox_id", "at"), "outbox_id"), state=F.lit("done"), owner=null("string"), lease_expires_at=null("long"), completed_at=F.col("at")).select(*outbox.columns)
    return Staged(moved.rows | {"publication_outbox": done}, refused.select(*requests.columns, "refusal"))


def promote(tables: dict[str, DataFrame], requests: DataFrame) -> Staged:
    """Merged publications, requests(repository_id, locale, commit, at): the manifest and its files are merged, and the memory of the versions their contents link to is trusted.

    tables also: links(content_version_id, version_id). Open trusted entries of the same place give way; the versions' own candidate entries become trusted.
    """
    manifests, files, memory = tables["manifests"], tables["files"], tables["memory"]
    got = manifests.filter("state <> 'superseded'").join(_newest(requests, ["repository_id", "locale", "commit"]).withColumnRenamed("at", "merged_at"), ["repository_id", "locale", "commit"])
    refused = requests.join(got.select("repository_id", "locale", "commit"), ["repository_id", "locale", "commit"], "left_anti").withColumn("refusal", F.lit("MANIFEST"))
    bound = tables["manifest_files"].join(got.select("manifest_id", "merged_at"), "manifest_id")
    moves = files.join(bound.select("file_id", "content_version_id").distinct(), ["file_id", "content_version_id"], "left_semi").select("file_id", F.lit("merged").alias("move"), F.lit(None).cast("string").alias("new_hash"))
    place = ["repository_id", "locale", "source_hash", "context_key"]
    linked = tables["links"].join(bound.select("content_version_id", "merged_at"), "content_version_id").groupBy("version_id").agg(F.max("merged_at").alias("merged_at"))
    mine = state.latest(memory.filter("superseded_at is null").join(linked, "version_id"), place, ["merged_at", "at"])
    raised = changed(mine, tier=F.lit("trusted"))
    old = memory.filter("tier = 'trusted' and superseded_at is null").join(mine.select(*place, F.col("memory_id").alias("new_id"), "merged_at"), place).filter("memory_id <> new_id")
    entries = raised.select(*memory.columns).unionByName(changed(old, tier=F.lit("history"), superseded_at=F.col("merged_at")).select(*memory.columns))
    return Staged({"manifests": changed(manifests.join(got.select("manifest_id"), "manifest_id", "left_semi"), state=F.lit("merged")), "files": move_files(files, moves), "memory": entries}, refused)


def idle_faults(leases: DataFrame, outboxes: list[DataFrame]) -> DataFrame:
    """What forbids an upgrade: leases(kind, owner, owner_alive) that are not a dead repository's, and entries in work whose owner is not known to be dead."""
    dead = ~F.coalesce("owner_alive", F.lit(True))
    out = leases.filter(~((F.col("kind") == "repository") & dead)).select(F.lit("LEASE").alias("fault"), "owner")
    for box in outboxes:
        known = F.coalesce(F.col("owner").rlike("^(materialize|publish):"), F.lit(False))
        out = out.union(box.filter((F.col("state") == "processing") & ~(known & dead)).select(F.lit("WORKER").alias("fault"), "owner"))
    return out
