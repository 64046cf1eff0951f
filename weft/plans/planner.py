"""Plans: what is pending, what a budget lets through, what people have edited, which results count, what may be written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import running
from ..operators.filesets import manifests

RANKS = {"error": 0, "needs_human": 1, "partial": 2, "ok": 3}


def budgeted(pending: DataFrame, order: list[str], most: int) -> DataFrame:
    """Adds `scheduled` to pending units: the first `most` in the order given.

    A top-k picks the last scheduled unit's place and every row is compared with it, so no single task sees all rows.
    """
    key = F.struct(*order)
    edge = pending.select(key.alias("k")).orderBy("k").limit(most).agg(F.max("k").alias("edge"))
    return pending.crossJoin(F.broadcast(edge)).withColumn("scheduled", F.coalesce(key <= F.col("edge"), F.lit(False))).drop("edge")


def enqueued(plan: DataFrame, group: list[str], order: list[str], piece: Column, most: int, reviews: bool) -> DataFrame:
    """Adds `enqueue` to plan(trusted_reuse, ...): the first `most` units of each group that are not reused, and, where reviews are on, every reused one, which uses up no budget.

    A running count of the open units by pieces of the order (see `running.totals`), so that one group may hold all rows.
    """
    open_ = (~F.col("trusted_reuse")).cast("long")
    counted = running.totals(plan, group, piece, [F.col(c) for c in order], {"nth_open": (F.sum, open_)})
    return counted.withColumn("enqueue", F.when(F.col("trusted_reuse"), F.lit(reviews)).otherwise(F.col("nth_open") <= most)).drop("nth_open")


def summary(plan: DataFrame, group: list[str], most: int) -> DataFrame:
    """Documents, pending within the budget, reused, conflicts and deferred of plan(doc_id, kind, trusted_reuse)."""
    waits = (~F.col("trusted_reuse")) & (F.col("kind") != "ambiguous")
    out = plan.groupBy(*group).agg(
        F.countDistinct("doc_id").alias("documents"), F.sum(F.when(waits, 1).otherwise(0)).alias("open"),
        F.sum(F.col("trusted_reuse").cast("long")).alias("reused"), F.sum((F.col("kind") == "ambiguous").cast("long")).alias("conflicts"),
    )
    return out.select(*group, "documents", F.least("open", F.lit(most)).alias("pending"), "reused", "conflicts", F.greatest(F.col("open") - most, F.lit(0)).alias("deferred"))


def human_edit(actual: Column, canonical: Column, materialized: Column) -> Column:
    """Whether a target is what neither the record nor the last write left there; a missing one counts."""
    return ~actual.eqNullSafe(canonical) & ~actual.eqNullSafe(materialized)


def write_outcome(desired: Column, expected: Column, observed: Column) -> Column:
    """Compare and swap of a file by hashes."""
    return F.when(observed.eqNullSafe(desired), "already_current").when(observed.eqNullSafe(expected), "written").otherwise("human_edit")


def changes(base: DataFrame, new: DataFrame) -> DataFrame:
    """add, modify, delete or same, of base and new (path, content_hash)."""
    both = base.select("path", F.col("content_hash").alias("old")).join(new.select("path", F.col("content_hash").alias("new")), "path", "full")
    return both.select("path", F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "modify").otherwise("same").alias("change"))


def outcomes(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Each task with what became of it; results(task_id, seq, ok, timed_out, output, valid), of which the last counts."""
    last = results.groupBy("task_id").agg(F.max_by(F.struct("ok", "timed_out", "output", "valid"), "seq").alias("r"))
    kind = F.when(F.col("r").isNull(), "missing").when(F.col("r.ok") & F.col("r.valid"), "candidate").when(F.col("r.ok"), "invalid").when(F.col("r.timed_out"), "timed_out").otherwise("failed")
    return tasks.join(last, "task_id", "left").withColumn("outcome", kind).withColumn("output", F.col("r.output")).drop("r")


def repair(tasks: DataFrame, attempt, rounds: int, keep=lambda df: df) -> list[DataFrame]:
    """attempt(tasks, round) for the tasks that still fail, at most `rounds` times; `keep` cuts the lineage of each round."""
    out = []
    for n in range(rounds):
        done = keep(attempt(tasks, n))
        out.append(done)
        tasks = done.filter(~F.col("outcome").isin("candidate"))
        if tasks.isEmpty():
            break
    return out


def review(output: Column, blocking: Column, text: Column) -> tuple[Column, Column]:
    """(verdict, text) of a review: OK approves, anything else replaces if it blocks and warns if not."""
    ok = F.lower(F.trim(output)) == "ok"
    return F.when(ok, "approved").when(blocking, "replaced").otherwise("warned"), F.when(ok | ~blocking, text).otherwise(output)


def verified(units: DataFrame) -> DataFrame:
    """Each document of units(doc_id, translation, scheduled): verified, failed (a scheduled unit has none) or skipped."""
    none = F.col("translation").isNull()
    return units.groupBy("doc_id").agg(F.bool_or(none & F.col("scheduled")).alias("f"), F.bool_or(none).alias("s")).select("doc_id", F.when(F.col("f"), "failed").when(F.col("s"), "skipped").otherwise("verified").alias("state"))


def batch(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """The verified documents, or none at all if any finding is an error."""
    errors = findings.filter(F.col("severity") == "error").limit(1).agg(F.count("*").alias("_e"))
    return documents.filter(F.col("state") == "verified").crossJoin(F.broadcast(errors)).filter("_e = 0").drop("_e")


def worst(status: Column) -> Column:
    """Aggregate: the gravest status of a group."""
    return F.min_by(status, F.coalesce(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])[status], F.lit(9)))


def format_counts(documents: DataFrame, units: DataFrame) -> DataFrame:
    """(format, documents, passed_through) of documents(path, format): those without a unit in units(path) are copied as they are."""
    n = units.groupBy("path").agg(F.count("*").alias("_n"))
    return documents.join(n, "path", "left").groupBy("format").agg(F.count("*").alias("documents"), F.count_if(F.col("_n").isNull()).alias("passed_through"))


def passed_through(documents: DataFrame, units: DataFrame) -> DataFrame:
    """Documents(path, bytes) without a unit: their target is their source, byte for byte, and its provenance is imported."""
    return documents.join(units.select("path").distinct(), "path", "left_anti").select("path", F.col("bytes").alias("content"), F.lit("imported").alias("provenance"))


def chosen(table: DataFrame, column: str, wanted: str | None, by_name: bool = False) -> DataFrame:
    """Rows whose column is the one wanted, or whose path ends in that name; all without a filter, and an error if none fits."""
    if wanted is None:
        return table
    fits = F.col(column) == wanted
    if by_name:
        fits = fits | (F.element_at(F.split(F.regexp_replace(column, "/+$", ""), "/"), -1) == wanted)
    out = table.filter(fits)
    if out.isEmpty():
        raise ValueError(f"nothing configured matches {wanted!r}")
    return out


def kind_of(context: Column) -> Column:
    """The key that memory is found by: the context's memory_key, else its kind, else empty."""
    return F.coalesce(F.get_json_object(context, "$.memory_key"), F.get_json_object(context, "$.kind"), F.lit(""))


def template(stage: Column, previous_source: Column, previous_translation: Column) -> Column:
    """The prompt of a task: a translation that has a previous one to go by is a revision of it."""
    again = (stage == "translate") & previous_source.isNotNull() & previous_translation.isNotNull()
    return F.when(again, "revise").otherwise(stage)


def prompt(version: str, resources: dict[str, str]) -> Column:
    """The prompt of a row of tasks(task_id, stage, source_language, target_language, tokens, context, previous_source, previous_translation, findings, source)."""
    name = template(F.col("stage"), F.col("previous_source"), F.col("previous_translation"))
    text = F.create_map(*[F.lit(x) for kv in resources.items() for x in kv])[name]
    block = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n\n--- {title} ---\n"), F.col(c), F.lit(f"\n--- END {title} ---"))).otherwise("")
    said = F.transform("findings", lambda f: F.concat(F.lit("- "), f["code"], F.lit(": "), f["message"], F.lit("\n")))
    found = F.when(F.size("findings") > 0, F.concat(F.lit("\n\nFindings:\n"), F.array_join(said, ""))).otherwise("")
    return F.concat(
        F.lit(version), F.lit("\nResource: "), name, F.lit("\n\n"), text, F.lit("\nSource language: "), F.col("source_language"), F.lit("\nTarget language: "), F.col("target_language"),
        F.lit("\nTask ID: "), F.col("task_id").cast("string"), F.lit("\nProtected tokens: "), F.array_join("tokens", ", "), F.lit("\n"), F.col("context"),
        block("PREVIOUS SOURCE", "previous_source"), block("PREVIOUS TRANSLATION", "previous_translation"), found, F.lit("\n\n--- SOURCE ---\n"), F.col("source"), F.lit("\n--- END SOURCE ---"),
    )


def project_check(documents: DataFrame, group: list[str]) -> DataFrame:
    """The check of each group's verified documents(path, content_hash): it hangs on the first path and names the hash of all."""
    hashed = manifests(documents, group, ["path", "content_hash"], ["path", "content_hash"])
    first = documents.groupBy(*group).agg(F.min("path").alias("path"))
    same = reduce(lambda a, b: a & b, [first[c].eqNullSafe(hashed[c]) for c in group])
    return first.join(hashed, same).select(*[first[c] for c in group], "path", "manifest")


def restored(desired: DataFrame, observed: DataFrame) -> DataFrame:
    """Targets of desired(path, content_hash) to be written back without asking what stands there: all that observed does not show as they should be."""
    return desired.join(observed, ["path", "content_hash"], "left_anti")
