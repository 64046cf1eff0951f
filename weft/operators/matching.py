"""Units of a revision matched with those of the one before.

Keyed units (messages) match first in, first out by key, which is an equi-join on key and number. Prose units match by normalised text where
that decides; the whole rule, in which each match uses its partner up in order, is solved in rounds of joins.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MARGIN
from . import running, similar, state


def keyed(previous: DataFrame, current: DataFrame, key: list[str], order: str) -> DataFrame:
    """current(key, order, source) against previous(key, order, source, trusted): exact, fuzzy (same key, text changed) or new.

    `order` is an integer column, by ranges of which a key with most rows is numbered.
    """
    number = lambda df: running.numbered(df, key, running.pieces(order), [F.col(order)], "rn")
    a = number(current)
    b = number(previous).select(*key, "rn", F.col("source").alias("p_source"), F.col("trusted").alias("p_trusted"))
    found = a.join(b, [*key, "rn"], "left")
    same = F.col("source") == F.col("p_source")
    return found.withColumn("kind", F.when(F.col("p_source").isNull(), "new").when(same, "exact").otherwise("fuzzy")).withColumn("trusted_reuse", F.coalesce(same & F.col("p_trusted"), F.lit(False))).drop("rn", "p_trusted")


def by_text(previous: DataFrame, current: DataFrame) -> DataFrame:
    """The rules of equal text alone, where no two current units compete: exact, moved, ambiguous or no_text_match.

    previous(doc_id, ordinal, source, norm, trusted) is reduced to a row for each text before the join.
    """
    once = previous.groupBy("doc_id", "norm").agg(F.count("*").alias("n"), F.min("ordinal").alias("p_ordinal"), F.min("source").alias("p_source"), F.bool_and("trusted").alias("p_trusted"))
    found = current.join(once, ["doc_id", "norm"], "left")
    kind = F.when(F.col("n").isNull(), "no_text_match").when(F.col("n") > 1, "ambiguous").when(F.col("p_ordinal") == F.col("ordinal"), "exact").otherwise("moved")
    reuse = F.coalesce((F.col("n") == 1) & F.col("p_trusted") & (F.col("source") == F.col("p_source")), F.lit(False))
    return found.select("doc_id", "ordinal", kind.alias("kind"), reuse.alias("trusted_reuse"))


def unmatched(previous: DataFrame, current: DataFrame) -> DataFrame:
    """The rows of current that `by_text` calls no_text_match. Texts meet by 128 bits of hash, so those of previous are not shuffled; counts current first (see `state.spread`)."""
    hashes = {"_h1": F.xxhash64("norm"), "_h2": F.xxhash64(F.lit(1), "norm")}
    return state.spread(current.withColumns(hashes), "doc_id", *hashes).join(previous.withColumns(hashes).select("doc_id", *hashes), ["doc_id", *hashes], "left_anti").drop(*hashes)


def fuzzy(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Scores above the floor of current against previous units of the same document, ranked, with ambiguity (see `similar`)."""
    scored = similar.pairs(previous, current, ["doc_id"], ["ordinal"], ["ordinal"])
    w = Window.partitionBy("doc_id", "ordinal").orderBy(F.desc("score"), "p_ordinal")
    ranked = scored.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).filter("rank = 1")
    return ranked.select("doc_id", "ordinal", "p_ordinal", F.round("score", 9).alias("score"), F.coalesce(F.col("score") - F.col("next") < MARGIN, F.lit(False)).alias("ambiguous"))


def in_order(previous: DataFrame, current: DataFrame) -> DataFrame:
    """The whole rule, in which current units come in order and every match uses its previous unit up, for every document.

    Of (doc_id, ordinal, source, norm, unit_kind, context, stable_id, trusted). current may have a column `hint`, the stable id that the unit had in a
    document that has not changed since. A unit looks among what earlier ones have left: a hinted unit of equal text, else the only one of equal
    text, else (where there is none) the best one of similar text, if it leads by the margin.

    The rule is solved in rounds of joins. A round lets all units decide at once, given who took each previous unit, and when, by the round before; a
    previous unit goes to the first that wants it. What the units before the n-th do is right after n rounds at the latest, and a round that changes
    nothing is the answer; as most units have no rival, a few rounds do. Units of equal text are never paired: how many are left, and which if it is the last,
    are running sums over those taken. Similar texts are sought only for units that find no equal one. Each round is a job; the tables are written between them.
    Texts are kept once, in columns, and read where similar ones are sought; all else goes by numbers and hashes (a source by 128 bits), so no round shuffles a text.
    """
    hints = F.col("hint") if "hint" in current.columns else F.lit(None).cast("string")
    known = lambda df: df.withColumn("doc", F.struct("doc_id")).withColumn("scope", F.xxhash64("doc_id", "unit_kind", "context")).withColumn("same", F.xxhash64("unit_kind", "context", "norm"))
    place, own = running.pieces("ordinal"), [F.col("ordinal"), F.xxhash64("norm", "source")]
    texts = ["doc", "scope", "same", "ordinal", "norm"]
    hashes = [F.when(F.col("source").isNotNull(), F.xxhash64(*x, "source")).alias(n) for n, x in (("s1", []), ("s2", [F.lit(1)]))]
    bare = lambda df, *more: known(df).withColumn("own", own[1]).select("doc_id", *texts, "own", "trusted", *hashes, *more)
    old = state.keep(running.numbered(bare(previous, "stable_id"), ["doc_id"], place, [F.col("ordinal"), F.col("stable_id"), F.col("own")], "pid").drop("doc_id", "own"))
    groups = state.cut(old.groupBy("doc", "same").agg(F.count("*").alias("n"), F.sum("pid").alias("pids"), F.min("pid").alias("only")))
    whole = state.keep(running.numbered(bare(current.withColumn("hint", hints), "hint"), ["doc_id"], place, [F.col("ordinal"), F.col("own")], "at").drop("own"))
    now = state.cut(whole.select("doc_id", "doc", "same", "ordinal", "at", "hint", "s1", "s2").join(groups, ["doc", "same"], "left").withColumn("n", F.coalesce("n", F.lit(0))))
    hinted = state.cut(now.filter("hint is not null").select("doc", "same", "at", F.col("hint").alias("stable_id")).join(old.select("doc", "same", "stable_id", "pid"), ["doc", "same", "stable_id"]).select("doc", "at", "pid"))
    any_hint = not hinted.isEmpty()

    def similar_to(asking: DataFrame) -> DataFrame:
        units = whole.select(*texts, "at").join(asking, ["doc", "at"], "left_semi")
        # texts of equal norm are told apart by `same`: a unit only gets here if no equal one is left
        found = similar.pairs(old, units, ["scope"], ["doc", "same", "at"], ["doc", "same", "pid", "stable_id"])
        return found.filter("doc = p_doc and same <> p_same").select("doc", "at", F.col("p_pid").alias("pid"), F.col("p_stable_id").alias("stable_id"), "score")

    # second and further units of a text that stood once before will not find it
    later = F.row_number().over(Window.partitionBy("doc", "same", F.floor(F.col("at") / running.PIECE)).orderBy("at")) > 1
    asked = state.cut(now.withColumn("later", later).filter("n = 0 or (n = 1 and later)").select("doc", "at"))
    edges = state.cut(similar_to(asked))
    taken = state.cut(now.limit(0).select("doc", F.col("at").alias("pid"), F.col("at").alias("time")))
    mark = None
    while True:
        free = lambda df, c="pid": df.join(taken.select("doc", F.col("pid").alias(c), "time"), ["doc", c], "left").filter("time is null or time >= at")
        once = free(now.filter("n = 1").select("doc", "at", F.col("only").alias("pid"))).select("doc", "at", F.lit(1).cast("long").alias("left"), "pid")
        lost = taken.join(old.select("doc", "pid", "same"), ["doc", "pid"]).join(groups.filter("n > 1"), ["doc", "same"]).select("doc", "same", "time", F.lit(1).cast("long").alias("gone"), "pid")
        many = now.filter("n > 1").select("doc", "same", "at", "n", "pids")
        # a unit stands before what is taken at its own time, by itself
        line = many.join(lost.select("doc", "same").distinct(), ["doc", "same"], "left_semi").select("doc", "same", F.col("at").alias("time"), F.lit(0).cast("long").alias("gone"), F.lit(0).cast("long").alias("pid")).union(lost)
        sums = running.totals(line, ["doc", "same"], running.pieces("time"), [F.col("time"), F.col("gone")], {"gone_before": (F.sum, F.col("gone")), "pid_before": (F.sum, F.col("pid"))})
        sums = sums.filter("gone = 0").select("doc", "same", F.col("time").alias("at"), "gone_before", "pid_before")
        several = many.join(sums, ["doc", "same", "at"], "left").select("doc", "at", (F.col("n") - F.coalesce("gone_before", F.lit(0))).alias("left"), (F.col("pids") - F.coalesce("pid_before", F.lit(0))).alias("pid")).filter("left > 0")
        equal = once.union(several)
        by = Window.partitionBy("doc", "at").orderBy(F.desc("score"), "stable_id", "pid")
        best = free(edges).withColumn("rank", F.row_number().over(by)).withColumn("next", F.lead("score").over(by)).filter("rank = 1")
        best = best.select("doc", "at", F.col("pid").alias("near"), "score", F.coalesce(F.col("score") - F.col("next") < MARGIN, F.lit(False)).alias("close"))
        units = now.select("doc", "at").join(equal, ["doc", "at"], "left").join(best, ["doc", "at"], "left")
        if any_hint:
            units = units.join(free(hinted).groupBy("doc", "at").agg(F.min("pid").alias("told")), ["doc", "at"], "left")
        told = F.col("told") if any_hint else F.lit(None).cast("long")
        how = F.when(told.isNotNull(), "hinted").when(F.col("left") == 1, "equal").when(F.col("left") > 1, "ambiguous").when(F.col("near").isNull(), "new").when(F.col("close"), "ambiguous").otherwise("fuzzy")
        made = units.select("doc", "at", how.alias("how"), told.alias("told"), "pid", "near", "score", F.col("left").isNull().alias("asks"))
        choice = F.when(F.col("how") == "hinted", F.col("told")).when(F.col("how") == "equal", F.col("pid")).when(F.col("how") == "fuzzy", F.col("near"))
        decided = state.cut(made.select("doc", "at", "how", choice.alias("pid"), F.when(F.col("how") == "fuzzy", F.col("score")).alias("score"), (F.col("asks") & (F.col("how") != "hinted")).alias("asks")))
        more = state.cut(decided.filter("asks").select("doc", "at").join(asked, ["doc", "at"], "left_anti"))
        taken = state.cut(decided.filter("pid is not null").groupBy("doc", "pid").agg(F.min("at").alias("time")))
        was, mark = mark, taken.agg(F.count("*"), F.sum(F.xxhash64("doc", "pid", "time").cast("decimal(38,0)"))).first()
        if not more.isEmpty():
            edges, asked, mark = state.cut(edges.union(similar_to(more))), state.cut(asked.union(more)), None
        elif mark == was:
            break
    found = now.join(decided, ["doc", "at"]).join(old.select("doc", "pid", F.col("ordinal").alias("previous_ordinal"), "stable_id", F.col("s1").alias("p_s1"), F.col("s2").alias("p_s2"), "trusted"), ["doc", "pid"], "left")
    kind = F.when(F.col("how") == "hinted", "exact").when(F.col("how") == "equal", F.when(F.col("ordinal") == F.col("previous_ordinal"), "exact").otherwise("moved")).otherwise(F.col("how"))
    reuse = F.coalesce(F.col("how").isin("hinted", "equal") & F.col("trusted") & (F.col("s1") == F.col("p_s1")) & (F.col("s2") == F.col("p_s2")), F.lit(False))
    return found.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), kind.alias("kind"), "score", F.col("previous_ordinal").cast("long").alias("previous_ordinal"), "stable_id", reuse.alias("trusted_reuse"))


def whole_documents(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches of documents without an ambiguous unit, and a finding for each ambiguous unit of the others."""
    marked = by_documents(matches)
    found = marked.filter(F.col("kind") == "ambiguous").select("doc_id", "ordinal", F.lit("MATCH-AMBIGUOUS").alias("code"), F.lit("error").alias("severity"))
    return marked.filter("not dropped").drop("dropped"), found


def by_documents(matches: DataFrame) -> DataFrame:
    """Adds `dropped`: whether the document has an ambiguous unit."""
    return matches.withColumn("dropped", F.max(F.col("kind") == "ambiguous").over(Window.partitionBy("doc_id")))


def reusable(candidates: DataFrame, policy: str, models: list[str]) -> DataFrame:
    """The first reusable candidate of each unit: trusted ones first, then the newest; of candidates(unit_id, candidate_id, text, trusted, allowed, policy, model)."""
    ok = (F.length("text") > 0) & (F.col("trusted") | (F.col("allowed") & (F.col("policy") == policy) & (F.col("model").isNull() | F.col("model").isin(models))))
    first = F.row_number().over(Window.partitionBy("unit_id").orderBy(F.desc("trusted"), F.desc("candidate_id")))
    return candidates.filter(ok).withColumn("_n", first).filter("_n = 1").drop("_n")


def eligible(candidates: DataFrame, run: str, invocation: str) -> DataFrame:
    """Adds `allowed` to candidates(unit_id, current_unit_id, run_id, invocation, hint): of the same unit, and of this run, this invocation or an unchanged document."""
    ours = F.coalesce(F.col("run_id") == run, F.lit(False)) | F.coalesce(F.col("invocation") == invocation, F.lit(False)) | (F.length(F.coalesce("hint", F.lit(""))) > 0)
    return candidates.withColumn("allowed", F.coalesce(F.col("unit_id") == F.col("current_unit_id"), F.lit(False)) & ours)


def reviewed(picked: DataFrame, receipts: DataFrame, stages: list[str]) -> DataFrame:
    """Picks of units without an incompatible receipt(unit_id, dedupe_key, compatible) of an enabled stage; the next candidate is not tried."""
    if not stages:
        return picked
    stage = F.element_at(F.split("dedupe_key", ":"), -1)
    bad = receipts.filter(stage.isin(stages) & ~F.coalesce("compatible", F.lit(False))).select("unit_id").distinct()
    return picked.join(bad, "unit_id", "left_anti")


def provenance_ok(stored: DataFrame, contracts: list[str]) -> DataFrame:
    """Adds `valid` to stored(path, source, kind, context, contract, now_path, now_source, now_kind, now_context): same document, source, kind and context under a contract that is still read."""
    same = F.lit(True)
    for c in ("path", "source", "kind", "context"):
        same = same & F.col(c).eqNullSafe(F.col(f"now_{c}"))
    return stored.withColumn("valid", same & F.coalesce(F.col("contract").isin(contracts), F.lit(False)))


def placeholder_counts(values: list[str]) -> dict[str, int]:
    return dict(Counter(values))
