"""What held at a time: each row with the newest entry of its key that is not later, by a union and last values.

Rows and entries of a key are cut into pieces of time, as in `running`: a piece is read in order by one task, and what a piece
starts from is the last entry of the pieces before it, of which there is a row for each key and piece. No pair of a row
and an older entry is ever formed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, entries: DataFrame, keys: list[str], at: str, piece: Column, ties: tuple[str, ...] = (), earlier: bool = False) -> DataFrame:
    """rows(*keys, at, ...) with the columns of the newest of entries(*keys, at, ...) whose `at` is no later, else nulls.

    `piece` is an expression over `at` that never falls as `at` rises, such as its day. Of entries of one key and time the one with the greatest
    `ties` counts, nulls being least; without them any. With `earlier` an entry of the row's own time does not count yet. A null key or
    time of a row finds nothing, one of an entry is never found. All rows are returned, repeated ones as often as
    they come. The entries' time is added as `<at>_found`; their other columns must have names that rows do not have.
    """
    held = [c for c in entries.columns if c not in (*keys, at)]
    if clash := {c.lower() for c in (*held, f"{at}_found")} & {c.lower() for c in rows.columns}:
        raise ValueError(f"both sides have {sorted(clash)}")
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, at)])
    entry = F.struct(F.col(at).alias("at"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(held)])
    left = rows.filter(whole).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(at).alias("t"), piece.alias("p"), F.struct(*rows.columns).alias("row"))
    right = entries.filter(whole).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(at).alias("t"), piece.alias("p"), entry.alias("entry"), F.struct(F.lit(0), *ties).alias("tie"))
    both = left.unionByName(right, allowMissingColumns=True)
    named = [f"k{i}" for i in range(len(keys))]
    is_row = F.col("row").isNotNull()
    # of equal times the entries come first, or last where only earlier ones count; entries by their ties
    order = [F.col("t"), ~is_row if earlier else is_row, F.col("tie").asc_nulls_first()]
    local = Window.partitionBy(*named, "p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("here", F.last("entry", ignorenulls=True).over(local)).filter(is_row)
    newest = right.groupBy(*named, "p").agg(F.max_by("entry", F.struct("t", "tie")).alias("entry"))
    marks = left.select(*named, "p").distinct().unionByName(newest, allowMissingColumns=True).groupBy(*named, "p").agg(F.first("entry", ignorenulls=True).alias("entry"))
    before = Window.partitionBy(*named).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    start = marks.select(*named, "p", F.last("entry", ignorenulls=True).over(before).alias("before"))
    got = F.coalesce("here", "before")
    columns = [F.col("row")[c].alias(c) for c in rows.columns]
    out = found.join(start, [*named, "p"]).select(*columns, got["at"].alias(f"{at}_found"), *[got[f"c{i}"].alias(c) for i, c in enumerate(held)])
    lost = rows.filter(~whole)
    return out.unionByName(lost, allowMissingColumns=True)


def previous_texts(units: DataFrame, versions: DataFrame, memory: DataFrame) -> DataFrame:
    """units(unit_id, locale, at, contract) with the text each had before `at`, and where it is from.

    A version of versions(unit_id, locale, at, id, text, contract, active) counts if it was active and made under the unit's contract
    (a null contract fits any); else the newest entry of memory(unit_id, locale, at, id, text); else there is none, and both are null.
    """
    month = F.date_trunc("month", "at")
    asked = units.select("unit_id", "locale", "at", "contract").distinct().withColumn("under", F.struct("contract"))  # never null itself
    keys = ["unit_id", "locale", "under"]
    active = versions.filter("active")
    own = active.filter("contract is not null").withColumn("under", F.struct("contract")).select(*keys, "at", "id", "text")
    # versions without a contract are entries of each contract that is asked for
    every = active.filter("contract is null").drop("contract").join(asked.select(*keys).distinct(), ["unit_id", "locale"]).select(*keys, "at", "id", "text")
    one = as_of(asked, own.union(every), keys, "at", month, ("id",), earlier=True)
    two = as_of(one.withColumnsRenamed({"at_found": "v_at", "id": "v_id", "text": "v_text"}), memory.select("unit_id", "locale", "at", "id", "text"), ["unit_id", "locale"], "at", month, ("id",), earlier=True)
    origin = F.when(F.col("v_at").isNotNull(), "version").when(F.col("at_found").isNotNull(), "memory")
    said = two.select("unit_id", "locale", "at", "contract", F.coalesce("v_text", "text").alias("previous"), origin.alias("origin"))
    same = reduce(lambda a, b: a & b, [units[c].eqNullSafe(said[c]) for c in ("unit_id", "locale", "at", "contract")])
    return units.join(said, same, "left").select(*[units[c] for c in units.columns], said["previous"], said["origin"])


def files_as_of(asked: DataFrame, manifests: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """Files(manifest, ...) that were published for each asked(*key, at): those of the newest manifests(*key, at, manifest, state) not superseded by then.

    A manifest's rows are its changes of state: where the newest change is to `superseded`, what was published before it is looked at no more.
    """
    held = as_of(asked.distinct(), manifests.select(*key, "at", "manifest", "state"), key, "at", F.date_trunc("month", "at"), ("manifest",))
    return held.filter("state <> 'superseded'").drop("state").join(files, "manifest").select(*key, "at", "manifest", *[c for c in files.columns if c != "manifest"])
