"""Sets of files compared by sums of hashes, and hashed in order, without an array of any set."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row_hash(columns: list[str]) -> Column:
    """32 hex digits of a row: each value led by its length, nulls apart from every text."""
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.md5(F.concat_ws(",", *parts))


def digests(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """(*group, n, high, low): how many rows a group has, and the sums of the two halves of their 128-bit hashes.

    The sums do not depend on order and are combined before they are shuffled, so a group of any size costs a row a task. Repeated
    rows count as often as they come. A sum of decimals of 20 digits has room for 10**10 rows.
    """
    half = lambda at: F.conv(F.substring(_row_hash(columns), at, 16), 16, 10).cast("decimal(20,0)")
    return rows.groupBy(*group).agg(F.count("*").alias("n"), F.sum(half(1)).alias("high"), F.sum(half(17)).alias("low"))


def _joined(a: DataFrame, b: DataFrame, columns: list[str], how: str) -> DataFrame:
    """A join by null-safe equality; of the columns, the first that is not null."""
    left, right = a.alias("l"), b.alias("r")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns]
    both = left.join(right, on, how)
    if how == "left_semi":
        return both
    rest = lambda df: [c for c in df.columns if c not in columns]
    return both.select(*[F.coalesce(f"l.{c}", f"r.{c}").alias(c) for c in columns], *[F.col(f"l.{c}") for c in rest(a)], *[F.col(f"r.{c}") for c in rest(b)])


def same_sets(a: DataFrame, b: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """(*group, same) of every group of either side. Null groups are groups like others; a group that one side lacks is not the same."""
    one = digests(a, group, columns).select(*group, F.struct("n", "high", "low").alias("x"))
    two = digests(b, group, columns).select(*group, F.struct("n", "high", "low").alias("y"))
    return _joined(one, two, group, "full").select(*group, F.col("x").eqNullSafe(F.col("y")).alias("same"))


def differences(a: DataFrame, b: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """(*group, *columns, n_a, n_b): the rows that the two sides do not have equally often.

    Only groups whose digests differ are compared row by row, so replaying what is already stored shuffles a row a group.
    """
    unlike = same_sets(a, b, group, columns).filter("not same").select(*group)
    every = [*group, *columns]
    count = lambda df, name: _joined(df.select(*every), unlike, group, "left_semi").groupBy(*every).agg(F.count("*").alias(name))
    both = _joined(count(a, "n_a"), count(b, "n_b"), every, "full")
    out = both.select(*every, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    return out.filter("n_a <> n_b")


def replayed(stored: DataFrame, asked: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """What becomes of each asked set: new (nothing is stored under its group), replay (the very same set is) or conflict."""
    known = digests(stored, group, columns).select(*group, F.struct("n", "high", "low").alias("x"))
    wanted = digests(asked, group, columns).select(*group, F.struct("n", "high", "low").alias("y"))
    said = F.when(F.col("x").isNull(), "new").when(F.col("x") == F.col("y"), "replay").otherwise("conflict")
    return _joined(known, wanted, group, "right").select(*group, said.alias("outcome"))


def manifests(rows: DataFrame, group: list[str], order: list[str], fields: list[str], name: str = "manifest") -> DataFrame:
    """(*group, name): SHA-256 of the JSON list of each group's rows(fields), in the order of `order`.

    The hash is sequential by definition: a group's rows are sorted by Spark, which spills, and read in order by one task that holds
    one hash state and one batch. Null groups are groups like others.
    """
    keyed = rows.select(*group, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.to_json(F.struct(*fields)).alias("_j"))
    # the key as text tells groups apart where Python has no type for it, and nulls from empty texts
    keyed = keyed.withColumn("_k", F.to_json(F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)]), {"ignoreNullFields": "false"}))
    placed = keyed.repartition("_k").sortWithinPartitions("_k", *[f"_o{i}" for i in range(len(order))], "_j").select("_k", "_j")
    hashed = placed.mapInArrow(_hash_runs, f"_k string, {name} string")
    types = ", ".join(f"g{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(group))
    back = hashed.withColumn("_g", F.from_json("_k", types))
    return back.select(*[F.col("_g")[f"g{i}"].alias(c) for i, c in enumerate(group)], name)


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for k, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if state is not None:
                    state.update(b"]")
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(b"[")
            else:
                state.update(b",")
            state.update(j.encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([h for _, h in done], pa.string())], names=["_k", "h"])
    if state is not None:
        state.update(b"]")
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["_k", "h"])
