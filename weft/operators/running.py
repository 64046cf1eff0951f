"""Running totals and numbers over keys that may hold most rows.

A key's rows are cut into pieces by a column that rises with their order. Each piece is totalled on its own, by one task at most;
what lies before a piece is added from the pieces' totals, of which there is a row for each key and piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of a key that one task numbers.
PIECE = 4096


def pieces(order: str, size: int | None = None) -> Column:
    """Pieces by the place that an integer column names; no place is one of its own, before the others."""
    return F.floor(F.col(order) / F.lit(size or PIECE))


def totals(rows: DataFrame, keys: list[str], piece: Column, order: list[Column], sums: dict[str, tuple[Callable[[Column], Column], Column]]) -> DataFrame:
    """Adds, under each name of `sums`, its aggregate (F.sum or F.bit_xor) over the key's rows as far as this one.

    `piece` never falls along `order` within a key. Null keys are keys like others. Rows of equal order come in any order, so
    the order should be whole. A sum is 0 before its first value that is not null.
    """
    taken = {c.lower() for c in rows.columns}
    at, part = (next(n for n in (f"{x}{'_' * i}" for i in range(len(taken) + 1)) if n not in taken) for x in ("_at", "_piece"))
    values = {name: f"{name}_value" for name in sums}
    cut = rows.withColumn(part, piece).withColumn(at, F.struct(*keys, part)).withColumns({values[n]: c for n, (_, c) in sums.items()})
    per = cut.groupBy(at).agg(*[f(values[n]).alias(n) for n, (f, _) in sums.items()])
    over = Window.partitionBy(*[F.col(at)[k] for k in keys]).orderBy(F.col(at)[part].asc_nulls_first())
    before = per.select(F.col(at), *[F.coalesce(f(n).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{n}_before") for n, (f, _) in sums.items()])
    local = Window.partitionBy(at).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cut.withColumns({n: f(values[n]).over(local) for n, (f, _) in sums.items()}).join(before, at)
    joined = lambda n, f: F.coalesce(F.col(n), F.lit(0)).bitwiseXOR(F.col(f"{n}_before")) if f is F.bit_xor else F.coalesce(F.col(n), F.lit(0)) + F.col(f"{n}_before")
    return run.withColumns({n: joined(n, f) for n, (f, _) in sums.items()}).drop(at, part, *values.values(), *[f"{n}_before" for n in sums])


def numbered(rows: DataFrame, keys: list[str], piece: Column, order: list[Column], name: str) -> DataFrame:
    """Adds the number of each row among its key's, from 1."""
    return totals(rows, keys, piece, order, {name: (F.sum, F.lit(1))})
