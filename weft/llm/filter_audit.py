"""Operator 12, filter interaction audit: what each filter removes at its place in every order of the filters.

A document is reduced to the mask of the filters that it fails, and documents to cells: a row for each part and mask, with counts. All orders of a part are
then met by swaps of two neighbours (plain changes). A swap leaves all steps but two as they are; these two are counted anew
from the cells. The Shapley numbers, what a filter removes summed over all orders, accumulate along the walk. With k filters a part has at
most 2**k cells and k * k! rows, whatever its documents; parts are walked in Arrow batches.

`masks` and `parts` hold what the query's contract fixes: five filters and their conditions. `audit` works on the cells of any filters.

Defined results: null and empty texts fail A alone; texts are equal if their SHA-256 is. Only a doc_id that is truly smaller makes a copy fail E:
rows of one doc_id and text don't, and a null doc_id is neither smaller nor larger than any. A null part is the empty string's; labels of a
doc_id that come several times count once if any of them says so, and those of no document count nothing. An
empty table has no parts, so no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kit import Scratch

FILTERS = "ABCDE"
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
# Parts whose rows are made at a time.
PARTS = 64


def conditions(text: Column) -> list[Column]:
    """Whether a text fails A to D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [F.size(words) < 100, 100 * F.size(F.array_distinct(words)) < 80 * F.size(words), 100 * capitals > 10 * F.char_length(text), text.rlike(r"[#$%&*|]")]


def masks(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, mask, good, toxic), a row for each of docs(doc_id, text, lang); bit i of the mask is the filter i.

    Texts are read once. Copies are found by the least doc_id of each digest, combined before its shuffle; both joins have a
    table of their own on the other side, so that adaptive execution can split a hot digest or doc_id.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions(text))]
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), sum(bits[1:], bits[0]).alias("bits"))
    facts = scratch.keep(read)
    copies = scratch.keep(facts.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("digest", "least"))
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    told = scratch.keep(labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality").alias("good"), said("toxic").alias("toxic")).filter("good or toxic"))
    both = facts.join(told, "doc_id", "left").join(copies, "digest", "left")
    copy = F.when(F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)), 1 << 4).otherwise(0)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("long")
    return both.select("part", (F.col("bits") + copy).alias("mask"), flag("good").alias("good"), flag("toxic").alias("toxic"))


def swaps(n: int) -> Iterator[int]:
    """The places, from 0, whose neighbours swap one after the other, so that all orders of n things are met once."""
    order, way = list(range(n)), [-1] * n
    while movable := [(x, i) for i, x in enumerate(order) if 0 <= i + way[x] < n and order[i + way[x]] < x]:
        x, i = max(movable)
        j = i + way[x]
        order[i], order[j] = order[j], order[i]
        for y in range(x + 1, n):
            way[y] = -way[y]
        yield min(i, j)


def walk(cells: np.ndarray, k: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray, np.ndarray]:
    """Orders; counts [part, order, step, removed and good and toxic ones lost]; kept [part, order, step]; Shapley numbers [part, filter].

    cells[part, count, mask] are documents, good ones and toxic ones.
    """
    mask = np.arange(1 << k)
    all_of = cells[:, 0].sum(axis=1)
    n, orders = factorial(k), []
    counts, kept = np.zeros((len(cells), n, k, 3), np.int64), np.zeros((len(cells), n, k), np.int64)
    shapley = np.zeros((len(cells), k), np.int64)
    order, now, left = list(range(k)), np.zeros((len(cells), k, 3), np.int64), np.zeros((len(cells), k), np.int64)

    def recount(steps: range) -> None:
        for s in steps:
            before = sum(1 << f for f in order[:s])
            now[:, s] = cells[:, :, (mask & before == 0) & (mask >> order[s] & 1 == 1)].sum(axis=2)
            left[:, s] = (left[:, s - 1] if s else all_of) - now[:, s, 0]

    recount(range(k))
    places = swaps(k)
    for i in range(n):
        orders.append(tuple(order))
        counts[:, i], kept[:, i] = now, left
        shapley[:, order] += now[:, :, 0]
        at = next(places, None)
        if at is not None:
            order[at], order[at + 1] = order[at + 1], order[at]
            recount(range(at, at + 2))
    return orders, counts, kept, shapley


def _rows(parts: pa.Array, cells: np.ndarray, names: str) -> pa.RecordBatch:
    k = len(names)
    orders, counts, kept, shapley = walk(cells, k)
    which = np.array(orders)  # the filter at each order and step
    mask = np.arange(1 << k)
    fails = np.stack([cells[:, 0, mask >> f & 1 == 1].sum(axis=1) for f in range(k)], axis=1)
    alone = np.stack([cells[:, 0, 1 << f] for f in range(k)], axis=1)
    each, n = which.size, len(cells)
    said = pa.array(np.repeat(["".join(names[f] for f in o) for o in orders], k))
    flat = lambda x: pa.array(np.ascontiguousarray(x).reshape(-1), pa.int64())
    return pa.RecordBatch.from_arrays([
        parts.take(pa.array(np.repeat(np.arange(n), each))), said.take(pa.array(np.tile(np.arange(each), n))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n * len(orders))), flat(kept),
        flat(counts[..., 0]), flat(fails[:, which] - counts[..., 0]), flat(alone[:, which]), flat(counts[..., 1]), flat(counts[..., 2]), flat(shapley[:, which]),
    ], names=[c.split()[0] for c in SCHEMA.split(", ")])


def audit(masked: DataFrame, names: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, of masked(part, mask, good, toxic) with a row for each document."""
    cells = masked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    by = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PARTS):
                some = b.slice(at, PARTS)
                lists = some.column("cells")
                row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
                flat = lists.flatten()
                of = {c: np.asarray(flat.field(c)) for c in ("mask", "n", "good", "toxic")}
                table = np.zeros((len(lists), 3, 1 << len(names)), np.int64)
                for i, c in enumerate(("n", "good", "toxic")):
                    table[row, i, of["mask"]] = of[c]
                yield _rows(some.column("part"), table, names)

    return by.mapInArrow(run, SCHEMA)
