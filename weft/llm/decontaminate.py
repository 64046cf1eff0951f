"""Operator 8, benchmark decontamination by greedy string tiling.

A seed is the rolling hash of `MIN_MATCH` words; an item of fewer words is one seed of all its words, so
that it leaks where it stands whole. Both tables are turned into seeds and joined on them:

1. a bit array of the items' seeds, of `MAX_BITS` at most, is broadcast, and a document's seeds that it does
   not know never leave the scan. The array is a filter only: fuller ones let more seeds through;
2. the seeds left are joined with the items' by hash, and gathered by document and item. An item whose places
   have too few of them could not be covered by any tiling and drops out;
3. tiles are laid by running Karp-Rabin: the greatest length at which the two texts have an unmarked window in common
   is found by bisection over window hashes, all matches of that length are marked in the order of their
   places, and so on down to `MIN_MATCH`. A match that is partly marked by then is found again at the length that is left.

The work of a pair is in proportion to the seeds of both texts, however often words repeat: places are never
multiplied with places. Tiles may stand in any order, so passages that were rearranged count in full. An item
leaks into a document when its tiles cover `COVERAGE` of the item's words.

Words are those of the whole texts, A-Z lower-cased, and windows are compared by 64-bit hashes. Defined results: items
without words and null texts leak nowhere; equal items and repeated rows each give their rows; empty tables give
none; null ids stay null; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kit import BASE, Scratch, Slice, prefix_hash, prefix_sums, shingles, slices, span_hash

MIN_MATCH = 5
COVERAGE = 0.8
MIN_BITS, MAX_BITS = 16, 27  # as powers of two: 8 kB to 16 MB
BROADCAST_ROWS = 1 << 19
SCHEMA = "doc_id long, item_id long, item_words long, matched_words long, n_tiles long, coverage double"
SEEDS = "row binary, doc_id long, at int, seed long"
ITEMS = "item_id long, size int, k int, seeds array<long>"


def seeds(s: Slice, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and hash of each k words in a row of a slice's texts."""
    starts, ends, first = s.words()
    words = span_hash(prefix_hash(s.data, lower=True), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    h = shingles(words, k) + np.uint64(k) * BASE
    row = np.repeat(np.arange(s.n), np.diff(first))
    inside = np.flatnonzero(row[: len(h)] == row[k - 1 :]) if len(h) else np.zeros(0, np.int64)
    return row[inside], inside - first[row[inside]], h[inside]


def _items(min_match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            size, ids, out = np.diff(s.words()[2]), s.batch.column("item_id").to_pylist(), []
            for k in np.unique(np.minimum(size, min_match)):
                if k:
                    row, _, h = seeds(s, int(k))
                    for i in np.flatnonzero(np.minimum(size, min_match) == k):
                        out.append((ids[i], size[i], k, h[np.searchsorted(row, i) : np.searchsorted(row, i, side="right")].view(np.int64)))
            if out:
                a, b, c, d = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int32()), pa.array(d, pa.list_(pa.int64()))], names=["item_id", "size", "k", "seeds"])

    return run


def _filter(items: DataFrame) -> tuple[int, np.ndarray]:
    """How many bits of a seed tell its place, and the 64-bit words of the array of places."""
    one = items.select(F.explode("seeds").alias("seed"))
    bits = min(MAX_BITS, max(MIN_BITS, 4 + int(one.count()).bit_length()))
    held = np.zeros(1 << (bits - 6), np.uint64)
    got = one.select(F.shiftrightunsigned("seed", 64 - bits).alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 AS int)))").alias("set")).toArrow()
    held[got.column("word").to_numpy()] = got.column("set").to_numpy().view(np.uint64)
    return bits, held


def _scan(held):
    """SEEDS that some item may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known, lengths = held.value
        for s in slices(batches):
            for k in lengths:
                row, at, h = seeds(s, k)
                place = h >> np.uint64(64 - bits)
                passed = np.flatnonzero(known[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1))
                if len(passed):
                    ids = s.batch.select(["row", "doc_id"]).take(pa.array(row[passed]))
                    yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(at[passed].astype(np.int32)), pa.array(h[passed].view(np.int64))], names=["row", "doc_id", "at", "seed"])

    return run


def tiles(at: np.ndarray, found: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, place in text, place in item): `found` are seeds of a text, `at` their places in order, `item` all seeds of the item."""
    base, out = int(at[0]), []
    in_text, in_item = np.zeros(int(at[-1]) - base + k, bool), np.zeros(len(item) + k - 1, bool)
    a, b = prefix_sums(found), prefix_sums(item)

    def windows(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Unmarked windows of n seeds in a row that both have: places and hashes in the text, and in the item."""
        i, j = np.arange(len(found) - n + 1), np.arange(len(item) - n + 1)
        i = i[at[i + n - 1] - at[i] == n - 1]
        marked, taken = np.concatenate(([0], np.cumsum(in_text))), np.concatenate(([0], np.cumsum(in_item)))
        place = at[i] - base
        i, j = i[marked[place + n + k - 1] == marked[place]], j[taken[j + n + k - 1] == taken[j]]
        x, y = span_hash(a, i, i + n), span_hash(b, j, j + n)
        both = np.isin(x, y)
        return at[i[both]], x[both], j, y

    longest = min(len(found), len(item))
    while longest:
        low, high = 0, longest
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if len(windows(n)[0]) else (low, n - 1)
        longest = low
        if not low:
            break
        size = low + k - 1
        places, hashes, j, y = windows(low)
        order = np.argsort(y, kind="stable")
        j, y = j[order], y[order]
        begin, end = np.searchsorted(y, hashes), np.searchsorted(y, hashes, side="right")
        reached: dict[int, int] = {}  # by hash: the item's windows before are taken
        for p, first, last in zip(places.tolist(), begin.tolist(), end.tolist(), strict=True):
            if in_text[p - base : p - base + size].any():
                continue
            q = reached.get(first, first)
            while q < last and in_item[j[q] : j[q] + size].any():
                q += 1
            if q < last:
                in_text[p - base : p - base + size] = True
                in_item[j[q] : j[q] + size] = True
                out.append((size, p, int(j[q])))
            reached[first] = q
    return out


def _tile(coverage: float):
    """Of each document and item gathered: a row if the item leaks, as often as the document's row repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                size, k = batch.column("size")[i].as_py(), batch.column("k")[i].as_py()
                item = batch.column("seeds")[i].values.to_numpy().view(np.uint64)
                hits = batch.column("hits")[i].values
                at, once, n = np.unique(hits.field("at").to_numpy(), return_index=True, return_counts=True)
                found = hits.field("seed").to_numpy()[once].view(np.uint64)
                edge = np.zeros(size + 1, np.int64)
                known = np.flatnonzero(np.isin(item, found))
                edge[known] += 1
                np.add.at(edge, known + k, -1)
                if (np.cumsum(edge[:-1]) > 0).sum() < coverage * size:
                    continue  # all its seeds together do not cover enough
                laid = tiles(at.astype(np.int64), found, item, k)
                matched = sum(t[0] for t in laid)
                if matched >= coverage * size:
                    out += [(batch.column("row")[i].as_py(), batch.column("doc_id")[i].as_py(), batch.column("item_id")[i].as_py(), size, matched, len(laid), matched / size)] * int(n[0])
            if out:
                columns = list(zip(*out, strict=True))
                types = [pa.binary(), *[pa.int64()] * 5, pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["row", *[x.split()[0] for x in SCHEMA.split(", ")]])

    return run


def row_name(docs: DataFrame) -> Column:
    """128 bits of a row's doc_id and text; equal rows leak alike."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(docs["doc_id"].cast("string"), F.lit("")), docs["text"].cast("string"))))


def _leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, min_match: int, coverage: float) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_items(min_match), ITEMS)
    items = scratch.keep(items.withColumn("item", F.monotonically_increasing_id()))
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect())
    held = docs.sparkSession.sparkContext.broadcast((*_filter(items), lengths))
    rows = docs.select(row_name(docs).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    by_seed = items.select("item", F.explode(F.array_distinct("seeds")).alias("seed"))
    hits = rows.mapInArrow(_scan(held), SEEDS).join(by_seed, "seed").groupBy("row", "item").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("at", "seed")).alias("hits"))
    return hits.join(items, "item").mapInArrow(_tile(coverage), f"row binary, {SCHEMA}")


def find(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, scratch: Scratch | None = None) -> DataFrame:
    """A row for each document of docs(doc_id, text) and each item of benchmark(item_id, text) that leaks into it."""
    return _leaks(docs, benchmark, scratch or Scratch(docs.sparkSession), min_match, coverage).drop("row")


def keep(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs into which no item leaks, with all their columns."""
    scratch = scratch or Scratch(docs.sparkSession)
    leaked = "leaked"
    while leaked in docs.columns:
        leaked += "_"
    dirty = scratch.keep(_leaks(docs, benchmark, scratch, min_match, coverage).select(F.col("row").alias(leaked)).distinct())
    if dirty.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        dirty = F.broadcast(dirty)
    return docs.join(dirty, row_name(docs) == F.col(leaked), "left_anti")
