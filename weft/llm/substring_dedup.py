"""Operator 3, suffix-array dedup: remove every byte covered by a long string that starts twice.

Not every suffix is sorted, but enough of them to be exact. Each window of `LENGTH` bytes has one
anchor, the least hash of its `GRAM`-byte strings, the first if several: a function of the window's
bytes alone, so equal windows have anchors at equal offsets, and a text has one anchor for some
185 bytes. An anchor's context holds all windows it stands for. A window occurs twice if and only if an equal
window has an anchor of the same string, so:

1. anchors whose string occurs once in the corpus drop out (a count by hash);
2. anchors with equal contexts settle each other: all their windows occur twice, and one of them
   stands for all from then on, so that copies cost a row each and are never compared;
3. the different contexts of one string are sorted as suffixes: ranges of leading bytes are cut by sampled
   splitters (a range partitioning by the anchors' strings), so that no string lies across a boundary, and each
   bucket sorts its suffixes, and the texts before them backwards, by a multikey quicksort on
   8-byte keys. The common prefixes of neighbours then tell, for each offset, which windows are equal
   to the right of the anchor, which to its left, and so which are equal altogether;
4. a string with more than `HOT` different contexts would be too much for one bucket. Its windows are
   counted by 128-bit hashes instead, one row a window, summed before the shuffle. Nothing is capped.

The same steps over words in place of bytes find passages: runs of over 50 words, A-Z lower-cased and whatever stands
between them, that another document has too. A byte string of `LENGTH` may well be shorter or longer than that, so
passages are counted beside the bytes that are removed, and remove none themselves.

Ranges are merged by text, and the remaining bytes hashed. Defined results: a null text is empty; texts shorter
than `LENGTH` lose nothing; repeated rows, null doc_ids included, are texts of their own and so copies of each
other, but one document where passages are counted; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import BYTE_CODE, Scratch, Slice, mix, partitions, prefix_hash, prefix_sums, signed, slices, span_hash

LENGTH = 400
GRAM = 32
PASSAGE_WORDS = 51  # a passage has over 50 words
PASSAGE_GRAM = 8
HOT = 30_000
CHUNK = 1 << 22  # texts are searched in pieces of so many bytes, which overlap by a window
ROW = "row binary, p int, lo int, hi int, h long, c1 long, c2 long"


def units(s: Slice, words: bool) -> Iterator[np.ndarray]:
    """What each text is a string of: its bytes, or the hashes of its words."""
    if not words:
        yield from (s.data[s.offsets[i] : s.offsets[i + 1]] for i in range(s.n))
        return
    starts, ends, first = s.words()
    h = span_hash(prefix_hash(s.data, lower=True), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    yield from (h[first[i] : first[i + 1]] for i in range(s.n))


def _codes(data: np.ndarray, other: bool = False) -> np.ndarray:
    """64 bits for each unit; other bits for a second hash."""
    if data.dtype == np.uint8:
        return BYTE_CODE[data ^ 0x5A] if other else BYTE_CODE[data]
    return mix(data ^ np.uint64(0x5851F42D4C957F2D)) if other else data


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: where each stands, its first and last window's start, and the hash of its string."""
    p, lo, hi, h = [], [], [], []
    for begin in range(0, max(1, len(data) - length + 1), CHUNK):
        piece = _codes(data[begin : begin + CHUNK + length - 1])
        n = len(piece) - length + 1
        if n <= 0:
            break
        at = np.arange(len(piece) - gram + 1)
        hashes = span_hash(prefix_sums(piece), at, at + gram)
        least = _least((hashes >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64), length - gram + 1)
        own = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        p.append(own[first] + begin)
        lo.append(first + begin)
        hi.append(np.append(first[1:], n) - 1 + begin)
        h.append(hashes[own[first]])
    if not p:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return np.concatenate(p), np.concatenate(lo), np.concatenate(hi), np.concatenate(h)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours: prefix and suffix minima of blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _contexts(data: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each context and of where the anchor stands in it."""
    at = (p - lo).astype(np.uint64)
    one = span_hash(prefix_sums(_codes(data)), lo, hi + length)
    two = span_hash(prefix_sums(_codes(data, True)), lo, hi + length)
    return mix(one + at), mix(two ^ (at << np.uint64(32)))


def _anchors(length: int, gram: int, words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            out = []
            for i, data in enumerate(units(s, words)):
                if len(data) < length:
                    continue
                p, lo, hi, h = anchors(data, length, gram)
                c1, c2 = _contexts(data, p, lo, hi, length)
                out.append((np.full(len(p), i), p, lo, hi, signed(h), signed(c1), signed(c2)))
            if out:
                a = [np.concatenate(x) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([s.batch.column("row").take(pa.array(a[0])), *(pa.array(x.astype(np.int32)) for x in a[1:4]), *(pa.array(x) for x in a[4:])], names=[x.split()[0] for x in ROW.split(", ")])

    return run


CUT = "h long, c1 long, c2 long, first int, last int, left binary, right binary, who long, hot boolean"


def _cut(length: int, words: bool):
    """The units around the anchors named in a text's list, in bytes that sort as they do: CUT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            out = []
            for data, marks in zip(units(s, words), s.batch.column("marks").to_pylist(), strict=True):
                text, size = data.astype(">u8").tobytes() if words else data.tobytes(), 8 if words else 1
                for m in marks:
                    p, lo, hi = m["p"], m["lo"], m["hi"]
                    out.append((m["h"], m["c1"], m["c2"], p - lo, hi - p, text[lo * size : p * size], text[p * size : (hi + length) * size], m["who"], bool(m["hot"])))
            if out:
                h, c1, c2, a, b, left, right, who, hot = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (h, c1, c2)), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(who, pa.int64()), pa.array(hot)], names=[x.split()[0] for x in CUT.split(", ")])

    return run


def multikey(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of rows by group and then by their keys from left to right.

    Rows that are still tied are parted by the next key only, all ties of one depth together.
    """
    order = np.argsort(group, kind="stable")
    rank = np.empty(len(order), np.int64)
    begins = np.flatnonzero(np.concatenate(([True], np.diff(group[order]) != 0)))
    rank[order] = np.repeat(begins, np.diff(np.append(begins, len(order))))
    active = np.arange(len(group))
    for depth in range(keys.shape[1]):
        _, inverse, n = np.unique(rank[active], return_inverse=True, return_counts=True)
        active = active[n[inverse] > 1]
        if not len(active):
            break
        key = keys[active, depth]
        by = np.lexsort((key, rank[active]))
        active, key = active[by], key[by]
        r = rank[active]
        fresh = np.concatenate(([True], (r[1:] != r[:-1]) | (key[1:] != key[:-1])))
        start = np.concatenate(([True], r[1:] != r[:-1]))
        # a new class stands as far behind its old one's place as rows of that come before it
        place = np.arange(len(r))
        rank[active] = r + (place[np.maximum.accumulate(np.where(fresh, place, 0))] - place[np.maximum.accumulate(np.where(start, place, 0))])
    return np.argsort(rank, kind="stable")


def _padded(parts: list[bytes], width: int, size: int, reverse: bool = False) -> np.ndarray:
    """A row of units for each part, `width` of them at most, padded to whole sort keys of 8 bytes."""
    unit = np.dtype(f">u{size}")
    out = np.zeros((len(parts), -(-width * size // 8) * 8 // size), unit)
    for i, x in enumerate(parts):
        row = np.frombuffer(x, unit)[::-1] if reverse else np.frombuffer(x, unit)
        out[i, : min(len(row), width)] = row[:width]
    return out


def _common(data: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Units that each row, in the order given, has in common with the one before; -1 where a group begins."""
    a, b = data[order[1:]], data[order[:-1]]
    differ = a != b
    out = np.where(differ.any(axis=1), differ.argmax(axis=1), data.shape[1])
    out[group[order[1:]] != group[order[:-1]]] = -1
    return np.concatenate(([-1], out))


def twice(group: np.ndarray, first: np.ndarray, last: np.ndarray, left: list[bytes], right: list[bytes], length: int, gram: int, size: int = 1, who: np.ndarray | None = None) -> np.ndarray:
    """By row and offset of the anchor in the window: whether that window is in a row of the group that is another's as well."""
    widest = length - gram + 1
    who = np.arange(len(group)) if who is None else who
    r, l = _padded(right, length, size), _padded(left, widest - 1, size, reverse=True)
    by_right, by_left = multikey(r.view(">u8"), group), multikey(l.view(">u8"), group)
    common_right, common_left = _common(r, by_right, group), _common(l, by_left, group)
    out = np.zeros((len(group), widest), bool)
    a, b = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
    for offset in range(widest):
        rows = np.flatnonzero((first >= offset) & (-last <= offset))
        if len(rows) < 2:
            continue
        a[by_right] = np.cumsum(common_right < length - offset)
        b[by_left] = np.cumsum(common_left < offset)
        key = a[rows] * (len(group) + 1) + b[rows]
        by = np.argsort(key, kind="stable")
        begins = np.flatnonzero(np.concatenate(([True], key[by][1:] != key[by][:-1])))
        whose = who[rows[by]]
        shared = np.minimum.reduceat(whose, begins) < np.maximum.reduceat(whose, begins)
        out[rows[by][np.repeat(shared, np.diff(np.append(begins, len(by))))], offset] = True
    return out


def _ranges(flags: np.ndarray) -> list[list[dict[str, int]]]:
    """Runs of set offsets of each row, as first and last."""
    out: list[list[dict[str, int]]] = [[] for _ in range(len(flags))]
    edges = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    for (i, a), (_, b) in zip(np.argwhere(edges == 1), np.argwhere(edges == -1), strict=True):
        out[i].append({"a": int(a), "b": int(b) - 1})
    return out


OFFSETS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _sorted_bucket(length: int, gram: int, words: bool, rows: int = 4096):
    """Compares the contexts of each string; rows come sorted by it, and a string's are kept together."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        h = t.column("h").to_numpy()
        flags = twice(np.unique(h, return_inverse=True)[1], t.column("first").to_numpy(), t.column("last").to_numpy(), t.column("left").to_pylist(), t.column("right").to_pylist(), length, gram, 8 if words else 1, t.column("who").to_numpy() if words else None)
        found = np.flatnonzero(flags.any(axis=1))
        return pa.RecordBatch.from_arrays([*(pa.array(t.column(c).to_numpy()[found]) for c in ("h", "c1", "c2")), pa.array([x for x in _ranges(flags[found])], OFFSETS)], names=["h", "c1", "c2", "offsets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for big in batches:
            for at in range(0, big.num_rows, rows):
                held.append(big.slice(at, rows))
                if sum(b.num_rows for b in held) < rows:
                    continue
                t = pa.Table.from_batches(held)
                h = t.column("h").to_numpy()
                cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0
                if cut:
                    yield solve(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


WINDOWS = "h long, c1 long, c2 long, offset int, w1 long, w2 long, who long"


def _windows(length: int, words: bool):
    """Each window of the hot strings' contexts: WINDOWS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.to_pylist():
                data = np.frombuffer(c["left"] + c["right"], ">u8").astype(np.uint64) if words else np.frombuffer(c["left"] + c["right"], np.uint8)
                at = np.arange(c["first"] + c["last"] + 1)
                w1, w2 = (span_hash(prefix_sums(_codes(data, x)), at, at + length) for x in (False, True))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(at), c[k], np.int64)) for k in ("h", "c1", "c2")), pa.array((c["first"] - at).astype(np.int32)), pa.array(signed(w1)), pa.array(signed(w2)), pa.array(np.full(len(at), c["who"], np.int64))], names=[x.split()[0] for x in WINDOWS.split(", ")])

    return run


def _runs(spans: list[dict[str, int]] | None, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs that windows with first and last starts a and b cover together."""
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.array([(x["a"], x["b"] + length) for x in spans], np.int64).T
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    fresh = np.concatenate(([True], a[1:] > b[:-1]))
    return a[fresh], b[np.append(np.flatnonzero(fresh)[1:] - 1, len(b) - 1)]


def _remove(length: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            out = []
            for i, (spans, passages) in enumerate(zip(s.batch.column("spans").to_pylist(), s.batch.column("passages").to_pylist(), strict=True)):
                text = s.text(i)
                (begin, end), (first, last) = _runs(spans, length), _runs(passages, words)
                left = b"".join(text[a:b] for a, b in zip([0, *end], [*begin, len(text)], strict=True)) if len(begin) else text
                out.append((len(text), len(text) - len(left), len(begin), hashlib.sha256(left).hexdigest(), len(first), int((last - first).sum())))
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([s.batch.column("doc_id"), *(pa.array(x) for x in columns)], names=[x.split()[0] for x in RESULT.split(", ")])

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long"


def repeats(rows: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, words: bool = False) -> DataFrame:
    """(row, a, b): first and last start of windows of rows(row, text), ranges that may overlap.

    Windows of bytes that occur twice or more, or windows of words that rows of another name have as well.
    """
    spark = rows.sparkSession
    every = scratch.keep(rows.mapInArrow(_anchors(length, gram, words), ROW))
    # of words, what repeats in one text alone is no passage
    again_ = F.min(F.xxhash64("row")) < F.max(F.xxhash64("row")) if words else F.count("*") > 1
    of_string = every.groupBy("h").agg(again_.alias("again"), F.min("c1").alias("c_lo"), F.max("c1").alias("c_hi"))
    strings = scratch.keep(of_string.filter("again").select("h", (F.col("c_lo") < F.col("c_hi")).alias("mixed")))
    again = scratch.keep(every.join(strings, "h"))
    scratch.drop(every, strings)
    contexts = scratch.keep(again.groupBy("h", "c1", "c2", "mixed").agg(again_.alias("again"), F.min(F.struct("row", "p", "lo", "hi")).alias("at")))
    mixed = contexts.filter("mixed")
    # one anchor for each context of a string that has several; a context that several texts have is nobody's own
    who = F.when(F.col("again"), F.xxhash64("c1", "c2")).otherwise(F.xxhash64("at.row"))
    several = mixed.join(mixed.groupBy("h").agg((F.count("*") > HOT).alias("hot")), "h").select("at.*", "h", "c1", "c2", who.alias("who"), "hot")
    marks = several.groupBy("row").agg(F.collect_list(F.struct("p", "lo", "hi", "h", "c1", "c2", "who", "hot")).alias("marks"))
    cut = scratch.keep(rows.join(marks, "row").select("text", "marks").mapInArrow(_cut(length, words), CUT))
    ranged = cut.filter("not hot").repartitionByRange(partitions(spark), F.substring("right", 1, 8 * gram if words else gram), "h").sortWithinPartitions("h")
    offsets = "h long, c1 long, c2 long, offsets array<struct<a:int,b:int>>"
    sorted_ = ranged.mapInArrow(_sorted_bucket(length, gram, words), offsets).select("h", "c1", "c2", F.explode("offsets").alias("o")).select("h", "c1", "c2", "o.a", "o.b")
    windows = cut.filter("hot").mapInArrow(_windows(length, words), WINDOWS)
    common = windows.groupBy("h", "offset", "w1", "w2").agg((F.min("who") < F.max("who") if words else F.count("*") > 1).alias("again")).filter("again").select("h", "offset", "w1", "w2")
    counted = windows.join(common, ["h", "offset", "w1", "w2"]).select("h", "c1", "c2", F.col("offset").alias("a"), F.col("offset").alias("b"))
    found = scratch.keep(sorted_.union(counted))
    scratch.drop(cut)
    copied = contexts.filter("again").select("h", "c1", "c2")
    whole = again.join(copied, ["h", "c1", "c2"]).select("row", F.col("lo").alias("a"), F.col("hi").alias("b"))
    part = again.join(found, ["h", "c1", "c2"]).select("row", (F.col("p") - F.col("b")).alias("a"), (F.col("p") - F.col("a")).alias("b"))
    out = scratch.keep(whole.union(part).groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    scratch.drop(again, contexts, found)
    return out


def dedup(docs: DataFrame, scratch: Scratch | None = None, length: int = LENGTH, gram: int = GRAM, passage: int = PASSAGE_WORDS, passage_gram: int = PASSAGE_GRAM) -> DataFrame:
    """For each row of docs(doc_id, text): its bytes, those removed, the runs removed, the rest's SHA-256, and its passages of other documents with their words."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("row", F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))))
    texts = rows.select("row", "text")
    spans = repeats(texts.filter(F.octet_length("text") >= length), scratch, length, gram)
    passages = repeats(texts.filter(F.octet_length("text") >= 2 * passage - 1), scratch, passage, passage_gram, words=True).withColumnRenamed("spans", "passages")
    both = scratch.keep(spans.join(passages, "row", "full"))
    scratch.drop(spans, passages)
    return rows.join(both, "row", "left").select("doc_id", "text", "spans", "passages").mapInArrow(_remove(length, passage), RESULT)
