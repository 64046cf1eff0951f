"""Operator 5, n-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles. Each shingle flips one bit of a long bit
sketch, so two sketches differ in at most as many bits as the sets differ in shingles; sets that
are similar enough to link differ in at most `(1 - t) / (1 + t)` of their summed sizes. The
sketch is cut into one segment more than that bound allows (and a few to spare) for the size band
at hand: some segment is then equal in both, by the pigeonhole principle, and an equi-join on
(band, segment number, segment) finds every pair that can link. A segment is carried as the XOR
of one 64-bit word for each bit that is set in it, which is a parity sketch's own linear digest.

Equal but empty segments say nothing. A set with at most `spare` empty segments meets each
partner in a full one; one with more adds a second and a third sketch under other hashes, to
which only such sets belong, and in the last of them empty segments are keys too. No pair is lost.

Documents of one set are one class, so copies cost one row each and are never paired. The members
of a key are not paired with one another either: all are compared with that member which shares
the most keys, as a rule the text that the others were made from. Keys whose members then still lie
in more than one component are taken up again with a finer sketch of some `FINE` segments for each
difference that a link allows. Two linked sets are equal in all but `d` of those segments, so they
share one of the `d + 1` first of each in any order that is the same for all sets (a prefix filter over segments, empty
ones included), and only members of different components that do are compared. The order puts rare segments
first: it goes by counts of one set in `SAMPLE`, of which the `COMMON` greatest are broadcast, and then by hash.
Both filters are exact whatever the counts: no link is lost.
Candidates pass the sketches' Hamming bound before the shingles themselves are compared.

Defined results: no word (null, empty or blank text) gives an empty set, linked with nothing;
fewer than k words are one shingle; repeated rows share a class and each has its row; a null
doc_id never is a component's name unless all its documents' are null; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kit import BASE, Scratch, mix, prefix_hash, shingles, signed, slices, span_hash

K = 4
PERCENT = 85
LAYERS = 3
FINE = 4
SAMPLE, COMMON = 16, 1 << 20
SKETCH_BITS = 256
META = "doc_id long, text_hash long, n_shingles long, fp long"


def bands(percent: int, largest: int) -> list[tuple[int, int]]:
    """Size bands [low, high]: sets that link are of one band or of two that follow each other."""
    out, low = [], 1
    while low <= largest:
        high = low * 100 // percent
        out.append((low, high))
        low = high + 1
    return out


def differing(percent: int, a: int, b: int) -> int:
    """At most so many shingles are in one only of two linked sets of sizes a and b."""
    return (100 - percent) * (a + b) // (100 + percent)


def segments(percent: int, high: int) -> tuple[int, int]:
    """Segments of the sketch of the band up to `high`, and how many of them may be empty."""
    d = differing(percent, high, high)
    # a looser bound cuts more segments, of which more are empty; any number of spare ones is exact
    spare = 0 if d == 0 else 1 + (d + 1) // (40 if percent >= PERCENT else 10)
    return d + 1 + spare, spare


def sets(s, k: int = K) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice."""
    starts, ends, first = s.words()
    h = span_hash(prefix_hash(s.data, lower=True), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    joined = shingles(h, k)
    for i in range(s.n):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            yield np.unique(joined[a : b - k + 1])
        elif b > a:
            whole = np.uint64(b - a)
            for x in h[a:b]:
                whole = whole * BASE + x
            yield mix(np.array([whole]))
        else:
            yield np.zeros(0, np.uint64)


def fingerprint(x: np.ndarray) -> np.uint64:
    """64 bits of a set."""
    return mix(np.array([mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(x))]))[0]


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            n, f = np.zeros(s.n, np.int64), np.zeros(s.n, np.uint64)
            for i, x in enumerate(sets(s, k)):
                n[i], f[i] = len(x), fingerprint(x)
            yield pa.RecordBatch.from_arrays([s.batch.column("doc_id").cast(pa.int64()), s.batch.column("text_hash"), pa.array(n), pa.array(signed(f))], names=["doc_id", "text_hash", "n_shingles", "fp"])

    return run


def _bands_of(n: int, all_bands: list[tuple[int, int]], percent: int) -> Iterator[int]:
    """The bands whose keys a set of n shingles has: its own, and the next if a link can reach it."""
    while all_bands[-2][1] < n:
        all_bands.extend(bands(percent, 4 * n)[len(all_bands) :])
    at = next(i for i, (_, high) in enumerate(all_bands) if n <= high)
    yield at
    if 100 * n >= percent * all_bands[at + 1][0]:
        yield at + 1


def _cut(x: np.ndarray, m: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
    """The segments of a sketch of 2**32 bits that are not empty, of m, and their digests."""
    bit = np.sort(mix(x + np.uint64(layer) * BASE)) >> np.uint64(32)
    segment = (bit * np.uint64(m)) >> np.uint64(32)  # in the order of the bits
    begins = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    return segment[begins], np.bitwise_xor.reduceat(mix(bit + np.uint64(1)), begins)


def _with_empty(filled: np.ndarray, digest: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    missing = np.setdiff1d(np.arange(m, dtype=np.uint64), filled)
    return np.concatenate((filled, missing)), np.concatenate((digest, np.zeros(len(missing), np.uint64)))


def _key(filled: np.ndarray, digest: np.ndarray, family: int) -> np.ndarray:
    return mix(mix(digest) + filled * np.uint64(0x100000001B3) + np.uint64(family) * BASE)


def keys(x: np.ndarray, all_bands: list[tuple[int, int]], percent: int) -> np.ndarray:
    out = []
    for band in _bands_of(len(x), all_bands, percent):
        m, spare = segments(percent, all_bands[band][1])
        for layer in range(LAYERS):
            filled, digest = _cut(x, m, layer)
            empty = m - len(filled)
            if layer == LAYERS - 1 and empty:
                filled, digest = _with_empty(filled, digest, m)
            out.append(_key(filled, digest, band * LAYERS + layer))
            if empty <= spare:
                break
    return np.concatenate(out)


def _keys(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_bands = bands(percent, 1 << 20)
        for s in slices(batches):
            fps, found = [], []
            for x in sets(s, k):
                if len(x):
                    found.append(keys(x, all_bands, percent))
                    fps.append(np.repeat(fingerprint(x), len(found[-1])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(found))), pa.array(signed(np.concatenate(fps)))], names=["key", "fp"])

    return run


def _fine(k: int, percent: int, held=None):
    """(key, fp, root, band) of the first segments of the finer sketches, by what `held` says of common ones; of all without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_bands = bands(percent, 1 << 20)
        for s in slices(batches):
            out = []
            for fp, root, x in zip(s.batch.column("fp").to_pylist(), s.batch.column("root").to_pylist(), sets(s, k), strict=True):
                for band in _bands_of(len(x), all_bands, percent):
                    d = differing(percent, all_bands[band][1], all_bands[band][1])
                    m = FINE * (d + 1)
                    key = signed(_key(*_with_empty(*_cut(x, m, 0), m), band))
                    if held is not None:
                        common, n = held.value
                        at = np.minimum(np.searchsorted(common, key), len(common) - 1)
                        key = key[np.lexsort((key, np.where(common[at] == key, n[at], 0)))[: d + 1]]
                    out.append((key, np.full(len(key), fp), np.full(len(key), root), np.full(len(key), band, np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["key", "fp", "root", "band"])

    return run


def _sketches(k: int, percent: int):
    """(fp, band, size, sketch): parity sketches of at least eight bits for each difference that the band allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_bands = bands(percent, 1 << 20)
        for s in slices(batches):
            out = []
            for fp, x in zip(s.batch.column("fp").to_pylist(), sets(s, k), strict=True):
                for band in _bands_of(len(x), all_bands, percent):
                    d = differing(percent, all_bands[band][1], all_bands[band][1])
                    bits = 64 * max(8, 1 << (d // 8).bit_length())
                    odd = np.bincount((mix(x + np.uint64(78)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
                    out.append((fp, band, len(x), np.packbits(odd.astype(np.uint8)).view(np.int64)))
            if out:
                fp, band, n, sketch = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array(band, pa.int32()), pa.array(n, pa.int64()), pa.array(sketch, pa.list_(pa.int64()))], names=["fp", "band", "size", "sketch"])

    return run


def parity(x: np.ndarray) -> np.ndarray:
    """A sketch of 256 bits: each shingle flips one."""
    odd = np.bincount((mix(x + np.uint64(77)) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8))


def _verify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            got = []
            for side in ("a", "b"):
                of, texts, seen = batch.column(side).to_pylist(), batch.column(f"text_{side}"), {}
                for i, fp in enumerate(of):  # each text once a batch
                    seen.setdefault(fp, i)
                new = [fp for fp in seen if fp not in last]
                if new:
                    rows = batch.select([f"text_{side}"]).take(pa.array([seen[fp] for fp in new]))
                    found = (x for s in slices(iter([rows]), f"text_{side}") for x in sets(s, k))
                    last |= {fp: (x, parity(x)) for fp, x in zip(new, found, strict=True)}
                got.append(of)
            out_a, out_b = [], []
            for a, b in zip(*got, strict=True):
                (x, p), (y, q) = last[a], last[b]
                n, m = len(x), len(y)
                if 100 * min(n, m) < percent * max(n, m) or int(np.bitwise_count(p ^ q).sum()) > differing(percent, n, m):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= percent * (n + m - both):
                    out_a.append(a)
                    out_b.append(b)
            if sum(len(x) for x, _ in last.values()) > 1_000_000:
                last.clear()
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def classes(docs: DataFrame, scratch: Scratch, k: int = K, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(one row a document: META), and (fp, root) for the classes that link with others."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    meta = scratch.keep(rows.mapInArrow(_describe(k), META))
    every = rows.mapInArrow(_keys(k, percent), "key long, fp long")
    # the keys of more than one class, then their members and how many such keys each member has
    held = scratch.keep(every.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo < hi").select("key"))
    members = scratch.keep(every.join(held, "key").distinct())
    scratch.drop(held)
    known = members.join(members.groupBy("fp").agg(F.count("*").alias("n")), "fp")
    middle = scratch.keep(known.groupBy("key").agg(F.max(F.struct("n", "fp")).alias("m")).select("key", F.col("m.fp").alias("mid")))
    others = scratch.keep(members.join(middle, "key").filter("fp <> mid"))
    scratch.drop(members, middle)
    pairs = scratch.keep(others.select(F.least("mid", "fp").alias("a"), F.greatest("mid", "fp").alias("b")).distinct())
    links = _linked(rows, meta, pairs, scratch, k, percent)
    roots = scratch.keep(components(links, scratch).select(F.col("id").alias("fp"), "root"))
    # members of a key, but for the one all were compared with, that lie in more than one component
    rooted = others.join(roots, "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 < r2").select("key")
    left = scratch.keep(rooted.join(open_keys, "key").select("fp", "root").distinct())
    scratch.drop(others)
    if left.isEmpty():
        return meta, roots
    texts = scratch.keep(_texts(rows, _first(meta, left)).join(left, "fp"))
    fine = "key long, fp long, root long, band int"
    seen = texts.filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).mapInArrow(_fine(k, percent), fine).groupBy("key").agg(F.count("*").alias("n"))
    common = seen.filter("n > 1").orderBy(F.desc("n"), "key").limit(COMMON).toArrow().sort_by("key")
    # a last key that none is, so that there is one at all
    known = np.append(common.column("key").to_numpy(), np.iinfo(np.int64).max), np.append(common.column("n").to_numpy(), 0)
    rare = scratch.keep(texts.mapInArrow(_fine(k, percent, rows.sparkSession.sparkContext.broadcast(known)), fine))
    open_keys = rare.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 < r2").select("key")
    sketches = texts.mapInArrow(_sketches(k, percent), "fp long, band int, size long, sketch array<long>")
    every, rare = rare, scratch.keep(rare.join(open_keys, "key").join(sketches, ["fp", "band"]))
    scratch.drop(every)
    x, y = rare.alias("x"), rare.alias("y")
    # keys of one band have sketches of one length, so the Hamming bound is part of the join
    distance = F.aggregate(F.zip_with("x.sketch", "y.sketch", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    near = (F.col("x.fp") < F.col("y.fp")) & (F.col("x.root") != F.col("y.root")) & ((100 + percent) * distance <= (100 - percent) * (F.col("x.size") + F.col("y.size")))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    more = scratch.keep(met.join(pairs, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        new = _linked(rows, meta, more, scratch, k, percent)
        both = roots.select(F.col("fp").alias("a"), F.col("root").alias("b")).union(new)
        roots = scratch.keep(components(both, scratch).select(F.col("id").alias("fp"), "root"))
    return meta, roots


def _linked(rows: DataFrame, meta: DataFrame, pairs: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame:
    """Those of pairs(a, b) that link, by their shingles."""
    wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
    texts = scratch.keep(_texts(rows, _first(meta, wanted)))
    new = pairs.join(texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a")), "a")
    out = scratch.keep(new.select("a", "text_a", "b", "text_b").mapInArrow(_verify(k, percent), "a long, b long"))
    scratch.drop(texts)
    return out


def _first(meta: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, doc_id, text_hash) of one document of each class of wanted(fp)."""
    return meta.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("of")).select("fp", "of.*")


def _texts(rows: DataFrame, first: DataFrame) -> DataFrame:
    """(fp, text) of one document of each class named in first(fp, doc_id, text_hash)."""
    to = first.select("fp", F.col("doc_id").alias("of"), "text_hash")
    return rows.join(to, rows["doc_id"].eqNullSafe(to["of"]) & (rows["text_hash"] == to["text_hash"])).select("fp", "text").dropDuplicates(["fp"])


def link(docs: DataFrame, scratch: Scratch | None = None, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text)."""
    scratch = scratch or Scratch(docs.sparkSession)
    meta, roots = classes(docs, scratch, k, percent)
    full = meta.filter("n_shingles > 0").join(roots, "fp", "left").select("doc_id", "n_shingles", F.coalesce("root", "fp").alias("root"))
    least = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = full.join(least, "root").select("doc_id", "n_shingles", "component_id")
    return named.union(meta.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep(docs: DataFrame, scratch: Scratch | None = None, k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row of each component, of the least doc_id (null ones last) and text hash; texts without words all stay."""
    scratch = scratch or Scratch(docs.sparkSession)
    meta, roots = classes(docs, scratch, k, percent)
    full = meta.filter("n_shingles > 0").join(roots, "fp", "left").groupBy("doc_id", "text_hash", F.coalesce("root", "fp").alias("root")).agg(F.count("*").alias("n"))
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    marked = full.join(full.groupBy("root").agg(F.min(rank).alias("least")), "root").withColumn("gone", rank != F.col("least")).filter("gone or n > 1")
    marked = scratch.keep(marked.select(F.col("doc_id").alias("__of"), F.col("text_hash").alias("__text"), "gone"))
    same = docs["doc_id"].cast("long").eqNullSafe(marked["__of"]) & (F.xxhash64(docs["text"].cast("string")) == marked["__text"])
    left = docs.join(marked, same, "left_anti")
    twice = marked.filter("not gone")
    if twice.isEmpty():
        return left
    # rows that repeat their doc_id and text: one of each
    many, name = docs.join(twice, same, "left_semi"), "text_hash"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return left.unionByName(many.withColumn(name, F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", name]).drop(name))
