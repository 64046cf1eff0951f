"""Operator 7, URL filters: rules by host and path, then a Bloom filter cascade for listed hosts.

A cascade holds a set exactly within a known universe of keys. Its first Bloom filter is made of
the listed keys; the next one of those keys of the universe that the first passes by mistake; the
third of the listed keys that the second passes; and so on until no mistake is left. A key's
answer is that of the level at which it is first turned away. The universe here is every host of
the table, so no host is judged wrongly and no join is needed.

The universe is cut by hash into shards of some `SHARD_KEYS` keys, each with a cascade of its own
that one task builds, so any number of keys takes bounded memory. The cascades are broadcast in blocks of
`BLOCK_BYTES`, as a rule one; each further block is another pass over the keys' hashes.

Defined results: a null url or one without `://` has an empty host and path; no rule fits it, and
it is judged like any host; repeated rows judge alike; a host that the universe has several times is listed if any of
its rows says so; a host that it does not have is judged by chance, so it should have all; an empty table gives no rows and an
empty listing allows all; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kit import BASE, Scratch, mix

SHARD_KEYS = 1 << 17
BLOCK_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as a string, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _hash(a: np.ndarray, b: np.ndarray, level: int, i: int) -> np.ndarray:
    return mix(a + (b | np.uint64(1)) * np.uint64(i + 1) + np.uint64(level) * BASE)


def _passes(bits: np.ndarray, k: int, a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    out = np.ones(len(a), bool)
    for i in range(k):
        at = _hash(a, b, level, i) % np.uint64(8 * len(bits))
        out &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def cascade(a: np.ndarray, b: np.ndarray, listed: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(hash functions, bits) of each level for keys with hashes a and b."""
    inside, outside, out = np.flatnonzero(listed), np.flatnonzero(~listed), []
    while len(inside):
        rate = min(0.5, max(2**-10, 0.7 * len(inside) / max(1, len(outside)))) if not out else 0.5
        k = max(1, round(-np.log2(rate)))
        bits = np.zeros(max(1, int(np.ceil(len(inside) * k / np.log(2) / 8))), np.uint8)
        for i in range(k):
            at = _hash(a[inside], b[inside], len(out), i) % np.uint64(8 * len(bits))
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        mistaken = outside[_passes(bits, k, a[outside], b[outside], len(out))]
        out.append((k, bits))
        if len(out) > 200:
            raise ValueError("two keys, one of them listed, have equal hashes")
        inside, outside = mistaken, inside
    return out


def member(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each key of the universe is listed."""
    out, open_ = np.zeros(len(a), bool), np.arange(len(a))
    for level, (k, bits) in enumerate(levels):
        passed = _passes(bits, k, a[open_], b[open_], level)
        out[open_[~passed]] = level % 2 == 1
        open_ = open_[passed]
    out[open_] = len(levels) % 2 == 1
    return out


def _build(key: tuple, t: pa.Table) -> pa.Table:
    levels = cascade(t.column("a").to_numpy().view(np.uint64), t.column("b").to_numpy().view(np.uint64), t.column("listed").to_numpy(zero_copy_only=False))
    return pa.table({"shard": [key[0].as_py()] * len(levels), "level": range(len(levels)), "k": [k for k, _ in levels], "bits": [b.tobytes() for _, b in levels]}, pa.schema([("shard", pa.int32()), ("level", pa.int32()), ("k", pa.int32()), ("bits", pa.binary())]))


def _probe(held, schema: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            shard, listed = t.column("shard").to_numpy(), t.column("listed").to_numpy(zero_copy_only=False).copy()
            a, b = (t.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
            for s in np.unique(shard):
                if s in held.value:
                    mine = shard == s
                    listed[mine] = member(held.value[s], a[mine], b[mine])
            columns = dict(zip(t.schema.names, t.columns, strict=True)) | {"listed": pa.array(listed)}
            yield pa.RecordBatch.from_arrays([columns[c] for c in schema], names=schema)

    return run


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.concat(F.lit("~"), key))


def insecure(pages: DataFrame) -> DataFrame:
    """(host, listed) for every host: listed are those without a page that is served over https."""
    host, _ = parts(F.col("url"))
    return pages.select(host.alias("host"), F.coalesce(F.col("url").startswith("https:"), F.lit(False)).alias("safe")).groupBy("host").agg((~F.max("safe")).alias("listed"))


def judge(pages: DataFrame, universe: DataFrame, rules: list[tuple[str, str, str]] = RULES, scratch: Scratch | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages(page_id, url), by universe(host, listed)."""
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark)
    a, b = hashes(F.col("host"))
    known = scratch.keep(universe.groupBy(a.alias("a"), b.alias("b")).agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed")))
    n = max(1, -(-known.count() // SHARD_KEYS))
    shard = F.pmod("a", F.lit(n)).cast("int")
    built = scratch.keep(known.withColumn("shard", shard).groupBy("shard").applyInArrow(_build, "shard int, level int, k int, bits binary"))
    total = built.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0]
    host, path = parts(F.col("url"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"), a.alias("a"), b.alias("b"), F.lit(False).alias("listed")).withColumn("shard", shard)
    blocks = max(1, -(-total // BLOCK_BYTES))
    for i in range(blocks):
        levels: dict[int, list[tuple[int, np.ndarray]]] = {}
        for r in built.filter(F.col("shard") % blocks == i).orderBy("shard", "level").toLocalIterator():
            levels.setdefault(r["shard"], []).append((r["k"], np.frombuffer(r["bits"], np.uint8)))
        rows = rows.mapInArrow(_probe(spark.sparkContext.broadcast(levels), rows.columns), rows.schema)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
