"""Operator 10, mixing sources to target weights by Poisson replication; DataFrame functions only.

A source's rate is its target number of documents over the number it has. Each document draws
its count from the Poisson distribution with that mean by inverting it at a uniform number that a
hash of seed, doc_id and text fixes: the draw needs no state, survives retries, and is the same
wherever the row lies. The document is exploded by its count and the copies are sorted by
a hash of seed, document and copy number, which is a global shuffle. Rates above `PIECE` are
drawn as sums of Poisson numbers, each with a hash of its own, so that exp(-rate) never underflows.

`weights` maps sources to weights; `DEFAULT` is the weight of any other. Weights are normalised over
the sources at hand, and `size` is the expected number of rows as a multiple of the input's. The
table of rates has a row a source and is broadcast only up to `BROADCAST_SOURCES` of them.

Defined results: a null source is a source of its own; a source of weight 0 vanishes; rows with equal
doc_id and text draw alike; null doc_id or text hash as empty strings; empty tables and all-zero
weights give no rows; further columns are carried along whatever their names (`copy_no` and `mix_key` are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kit import Scratch

DEFAULT = "*"
PIECE = 16.0
BROADCAST_SOURCES = 20_000
# Terms of the series: beyond it, at a rate of 16, lies less than 2**-52.
TERMS = 80


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) of 48 bits, from an MD5 of the parts."""
    key = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return (F.conv(F.substring(key, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def series(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ..., as far as a uniform number can reach, for rates up to PIECE."""
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["all"], F.array(s["c"] + p)).alias("all"))

    steps = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["all"])
    return F.filter(steps, lambda c: c < 1 - 2.0**-49)


def poisson(steps: Column, u: Column) -> Column:
    """The least k with P(X <= k) >= u."""
    return F.size(F.filter(steps, lambda c: c < u))


def counts(pieces: Column, steps: Column, seed: int, *identity: Column) -> Column:
    """How often each row comes: a draw, or the sum of several for a rate above PIECE."""
    draw = lambda i: poisson(steps, uniform(F.lit(f"draw{seed}"), i, *identity))
    many = F.aggregate(F.transform(F.sequence(F.lit(1), pieces), draw), F.lit(0), lambda a, b: a + b)
    return F.when(pieces == 0, 0).when(pieces == 1, draw(F.lit(1))).otherwise(many)


def rates(docs: DataFrame, weights: dict[str, float], size: float) -> DataFrame:
    """(source, rate), a row a source; the counts are summed before their shuffle."""
    listed = F.lit(float(weights.get(DEFAULT, 1.0)))
    for name, w in weights.items():
        if name != DEFAULT:
            listed = F.when(F.col("source") == name, F.lit(float(w))).otherwise(listed)
    by = docs.select("source").groupBy("source").agg(F.count("*").alias("n")).withColumn("w", listed)
    total = by.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    return by.crossJoin(F.broadcast(total)).select("source", F.when(F.col("all_w") > 0, F.lit(float(size)) * F.col("all_n") * F.col("w") / F.col("all_w") / F.col("n")).otherwise(0.0).alias("rate"))


def _unused(name: str, columns: list[str]) -> str:
    """A column name that the table does not have, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(docs: DataFrame, weights: dict[str, float], size: float = 1.0, seed: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs(doc_id, text, source, ...), each as often as drawn, in a random global order.

    Adds copy_no (from 1) and mix_key, by which the rows are sorted. The rates are written once, so the documents are read twice.
    """
    spark = docs.sparkSession
    docs = docs.drop("copy_no", "mix_key")
    of, pieces, steps, hashed, n = (_unused(x, docs.columns) for x in ("mix_of", "mix_pieces", "mix_steps", "mix_text", "mix_n"))
    by = (scratch or Scratch(spark)).keep(rates(docs, weights, size))
    whole = F.when(F.col("rate") > 0, F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE))).otherwise(0).cast("int")
    side = by.select(F.col("source").alias(of), whole.alias(pieces), series(F.when(whole > 0, F.col("rate") / whole).otherwise(0.0)).alias(steps))
    small = by.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    texts = docs.withColumn(hashed, F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    named = texts.join(F.broadcast(side) if small else side, F.col("source").eqNullSafe(F.col(of))).drop(of)
    drawn = named.withColumn(n, counts(F.col(pieces), F.col(steps), seed, F.col("doc_id"), F.col(hashed))).filter(F.col(n) > 0).drop(pieces, steps)
    copies = drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col(n)))).drop(n)
    key = F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col(hashed), F.col("copy_no")))
    keyed = copies.withColumn("mix_key", key).drop(hashed)
    # keys are spread evenly, so ranges of equal width are balanced without sampling the rows
    ways = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("double") * ways / float(1 << 32)).cast("int")
    return keyed.repartitionById(ways, place).sortWithinPartitions("mix_key")
