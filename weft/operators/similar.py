"""An exact edit-distance join of the units of a document with those of the revision before.

A pair counts if its score, of text and place, reaches the floor. The farther two units stand apart, the more alike their texts must be, so pairs are met in
two ways. Within `NEARBY` places they are met by place: ranges of ordinals are joined. Beyond, a text of n characters may differ from a
longer one by d(n) edits at most; of any d(n) + 1 pieces of it that do not overlap, one stands unchanged in the longer text, at most d(n) places off. The rarest
pieces of each text are joined with all runs of as many characters of the longer text, by band of lengths and block of places (where a document has few texts of a
length, these meet as they are). Both ways lose no pair; what
they let through is settled by the edit distance (`functions/edits.py`), worked out only as far as the floor allows. No key is a document, so a
long document is joined by many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import edits
from ..functions.text import FUZZY_FLOOR, PLACE_WEIGHT, TEXT_WEIGHT, fuzzy_score
from . import state

NEARBY = 8
# Of so few texts each may meet all others of its scope and length.
FEW = 64
# Keys of rows to pick that are broadcast at most; and pairs whose texts one task reads.
BROADCAST, PAIRS_A_TASK = 1 << 18, 1 << 17
# Edits a character of the longer text, beyond NEARBY.
EDITS = 1 - (FUZZY_FLOOR - PLACE_WEIGHT / (2 + NEARBY)) / TEXT_WEIGHT
# Lengths from which pieces have so many characters at least.
PIECE_CHARS = ((23, 4), (8, 3), (5, 2), (0, 1))


def most_edits(n: int) -> int:
    """Edits between a text of n characters and any that is as long or longer, beyond NEARBY."""
    return math.floor(EDITS * math.floor(n / (1 - EDITS) + 1e-9) + 1e-9)


def _most_edits(n: Column) -> Column:
    return F.floor(EDITS * F.floor(n / (1 - EDITS) + 1e-9) + 1e-9).cast("int")


def _chars(n: Column) -> Column:
    out = F.lit(PIECE_CHARS[-1][1])
    for least, q in reversed(PIECE_CHARS[:-1]):
        out = F.when(n >= least, q).otherwise(out)
    return out


def _band(n: Column) -> Column:
    """Doublings of length; a block of places is half as wide as the band's least length."""
    return F.char_length(F.bin(F.greatest(n, F.lit(1)).cast("long"))) - 1


_width = lambda band: F.greatest(F.lit(1), F.shiftright(F.pow(F.lit(2), band).cast("int"), 1))


def _key(band: Column, q: Column, block: Column, at: Column) -> Column:
    return F.xxhash64("_part", band, q, block, F.array_join(F.slice("chars", at + 1, q), ""))


def _pieces(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, key): pieces of a text as the shorter one, in each block where they can stand in the longer one.

    A text has more pieces than edits can reach, so any d + 1 of them will do: the rarest among the runs are taken, and what all lines
    begin with is left out.
    """
    n, d, q, band = F.col("n"), _most_edits(F.col("n")), _chars(F.col("n")), _band(F.col("n"))
    wide = rows.withColumns({"d": d, "q": q, "band": band}).withColumn("width", _width(F.col("band")))
    each = wide.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(n / F.col("q")).cast("int") - 1)))).withColumn("at", F.col("i") * F.col("q"))
    block = F.explode(F.sequence(F.floor((F.col("at") - F.col("d")) / F.col("width")), F.floor((F.col("at") + F.col("d")) / F.col("width"))))
    keys = each.withColumn("block", block).select("id", "i", "d", _key(F.col("band"), F.col("q"), F.col("block"), F.col("at")).alias("key"))
    counted = keys.join(runs.groupBy("key").agg(F.count("*").alias("n")), "key", "left").groupBy("id", "i", "d").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.collect_set("key").alias("keys"))
    rarest = F.row_number().over(Window.partitionBy("id").orderBy("n", "i"))
    return counted.withColumn("rank", rarest).filter("rank <= d + 1 and n > 0").select("id", F.explode("keys").alias("key"))


def _runs(rows: DataFrame) -> DataFrame:
    """(id, key): each run of characters of a text as the longer one, for all bands of the shorter texts that it can be near to."""
    least = F.ceil((1 - EDITS) * F.col("n") - 1e-9).cast("int")
    bands = F.sequence(_band(least), _band(F.col("n")))
    wide = rows.withColumn("band", F.explode(bands)).withColumn("q", F.explode(F.sequence(_chars(least), _chars(F.col("n"))))).withColumn("width", _width(F.col("band")))
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - F.col("q"))), lambda at: _key(F.col("band"), F.col("q"), F.floor(at / F.col("width")), at))
    return wide.select("id", F.explode(F.array_distinct(each)).alias("key"))


def _cells(n: Column) -> Column:
    """Bands of length so narrow that a longer text is of the shorter one's or the next."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / (1.0001 * math.log(1 / (1 - EDITS)))).cast("int")


def _met(both: DataFrame) -> DataFrame:
    """(c, p, most): pairs of c, n, ordinal, p, p_n and p_ordinal whose lengths and places allow the floor, with the edits that it allows."""
    least = (FUZZY_FLOOR - PLACE_WEIGHT / (1.0 + F.abs(F.col("ordinal") - F.col("p_ordinal")))) / TEXT_WEIGHT
    most = F.floor((1 - least) * F.greatest("n", "p_n") + 1e-9).cast("int")
    return both.withColumn("most", most).filter(F.abs(F.col("n") - F.col("p_n")) <= F.col("most")).select("c", "p", "most")


def _of(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose key is among distinct ones, which are broadcast if they are few, so that no text is shuffled to be picked."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST else keys, by, "left_semi")


def _far(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(c, p, most): all pairs farther apart than NEARBY that can be similar, and of some others.

    Texts of one scope and of bands of lengths next to each other meet if there are FEW of either; where many meet many, shorter and longer ones meet by pieces.
    """
    light = lambda df, cell: df.select("_part", "id", "n", "ordinal", cell.alias("cell"))
    now, old = light(current, F.explode(F.sequence(_cells(F.col("n")) - 1, _cells(F.col("n")) + 1))), light(previous, _cells(F.col("n")))
    count = lambda df, name: df.groupBy("_part", "cell").agg(F.count("*").alias(name))
    both = state.cut(count(now, "nc").join(count(old, "np"), ["_part", "cell"]).select("_part", "cell", (F.least("nc", "np") <= FEW).alias("few")))
    few, many = both.filter("few").drop("few"), both.filter("not few").drop("few")
    then = lambda df: df.withColumnRenamed("id", "p").withColumnRenamed("n", "p_n").withColumnRenamed("ordinal", "p_ordinal")
    here = now.withColumnRenamed("id", "c").join(few, ["_part", "cell"]).join(then(old), ["_part", "cell"])
    out = _met(here.filter(F.abs(F.col("ordinal") - F.col("p_ordinal")) > NEARBY))
    if many.isEmpty():
        return out
    ids = lambda df: state.cut(_of(df, many, ["_part", "cell"]).select("id").distinct())
    cut = lambda df, light: _of(df, ids(light), ["id"]).distinct().withColumn("chars", F.split("norm", ""))
    now, old = state.cut(cut(current, now)), state.cut(cut(previous, old))
    split = None
    for shorter, longer in ((now, old), (old, now)):
        runs = state.cut(_runs(longer))
        met = _pieces(shorter, runs).withColumnRenamed("id", "s").join(runs.withColumnRenamed("id", "t"), "key").select("s", "t")
        met = (met if shorter is now else met.select("t", "s")).toDF("c", "p").distinct()
        split = met if split is None else split.union(met)
    named = lambda df: df.select("id", "n", "ordinal")
    return out.union(_met(split.join(named(now).withColumnRenamed("id", "c"), "c").join(then(named(old)), "p")))


def pairs(previous: DataFrame, current: DataFrame, scope: list[str], carry: list[str], p_carry: list[str]) -> DataFrame:
    """All pairs of one scope whose score reaches the floor: scope, the columns to carry of each side (those of previous under p_ names), score.

    Both tables have ordinal and norm. Rows of a null scope column pair with none. Repeated rows make repeated pairs. The tables are written
    while the plan is made, as they are read several times; pairs are met by ids, and texts go to them once, on either side.
    """
    known = F.lit(True)
    for k in scope:
        known = known & F.col(k).isNotNull()
    side = lambda df: df.filter(known).withColumn("_part", F.xxhash64(*scope)).withColumn("id", F.xxhash64("_part", "ordinal", "norm")).withColumn("n", F.char_length("norm"))
    a = state.keep(side(current.select(*dict.fromkeys([*scope, "ordinal", "norm", *carry]))))
    b = side(previous.select(*dict.fromkeys([*scope, "ordinal", "norm", *p_carry])))
    parts = state.cut(a.select("_part").distinct())
    b = state.keep(_of(b, parts, ["_part"]) if parts.count() <= BROADCAST else b)
    block = lambda c: F.floor(c / (2 * NEARBY)).cast("long")
    then = b.select("_part", F.col("id").alias("p"), F.col("n").alias("p_n"), F.col("ordinal").alias("p_ordinal"), block(F.col("ordinal")).alias("block"))
    here = a.select("_part", F.col("id").alias("c"), "n", "ordinal", F.explode(F.sequence(block(F.col("ordinal") - NEARBY), block(F.col("ordinal") + NEARBY))).alias("block"))
    near = _met(here.join(then, ["_part", "block"]).filter(F.abs(F.col("ordinal") - F.col("p_ordinal")) <= NEARBY))
    texts = lambda df: df.select("id", "_part", "ordinal", "norm", "n")
    met = state.cut(near.union(_far(texts(b), texts(a))).distinct())
    # dealt out evenly, whatever the scan's or a broadcast's partitions; the number is stated, as few bytes can be much work
    ways = max(int(current.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-met.count() // PAIRS_A_TASK))
    named = b.select(*[F.col(c).alias(f"p_{c}") for c in b.columns])
    same = F.lit(True)
    for k in scope:
        same = same & (F.col(k) == F.col(f"p_{k}"))
    whole = met.repartition(ways, "c").join(a, F.col("c") == F.col("id")).repartition(ways, "p").join(named, F.col("p") == F.col("p_id")).filter(same)
    # exploded, it is worked out once and not again for each filter
    close = whole.withColumn("distance", F.explode(F.array(F.arrow_udf(edits.within, "int")("p_norm", "norm", "most")))).filter("distance >= 0")
    scored = close.withColumn("score", fuzzy_score(F.col("p_norm"), F.col("norm"), F.col("p_ordinal") - F.col("ordinal"), F.col("distance"))).filter(F.col("score") >= FUZZY_FLOOR)
    return scored.select(*dict.fromkeys([*scope, *carry]), *[f"p_{c}" for c in p_carry if c not in scope], "score")
