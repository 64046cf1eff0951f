"""Protected spans of a text as arrays: found, thinned, turned into tokens and back, checked; all in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import token
from ..functions.text import occurrences, placeholders


def spans(units: DataFrame, text: str = "source") -> DataFrame:
    """A row for each placeholder of a unit: its number from 0, value and token."""
    values = units.select("doc_id", "ordinal", F.posexplode(placeholders(F.col(text))).alias("i", "value"))
    return values.withColumn("token", token("WEFT", F.lit("PLACEHOLDER"), F.col("i"), F.col("value")))


def normalize(spans_: DataFrame, key: list[str]) -> DataFrame:
    """spans(key, start, end, nth): contained ones dropped; `crossing` marks one that runs over an earlier one's end."""
    before = Window.partitionBy(*key).orderBy("start", F.desc("end"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end").over(before)
    out = spans_.withColumn("reach", reach)
    return out.filter(F.col("reach").isNull() | (F.col("end") > F.col("reach"))).withColumn("crossing", F.coalesce(F.col("start") < F.col("reach"), F.lit(False))).drop("reach")


def tokens_of(text: Column, namespace: str = "WEFT") -> Column:
    """(token, value) for each placeholder of a text."""
    values = placeholders(text)
    return F.transform(values, lambda v, i: F.struct(token(namespace, F.lit("PLACEHOLDER"), i, v).alias("token"), v.alias("value")))


def tokenize(text: Column, tokens: Column) -> Column:
    """The text with each value, in order, replaced by its token: all before a value is passed over once replaced."""
    start = F.struct(F.lit("").alias("done"), text.alias("rest"))

    def step(acc: Column, t: Column) -> Column:
        at = F.instr(acc["rest"], t["value"])
        return F.struct(
            F.concat(acc["done"], F.substr(acc["rest"], F.lit(1), at - 1), t["token"]).alias("done"),
            F.substr(acc["rest"], at + F.char_length(t["value"])).alias("rest"),
        )

    return F.aggregate(tokens, start, step, lambda acc: F.concat(acc["done"], acc["rest"]))


def restore(text: Column, tokens: Column) -> Column:
    return F.aggregate(tokens, text, lambda acc, t: F.replace(acc, t["token"], t["value"]))


def findings(target: Column, tokens: Column, namespace: str = "WEFT") -> Column:
    """Codes for tokens that do not come exactly once, then for tokens that are not the unit's own."""
    wrong = F.transform(F.filter(tokens, lambda t: occurrences(target, t["token"]) != 1), lambda t: F.lit("MD-PROTECTED"))
    known = F.transform(tokens, lambda t: t["token"])
    seen = F.regexp_extract_all(target, F.lit(rf"@@{namespace}_[^@\r\n]*@@"), F.lit(0))
    unknown = F.transform(F.filter(seen, lambda t: ~F.array_contains(known, t)), lambda t: F.lit("MD-UNKNOWN-TOKEN"))
    return F.concat(wrong, unknown)


def same_code(source: Column, target: Column) -> Column:
    """Whether both texts have the same inline code, as multisets."""
    code = lambda x: F.array_sort(F.regexp_extract_all(x, F.lit("`[^`]+`"), F.lit(0)))
    return code(source) == code(target)


def unit_findings(source: Column, target: Column, tokens: Column) -> Column:
    """All codes of a unit: faults of tokens alone if there are any, else those of the restored text."""
    first = findings(target, tokens)
    then = F.when(~same_code(source, restore(target, tokens)), F.array(F.lit("MD-PROTECTED-CODE"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(first) > 0, first).otherwise(then)


def repaired(source: Column, target: Column) -> Column:
    """A blank after a leading strong run where the source has one and the target none."""
    fits = source.rlike(r"^\*\*[^*\n]+\*\*[ \t]") & target.rlike(r"^\*\*[^*\n]+\*\*\S")
    return F.when(fits, F.regexp_replace(target, r"^(\*\*[^*\n]+\*\*)", "$1 ")).otherwise(target)


def same_multiset(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values equally often."""
    return F.array_sort(a) == F.array_sort(b)
