"""Connected components by large-star and small-star steps, each one shuffle, until labels rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) for each id of edges(a, b): root is the least id that it reaches.

    Rounds grow with the logarithm of the longest path. A hub's edges are never gathered: both
    steps are a minimum by key, combined before its shuffle, and a join whose hot keys adaptive
    execution splits. Null ends and loops are left out; no edges give no rows.
    """
    now = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    mark = print_of(now)
    while mark[0]:
        after = scratch.keep(_small_star(_large_star(now)))
        scratch.drop(now)
        now, was = after, mark
        mark = print_of(now)
        if mark == was:
            break
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
