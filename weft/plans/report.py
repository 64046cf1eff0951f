"""Run reports: totals, JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .planner import worst


def totals(outcomes: DataFrame) -> DataFrame:
    """One row over outcomes(language, status, calls, attempts, failures, documents)."""
    return outcomes.agg(
        worst(F.col("status")).alias("status"), F.count("*").alias("languages"), F.sum("documents").alias("documents"), F.sum("calls").alias("calls"),
        F.sum("attempts").alias("attempts"), F.greatest(F.sum("attempts") - F.sum("calls"), F.lit(0)).alias("retries"), F.sum("failures").alias("failures"),
    )


def as_json(outcomes: DataFrame) -> DataFrame:
    """The report as one JSON text, languages in order; a row a language, so the list is small."""
    rows = F.array_sort(F.collect_list(F.struct("language", "status", "documents", "calls", "attempts", "failures")))
    return outcomes.agg(rows.alias("languages"), worst(F.col("status")).alias("status")).select(F.to_json(F.struct(F.lit(4).alias("schema"), "status", "languages")).alias("report"))


def as_markdown(outcomes: DataFrame) -> DataFrame:
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "language", "status", *[F.col(c).cast("string") for c in ("documents", "calls", "failures")]), F.lit(" |"))
    head = "# Report\n\n| language | status | documents | calls | failures |\n| - | - | - | - | - |\n"
    return outcomes.agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("report"))
