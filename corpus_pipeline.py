"""A corpus pipeline: each stage works on all that the one before it kept.

quality: documents that the quality rules reject go. near_duplicates: one document of each group of
linked ones stays, the one of the least doc_id; shingles are of five words and link from a similarity of 0.8
(op5 has a contract of its own, four words and 0.85). decontamination: documents into which a benchmark
item leaks go. secrets: secrets are replaced by the names of their kinds. mixing: documents are
replicated to the sources' target weights and shuffled.

Defined results, of every stage: an empty table gives an empty one; further columns are carried along whatever their names; all
but the last return the columns of their input. quality: a null or empty text goes, repeated rows go or stay alike, a null
language is one of its own. near_duplicates: texts without words, null ones included, all stay; of equal rows one stays, and of
linked ones that of the least doc_id (null ones last) and text hash. decontamination: null texts and empty ones stay, equal rows go or stay
alike. secrets: no row goes; a text without a secret keeps its bytes, a null one stays null, n_chars follows a text that changes and is else
left alone, a null source counts as an empty path. mixing: a null source is one of its own, rows of equal doc_id and text draw alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import decontaminate, mixing, ngram_join, quality_rules, registry, secret_scan
from weft.llm.kit import Scratch

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep(docs, Scratch(spark), k=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, registry.WEIGHTS, registry.MIX_SIZE, registry.MIX_SEED)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mix)]

# Perplexity, tiling and the forest have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again as the next one's input."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
