"""Operator 4, token counts: rollups by source, language and tokenizer version, kept up by deltas.

A batch holds changes to documents: inserts, deletes and revised counts, each with the counts
before and after. It is summed to one signed row for each (source, lang, tokenizer_version) before
anything is shuffled or stored, and committed as one folder named after its batch id: the sums
are written beside it and renamed into place, so a batch that a retry or a second
writer brings again is found and left alone; finding it is one listing of folders. Renaming is atomic on HDFS and local disks; on
an object store, where it is not, let one writer commit. Totals are sums over the committed folders, read as one table; nothing is
ever updated in place. `compact` folds them into one commit, whose `batches` names those it replaces.

Defined results: null sources and languages are groups of their own; a null text has no tokens; a
change without counts before (insert) or after (delete) adds or takes one document; groups whose
documents are all gone vanish from the totals; empty batches commit nothing but their id.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ["source", "lang", "tokenizer_version"]
DELTA = "source string, lang string, tokenizer_version string, d_docs long, d_tokens long, n_inserts long, n_deletes long, n_revisions long"
ONE, ALL = "commit-", "compact-"
SPACES = "[ \\t\\n\\x0B\\f\\r]+"


def words(text: Column) -> Column:
    """Tokens of version words-1: runs of anything but the six ASCII spaces."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")).cast("long")


def pieces(text: Column) -> Column:
    """Tokens of version words-2: runs of letters and digits, and single other characters that are no spaces."""
    marks = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[A-Za-z0-9\\u0080-\\x{10FFFF} \\t\\n\\x0B\\f\\r]", ""))
    runs = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9\\u0080-\\x{10FFFF}]+"), lambda w: w != ""))
    return (marks + runs).cast("long")


class Rollup:
    """Token totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.jvm = spark.sparkContext._jvm
        self.fs = self._p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def committed(self) -> dict[str, list[str]]:
        """Each commit's folder and the batches it stands for, without commits that another has replaced."""
        names = [f.getPath().getName() for f in self.fs.listStatus(self._p(self.path))] if self.fs.exists(self._p(self.path)) else []
        out = {n: [unquote(n[len(ONE) :])] for n in names if n.startswith(ONE)}
        for n in names:  # compacted ones are few
            if n.startswith(ALL):
                out[n] = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/{n}/batches").collect()))
        return {n: b for n, b in out.items() if not any(m != n and set(b) < set(c) for m, c in out.items())}

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commits changes(source, lang, tokenizer_version, before, after); False if the batch was there already."""
        if any(batch_id in b for b in self.committed().values()):
            return False
        one = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
        new, old = F.col("before").isNull(), F.col("after").isNull()
        sums = changes.filter(~(new & old)).groupBy(*GROUP).agg(
            F.sum(F.when(new, 1).when(old, -1).otherwise(0)).alias("d_docs"),
            F.sum(F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("d_tokens"),
            one(new)("n_inserts"), one(old)("n_deletes"), one(~new & ~old)("n_revisions"),
        )
        return self._commit(ONE + quote(batch_id, safe=""), sums)

    def _commit(self, name: str, sums: DataFrame, batches: list[str] | None = None) -> bool:
        draft = f"{self.path}/draft-{name}-{self.jvm.java.util.UUID.randomUUID().toString()}"
        sums.write.parquet(f"{draft}/sums")
        if batches is not None:
            self.spark.createDataFrame([(json.dumps(batches),)], "value string").coalesce(1).write.text(f"{draft}/batches")
        # whoever renames first has committed; a folder that is there already makes this one fail or nest, which is undone
        target = self._p(f"{self.path}/{name}")
        done = not self.fs.exists(target) and self.fs.rename(self._p(draft), target)
        for stray in (self._p(draft), self._p(f"{self.path}/{name}/{draft.rsplit('/', 1)[1]}")):
            if self.fs.exists(stray):
                self.fs.delete(stray, True)
                done = False
        return bool(done)

    def deltas(self) -> DataFrame:
        folders = [f"{self.path}/{name}/sums" for name in self.committed()]
        return self.spark.read.schema(DELTA).parquet(*folders) if folders else self.spark.createDataFrame([], DELTA)

    def _sums(self) -> DataFrame:
        return self.deltas().groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in ("d_docs", "d_tokens", "n_inserts", "n_deletes", "n_revisions")])

    def compact(self) -> None:
        """One commit in place of all; the old folders are removed once it stands."""
        old = self.committed()
        batches = sorted({b for x in old.values() for b in x})
        if len(old) > 1 and self._commit(f"{ALL}{uuid.uuid4().hex}", self._sums(), batches):
            for name in old:
                self.fs.delete(self._p(f"{self.path}/{name}"), True)

    def totals(self) -> DataFrame:
        return self._sums().filter("d_docs <> 0").select(*GROUP, F.col("d_docs").alias("n_docs"), F.col("d_tokens").alias("n_tokens"), "n_inserts", "n_deletes", "n_revisions")


def changes(docs: DataFrame, version: str, before: Column | None, after: Column | None) -> DataFrame:
    none = F.lit(None).cast("long")
    return docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("tokenizer_version"), (none if before is None else before).alias("before"), (none if after is None else after).alias("after"))
