"""State tables that streams of requests keep up to date, through `foreachBatch` and Spark's own Parquet writer.

A transaction (`operators.transactions`) is applied to each micro-batch and the tables as they were before it. What it stages is written to partition n of
each table it writes, in place of whatever a broken-off attempt left there; the rows of n in `batches`, written last and in one file, make it count. They name
the stream and its batch, so a batch that Spark runs again after a restart, though it counted, is left alone: its requests take effect once. Readers take the
partitions that `batches` names for their table, so they see all tables of a batch or none.

A stream goes by its checkpoint's location, which Spark lets one query use at a time; several streams, or batch jobs that call `write`, take turns: one
folder has one writer at a time. Refused requests are kept as JSON in the table `refused`. An empty batch counts and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import state
from ..operators.transactions import Staged

BATCHES = "n long, source string, batch string, table string"
REFUSED = "request string, refusal string"
Rows = Staged | dict[str, DataFrame]


@dataclass
class Tables:
    spark: SparkSession
    path: str
    schemas: dict[str, str]
    keys: dict[str, list[str]]

    def __post_init__(self):
        self.schemas = self.schemas | {"refused": REFUSED}

    def create(self) -> Tables:
        """Writes empty tables where there are none yet."""
        self._frame(BATCHES).write.mode("ignore").parquet(f"{self.path}/batches/n=0")
        for name, schema in self.schemas.items():
            self._frame(schema).write.mode("ignore").parquet(f"{self.path}/{name}/n=0")
        return self

    def _frame(self, schema: str) -> DataFrame:
        names = [f.split()[0] for f in schema.split(", ") if f != "n long"]
        return self.spark.createDataFrame([], schema).select(*names).coalesce(1)

    def batches(self) -> DataFrame:
        return self.spark.read.schema(BATCHES).parquet(f"{self.path}/batches")

    def counted(self) -> dict[str, list[int]]:
        """By table the partitions that count: a few numbers a batch, as many as there are folders to list; Spark prunes by them."""
        return {r.table: r.ns for r in self.batches().filter("table is not null").groupBy("table").agg(F.collect_set("n").alias("ns")).collect()}

    def versions(self, name: str, upto: int | None = None, counted: dict[str, list[int]] | None = None) -> DataFrame:
        """All rows that count, with n, the number of their batch."""
        ns = (self.counted() if counted is None else counted).get(name, [])
        rows = self.spark.read.schema(f"{self.schemas[name]}, n long").parquet(f"{self.path}/{name}")
        return rows.filter(F.col("n").isin([n for n in ns if upto is None or n <= upto]))

    def current(self, name: str, upto: int | None = None, counted: dict[str, list[int]] | None = None) -> DataFrame:
        """The newest row of each key, as of now or of an earlier batch."""
        rows = self.versions(name, upto, counted)
        return state.latest(rows, self.keys[name], ["n"]).select(*[c for c in rows.columns if c != "n"])

    def tables(self, upto: int | None = None) -> dict[str, DataFrame]:
        counted = self.counted()
        return {name: self.current(name, upto, counted) for name in self.schemas if name in self.keys}

    def write(self, batch: str, staged: Rows | Callable[[dict[str, DataFrame]], Rows], source: str = "") -> bool:
        """Writes what is staged, or what a function of the tables stages; False if this batch of the source counts already."""
        done = self.batches().agg(F.coalesce(F.max("n"), F.lit(0)).alias("last"), F.max((F.col("source") == source) & (F.col("batch") == batch)).alias("seen")).first()
        if done.seen:
            return False
        n = done.last + 1
        staged = staged(self.tables()) if callable(staged) else staged
        rows = dict(staged.rows if isinstance(staged, Staged) else staged)
        if isinstance(staged, Staged) and staged.refused is not None:
            told = F.to_json(F.struct(*[c for c in staged.refused.columns if c != "refusal"]))
            rows["refused"] = staged.refused.select(told.alias("request"), "refusal")
        if unknown := set(rows) - set(self.schemas):
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        for name, df in rows.items():
            fields = [f.split() for f in self.schemas[name].split(", ")]
            df.select(*[F.col(c).cast(kind) for c, kind in fields]).write.mode("overwrite").parquet(f"{self.path}/{name}/n={n}")
        told = [(source, batch, name) for name in sorted(rows)] or [(source, batch, None)]
        self.spark.createDataFrame(told, "source string, batch string, table string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batches/n={n}")
        return True

    def follow(self, requests: DataFrame, transaction: Callable[[dict[str, DataFrame], DataFrame], Rows], checkpoint: str, **trigger) -> StreamingQuery:
        """Starts a query that applies the transaction to each micro-batch; by default to all that is there, and then ends."""

        def apply(batch: DataFrame, batch_id: int) -> None:
            here = replace(self, spark=batch.sparkSession)
            batch = batch.persist()  # read by each table's job
            try:
                here.write(str(batch_id), lambda tables: transaction(tables, batch), checkpoint)
            finally:
                batch.unpersist()

        return requests.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def copy(self, path: str) -> Tables:
        """The current tables as the first batch of another folder, which ends what their history costs to read."""
        other = replace(self, path=path).create()
        if not other.batches().isEmpty():
            raise ValueError("a copy goes to a folder without batches")
        other.write("copy", self.tables() | {"refused": self.versions("refused").drop("n")}, self.path)
        return other
