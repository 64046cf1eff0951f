"""State tables without updates in place: versions are appended, and what holds now is a top-1 by key."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# How far a publication has come, for the strongest state and for moves that only go forward.
STRENGTH = {"merged": 5, "pr_open": 4, "push_pending": 3, "commit_created": 2}
PROGRESS = {"prepared": 0, "commit_created": 1, "push_pending": 2, "pr_open": 3, "merged": 4, "superseded": 4}


def _table(m: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in m.items() for x in kv])


def latest(rows: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """The newest row of each key: a maximum by struct, combined before its shuffle, so that a hot key costs no task much."""
    rest = [c for c in rows.columns if c not in key]
    order = F.struct(*by, *[c for c in rest if c not in by])
    return rows.groupBy(*key).agg(F.max(order).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, key: list[str], seq: str, created: str) -> DataFrame:
    """old and new as one table: the newest values of each key, and the time it was first seen."""
    both = old.unionByName(new)
    first = F.min(created).alias("_c")
    rest = [c for c in both.columns if c not in (*key, created)]
    got = both.groupBy(*key).agg(F.max(F.struct(seq, *[c for c in rest if c != seq])).alias("_r"), first)
    return got.select(*key, F.col("_c").alias(created), *[F.col(f"_r.{c}").alias(c) for c in rest])


def insert_absent(old: DataFrame, new: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The rows of new whose key is in neither old nor an earlier row of new."""
    rest = [c for c in new.columns if c not in (*key, seq)]
    first = new.groupBy(*key).agg(F.min(F.struct(seq, *rest)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in (seq, *rest)])
    return first.join(old.select(*key).distinct(), key, "left_anti")


def history(rows: DataFrame, key: list[str], at: str, id_: str) -> DataFrame:
    """Adds superseded_at, the time of the key's next version, and active; of versions of one time the id decides."""
    until = F.lead(at).over(Window.partitionBy(*key).orderBy(at, id_))
    return rows.withColumn("superseded_at", until).withColumn("active", F.col("superseded_at").isNull())


def attempt_numbers(rows: DataFrame, key: list[str], order: list[str], known: DataFrame | None = None) -> DataFrame:
    """Numbers a key's attempts on from the highest known one."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    if known is None:
        return rows.withColumn("attempt_no", n.cast("long"))
    high = known.groupBy(*key).agg(F.max("attempt_no").alias("_h"))
    return rows.join(high, key, "left").withColumn("attempt_no", (F.coalesce("_h", F.lit(0)) + n).cast("long")).drop("_h")


def strongest(rows: DataFrame, key: list[str], state: str, id_: str, ranks: dict[str, int] | None = None) -> DataFrame:
    """The strongest state of each key, the newest of equals."""
    rank = F.coalesce(_table(ranks or STRENGTH)[F.col(state)], F.lit(1))
    return rows.groupBy(*key).agg(F.max_by(state, F.struct(rank, id_)).alias(state))


def may_move(old: Column, new: Column) -> Column:
    """Whether a publication may go from one state to another: never back, never out of an end."""
    rank = lambda c: _table(PROGRESS)[c]
    return old.eqNullSafe(new) | (~old.isin("merged", "superseded") & (rank(new) > rank(old)))


def transition(state: Column, event: Column) -> Column:
    """The next state of a canonical file; null if the event does not apply."""
    table = {
        ("candidate", "verify"): "verified", ("verified", "materialize"): "materialized", ("materialized", "publish"): "published", ("published", "merge"): "merged",
        ("materialized", "edit"): "human_edited", ("published", "edit"): "human_edited", ("human_edited", "adopt"): "adopted", ("human_edited", "discard"): "materialized",
    }
    out = F.lit(None).cast("string")
    for (a, e), b in table.items():
        out = F.when((state == a) & (event == e), b).otherwise(out)
    return out


def conflicts(versions: DataFrame, key: list[str], content: str) -> DataFrame:
    """Keys under which different contents were stored."""
    return versions.groupBy(*key).agg(F.min(content).alias("a"), F.max(content).alias("b"), F.count("*").alias("n")).filter("a <> b").select(*key, "n")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one only, with the side they are on."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where none is named, a local session gets one of its own; on a cluster that is an error, as executors share no other folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return base or tempfile.mkdtemp(prefix="weft-checkpoints-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder there, for what is kept between jobs."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows without their lineage, written to the checkpoint folder at once."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()


# Rows that one task groups, sorts or joins, where a table is dealt out by `spread`.
ROWS_A_TASK = 1 << 20


def spread(df: DataFrame, *by: str, like: DataFrame | None = None) -> DataFrame:
    """The rows dealt out by columns to as many tasks as their number asks for, so that no task's memory grows with the table; counts them, or those of `like`, first."""
    ways = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(ways, -(-(df if like is None else like).count() // ROWS_A_TASK)), *by)


def keep(df: DataFrame) -> DataFrame:
    """The rows as a table of Parquet in the checkpoint folder, written at once: for what several plans read some columns of."""
    path = shared_folder(df.sparkSession, "kept")
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    # the shuffle files of the plan go when it is garbage; the scheduler holds on to the last one until another has run
    gc.collect()
    df.sparkSession.range(0, 1, 1, 1).collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def drop(*kept: DataFrame) -> None:
    """Deletes tables of `keep` that nothing reads any more."""
    for df in kept:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


# Jumps are doubled as long as there are at most so many times as many of them as edges.
GROWTH = 4


def closure(edges: DataFrame, root, keep=cut) -> DataFrame:
    """All that root reaches over edges(parent, child), cycles included.

    Jumps of 1, 2, 4, ... edges are each made of two of the one before, and what is reached goes through them in turn, so rounds grow with the
    logarithm of the longest path. Where nodes with many edges both ways would make too many jumps, the last length is kept and
    repeated: what is reached so far holds every shorter distance, so no node is stepped over.
    """
    reached, n = edges.sparkSession.createDataFrame([(root,)], "node string"), 1
    jumps = keep(edges.select(F.col("parent").cast("string").alias("parent"), F.col("child").cast("string").alias("child")).filter("parent is not null and child is not null").distinct())
    most, doubling = GROWTH * jumps.count(), True
    while True:
        after = keep(reached.union(reached.join(jumps, reached["node"] == jumps["parent"]).select("child")).distinct())
        m = after.count()
        if m == n:
            return reached
        reached, n = after, m
        if doubling:
            into, out = jumps.groupBy(F.col("child").alias("via")).agg(F.count("*").alias("i")), jumps.groupBy(F.col("parent").alias("via")).agg(F.count("*").alias("o"))
            doubling = (into.join(out, "via").agg(F.sum(F.col("i") * F.col("o"))).first()[0] or 0) <= most
        if doubling:
            jumps = keep(jumps.select("parent", F.col("child").alias("via")).join(jumps.select(F.col("parent").alias("via"), "child"), "via").select("parent", "child").distinct())


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule and row that breaks it; a rule that is null counts as broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("rule", F.explode(broken))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose foreign key is set and found nowhere."""
    to = parent.select(F.col(parent_key).alias("_k")).distinct()
    return child.filter(F.col(key).isNotNull()).join(to, child[key] == to["_k"], "left_anti")


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
