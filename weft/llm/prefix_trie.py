"""Operator 11, conversation prefix trie: nodes in preorder, subtrees as intervals, their sums as differences of prefix sums.

A node is a distinct sequence of a conversation's first turns. Sequences are put in lexicographic order by the digests of their turns:
turns are cut into blocks of `WIDTH`, the distinct blocks are ranked by one distributed sort, blocks of ranks are cut into blocks
again, until a conversation is one block. Rounds grow with the logarithm, to the base `WIDTH`, of the longest
conversation, and rows fall by that factor each round. A node then stands before another in preorder if the least rank of its members is less or,
for equal ones, if it is less deep. A subtree ends with the last node of its members' greatest rank; what lies in it
is the difference of prefix sums at its two ends. No path is ever written out and no conversation or group of them is gathered in a task.

A conversation's rows are held in pieces: ranges of one global sort, so that a conversation of any length is numbered and hashed
by many tasks (see `running.totals`). Nodes are told apart by depth and 128 bits of hash: the exclusive or, over the turns so far, of hashes of place and turn.

`trie` takes any turn sequences; `rebuilt` and `query` hold what the contract fixes.

Defined results: rows with a null conv_id belong to no conversation; a null role or text is empty; turns of one conversation and number stand
in the order of their hashes, equal ones all count; null turns come first. An empty table gives no rows; conversations without turns are members of the root alone. Further columns are
ignored. The hash of a node's ends reads its members in order, chunk by chunk, in one task at a time, as SHA-256 is defined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import running
from .kit import Scratch, partitions

WIDTH = 16
# Ids that are joined to one piece of text before the hash reads them.
CHUNK = 256
# The contract: a conversation takes the first h turns, h under HEADS, of the one whose id is the last multiple of FAMILY.
FAMILY, HEADS = 100, 6
EMPTY = hashlib.sha256().hexdigest()


def numbered(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, piece, nth, x1, x2, chars) of conversations(conv_id, turn, role, text): turns in order from 1, by hash and length alone."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(F.lit(1), role, text).alias("x1"), F.xxhash64(F.lit(2), text, role).alias("x2"),
        F.char_length(text).cast("long").alias("chars"), F.rand(7).alias("salt"),
    )
    # equal rows are told apart by the salt, so that a range of them can be cut as well
    ranged = rows.repartitionByRange(partitions(scratch.spark), "conv_id", F.col("turn").asc_nulls_first(), "x1", "x2", "salt")
    kept = scratch.keep(ranged.withColumn("piece", F.spark_partition_id()))
    order = [F.col("turn").asc_nulls_first(), F.col("x1"), F.col("x2")]
    return scratch.keep(running.numbered(kept, ["conv_id"], F.col("piece"), order, "nth").select("conv_id", "piece", "nth", "x1", "x2", "chars"))


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.max("nth").alias("n"))


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: (conv_id, piece, depth, x1, x2, chars), and (conv_id, n) for all of them, those without turns included."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    sizes = scratch.keep(lengths(turns).withColumn("h", h).withColumn("base", base))
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("nth") < HEADS)).select(F.col("conv_id").alias("base"), "nth", "x1", "x2", "chars")
    taken = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("of_base")).filter(F.col("base") % FAMILY == 0)
    members = sizes.join(taken, "base", "left").withColumn("p", F.least("h", F.coalesce("of_base", F.lit(0))))
    members = scratch.keep(members.select("conv_id", "base", "p", (F.col("p") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")))
    first = members.select("conv_id", "base", "p").join(heads, "base").filter("nth <= p")
    # what is added to a place is joined by piece, of which none holds more than a range of the sort
    shift = turns.select("conv_id", "piece").distinct().join(members.select("conv_id", "p"), "conv_id")
    own = turns.filter(F.col("nth") > h).join(shift, ["conv_id", "piece"])
    rows = first.select("conv_id", F.lit(-1).alias("piece"), F.col("nth").alias("depth"), "x1", "x2", "chars")
    return rows.union(own.select("conv_id", "piece", (F.col("p") + F.col("nth") - h).alias("depth"), "x1", "x2", "chars")), members.select("conv_id", "n")


def running_sums(rows: DataFrame, order: list[Column], sums: dict, scratch: Scratch) -> DataFrame:
    """Running totals over all rows in one order, kept: a range of the sort is totalled by a task, and what precedes it is added."""
    ranged = scratch.keep(rows.repartitionByRange(partitions(scratch.spark), *order).withColumn("range", F.spark_partition_id()))
    out = scratch.keep(running.totals(ranged.withColumn("whole", F.lit(1)), ["whole"], F.col("range"), order, sums).drop("range", "whole"))
    scratch.drop(ranged)
    return out


def ranks(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, rank), lexicographic by turns, from 1 and dense, of rows(conv_id, depth, x1, x2)."""
    now = rows.select("conv_id", (F.col("depth") - 1).alias("at"), F.struct("x1", "x2").alias("symbol"))
    while True:
        block = now.groupBy("conv_id", F.floor(F.col("at") / WIDTH).alias("at"))
        keys = lambda s: F.transform(F.array_sort(s), lambda x: x["symbol"])
        blocks = scratch.keep(block.agg(keys(F.collect_list(F.struct(F.col("at").alias("place"), "symbol"))).alias("key")))
        known = running_sums(blocks.select("key").distinct(), [F.col("key")], {"rank": (F.sum, F.lit(1))}, scratch)
        ranked = scratch.keep(blocks.join(known, "key").select("conv_id", "at", "rank"))
        scratch.drop(blocks, known)
        if not ranked.filter("at > 0").limit(1).count():
            return ranked.select("conv_id", "rank")
        now = ranked.withColumn("symbol", F.struct(F.col("rank").alias("x1"), F.lit(0).cast("long").alias("x2"))).drop("rank")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the chunks of each node, one after the other; the rows come sorted."""
    node, state, out = None, None, []

    def flush() -> pa.RecordBatch:
        a, b, c = zip(*out, strict=True)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=["n1", "n2", "ends_sha256"])

    for batch in batches:
        for n1, n2, ids in zip(batch.column("n1").to_pylist(), batch.column("n2").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if (n1, n2) == node:
                state.update(b",")
            else:
                if state:
                    out.append((*node, state.hexdigest()))
                node, state = (n1, n2), hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield flush()
    if state:
        out.append((*node, state.hexdigest()))
        yield flush()


def ends(terminals: DataFrame, scratch: Scratch) -> DataFrame:
    """(n1, n2, ends_sha256) of terminals(n1, n2, conv_id): the ids of each node, ascending, in decimal, joined by commas."""
    ranged = terminals.select("n1", "n2", "conv_id").repartitionByRange(partitions(scratch.spark), "n1", "n2", "conv_id")
    kept = scratch.keep(ranged.withColumn("piece", F.spark_partition_id()))
    nth = F.row_number().over(Window.partitionBy("n1", "n2", "piece").orderBy("conv_id"))
    chunks = kept.withColumn("chunk", F.floor((nth - 1) / CHUNK)).groupBy("n1", "n2", "piece", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return chunks.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "piece", "chunk").mapInArrow(_hashes, "n1 long, n2 long, ends_sha256 string")


def trie(rows: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of rows(conv_id, piece, depth, x1, x2, chars), where members(conv_id, n) has every conversation and its length.

    Besides the contract's columns: position, the node's place in preorder from 0, and subtree_end, the place of its subtree's last node.
    """
    spark = scratch.spark
    salted = rows.withColumn("s1", F.xxhash64("depth", "x1", "x2")).withColumn("s2", F.xxhash64("x2", "x1", "depth"))
    hashed = scratch.keep(running.totals(salted, ["conv_id"], F.col("piece"), [F.col("depth")], {"n1": (F.bit_xor, F.col("s1")), "n2": (F.bit_xor, F.col("s2"))}))
    # rank and length are joined by piece, as no key of that join is long
    of = hashed.select("conv_id", "piece").distinct().join(ranks(hashed, scratch), "conv_id").join(members.withColumnRenamed("n", "length"), "conv_id")
    full = scratch.keep(hashed.join(of, ["conv_id", "piece"]).select("conv_id", "depth", "length", "rank", "chars", "n1", "n2", F.col("n1").bitwiseXOR(F.col("s1")).alias("p1"), F.col("n2").bitwiseXOR(F.col("s2")).alias("p2")))
    scratch.drop(hashed)
    nodes = full.groupBy("n1", "n2", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.max("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2")
    )
    nodes = scratch.keep(nodes)
    born = nodes.groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    grown = nodes.join(born, ["n1", "n2", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    leaf, saving = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("chars")
    placed = running_sums(grown.withColumn("leaf", leaf).withColumn("saving", saving), [F.col("low"), F.col("depth")], {"position": (F.sum, F.lit(1)), "leaves": (F.sum, F.col("leaf")), "savings": (F.sum, F.col("saving"))}, scratch)
    last = scratch.keep(placed.groupBy(F.col("low").alias("high")).agg(F.max("position").alias("end"), F.max("leaves").alias("end_leaves"), F.max("savings").alias("end_savings")))
    closed = placed.join(last, "high")
    parents = nodes.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent"))
    hashes = scratch.keep(ends(full.filter("depth = length"), scratch))
    root_id = members.agg(F.min("conv_id").alias("root"), F.count("*").alias("n_convs"))
    deeper = closed.join(parents, ["p1", "p2", "depth"], "left").join(hashes, ["n1", "n2"], "left").crossJoin(F.broadcast(root_id.select("root")))
    below = deeper.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") == 1, F.col("root")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("end_leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"), (F.col("end_savings") - F.col("savings") + F.col("saving")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "position", F.col("end").alias("subtree_end"),
    )
    whole = placed.agg(F.count("*").alias("nodes"), F.coalesce(F.sum((F.col("depth") == 1).cast("long")), F.lit(0)).alias("n_children"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("saving"), F.lit(0)).alias("savings"))
    silent = ends(members.filter("n = 0").select(F.lit(0).cast("long").alias("n1"), F.lit(0).cast("long").alias("n2"), "conv_id"), scratch).select("ends_sha256")
    top = root_id.filter("n_convs > 0").crossJoin(F.broadcast(whole)).join(F.broadcast(silent), F.lit(True), "left")
    null = F.lit(None).cast("long")
    root = top.select(
        F.col("root").alias("conv_id"), F.lit(0).cast("long").alias("depth"), null.alias("parent_conv_id"), "n_convs", "n_children", F.greatest("leaves", F.lit(1)).alias("n_leaves"), F.col("savings").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), F.lit(0).cast("long").alias("position"), F.col("nodes").alias("subtree_end"),
    )
    return root.union(below)


def query(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    turns = numbered(conversations, scratch)
    rows, members = rebuilt(turns, scratch)
    return trie(rows, members, scratch)
