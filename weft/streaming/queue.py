"""Work queues and leases as folds over event logs, by key in Arrow groups or as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUEUE = "key string, status string, owner string, attempts long, available_at long, expires_at long, payload string"
LEASE = "key string, owner string, token long, expires_at long, refused long"
LEASE_MS = 60_000
RETRY_MS = 1_000


def step(state: dict | None, e: dict, lease_ms: int = LEASE_MS) -> dict:
    """The queue entry after an event (kind, at, owner, payload, owner_alive); events of who does not own it change nothing."""
    s = dict(state or {"status": "pending", "owner": None, "attempts": 0, "available_at": 0, "expires_at": None, "payload": None})
    kind, at = e["kind"], e["at"]
    if s["status"] in ("done", "superseded"):
        return s
    if kind in ("enqueue", "supersede", "cancel"):
        live = s["status"] == "processing" and s["expires_at"] > at and e.get("owner_alive", True)
        if kind == "enqueue":
            return s if state else s | {"available_at": at, "payload": e.get("payload")}
        return s if live else s | {"status": "superseded", "owner": None, "expires_at": None}
    if kind == "claim":
        free = s["status"] == "processing" and (s["expires_at"] <= at or not e.get("owner_alive", True))
        if (s["status"] == "pending" or free) and s["available_at"] <= at:
            return s | {"status": "processing", "owner": e["owner"], "attempts": s["attempts"] + 1, "expires_at": at + lease_ms}
        return s
    if s["status"] != "processing" or s["owner"] != e["owner"]:
        return s
    if kind == "complete":
        return s | {"status": "done", "owner": None, "expires_at": None}
    if kind == "retry":
        return s | {"status": "pending", "owner": None, "expires_at": None, "available_at": at + RETRY_MS}
    if kind == "payload":
        return s | {"payload": e.get("payload")}
    return s


def lease_step(state: dict | None, e: dict) -> dict:
    """A lease after acquire, renew or release (at, owner, ttl); the fencing token grows when the owner changes."""
    s = dict(state or {"owner": None, "token": 0, "expires_at": 0, "refused": 0})
    held = s["owner"] is not None and s["expires_at"] > e["at"] and e.get("owner_alive", True)
    mine = s["owner"] == e["owner"]
    if e["kind"] == "acquire":
        if held and not mine:
            return s | {"refused": s["refused"] + 1}
        return s | {"owner": e["owner"], "token": s["token"] + (0 if mine else 1), "expires_at": e["at"] + e["ttl"]}
    if not mine or not held:
        return s | {"refused": s["refused"] + 1}
    return s | ({"expires_at": e["at"] + e["ttl"]} if e["kind"] == "renew" else {"expires_at": e["at"]})


def _by_key(events: DataFrame, one, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    types = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for b in batches:
            for e in b.to_pylist():
                if state is not None and e["key"] != key:
                    out.append({"key": key} | {n: state[n] for n in names[1:]})
                    state = None
                key, state = e["key"], one(state, e)
            if len(out) > 4096:
                yield pa.RecordBatch.from_pylist(out, types)
                out = []
        if state is not None:
            out.append({"key": key} | {n: state[n] for n in names[1:]})
        if out:
            yield pa.RecordBatch.from_pylist(out, types)

    # rows of a key lie together and in order, and stream past: no key's log is held in memory
    return events.repartition("key").sortWithinPartitions("key", "at", "seq").mapInArrow(run, schema)


def fold_queue(events: DataFrame) -> DataFrame:
    """The last state of every entry of events(key, seq, kind, at, owner, payload)."""
    return _by_key(events, step, QUEUE)


def fold_leases(events: DataFrame) -> DataFrame:
    """The last state of every lease of events(key, seq, kind, at, owner, ttl)."""
    return _by_key(events, lease_step, LEASE)


def due(queue: DataFrame, now: int, group: list[str] | None = None) -> DataFrame:
    """The oldest entry that is due, of all or of each group."""
    ready = queue.filter((F.col("status") == "pending") & (F.col("available_at") <= now))
    if not group:
        return ready.orderBy("available_at", "key").limit(1)
    rest = [c for c in queue.columns if c not in group]
    return ready.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct("available_at", "key")).alias("_r")).select(*group, "_r.*")


def supersede_older(entries: DataFrame, key: list[str], id_: str) -> DataFrame:
    """Marks all but the newest entry of each key as superseded."""
    newest = F.max(id_).over(Window.partitionBy(*key))
    return entries.withColumn("status", F.when(F.col(id_) < newest, "superseded").otherwise(F.col("status")))


def effect_key(base: str, finished: dict[str, int]) -> str:
    """The next key of a chain of effects: base, or base:after:<id of the last that is finished>, and so on."""
    key = base
    while key in finished:
        key = f"{base}:after:{finished[key]}"
    return key


def stream_queue(events: DataFrame) -> DataFrame:
    """fold_queue over a stream; emits an entry's state whenever it changes."""
    names = [x.split()[0] for x in QUEUE.split(", ")]
    schema = QUEUE.split(", ", 1)[1]

    def run(key, frames, state):
        now = dict(zip(names[1:], state.get, strict=True)) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        for e in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            now = step(now, e)
        state.update(tuple(now[n] for n in names[1:]))
        yield pd.DataFrame([{"key": key[0]} | now])[names]

    return events.groupBy("key").applyInPandasWithState(run, QUEUE, schema, "update", "NoTimeout")


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Beyond parity: events(ts, event_type, value) by event time, late ones within the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def transitions(events: DataFrame, key: list[str], state: str, order: list[str]) -> DataFrame:
    """Adds from_state, the state before, and keeps the rows at which it changes."""
    before = F.lag(state).over(Window.partitionBy(*key).orderBy(*order))
    return events.withColumn("from_state", before).filter(~F.col("from_state").eqNullSafe(F.col(state)))
