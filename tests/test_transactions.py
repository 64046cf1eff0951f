"""Business transactions, the tables they are written to, and streams of requests."""

import contextlib
import hashlib
import io
import json
import shutil

import pytest
from pyspark.sql import functions as F

from weft import catalog_txn
from weft.operators import state
from weft.operators import transactions as tx
from weft.streaming.tables import Tables

FP = hashlib.sha256(b"x").hexdigest()
SCHEMAS = {
    "runs": "run_id string, repository_id long, invocation_key string, policy string, metadata string, status string, started_at long, heartbeat_at long, finished_at long",
    "documents": "document_id string, repository_id long, path string, source_revision string, content_hash string, metadata string, created_at long, deleted_at long",
    "units": "unit_id string, document_id string, unit_key string, ordinal int, source_text string, source_hash string, context string, active boolean, created_at long",
    "unit_versions": "unit_version_id string, unit_id string, source_revision string, source_hash string, source_text string, context string",
    "work_items": "work_item_id string, run_id string, unit_id string, document_id string, locale string, kind string, input string, status string, result string, created_at long",
    "attempts": "attempt_id string, work_item_id string, dedupe_key string, attempt_no long, agent string, provider string, model string, adapter string, prompt_version string, provider_fingerprint string, prompt_hash string, policy string, status string, response string, error string, at long",
    "candidates": "unit_id string, locale string, candidate_key string, text string, attempt_id string, score double, selected boolean",
    "versions": "version_id string, unit_version_id string, locale string, text string, provenance string, validation string, review string, publication string, policy string, attempt_id string, superseded_at long",
    "memory": "memory_id string, repository_id long, unit_id string, version_id string, locale string, source_hash string, source_revision string, context_key string, text string, tier string, provenance string, policy string, at long, superseded_at long",
    "findings": "work_item_id string, fingerprint string, severity string, code string, message string, resolved_at long",
    "outbox": tx.OUTBOX,
    "files": tx.FILES,
    "content_versions": "content_version_id string, file_id string, source_revision string, content_hash string, content string",
    "manifests": tx.MANIFESTS,
    "manifest_files": "manifest_id string, content_version_id string, file_id string, content_hash string",
    "publication_outbox": tx.OUTBOX,
    "pull_requests": "repository_id long, provider string, external_id string, head_revision string, state string, at long",
    "pr_events": "repository_id long, provider string, external_id string, event_key string, from_state string, to_state string, at long",
    "links": "content_version_id string, version_id string",
}
KEYS = {"runs": ["run_id"], "documents": ["document_id"], "units": ["unit_id"], "unit_versions": ["unit_version_id"], "work_items": ["work_item_id"], "attempts": ["attempt_id"], "candidates": ["unit_id", "locale", "attempt_id"], "versions": ["version_id"], "memory": ["memory_id"], "findings": ["work_item_id", "fingerprint"], "outbox": ["outbox_id"], "files": ["file_id"], "content_versions": ["content_version_id"], "manifests": ["manifest_id"], "manifest_files": ["manifest_id", "content_version_id"], "publication_outbox": ["outbox_id"], "pull_requests": ["repository_id", "provider", "external_id"], "pr_events": ["repository_id", "provider", "external_id", "event_key"], "links": ["content_version_id", "version_id"]}


class Steps(Tables):
    def commit(self, batch, staged):
        return self.write(batch, staged)

    def done(self):
        return [r.batch for r in self.batches().select("n", "batch").distinct().orderBy("n").collect()]


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty") / "state"
    Tables(spark, str(path), SCHEMAS, KEYS).create()
    return path


@pytest.fixture
def store(spark, empty, tmp_path):
    """Few rows and many plans: one partition each is enough."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    shutil.copytree(empty, tmp_path / "state")
    yield Steps(spark, str(tmp_path / "state"), SCHEMAS, KEYS)
    spark.conf.set("spark.sql.shuffle.partitions", was)


def frame(spark, schema, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], schema).coalesce(1)


def begun(spark, store):
    runs = frame(spark, "repository_id long, invocation_key string, policy string, metadata string, at long", (1, "a", FP, "{}", 10), (2, "b", "bad", "{}", 10))
    staged = tx.begin_runs(store.current("runs"), runs)
    assert [r.refusal for r in staged.refused.collect()] == ["POLICY"]
    assert store.commit("begin", staged) and not store.commit("begin", staged)
    return store.current("runs").first().run_id


DOC = "run_id string, repository_id long, path string, locale string, source_revision string, content_hash string, metadata string, at long"
UNIT = "repository_id long, path string, unit_key string, ordinal int, source_text string, source_hash string, context string, enqueue string"


def prepared(spark, store, run, at=20, revision="r1", text="Hello"):
    work = json.dumps({"source_revision": revision, "path": "a.md", "unit": "u1"})
    docs = frame(spark, DOC, (run, 1, "a.md", "ja", revision, "h", "{}", at), ("other", 1, "b.md", "ja", "r1", "h", "{}", at), (run, 1, "c.md", "ja", "r2", "h", "{}", at))
    units = frame(spark, UNIT, (1, "a.md", "u1", 0, text, f"hash {text}", "{}", work), (1, "a.md", "u2", 1, "World", "hash World", "{}", None), (1, "c.md", "u1", 0, "x", "y", "{}", work))
    return tx.prepare(store.tables(), docs, units)


def test_runs_are_idempotent(spark, store):
    run = begun(spark, store)
    assert store.commit("end", tx.finish_runs(store.current("runs"), frame(spark, "run_id string, new_status string, at long", (run, "ok", 30), ("none", "ok", 30))))
    assert [(r.status, r.finished_at) for r in store.current("runs").collect()] == [("ok", 30)]
    again = tx.begin_runs(store.current("runs"), frame(spark, "repository_id long, invocation_key string, policy string, metadata string, at long", (1, "a", FP, "{}", 40)))
    assert store.commit("again", again)
    assert [(r.run_id, r.status, r.started_at, r.heartbeat_at, r.finished_at) for r in store.current("runs").collect()] == [(run, "running", 10, 40, None)]
    assert [(r.status, r.finished_at) for r in store.current("runs", upto=2).collect()] == [("ok", 30)]  # an earlier snapshot stands


def test_prepare_is_one_commit(spark, store, tmp_path):
    run = begun(spark, store)
    staged = prepared(spark, store, run)
    assert sorted((r.path, r.refusal) for r in staged.refused.collect()) == [("b.md", "RUN"), ("c.md", "WORK")]
    assert store.commit("prepare", staged)
    assert {n: store.current(n).count() for n in ("documents", "units", "unit_versions", "work_items")} == {"documents": 1, "units": 2, "unit_versions": 2, "work_items": 1}
    store.commit("prepare 2", prepared(spark, store, run, 50, "r2", "Hello!"))  # a new revision: the unit lives on, its versions add up
    assert {n: store.current(n).count() for n in ("documents", "units", "unit_versions", "work_items")} == {"documents": 1, "units": 2, "unit_versions": 4, "work_items": 2}
    doc = store.current("documents").first()
    assert (doc.source_revision, doc.created_at) == ("r2", 20)
    # a commit that breaks off leaves nothing
    with pytest.raises(Exception, match="boom"):
        store.commit("broken", {"runs": store.current("runs"), "units": store.current("units").withColumn("unit_key", F.raise_error(F.lit("boom")))})
    assert store.done() == ["begin", "prepare", "prepare 2"]
    runs = store.current("runs").collect()
    # the next batch takes the number of the broken one, whose rows in other tables do not count
    assert store.commit("units again", {"units": store.current("units").withColumn("active", F.lit(False))})
    assert store.current("runs").collect() == runs and store.versions("runs").count() == 1
    assert [r.active for r in store.current("units").collect()] == [False, False] and store.current("units", upto=3).filter("active").count() == 2
    copy = store.copy(str(tmp_path / "copy"))
    assert copy.current("units").exceptAll(store.current("units")).count() == 0 and copy.current("units").count() == 2 and copy.versions("unit_versions").count() == 4
    assert sorted(r.refusal for r in copy.versions("refused").collect()) == sorted(["POLICY", "RUN", "WORK", "RUN", "WORK"])
    with pytest.raises(ValueError, match="without batches"):
        store.copy(str(tmp_path / "copy"))
    with pytest.raises(ValueError, match="unknown tables"):
        store.commit("strange", {"others": store.current("runs")})


ATTEMPT = "work_item_id string, dedupe_key string, agent string, provider string, model string, adapter string, prompt_version string, provider_fingerprint string, prompt_hash string, policy string, status string, response string, error string, at long, unit_id string, locale string, candidate_key string, text string, score double, provenance string"


def attempt(work, key, unit, text, at, output=None, status="succeeded", agent="a", candidate=None):
    return (work, key, agent, "p", "m", "x", "1", FP, FP, FP, status, json.dumps({"output": text if output is None else output}), None, at, unit, "ja", candidate or key, text, 0.5, "model")


def with_sources(store):
    tables = store.tables()
    units = tables["units"].join(tables["documents"].select("document_id", "repository_id"), "document_id").join(tables["unit_versions"].select("unit_id", "unit_version_id", "source_hash", "source_revision"), ["unit_id", "source_hash"])
    return tables | {"sources": units.select("unit_id", "unit_version_id", "repository_id", "source_hash", "source_revision", F.lit("").alias("context_key"))}


def test_candidates_are_recorded_and_retired(spark, store):
    run = begun(spark, store)
    store.commit("prepare", prepared(spark, store, run))
    unit = store.current("units").filter("unit_key = 'u1'").first().unit_id
    work = store.current("work_items").first().work_item_id
    rows = [attempt(work, "k1", unit, "one", 30), attempt(work, "k2", unit, "two", 31), attempt(work, "k3", unit, "three", 32, output="other"), attempt(work, "k4", unit, "four", 33, status="failed"), attempt(work, "k5", unit, "five", 34, agent=" "), attempt(work, "k6", "nobody", "six", 35)]
    staged = tx.record_candidates(with_sources(store), frame(spark, ATTEMPT, *rows))
    assert {r.dedupe_key: r.refusal for r in staged.refused.collect()} == {"k3": "OUTPUT", "k4": "STATUS", "k5": "AGENT", "k6": "UNIT"}
    assert store.commit("attempts", staged)
    assert sorted((r.dedupe_key, r.attempt_no) for r in store.current("attempts").collect()) == [("k1", 1), ("k2", 2)]
    assert sorted((r.text, r.selected) for r in store.current("candidates").collect()) == [("one", False), ("two", True)]
    assert store.current("versions").count() == 2
    assert [(r.text, r.tier) for r in store.current("memory").collect()] == [("two", "candidate")]
    # brought again: the attempt stays; another response under the key conflicts; a new one follows on
    rows = [attempt(work, "k1", unit, "one", 40), attempt(work, "k2", unit, "2", 41), attempt(work, "k7", unit, "seven", 42)]
    staged = tx.record_candidates(with_sources(store), frame(spark, ATTEMPT, *rows))
    assert [(r.dedupe_key, r.refusal) for r in staged.refused.collect()] == [("k2", "CONFLICT")]
    assert {r.dedupe_key: r.inserted for r in staged.receipts.collect()} == {"k1": False, "k7": True}
    store.commit("attempts 2", staged)
    assert sorted((r.dedupe_key, r.attempt_no) for r in store.current("attempts").collect()) == [("k1", 1), ("k2", 2), ("k7", 3)]
    assert [r.text for r in store.current("candidates").filter("selected").collect()] == ["seven"] and store.current("versions").count() == 3
    memory = store.current("memory").collect()
    assert [(r.text, r.superseded_at) for r in memory] == [("seven", None)]
    # retired: the key is free again
    last = store.current("attempts").filter("dedupe_key = 'k7'").first().attempt_id
    store.commit("retire", tx.retire(store.tables(), frame(spark, "attempt_id string, at long", (last, 50))))
    now = {r.attempt_id: r for r in store.current("attempts").collect()}[last]
    assert (now.status, now.dedupe_key) == ("cancelled", f"k7:superseded:{last}")
    assert store.current("candidates").filter("selected").count() == 0
    assert [(r.tier, r.superseded_at) for r in store.current("memory").collect()] == [("history", 50)]
    assert [(r.validation, r.superseded_at) for r in store.current("versions").filter(F.col("attempt_id") == last).collect()] == [("quarantined", 50)]
    assert tx.record_candidates(with_sources(store), frame(spark, ATTEMPT, attempt(work, "k7", unit, "7", 60))).receipts.first().inserted


def test_quarantine_and_trust(spark, store):
    run = begun(spark, store)
    store.commit("prepare", prepared(spark, store, run))
    unit = store.current("units").filter("unit_key = 'u1'").first().unit_id
    version = store.current("unit_versions").filter(F.col("unit_id") == unit).first()
    wanted = "repository_id long, unit_id string, unit_version_id string, locale string, source_hash string, source_revision string, context_key string, text string, provenance string, policy string, at long"
    one = (1, unit, version.unit_version_id, "ja", "h", "r1", "", "eins", "person", FP, 30)
    assert store.commit("trust", tx.trust(store.tables(), frame(spark, wanted, one)))
    same = tx.trust(store.tables(), frame(spark, wanted, (*one[:10], 35)))
    assert same.rows["memory"].count() == 0 and same.rows["versions"].count() == 0
    store.commit("trust 2", tx.trust(store.tables(), frame(spark, wanted, (*one[:7], "zwei", "person", FP, 40), (1, unit, None, "ko", "h", "r1", "", "x", "person", FP, 40))))
    assert sorted((r.text, r.tier, r.superseded_at) for r in store.current("memory").collect()) == [("eins", "history", 40), ("zwei", "trusted", None)]
    good = store.current("versions").filter("text = 'eins'").select("version_id")
    store.commit("quarantine", tx.quarantine(store.tables(), good, frame(spark, "unit_version_id string, locale string", (version.unit_version_id, "ja")), 60))
    assert sorted((r.text, r.validation) for r in store.current("versions").collect()) == [("eins", "passed"), ("zwei", "quarantined")]
    assert sorted((r.text, r.tier, r.superseded_at) for r in store.current("memory").collect()) == [("eins", "history", 40), ("zwei", "history", 60)]


def canonical(spark, store, run):
    text = "canon"
    content = frame(spark, "repository_id long, locale string, path string, source_revision string, content string, content_hash string, at long", (1, "ja", "t/a.md", "r1", text, hashlib.sha256(text.encode()).hexdigest(), 30), (1, "ja", "t/b.md", "r1", text, FP, 30))
    staged = tx.persist_files(store.tables(), content)
    assert [(r.path, r.refusal) for r in staged.refused.collect()] == [("t/b.md", "HASH")]
    store.commit("persist", staged)
    return store.current("files").first()


INTENT = "run_id string, repository_id long, document_id string, locale string, path string, dedupe_key string, work_input string, payload string, at long"


def intent(run, doc, f, key, at, **more):
    said = {"repository_id": 1, "locale": "ja", "path": f.path, "canonical_file_id": f.file_id, "canonical_content_version_id": f.content_version_id, "content_hash": f.content_hash} | more
    return (run, 1, doc, "ja", f.path, key, json.dumps({"effect_key": key}), json.dumps(said), at)


def test_materialization_is_scheduled_and_settled(spark, store):
    run = begun(spark, store)
    store.commit("prepare", prepared(spark, store, run))
    doc, f = store.current("documents").first().document_id, canonical(spark, store, run)
    plan = lambda *rows: tx.schedule(store.tables(), frame(spark, INTENT, *rows))
    assert plan(intent(run, doc, f, "k", 40, locale="ko")).refused.first().refusal == "INTENT"
    assert plan(intent("nobody", doc, f, "k", 40)).refused.first().refusal == "RUN"
    store.commit("one", plan(intent(run, doc, f, "k1", 40)))
    store.commit("two", plan(intent(run, doc, f, "k2", 50)))
    assert sorted((r.dedupe_key, r.state, r.last_error) for r in store.current("outbox").collect()) == [("k1", "done", tx.DONE), ("k2", "pending", None)]
    assert sorted(r.status for r in store.current("work_items").filter("kind = 'materialization'").collect()) == ["cancelled", "pending"]
    assert plan(intent(run, doc, f, "k1", 60)).refused.first().refusal == "TERMINAL"
    entry = store.current("outbox").filter("dedupe_key = 'k2'")
    store.commit("claim", {"outbox": tx.changed(entry, state=F.lit("processing"), owner=F.lit("materialize:1"), owner_alive=F.lit(True), lease_expires_at=F.lit(99).cast("long"))})
    assert plan(intent(run, doc, f, "k3", 60)).refused.first().refusal == "BUSY"
    e = store.current("outbox").filter("dedupe_key = 'k2'").first()
    asked = "outbox_id string, owner string, work_item_id string, file_id string, move string, new_hash string, succeeded boolean, result string, at long"
    end = lambda **v: tx.settle(store.tables(), frame(spark, asked, list(({"outbox_id": e.outbox_id, "owner": e.owner, "work_item_id": e.work_item_id, "file_id": f.file_id, "move": "materialized", "new_hash": f.content_hash, "succeeded": True, "result": "{}", "at": 70} | v).values())))
    assert end(owner="thief").refused.first().refusal == "OWNER" and end(new_hash=FP).refused.first().refusal == "BYTES"
    store.commit("settle", end())
    assert [(r.state, r.materialized_hash) for r in store.current("files").collect()] == [("materialized", f.content_hash)]
    assert {r.dedupe_key: (r.state, r.owner) for r in store.current("outbox").collect()} == {"k1": ("done", None), "k2": ("done", None)}
    assert end().refused.first().refusal == "OWNER"  # settled once
    keys = tx.effect_keys(frame(spark, "base_key string", ("k2",), ("k9",)), store.current("outbox"))
    assert {r.base_key: r.dedupe_key for r in keys.collect()} == {"k2": f"k2:after:{e.outbox_id}", "k9": "k9"}


def test_discard(spark, store):
    run = begun(spark, store)
    store.commit("prepare", prepared(spark, store, run))
    doc, f = store.current("documents").first().document_id, canonical(spark, store, run)
    asked = "run_id string, repository_id long, document_id string, file_id string, content_version_id string, locale string, path string, content_hash string, observed_hash string, at long"
    row = (run, 1, doc, f.file_id, f.content_version_id, "ja", f.path, f.content_hash, FP, 40)
    assert tx.begin_discard(store.tables(), frame(spark, asked, (*row[:7], FP, FP, 40))).refused.first().refusal == "CONTENT"
    staged = tx.begin_discard(store.tables(), frame(spark, asked, row))
    store.commit("begin discard", staged)
    got = store.current("outbox").first()
    assert json.loads(got.payload)["expected_hash"] == FP and got.state == "pending"
    done = "outbox_id string, work_item_id string, file_id string, content_hash string, at long"
    assert tx.complete_discard(store.tables(), frame(spark, done, (got.outbox_id, got.work_item_id, f.file_id, FP, 50))).refused.first().refusal == "RECEIPT"
    store.commit("discard", tx.complete_discard(store.tables(), frame(spark, done, (got.outbox_id, got.work_item_id, f.file_id, f.content_hash, 50))))
    assert store.current("outbox").first().state == "done" and store.current("files").first().state == "materialized"
    again = tx.begin_discard(store.tables(), frame(spark, asked, row)).receipts.first()
    assert again.dedupe_key.endswith(f":after:{got.outbox_id}")


def test_adoption(spark, store):
    run = begun(spark, store)
    text = "target"
    docs = frame(spark, f"{DOC}, target_path string, content string, target_hash string, policy string", (run, 1, "a.md", "ja", "r1", "h", "{}", 20, "ja/a.md", text, hashlib.sha256(text.encode()).hexdigest(), FP))
    units = frame(spark, "repository_id long, path string, unit_key string, ordinal int, source_text string, source_hash string, context string, target_text string, context_key string", (1, "a.md", "u1", 0, "Hello", "h1", "{}", "Konnichiwa", "k"))
    # neither other bytes than the hash says nor a policy that is none leave anything
    for bad, why in (("target_hash", "HASH"), ("policy", "POLICY")):
        staged = tx.adopt(store.tables(), docs.withColumn(bad, F.lit("x")), units)
        assert [(r.path, r.refusal) for r in staged.refused.collect()] == [("a.md", why)] and all(df.isEmpty() for df in staged.rows.values())
    store.commit("adopt", tx.adopt(store.tables(), docs, units))
    f = store.current("files").first()
    assert (f.state, f.provenance, f.trust_tier, f.materialized_hash) == ("adopted", "human", "trusted", f.content_hash)
    assert [(r.text, r.tier) for r in store.current("memory").collect()] == [("Konnichiwa", "trusted")]
    assert sorted((r.kind, r.status) for r in store.current("work_items").collect()) == [("assembly", "succeeded"), ("materialization", "succeeded")]


def test_adoption_shuffles_no_text_for_each_table(spark, store):
    """Every table with texts is read from one kept table; a unit or request that is listed twice is trusted once."""
    run = begun(spark, store)
    text = "target"
    doc = (run, 1, "a.md", "ja", "r1", "h", "{}", 20, "ja/a.md", text, hashlib.sha256(text.encode()).hexdigest(), FP)
    docs = frame(spark, f"{DOC}, target_path string, content string, target_hash string, policy string", doc)
    unit = "repository_id long, path string, unit_key string, ordinal int, source_text string, source_hash string, context string, target_text string, context_key string"
    rows = [(1, "a.md", f"u{i}", i, "Hello", "h1", "{}", "t1", "k") for i in (0, 1, 1)] + [(1, "a.md", "u2", 2, "World", "h2", "{}", "t2", None)]
    staged = tx.adopt(store.tables(), docs, frame(spark, unit, *rows))
    for name in ("units", "unit_versions", "files", "content_versions"):
        said = io.StringIO()
        with contextlib.redirect_stdout(said):
            staged.rows[name].explain()
        assert "Exchange" not in said.getvalue(), name
    assert sorted(r.text for r in staged.rows["versions"].collect()) == sorted(r.text for r in staged.rows["memory"].collect()) == ["t1", "t2"]
    twice = tx.adopt(store.tables(), docs.union(docs), frame(spark, unit, *rows))
    assert [r.content for r in twice.rows["files"].collect()] == [text] and twice.rows["memory"].count() == 2


ORDERS = "/root/testdata/sf0.001"


def settled_orders(spark, how):
    """What `how` stages of the orders' entries, each asked for by who holds it."""
    o, tables = catalog_txn._entries(spark, ORDERS)
    asked = o.select("outbox_id", F.col("holder").alias("owner"), "work_item_id", "file_id", F.lit("materialized").alias("move"), F.col("content_hash").alias("new_hash"), "content_hash", F.lit(True).alias("succeeded"), F.lit("{}").alias("result"), "at")
    return how(tables, asked)


def shuffles_nothing(*frames):
    for df in frames:
        said = io.StringIO()
        with contextlib.redirect_stdout(said):
            df.explain()
        assert "Exchange" not in said.getvalue()


def test_discards_read_entries_and_files_once(spark):
    """Files, entries and refusals come of one kept table."""
    staged = settled_orders(spark, tx.complete_discard)
    shuffles_nothing(staged.rows["files"], staged.rows["outbox"], staged.refused)
    assert 0 < staged.rows["files"].count() == staged.rows["outbox"].count() == staged.rows["work_items"].count() == 1500 - staged.refused.count()


def test_settling_reads_entries_and_files_once(spark):
    """As discards; only entries in work are looked up, and every request is settled or refused."""
    staged = settled_orders(spark, tx.settle)
    shuffles_nothing(staged.rows["files"], staged.rows["outbox"], staged.refused)
    assert 0 < staged.rows["files"].count() == staged.rows["outbox"].count() == staged.rows["work_items"].count() == 1500 - staged.refused.count()
    assert {r.refusal for r in staged.refused.select("refusal").distinct().collect()} == {"OWNER", "CONTENT"}


def test_verification_work(spark, store):
    run = begun(spark, store)
    staged = tx.begin_verification(store.tables(), frame(spark, "run_id string, document_id string, locale string, kind string, input string, at long", (run, "d1", "ja", "assembly", "{}", 20), (run, "d2", "ja", "assembly", "{}", 20), (run, "d1", "ja", "pipeline", "{}", 20)))
    assert staged.refused.first().refusal == "KIND"
    store.commit("begin check", staged)
    work = {r.document_id: r.work_item_id for r in store.current("work_items").collect()}
    done = frame(spark, "work_item_id string, result_kind string, result string, at long", (work["d1"], "assembled", "{}", 30), (work["d2"], "checked", "{}", 30))
    staged = tx.complete_verification(store.tables(), done, frame(spark, "work_item_id string, fingerprint string, code string, message string", (work["d1"], "f", "C", "m")))
    assert [r.refusal for r in staged.refused.collect()] == ["KIND"]
    store.commit("check", staged)
    assert {r.document_id: r.status for r in store.current("work_items").collect()} == {"d1": "failed", "d2": "pending"}
    assert [(r.code, r.severity, r.resolved_at) for r in store.current("findings").collect()] == [("C", "error", None)]


def test_publication(spark, store):
    run = begun(spark, store)
    f = canonical(spark, store, run)
    box = {"outbox_id": "o", "work_item_id": "w", "run_id": run, "repository_id": 1, "document_id": None, "locale": "ja", "path": None, "dedupe_key": "key", "payload": "{}", "state": "processing", "owner": "publish:1", "owner_alive": True, "lease_expires_at": 99, "available_at": 0, "last_error": None, "completed_at": None}
    store.commit("box", {"publication_outbox": frame(spark, tx.OUTBOX, list(box.values()))})
    files = frame(spark, "authorization_key string, content_version_id string, file_id string, content_hash string", ("key", f.content_version_id, f.file_id, f.content_hash))
    asked = "repository_id long, run_id string, locale string, source_revision string, commit string, policy string, authorization_key string, at long, outbox_id string, owner string, payload string, new_state string"
    payload = {"commit": "c1", "run_id": run, "language": "ja", "source_revision": "r1", "policy_fingerprint": FP}
    row = (1, run, "ja", "r1", "c1", FP, "key", 40, "o", "publish:1", json.dumps(payload), "push_pending")
    refused = lambda r, files=files: [x.refusal for x in tx.persist_publications(store.tables(), frame(spark, asked, r), files).refused.collect()]
    assert refused((*row[:9], "thief", *row[10:])) == ["OWNER"] and refused((*row[:10], "{}", "pr_open")) == ["PAYLOAD"]
    assert refused(row, files.withColumn("content_hash", F.lit("x"))) == ["BYTES"] and refused(row, files.union(files)) == ["TWICE"]
    store.commit("persist publication", tx.persist_publications(store.tables(), frame(spark, asked, row), files))
    assert [(r.state, r.commit) for r in store.current("manifests").collect()] == [("push_pending", "c1")]
    assert json.loads(store.current("publication_outbox").first().payload)["commit"] == "c1"
    bare = "repository_id long, run_id string, locale string, source_revision string, commit string, policy string, authorization_key string, at long"
    assert tx.authorize(store.tables(), frame(spark, bare, row[:8]), files.withColumn("file_id", F.lit("y"))).refused.first().refusal == "CONFLICT"
    assert tx.authorize(store.tables(), frame(spark, bare, (*row[:3], "r9", *row[4:6], "key2", 41)), files.withColumn("authorization_key", F.lit("key2"))).refused.first().refusal == "SNAPSHOT"
    end = "outbox_id string, owner string, repository_id long, locale string, authorization_key string, commit string, new_state string, head_revision string, at long"
    done = ("o", "publish:1", 1, "ja", "key", "c1", "pr_open", "c1", 50)
    assert tx.settle_publications(store.tables(), frame(spark, end, (*done[:5], "c2", *done[6:]))).refused.first().refusal == "COMMIT"
    pulls = tx.record_pulls(store.tables(), frame(spark, "repository_id long, provider string, external_id string, head_revision string, state string, event_key string, at long", (1, "g", "7", "c1", "open", "e1", 50), (1, "g", "7", "c1", "merged", "e2", 60), (1, "g", "7", "c1", "merged", "e2", 60)))
    store.commit("settle publication", tx.settle_publications(store.tables(), frame(spark, end, done)).rows | pulls)
    assert store.current("manifests").first().state == "pr_open" and store.current("publication_outbox").first().state == "done"
    assert sorted((r.event_key, r.from_state, r.to_state) for r in store.current("pr_events").collect()) == [("e1", None, "open"), ("e2", "open", "merged")]
    back = tx.move_publications(store.current("manifests"), frame(spark, "repository_id long, locale string, commit string, authorization_key string, new_state string", (1, "ja", "c1", None, "push_pending"), (1, "ja", "c9", "k", "superseded"), (1, "ja", "c9", None, "pr_open"), (1, "ja", "c1", None, "merged")))
    assert back.rows["manifests"].count() == 0 and sorted(r.refusal for r in back.refused.collect()) == ["MANIFEST", "STATE"]
    memory = lambda id_, version, tier, text: (id_, 1, "u", version, "ja", "h", "r1", "", text, tier, "model", FP, 5, None)
    store.commit("memory", {"memory": frame(spark, SCHEMAS["memory"], memory("m1", "v1", "candidate", "new"), memory("m2", "v0", "trusted", "old")), "links": frame(spark, SCHEMAS["links"], (f.content_version_id, "v1"))})
    store.commit("promote", tx.promote(store.tables(), frame(spark, "repository_id long, locale string, commit string, at long", (1, "ja", "c1", 70))))
    assert sorted((r.text, r.tier, r.superseded_at) for r in store.current("memory").collect()) == [("new", "trusted", None), ("old", "history", 70)]
    assert (store.current("files").first().state, store.current("manifests").first().state) == ("merged", "merged")


def test_idle_check(spark):
    leases = frame(spark, "kind string, owner string, owner_alive boolean", ("repository", "a", False), ("repository", "b", True), ("worker", "c", False))
    box = frame(spark, "state string, owner string, owner_alive boolean", ("processing", "materialize:1", False), ("processing", "strange", False), ("pending", None, None), ("processing", "publish:2", None))
    assert sorted(map(tuple, tx.idle_faults(leases, [box]).collect())) == [("LEASE", "b"), ("LEASE", "c"), ("WORKER", "publish:2"), ("WORKER", "strange")]


def test_ids_tell_parts_apart(spark):
    ids = spark.range(1).select(tx.id_of(F.lit("a"), F.lit("bc")).alias("x"), tx.id_of(F.lit("ab"), F.lit("c")).alias("y"), tx.id_of(F.lit(""), F.lit(None).cast("string")).alias("z"), tx.id_of(F.lit(None).cast("string"), F.lit("")).alias("w")).first()
    assert len(set(ids)) == 4 and state.duplicates is not None


PULL = "repository_id long, provider string, external_id string, head_revision string, state string, event_key string, at long"


def pulls(n):
    """Batches of events; the third brings an event of the second again."""
    rows = [[(1, "g", str(k % 3), "c", "open" if i == 0 else "merged", f"e{i}.{k}", 10 * i + k) for k in range(5)] for i in range(n)]
    rows[2].append(rows[1][0])
    return rows


def test_a_stream_takes_each_request_once(spark, store, tmp_path):
    source, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    source.mkdir()
    for i, rows in enumerate(pulls(3)):
        (source / f"{i}.json").write_text("\n".join(json.dumps(dict(zip([f.split()[0] for f in PULL.split(", ")], r, strict=True))) for r in rows))
        if i == 1:
            continue  # two files wait for the next start
        stream = spark.readStream.schema(PULL).option("maxFilesPerTrigger", "1").json(str(source))
        store.follow(stream, tx.record_pulls, checkpoint).awaitTermination()
    assert store.batches().filter("source <> ''").select("batch").distinct().count() == 3
    want = {f"e{i}.{k}" for i in range(3) for k in range(5)}
    events = store.versions("pr_events").collect()
    assert len(events) == 15 and {r.event_key for r in events} == want
    assert {r.external_id: r.state for r in store.current("pull_requests").collect()} == {"0": "merged", "1": "merged", "2": "merged"}
    assert sorted(r.from_state or "" for r in events if r.to_state == "open") == ["", "", "", "open", "open"]


def test_a_stream_goes_on_after_a_failure(spark, store, tmp_path):
    """A batch that breaks off between its tables, and one that counted though Spark did not get to note it."""
    source, checkpoint = tmp_path / "in", tmp_path / "checkpoint"
    spark.createDataFrame(pulls(3)[0], PULL).coalesce(1).write.json(str(source))
    stream = spark.readStream.schema(PULL).json(str(source))
    broken = lambda tables, asked: tx.record_pulls(tables, asked) | {"runs": tables["runs"].limit(0).union(spark.range(1).select(F.raise_error(F.lit("boom")), *[F.lit(None)] * 8))}
    whole = lambda tables, asked: tx.record_pulls(tables, asked)
    with pytest.raises(Exception, match="boom"):
        store.follow(stream, broken, str(checkpoint)).awaitTermination()
    assert store.done() == [] and store.current("pr_events").isEmpty()
    store.follow(stream, whole, str(checkpoint)).awaitTermination()
    assert store.versions("pr_events").count() == 5
    before = sorted(map(str, store.versions("pull_requests").collect()))
    for f in (checkpoint / "commits").iterdir():  # as if the driver had died before Spark noted the batch
        f.unlink()
    store.follow(stream, whole, str(checkpoint)).awaitTermination()
    assert sorted(map(str, store.versions("pull_requests").collect())) == before and store.versions("pr_events").count() == 5 and len(store.done()) == 1
