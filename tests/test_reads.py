"""The named reads' edges: no rows, nulls, ties and repeated rows; the queries themselves are held against SQL in test_engine."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from weft.operators import state
from weft.plans import reads


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_history_falls_back(spark):
    units = spark.createDataFrame([(1,), (2,), (3,)], "unit_id int")
    versions = spark.createDataFrame([(1, 1, "old", True, True), (1, 2, "new", True, False), (2, 3, "a", False, True), (2, 4, None, True, False)], "unit_id int, id int, text string, active boolean, trusted boolean")
    assert rows(reads.unit_history(units, versions)) == [(1, 1, "old", True), (2, 4, None, False), (3, None, None, False)]


def test_attempts(spark):
    a = spark.createDataFrame([(1, 1, "failed", '{"output":"x"}', "e", "d"), (1, 2, "timed_out", None, None, "d"), (1, 3, "succeeded", '{"other":1}', None, None), (2, 4, "succeeded", '{"output":"y"}', None, "d")], "work_item int, id int, status string, response string, error string, bound string")
    assert rows(reads.failed_context(a)) == [(1, 2, None, None)]
    work = spark.createDataFrame([(1, None), (2, "c")], "work_item int, document string")
    assert rows(reads.successes(a, work)) == [(1, 3, "", True), (2, 4, "y", False)]


def test_recoverable(spark):
    c = spark.createDataFrame([(1, 1, "t", True), (1, 2, "u", True), (2, 3, "t", True), (3, 4, "t", False), (4, 5, "t", True)], "unit_id int, attempt_id int, text string, selected boolean")
    a = spark.createDataFrame([(1, "succeeded", "p", "m", "v0", "t"), (2, "succeeded", "p", "m", "v0", "else"), (3, "succeeded", "p", "deterministic", "v0", "t"), (4, "succeeded", "p", "m", None, "t"), (5, "succeeded", "q", "m", None, "t")], "id int, status string, policy string, agent string, model string, output string")
    assert rows(reads.recoverable(c, a, "p", "v1")) == [(1, 1, "t")]
    assert rows(reads.recoverable(c, a, "p", "v0")) == [(1, 1, "t"), (2, 3, "t")]


def test_reviews(spark):
    a = spark.createDataFrame([("k:revision", "r", None), ("k:proofread", None, "i"), ("k", "r", "i"), ("k:revision:x", "r", "i")], "dedupe_key string, run_id string, invocation string")
    assert reads.review_attempts(a).count() == 2 and reads.review_attempts(a, run="r").count() == 1 and reads.review_attempts(a, "r", "i").count() == 2


def test_provenance(spark):
    a = spark.createDataFrame([(1, None, "p"), (2, 7, "p"), (3, None, "p")], "id int, version int, policy string")
    v = spark.createDataFrame([(1, 5), (1, 6), (2, 8)], "attempt_id int, version int")
    audits = spark.createDataFrame([(5, 1, "old"), (5, 2, "new")], "version int, at int, policy string")
    assert rows(reads.provenance(a, v, audits)) == [(1, 5, "new"), (2, 7, "p"), (3, None, "p")]


def test_compatible(spark):
    contents = spark.createDataFrame([(i,) for i in range(5)], "content int")
    links = spark.createDataFrame([(1, False, True), (2, True, True), (2, False, False), (3, True, False), (4, True, None)], "content int, active boolean, valid boolean")
    assert rows(reads.compatible(contents, links)) == [(0, True), (1, False), (2, True), (3, False), (4, False)]


def test_publications(spark):
    m = spark.createDataFrame([("r", 1, "merged"), ("r", 2, "pr_open"), ("s", 3, "prepared"), ("s", 4, "superseded"), ("t", 5, "superseded")], "repo string, id int, state string")
    f = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")], "manifest int, path string")
    assert sorted((r["repo"], r["path"]) for r in reads.snapshot(m, f, ["repo"]).collect()) == [("r", "a"), ("s", "c")]
    files = spark.createDataFrame([(1, "a", "x", "s", 1), (1, "b", "x", "s", 2), (2, "a", "x", "s", 1), (2, "a", "x", "s", 1), (3, "z", "x", "s", 1), (4, "a", "x", "s", 1), (4, "b", "y", "s", 2)], "publication int, path string, revision string, shape string, n_units int")
    sources = spark.createDataFrame([("a", "s", 1), ("b", "s", 2)], "path string, shape string, n_units int")
    assert rows(reads.publishable(files, sources)) == [(1, True, True), (2, False, True), (3, False, True), (4, True, False)]
    verdicts = spark.createDataFrame([(1, True), (2, True), (2, None)], "publication int, good boolean")
    assert rows(reads.assessed(spark.createDataFrame([(1,), (2,), (3,)], "publication int"), verdicts)) == [(1, "verified"), (2, "superseded"), (3, "unchanged")]


def test_pairs_and_sets(spark):
    s = spark.createDataFrame([("d", 0), ("d", 1), ("e", 0)], "doc string, n int")
    t = spark.createDataFrame([("d", 0, "x"), ("d", 1, "y"), ("e", 0, "z"), ("e", 1, "z")], "doc string, n int, text string")
    assert rows(reads.positional(s, t, ["doc"], "n")) == [("d", 0, "x"), ("d", 1, "y")]
    a = spark.createDataFrame([("e", 1), ("e", 1), ("p", 1), ("p", 2), ("b", 1), ("d", 1)], "k string, x int")
    b = spark.createDataFrame([("e", 1), ("p", 1), ("b", 1), ("b", 2), ("d", 2)], "k string, x int")
    assert rows(reads.set_relations(a, b, ["k"])) == [("b", "subset"), ("d", "differs"), ("e", "equal"), ("p", "superset")]


@pytest.mark.parametrize("text,ok", [('{"a":1}', True), ("1", True), (' "x" ', True), ("1,2", False), ("1] [2", False), ('{"a":1}}', False), ("", False), ("nul", False), (None, False)])
def test_json(spark, text, ok):
    assert spark.createDataFrame([(text,)], "x string").select(reads.json_ok(F.col("x")).alias("ok")).first()["ok"] is ok


def plan_of(df):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain()
    return said.getvalue()


def test_set_relations_join_and_sort_nothing(spark, monkeypatch):
    """Rows are dealt out by their number; one with a null equals no other, and a row listed twice counts once."""
    a = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (3, None), (4, 1), (5, 1), (5, 2), (None, 1)], "k long, x long")
    b = spark.createDataFrame([(1, 2), (1, 1), (2, 1), (2, 2), (3, None), (4, 2), (5, 2), (None, 1)], "k long, x long")
    monkeypatch.setattr(state, "ROWS_A_TASK", 2)
    got = reads.set_relations(a, b, ["k"])
    assert {r.k: r.relation for r in got.collect()} == {1: "equal", 2: "subset", 3: "differs", 4: "differs", 5: "superset", None: "differs"}
    said = plan_of(got)
    assert "Join" not in said and "Sort" not in said and "9), REPARTITION_BY_NUM" in said


def test_publishable_deals_files_out_by_their_number(spark, monkeypatch):
    """What is joined and grouped is dealt out, and nothing is sorted to be grouped by publication and path."""
    files = spark.createDataFrame([(1, 1, 0, 5, 1), (1, 2, 0, None, 1), (2, 1, 0, 5, 1), (2, 1, 1, 5, 1), (3, 2, 1, 6, 1), (4, 9, 1, 5, 1)], "publication long, path long, revision long, shape long, n_units int")
    sources = spark.createDataFrame([(1, 5, 1), (2, None, 1)], "path long, shape long, n_units int")
    monkeypatch.setattr(state, "ROWS_A_TASK", 1)
    got = reads.publishable(files, sources)
    assert {r.publication: (r.ok, r.uniform) for r in got.collect()} == {1: (True, True), 2: (False, False), 3: (False, True), 4: (False, True)}
    said = plan_of(got)
    assert said.count("6), REPARTITION_BY_NUM") >= 2 and "SortAggregate" not in said
