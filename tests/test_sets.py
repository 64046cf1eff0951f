"""What held at a time, file sets and routing against plain readings on small random tables."""

import hashlib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weft.operators import filesets, history
from weft.sources import discovery


def plain_as_of(rows, entries, earlier):
    out = []
    for i, k, at in rows:
        fits = [e for e in entries if k is not None and at is not None and e[0] == k and e[1] is not None and (e[1] < at or (not earlier and e[1] == at))]
        best = max(fits, key=lambda e: (e[1], e[2] is not None, e[2] or 0), default=None)
        out.append((i, k, at, best and best[1], best and best[2]))
    return Counter(out)


@pytest.mark.parametrize("earlier", [False, True])
@pytest.mark.parametrize("size", [1, 4, 100])
def test_as_of_is_the_newest_entry_that_is_not_later(spark, earlier, size):
    rng = random.Random(size)
    some = lambda n: rng.choice([None, *range(n)])
    rows = [(rng.randrange(30), some(4), some(20)) for _ in range(120)]  # repeated ones too
    entries = [(some(4), some(20), some(9)) for _ in range(60)]
    left, right = spark.createDataFrame(rows, "i int, k int, at int"), spark.createDataFrame(entries, "k int, at int, tie int")
    got = history.as_of(left, right, ["k"], "at", F.floor(F.col("at") / size), ("tie",), earlier)
    assert got.columns == ["i", "k", "at", "at_found", "tie"]
    assert Counter(map(tuple, got.collect())) == plain_as_of(rows, entries, earlier)


def test_as_of_empty_tables_and_clashing_names(spark):
    rows, entries = spark.createDataFrame([(1, 5)], "k int, at int"), spark.createDataFrame([], "k int, at int, x string")
    p = F.floor(F.col("at") / 10)
    assert [tuple(r) for r in history.as_of(rows, entries, ["k"], "at", p).collect()] == [(1, 5, None, None)]
    assert history.as_of(rows.limit(0), entries, ["k"], "at", p).count() == 0
    with pytest.raises(ValueError, match="both sides"):
        history.as_of(rows.withColumn("X", F.lit(1)), entries, ["k"], "at", p)


def test_as_of_of_a_key_with_most_rows_has_no_large_window(spark):
    rows = spark.range(40_000).select(F.lit(1).alias("k"), F.col("id").alias("at"))
    entries = spark.range(0, 40_000, 1000).select(F.lit(1).alias("k"), F.col("id").alias("at"), F.col("id").alias("v"))
    got = history.as_of(rows, entries, ["k"], "at", F.floor(F.col("at") / 512))
    assert got.filter(F.col("v") != F.floor(F.col("at") / 1000) * 1000).count() == 0 and got.count() == 40_000


def test_previous_texts_of_contracts_and_memory(spark):
    at = lambda n: F.to_timestamp(F.format_string("2024-%02d-01 00:00:00", F.col(n)))
    units = spark.createDataFrame([(1, "ja", 5, "a"), (1, "ja", 5, "b"), (1, "ja", 5, None), (1, "ko", 5, "a"), (2, "ja", 2, "a"), (2, "ja", 2, "a")], "unit_id int, locale string, m int, contract string").withColumn("at", at("m")).drop("m")
    versions = spark.createDataFrame([(1, "ja", 2, 10, "va", "a", True), (1, "ja", 3, 11, "vn", None, True), (1, "ja", 4, 12, "vb", "b", True), (1, "ja", 4, 13, "off", "a", False), (1, "ja", 5, 14, "now", "a", True)], "unit_id int, locale string, m int, id int, text string, contract string, active boolean").withColumn("at", at("m")).drop("m")
    memory = spark.createDataFrame([(1, "ko", 1, 1, "m1"), (1, "ko", 1, 2, "m2"), (2, "ja", 2, 3, "late")], "unit_id int, locale string, m int, id int, text string").withColumn("at", at("m")).drop("m")
    got = sorted((tuple(r) for r in history.previous_texts(units, versions, memory).select("unit_id", "locale", "contract", "previous", "origin").collect()), key=str)
    assert got == sorted([(1, "ja", "a", "vn", "version"), (1, "ja", "b", "vb", "version"), (1, "ja", None, "vn", "version"), (1, "ko", "a", "m2", "memory"), (2, "ja", "a", None, None), (2, "ja", "a", None, None)], key=str)


def test_files_as_of_ends_with_a_superseded_manifest(spark):
    at = lambda n: F.to_timestamp(F.format_string("2024-%02d-01 00:00:00", F.col(n)))
    asked = spark.createDataFrame([("r", n) for n in (1, 2, 4, 6)], "k string, m int").withColumn("at", at("m")).drop("m")
    manifests = spark.createDataFrame([("r", 2, 1, "merged"), ("r", 4, 2, "merged"), ("r", 5, 2, "superseded")], "k string, m int, manifest int, state string").withColumn("at", at("m")).drop("m")
    files = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "manifest int, path string")
    got = history.files_as_of(asked, manifests, files, ["k"]).select(F.month("at"), "manifest", "path").collect()
    assert sorted(map(tuple, got)) == [(2, 1, "a"), (2, 1, "b"), (4, 2, "a")]


def test_file_sets_with_nulls_repeats_and_missing_groups(spark):
    rng = random.Random(7)
    pick = lambda *x: rng.choice(x)
    rows = lambda n: [(pick(None, 1, 2, 3, 4, 5, 6, 7, 8), pick(None, "", "a", "b,1:", "1:a"), pick(None, "", "x")) for _ in range(n)]
    a = rows(40)
    b = [r for r in a if r[0] not in (2, 3)] + [r for r in a if r[0] == 3][1:] + [(9, "a", "x"), (9, "a", "x")]
    rng.shuffle(b)
    schema = "g int, path string, content string"
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    groups = lambda x: {g: Counter(r[1:] for r in x if r[0] == g) for g in {r[0] for r in x}}
    ga, gb = groups(a), groups(b)
    same = {r.g: r.same for r in filesets.same_sets(da, db, ["g"], ["path", "content"]).collect()}
    assert same == {g: ga.get(g) == gb.get(g) for g in {*ga, *gb}}
    ca, cb = Counter(a), Counter(b)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filesets.differences(da, db, ["g"], ["path", "content"]).collect()}
    assert got == {r: (ca[r], cb[r]) for r in {*ca, *cb} if ca[r] != cb[r]}
    said = {r.g: r.outcome for r in filesets.replayed(da, db, ["g"], ["path", "content"]).collect()}
    assert said == {g: "new" if g not in ga else "replay" if ga[g] == gb[g] else "conflict" for g in gb}
    none = da.limit(0)
    assert filesets.same_sets(none, none, ["g"], ["path"]).count() == 0


def test_values_that_run_together_are_told_apart(spark):
    a, b = spark.createDataFrame([(1, "a,1:b", "c")], "g int, x string, y string"), spark.createDataFrame([(1, "a", "b,1:c")], "g int, x string, y string")
    assert not filesets.same_sets(a, b, ["g"], ["x", "y"]).head().same


def test_manifests_hash_in_order_whatever_the_partitions(spark):
    rows = [(g, p, f"h{p}é") for g in (1, 2, None) for p in range(50)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "g int, path int, content_hash string").repartition(7)
    got = {r.g: r.manifest for r in filesets.manifests(df, ["g"], ["path"], ["path", "content_hash"]).collect()}
    want = hashlib.sha256(json.dumps([{"path": p, "content_hash": f"h{p}é"} for p in range(50)], separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert got == {1: want, 2: want, None: want}
    assert filesets.manifests(df.limit(0), ["g"], ["path"], ["path"]).count() == 0


def test_rules_found_by_prefix_are_those_that_all_patterns_give(spark):
    rng = random.Random(11)
    part = lambda: rng.choice(["a", "b", "a.b", "*", "?", "**", "[ab]", "{a,b}", "a*"])
    last = lambda: rng.choice(["*.md", "a.md", "*", "**", "*.m?", "*.{md,json}", "[ab].json", "*b", "a", ".md"])
    glob = lambda: "/".join([part() for _ in range(rng.randrange(3))] + [last()])
    rules = [discovery.Rule(f"r{i}", tuple(glob() for _ in range(rng.randrange(1, 3))), tuple(glob() for _ in range(rng.randrange(2)))) for i in range(60)]
    name = lambda: rng.choice(["a", "b", "a.b", "ab", "c"])
    paths = ["/".join([name() for _ in range(rng.randrange(4))] + [rng.choice(["a.md", "b.md", "a.json", "a", "b", "ab", ".md", "a.mx", "c.txt"])]) for _ in range(80)] + [None, "", "/a.md", "a//b.md", "a/"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    each = F.filter(F.array(*[F.when(discovery.matches(F.col("path"), r), F.lit(i)) for i, r in enumerate(rules)]), lambda i: i.isNotNull())
    want = {r.path: r.hits for r in df.distinct().select("path", each.alias("hits")).collect() if r.hits}
    got = {r.path: (r._n, r._i) for r in discovery.rule_hits(df, rules).collect()}
    assert got == {p: (len(x), min(x)) for p, x in want.items()}


def test_ten_thousand_rules_make_one_small_plan(spark):
    rules = [discovery.Rule(f"r{i}", (f"d{i}/*.md",)) for i in range(10_000)]
    files = spark.range(2000).select(F.concat(F.lit("d"), F.col("id") * 7, F.lit("/x.md")).alias("path"))
    routed = discovery.route(files, rules, strict=False)
    plan = routed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("rlike") <= 2 and len(plan) < 20_000
    assert routed.count() == len(range(0, 10_000, 7)) and routed.filter("error is not null").count() == 0
