"""Operators on tables, against plain readings and against SQL."""

import itertools

import duckdb
import plain_matching
import pytest
from pyspark.sql import functions as F

from weft import catalog, catalog_reads  # noqa: F401  the latter adds to the former
from weft.functions import hashing, text
from weft.operators import matching, protect, running, segment, similar, state
from weft.plans import planner, reads, report
from weft.sources import discovery
from weft.streaming import queue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([float(r[i]) if type(r[i]) in (int, float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_is_its_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sql.execute(catalog.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.columns, df.collect()) == plain(names, got.fetchall())


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first()["x"]


def test_normalized_is_unicode(spark):
    assert one(spark, text.normalized(F.col("a")), a="  a \n b \t") == "a b"


def test_text_functions(spark):
    assert one(spark, text.similarity(F.col("a"), F.col("b")), a="", b="") == 1 and one(spark, text.similarity(F.col("a"), F.col("b")), a="é", b="e") == 0
    assert one(spark, text.rfind(F.col("a"), "ab"), a="abxab") == 3 and one(spark, text.rfind(F.col("a"), "q"), a="ab") == -1
    assert one(spark, text.occurrences(F.col("a"), F.col("b")), a="a.a.", b=".") == 2
    assert one(spark, text.strip_prefix(F.col("a"), "docs"), a="docs/x") == "x" and one(spark, text.strip_prefix(F.col("a"), "docs"), a="docsx/x") is None
    assert one(spark, text.placeholders(F.col("a")), a="{{x}} ${Y} %(n)s %d%% {k:>3} @@T@@") == ["{{x}}", "${Y}", "%(n)s", "%d", "%%", "{k:>3}", "@@T@@"]
    for path, ok in (("a/b", True), ("/a", False), ("a/../b", False), ("", False), ("a//b", False)):
        assert one(spark, text.safe_target(F.col("a")), a=path) is ok


def test_hashes(spark):
    import hashlib

    parts = ["a", "é", ""]
    want = hashlib.sha256(b"".join(len(p.encode()).to_bytes(8, "big") + p.encode() for p in parts)).hexdigest()
    assert one(spark, hashing.parts_hash(*[F.lit(p) for p in parts]), a=1) == want
    assert one(spark, hashing.occurrence_id(hashing.fingerprint(F.lit("Paragraph"), F.col("a")), F.lit(0)), a="Hello  world.") == "md-f531bb73b1a3c75e-00"
    assert one(spark, hashing.occurrence_id(F.lit("f"), F.lit(123)), a=1) == "md-f-123"
    assert one(spark, hashing.memory_key(b=F.lit(1), a=F.lit("x")), a=1) == '{"a":"x","b":1}'


def unit(n, source, stable=None, kind="paragraph", context="c", trusted=True):
    return {"doc_id": 1, "ordinal": n, "source": source, "norm": " ".join(source.split()), "unit_kind": kind, "context": context, "stable_id": stable or f"s{n}", "trusted": trusted}


def test_matching_rules():
    kinds = lambda p, c, h=None: [m["kind"] for m in plain_matching.sequential(p, c, h)]
    assert kinds([unit(0, "Same text")], [unit(0, "Same text")]) == ["exact"]
    assert kinds([unit(0, "Same text")], [unit(3, "Same  text")]) == ["moved"]
    assert kinds([unit(0, "Twice."), unit(1, "Twice.")], [unit(0, "Twice."), unit(1, "Twice.")]) == ["ambiguous"] * 2
    assert kinds([unit(0, "Twice."), unit(1, "Twice.")], [unit(0, "Twice."), unit(1, "Twice.")], {0: "s0", 1: "s1"}) == ["exact"] * 2
    assert kinds([unit(0, "A sentence about cats.")], [unit(0, "A sentence about bats.")]) == ["fuzzy"]
    assert kinds([unit(0, "A sentence about cats."), unit(1, "A sentence about rats.")], [unit(0, "A sentence about bats.")]) == ["fuzzy"]
    assert kinds([unit(5, "A sentence about cats."), unit(6, "A sentence about rats.")], [unit(0, "A sentence about bats.")]) == ["ambiguous"]
    assert kinds([unit(0, "abc")], [unit(0, "something else")]) == ["new"] and kinds([unit(0, "x", context="d")], [unit(0, "x")]) == ["new"]
    assert kinds([unit(0, "Used up.")], [unit(0, "Used up."), unit(1, "Used up.")]) == ["exact", "new"]
    got = plain_matching.sequential([unit(0, "Some  text")], [unit(0, "Some text")])[0]
    assert got["kind"] == "exact" and not got["trusted_reuse"]  # trust needs equal bytes


def test_matching_table_agrees_with_rules(spark):
    units = segment.prose_units(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {(r.doc_id, r.ordinal): r.kind for r in catalog.match_in_order(spark, SF).collect()}
    by_text = {(r.doc_id, r.ordinal): r.kind for r in catalog.match_by_text(spark, SF).collect()}
    assert set(got) == {(r.doc_id, r.ordinal) for r in units.collect()}
    assert all(got[k] == v or v == "no_text_match" or "ambiguous" in (got[k], v) or got[k] == "new" for k, v in by_text.items())


def test_fuzzy_scores(spark):
    for r in catalog.match_fuzzy(spark, SF).limit(50).collect():
        assert r.score >= 0.72


def test_distance():
    import random

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randrange(80))) for _ in range(2))
        assert plain_matching.distance(a, b) == slow(a, b)


def test_fuzzy_agrees_with_rules(spark):
    """Alone with its document's units, each current unit gets what the sequential rule gives it."""
    old = [(1, i, f"sentence number {i} about {w} and more", True) for i, w in enumerate("cats dogs birds trees stones".split())]
    new = [(1, i, f"sentence number {i} on {w} and mere", True) for i, w in enumerate("bats hogs wolves trees".split())]
    cols = "doc_id long, ordinal long, norm string, trusted boolean"
    got = {r.ordinal: r for r in matching.fuzzy(spark.createDataFrame(old, cols), spark.createDataFrame(new, cols)).collect()}
    for _, n, norm, _ in new:
        want = plain_matching.sequential([unit(i, s) for _, i, s, _ in old], [unit(n, norm)])[0]
        r = got.get(n)
        assert want["kind"] == ("new" if r is None else "ambiguous" if r.ambiguous else "fuzzy")
        if want["kind"] == "fuzzy":
            assert (r.p_ordinal, r.score) == (want["previous_ordinal"], round(want["score"], 9))


def test_rounds_shuffle_no_texts(spark):
    """Texts are shuffled where they are numbered and where similar ones are sought, and not in every round."""
    import random

    rng = random.Random(2)
    text = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(4000)).strip()
    lines = [text() for _ in range(150)]
    old = [(1, i, x, " ".join(x.split()), "p", "", f"s{i}", True) for i, x in enumerate(lines)]
    new = [(1, i, x, " ".join(x.split()), "p", "", f"s{i}", True) for i, x in enumerate(lines)]
    cols = "doc_id long, ordinal long, source string, norm string, unit_kind string, context string, stable_id string, trusted boolean"
    old, new = (spark.createDataFrame(x, cols) for x in (old, new))
    sc = spark.sparkContext

    def written():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    got = matching.in_order(old, new).collect()
    assert len(got) == 150 and all(r.kind == "exact" and r.trusted_reuse for r in got)
    # a text goes around once on either side, and once more where those that ask for similar ones are picked
    assert written() - before < 4 * sum(map(len, lines)), (written() - before, sum(map(len, lines)))


def test_edits_are_those_of_the_table(monkeypatch):
    import random

    import pyarrow as pa

    from weft.functions import edits

    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcé𝒳 d") for _ in range(n))
    pairs = [("", ""), ("", "ab"), ("abc", "abc"), ("ab" * 3000, "x" + "ab" * 3000), (text(3000), text(3000)), ("a" * 5000, "b" * 5000)]
    for _ in range(1500):
        a = text(rng.choice([1, 2, 3, 9, 60, 200]))
        b = list(a) if rng.random() < 0.7 else list(text(rng.choice([1, 3, 9, 60, 200])))
        for _ in range(rng.randrange(2 + len(b) // 3)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choice(["x", "", "é"])
        pairs.append((a, "".join(b)))
    real = [plain_matching.distance(a, b) for a, b in pairs]
    most = [max(0, d + rng.randrange(-3, 4)) if rng.random() < 0.7 else rng.randrange(len(a) + 1) for d, (a, _) in zip(real, pairs, strict=True)]
    want = [d if d <= m else -1 for d, m in zip(real, most, strict=True)]
    columns = [pa.array(x) for x in zip(*pairs, strict=True)]
    for cells, chars in ((edits.CELLS, edits.SLICE_CHARS), (1 << 9, 300)):
        monkeypatch.setattr(edits, "CELLS", cells)
        monkeypatch.setattr(edits, "SLICE_CHARS", chars)
        assert edits.within(*columns, pa.array(most, pa.int32())).to_pylist() == want
    assert min(want.count(-1), len(want) - want.count(-1)) > 300
    # by counts alone some far pairs are told, at once and however long
    a, b = ([text(300) for _ in range(200)] for _ in range(2))
    monkeypatch.setattr(edits, "distance", lambda a, b, most: 1 / 0)
    assert set(edits.within(pa.array(a), pa.array(b), pa.array([20] * 200)).to_pylist()) == {-1}


def test_similar_texts_are_shuffled_once(spark, monkeypatch):
    """Pairs are met by ids: a text goes to its pairs once, and with them to the other text."""
    import random

    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    # lengths double, so no text meets another than its own
    old = [(d, i, text(100 << i)) for d in range(20) for i in range(8)]
    new = [(d, i, "y" + x) for d, i, x in old]
    columns = "doc_id long, ordinal long, norm string"
    old, new = (spark.createDataFrame(x, columns) for x in (old, new))
    sc = spark.sparkContext

    def written():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    def pairs():
        before = written()
        found = similar.pairs(old, new, ["doc_id"], ["ordinal"], ["ordinal"])
        assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
        got = found.collect()
        return sorted((r.doc_id, r.ordinal, r.p_ordinal, r.score) for r in got), written() - before

    got, moved = pairs()
    assert [r[:3] for r in got] == [(d, i, i) for d in range(20) for i in range(8)]
    # small tables are broadcast, so a text is dealt out with its pair; before, it went around more than three times
    chars = sum(len(x) for _, _, x in new.collect())
    assert moved < 2.5 * chars, (moved, chars)
    monkeypatch.setattr(similar, "BROADCAST", 0)
    monkeypatch.setattr(similar, "PAIRS_A_TASK", 100)
    assert pairs()[0] == got


def edited(rng, norm):
    out = list(norm)
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(out) + 1)
        out[i : i + rng.randrange(2)] = rng.choice(["é", "x", "", "𝒳 "])
    return " ".join("".join(out).split()) or "y"


def revisions(rng, n_docs, lines, words):
    """Documents and what became of them: lines kept, edited, repeated, moved, dropped and new ones."""
    unit_of = lambda d, i, t, s: (d, i, t, " ".join(t.split()), rng.choice(["p", "p", "p", "h"]), "", f"u{d}-{s}", rng.random() < 0.8)
    old, new = [], []
    for d in range(n_docs):
        text = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(lines))]
        text += rng.choices(text, k=lines // 4) if text else []
        now = [edited(rng, t) if rng.random() < 0.4 else t for t in text if rng.random() < 0.85]
        now += rng.choices(now, k=lines // 5) if now else []
        if rng.random() < 0.5:
            rng.shuffle(now)
        old += [unit_of(d, i, t, i) for i, t in enumerate(text)]
        new += [(*unit_of(d, i, t, i), f"u{d}-{rng.randrange(lines)}" if rng.random() < 0.2 else None) for i, t in enumerate(now)]
    return old, new


@pytest.mark.parametrize("piece", [4096, 3])
def test_rounds_agree_with_the_sequential_rule(spark, monkeypatch, piece):
    import random

    monkeypatch.setattr(running, "PIECE", piece)
    monkeypatch.setattr(similar, "FEW", 64 if piece > 3 else 1)
    old, new = revisions(random.Random(piece), 14, 16, "alpha beta gamma alphas betas gammy delta".split())
    columns = "doc_id long, ordinal long, source string, norm string, unit_kind string, context string, stable_id string, trusted boolean"
    names = [c.split()[0] for c in columns.split(", ")] + ["hint"]
    for with_hints in (False, True):
        current = spark.createDataFrame(new, columns + ", hint string")
        got = matching.in_order(spark.createDataFrame(old, columns), current if with_hints else current.drop("hint")).collect()
        got = sorted((r.doc_id, r.ordinal, r.kind, round(r.score or 0, 9), r.previous_ordinal, r.stable_id, r.trusted_reuse) for r in got)
        want = []
        for d in {r[0] for r in new}:
            p, c = ([dict(zip(names, r, strict=False)) for r in rows if r[0] == d] for rows in (old, new))
            hints = {i: u["hint"] for i, u in enumerate(c) if u["hint"]} if with_hints else None
            want += [(m["doc_id"], m["ordinal"], m["kind"], round(m["score"] or 0, 9), m["previous_ordinal"], m["stable_id"], m["trusted_reuse"]) for m in plain_matching.sequential(p, c, hints)]
        assert got == sorted(want)
        assert {r[2] for r in got} == {"exact", "moved", "fuzzy", "ambiguous", "new"}


@pytest.mark.parametrize("few", [64, 0])
def test_pairs_are_all_found(spark, monkeypatch, few):
    import random

    monkeypatch.setattr(similar, "FEW", few)
    rng = random.Random(few)
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    old = [(1 + (i % 3 == 0), i, t) for i, t in enumerate(base)] + [(None, 1, "one")]
    new = [(1 + (i % 3 == 0), (i * 7) % 60, edited(rng, edited(rng, t))) for i, t in enumerate(base)] + [(None, 1, "one"), (1, 5, "")]
    columns = "doc_id long, ordinal long, norm string"
    got = {(r.doc_id, r.ordinal, r.p_ordinal): r.score for r in similar.pairs(spark.createDataFrame(old, columns), spark.createDataFrame(new, columns), ["doc_id"], ["ordinal"], ["ordinal"]).collect()}
    want = {}
    for (d, i, a), (e, j, b) in itertools.product(new, old):
        if d is not None and d == e:
            longer = max(len(a), len(b))
            score = text.TEXT_WEIGHT * (1 - plain_matching.distance(a, b) / longer) + text.PLACE_WEIGHT / (1 + abs(i - j))
            if score >= text.FUZZY_FLOOR:
                want[d, i, j] = score
    assert got == pytest.approx(want) and sum(abs(i - j) > similar.NEARBY for _, i, j in want) > 10


def test_pieces_are_as_long_as_stated():
    for n in range(1, 30_000):
        q = next(q for least, q in similar.PIECE_CHARS if n >= least)
        assert n // (similar.most_edits(n) + 1) >= q


def test_unmatched_is_what_no_text_matches(spark):
    columns = "doc_id long, ordinal long, norm string, source string, trusted boolean"
    old = spark.createDataFrame([(1, 0, "a", "a", True), (1, 1, "b", "b", True), (2, 0, "c", "c", False), (None, 0, "d", "d", True)], columns)
    new = spark.createDataFrame([(1, 0, "b", "b", True), (1, 1, "c", "c", True), (1, 2, "c", "c", True), (2, 0, "c", "c", True), (3, 0, "a", "a", True), (None, 0, "d", "d", True)], columns)
    want = sorted((r.doc_id or 0, r.ordinal) for r in matching.by_text(old, new).filter("kind = 'no_text_match'").collect())
    got = matching.unmatched(old, new)
    assert got.columns == new.columns and sorted((r.doc_id or 0, r.ordinal) for r in got.collect()) == want == [(0, 0), (1, 1), (1, 2), (3, 0)]


def test_running_totals(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), i, rng.choice([None, 1, 5]), rng.randrange(100)) for i in range(300)]
    got = running.totals(spark.createDataFrame(rows, "k string, i long, v long, x long"), ["k"], running.pieces("i", 7), [F.col("i")], {"s": (F.sum, F.col("v")), "o": (F.bit_xor, F.col("x"))})
    assert got.columns == ["k", "i", "v", "x", "s", "o"]
    so_far = {}
    for k, i, v, x in rows:
        s, o = so_far.get(k, (0, 0))
        so_far[k] = so_far[k, i] = (s + (v or 0), o ^ x)
    assert {(r.k, r.i): (r.s, r.o) for r in got.collect()} == {k: v for k, v in so_far.items() if isinstance(k, tuple)}
    assert {(r.k, r.i): r.n for r in running.numbered(spark.createDataFrame(rows, "k string, i long, v long, x long"), ["k"], running.pieces("i", 7), [F.col("i")], "n").collect() if r.k == "b"} == {("b", i): n + 1 for n, i in enumerate(i for k, i, _, _ in rows if k == "b")}


def test_closure_of_long_and_dense_graphs(spark, monkeypatch):
    rounds = []

    def keep(df):
        rounds.append(df)
        return state.cut(df)

    chain = spark.range(3000).select(F.col("id").cast("string").alias("parent"), (F.col("id") + 1).cast("string").alias("child"))
    assert state.closure(chain, "5", keep).count() == 2996 and len(rounds) <= 2 * 13 + 1
    # a cycle, and layers of which every node leads to all of the next
    edges = [(f"{i}", f"{(i + 1) % 7}") for i in range(7)] + [(f"a{i}{j}", f"a{i + 1}{k}") for i in range(9) for j in range(5) for k in range(5)] + [("3", "a00"), (None, "x"), ("z", "y")]
    want, front = {"2"}, {"2"}
    while front:
        front = {b for a, b in edges if a in front} - want
        want |= front
    table = spark.createDataFrame(edges, "parent string, child string")
    assert {r.node for r in state.closure(table, "2").collect()} == want
    monkeypatch.setattr(state, "GROWTH", 0)
    assert {r.node for r in state.closure(table, "2").collect()} == want


def test_reviews_use_no_budget(spark):
    rows = [("g", 1, 0, False), ("g", 1, 1, True), ("g", 2, 0, False), ("g", 3, 0, False), ("h", 1, 0, True), ("h", 9, 0, False)]
    df = spark.createDataFrame(rows, "lang string, doc_id long, ordinal long, trusted_reuse boolean")
    queued = lambda reviews: {(r.lang, r.doc_id, r.ordinal) for r in planner.enqueued(df, ["lang"], ["doc_id", "ordinal"], running.pieces("doc_id", 1), 2, reviews).filter("enqueue").collect()}
    assert queued(False) == {("g", 1, 0), ("g", 2, 0), ("h", 9, 0)} and queued(True) == queued(False) | {("g", 1, 1), ("h", 1, 0)}


def test_reusable(spark):
    rows = [(1, 1, "old", True, False, "p", None), (1, 2, "new", False, True, "p", None), (2, 3, "", True, True, "p", None), (2, 4, "x", False, True, "q", None), (3, 5, "x", False, True, "p", "m0"), (3, 6, "y", False, True, "p", "m1")]
    df = spark.createDataFrame(rows, "unit_id long, candidate_id long, text string, trusted boolean, allowed boolean, policy string, model string")
    assert {r.unit_id: r.text for r in matching.reusable(df, "p", ["m0"]).collect()} == {1: "old", 3: "x"}


def test_spans(spark):
    df = spark.createDataFrame([(1, 0, 5, 0), (1, 1, 3, 1), (1, 5, 8, 2), (2, 0, 5, 0), (2, 3, 9, 1), (3, 0, 4, 0), (3, 0, 4, 1)], "k int, start int, end int, nth int")
    assert {(r.k, r.nth): r.crossing for r in protect.normalize(df, ["k"]).collect()} == {(1, 0): False, (1, 2): False, (2, 0): False, (2, 1): True, (3, 0): False}
    df = spark.createDataFrame([("Hi {a} `c` {a}",)], "source string").withColumn("t", protect.tokens_of(F.col("source"))).withColumn("m", protect.tokenize(F.col("source"), F.col("t")))
    codes = lambda target: df.select(protect.unit_findings(F.col("source"), target, F.col("t")).alias("x")).first().x
    assert codes(F.col("m")) == [] and codes(F.lit("nothing")) == ["MD-PROTECTED"] * 2 and codes(F.concat("m", F.lit("`d`"))) == ["MD-PROTECTED-CODE"] and codes(F.concat("m", F.lit("@@WEFT_Q@@"))) == ["MD-UNKNOWN-TOKEN"]
    assert one(spark, protect.repaired(F.col("a"), F.col("b")), a="**N** x", b="**M**y") == "**M** y"


def test_documents(spark):
    files = [("a.md", "markdown", b"# T\n\ntext\n"), ("b.json", "json", b'{"k": "v"}'), ("c.json", "json", b'{"k": 1, "k": 2}'), ("d.mdx", "mdx", b"x"), ("e.md", "markdown", b"\xff"), ("f.md", "markdown", None)]
    got = segment.document_units(spark.createDataFrame(files, "path string, format string, bytes binary")).collect()
    assert [(r.path, r.source) for r in got if not r.error] == [("a.md", "T"), ("a.md", "text"), ("b.json", "v")] and {r.path for r in got if r.error} == {"c.json", "d.mdx", "e.md"}


def test_discovery(spark):
    rules = [discovery.Rule("docs", ("docs/**",), ("docs/skip/**",), "docs", "i18n/{lang}/{relpath}"), discovery.Rule("one", ("README.md",), target="README.{lang}.md", single=True), discovery.Rule("both", ("docs/x.md",))]
    files = spark.createDataFrame([(p,) for p in ("docs/a.md", "docs/skip/b.md", "README.md", "docs/x.md", "docs/p.png", "src/q.md")], "path string")
    got = {r.path: (r.rule, r.relpath, r.error) for r in discovery.route(files, rules, strict=False).collect()}
    assert got == {"docs/a.md": ("docs", "a.md", None), "README.md": ("one", "README.md", None), "docs/x.md": ("docs", "x.md", "MULTIPLE-RULES"), "docs/p.png": ("docs", "p.png", "FORMAT")}
    with pytest.raises(ValueError, match="MULTIPLE-RULES|FORMAT"):
        discovery.route(files, rules)
    fine = discovery.route(files.filter("path in ('docs/a.md', 'README.md')"), rules)
    langs = spark.createDataFrame([("de",)], "lang string")
    assert {r.target for r in discovery.targets(fine, langs).collect()} == {"i18n/de/a.md", "README.de.md"}
    assert discovery.single_violations(fine.filter("rule = 'docs'"), rules).collect()[0].n == 0
    assert discovery.rediscovered(spark.createDataFrame([("docs/de/a.md",), ("i18n/a.md",)], "target string"), rules).count() == 1
    a = spark.createDataFrame([("a/b",), ("a/bc",), ("x",)], "path string")
    b = spark.createDataFrame([("a",), ("a/b",), ("a/b/c",)], "path string")
    want = {(p, q) for p, q in itertools.product(["a/b", "a/bc", "x"], ["a", "a/b", "a/b/c"]) if p == q or p.startswith(q + "/") or q.startswith(p + "/")}
    got = [(r.a, r.b) for r in discovery.overlaps(a, b).collect()]
    assert set(got) == want and len(got) == len(want)


def test_budget(spark):
    df = spark.createDataFrame([(2, 0), (1, 1), (1, 0)], "doc_id long, ordinal long")
    assert {(r.doc_id, r.ordinal): r.scheduled for r in planner.budgeted(df, ["doc_id", "ordinal"], 2).collect()} == {(1, 0): True, (1, 1): True, (2, 0): False}
    assert not any(r.scheduled for r in planner.budgeted(df, ["doc_id", "ordinal"], 0).collect())
    plan = spark.createDataFrame([(1, "new", False)] * 3, "doc_id long, kind string, trusted_reuse boolean").withColumn("lang", F.lit("de"))
    s = planner.summary(plan, ["lang"], 1).first()
    assert (s.pending, s.deferred) == (1, 2)


def test_gates(spark):
    units = spark.createDataFrame([(1, "x", True), (1, None, True), (2, "x", False), (2, None, False), (3, "x", False)], "doc_id long, translation string, scheduled boolean")
    docs = planner.verified(units)
    assert {r.doc_id: r.state for r in docs.collect()} == {1: "failed", 2: "skipped", 3: "verified"}
    ok, bad = spark.createDataFrame([("warning",)], "severity string"), spark.createDataFrame([("error",)], "severity string")
    assert planner.batch(docs, ok).count() == 1 and planner.batch(docs, bad).count() == 0
    r = spark.createDataFrame([(" ok ", True), ("new", True), ("new", False)], "o string, b boolean").select(*[c.alias(n) for c, n in zip(planner.review(F.col("o"), F.col("b"), F.lit("t")), "vx", strict=True)]).collect()
    assert [(x.v, x.x) for x in r] == [("approved", "t"), ("replaced", "new"), ("warned", "t")]
    tries = []
    planner.repair(spark.createDataFrame([(1,)], "task_id long"), lambda df, n: tries.append(n) or df.withColumn("outcome", F.lit("candidate" if n == 1 else "failed")), 5)
    assert tries == [0, 1]


def test_state(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "k long, seq long, v string").withColumn("created", F.col("seq"))
    got = {r.k: (r.v, r.created) for r in state.upsert(rows.filter("seq = 1"), rows.filter("seq > 1"), ["k"], "seq", "created").collect()}
    assert got == {1: ("b", 1), 2: ("c", 3)} and {r.k for r in state.insert_absent(rows.filter("k = 1"), rows, ["k"], "seq").collect()} == {2}
    known = spark.createDataFrame([(1, 4)], "k long, attempt_no long")
    assert sorted((r.k, r.attempt_no) for r in state.attempt_numbers(rows, ["k"], ["seq"], known).collect()) == [(1, 5), (1, 6), (2, 1)]
    moves = spark.createDataFrame([("pr_open", "push_pending"), ("push_pending", "pr_open"), ("merged", "superseded"), ("merged", "merged")], "a string, b string")
    assert [r.ok for r in moves.select(state.may_move(F.col("a"), F.col("b")).alias("ok")).collect()] == [False, True, False, True]
    assert state.conflicts(rows, ["k"], "v").collect()[0].k == 1
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a"), ("x", "y")], "parent string, child string")
    assert {r.node for r in state.closure(edges, "r").collect()} == {"r", "a", "b"}


def test_queue():
    e = lambda kind, at, owner="w", **more: {"kind": kind, "at": at, "owner": owner} | more
    fold = lambda *es: [s := None] and __import__("functools").reduce(queue.step, es, None)
    assert fold(e("enqueue", 0), e("claim", 5))["status"] == "processing"
    assert fold(e("enqueue", 10), e("claim", 5))["status"] == "pending"
    held = [e("enqueue", 0), e("claim", 0, "a")]
    assert fold(*held, e("claim", queue.LEASE_MS - 1, "b"))["owner"] == "a"
    assert fold(*held, e("claim", queue.LEASE_MS, "b")) | {} and fold(*held, e("claim", queue.LEASE_MS, "b"))["attempts"] == 2
    assert fold(*held, e("claim", 1, "b", owner_alive=False))["owner"] == "b"
    assert fold(*held, e("complete", 1, "b"))["status"] == "processing" and fold(*held, e("complete", 1, "a"), e("claim", 2))["status"] == "done"
    assert fold(*held, e("retry", 1, "a"))["available_at"] == 1 + queue.RETRY_MS and fold(*held, e("supersede", 1, "z"))["status"] == "processing"
    lease = lambda *es: __import__("functools").reduce(queue.lease_step, es, None)
    a = e("acquire", 0, "a", ttl=10)
    assert lease(a, e("acquire", 9, "b", ttl=10))["token"] == 1 and lease(a, e("acquire", 10, "b", ttl=10))["token"] == 2 and lease(a, e("acquire", 5, "a", ttl=10))["token"] == 1
    assert lease(a, e("release", 5, "a"), e("acquire", 5, "b", ttl=1))["token"] == 2 and lease(a, e("renew", 11, "a", ttl=5))["refused"] == 1
    assert queue.effect_key("k", {"k": 1, "k:after:1": 2}) == "k:after:1:after:2".replace("k:after:1:after:2", "k:after:2")


def test_queue_stream_agrees_with_batch(spark, tmp_path):
    log = catalog._log(spark, SF, {"view": "enqueue", "click": "claim", "purchase": "complete", "error": "retry"}, "claim")
    log.write.parquet(f"{tmp_path}/log")
    stream = queue.stream_queue(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log"))
    q = stream.writeStream.outputMode("update").format("memory").queryName("queue_states").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {r.key: (r.status, r.attempts) for r in spark.table("queue_states").collect()}
    assert got == {r.key: (r.status, r.attempts) for r in queue.fold_queue(log).collect()}


def test_report(spark):
    rows = spark.createDataFrame([("de", "ok", 1, 2, 3, 0), ("fr", "partial", 1, 2, 2, 1)], "language string, status string, documents long, calls long, attempts long, failures long")
    t = report.totals(rows).first()
    assert (t.status, t.retries) == ("partial", 1)
    assert report.as_json(rows).first().report.startswith('{"schema":4,"status":"partial"') and "| fr | partial | 1 | 2 | 1 |" in report.as_markdown(rows).first().report


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4 and set(entry.oracle_sql()) <= set(entry.queries())
