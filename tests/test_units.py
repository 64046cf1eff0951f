"""Single units, hints, selections and listings."""

import pytest
from pyspark.sql import functions as F

from weft.functions import hashing, text
from weft.operators import jsondoc, markdown, matching, stored
from weft.plans import planner, reads
from weft.sources import discovery


def test_json_tokens_round_trip():
    source = "Hi {{name}} / {{ user.name }} / {{name}}"
    masked, tokens = jsondoc.tokenize(source)
    assert masked == "Hi @@WEFT_JSON_0@@ / @@WEFT_JSON_1@@ / @@WEFT_JSON_2@@" and [v for _, v in tokens] == ["{{name}}", "{{ user.name }}", "{{name}}"]
    good = "@@WEFT_JSON_1@@: @@WEFT_JSON_2@@, @@WEFT_JSON_0@@"  # any order
    assert jsondoc.validate_tokens(source, good) == []
    for bad in (masked + " @@WEFT_JSON_0@@", masked.replace("@@WEFT_JSON_1@@", ""), good + " @@WEFT_JSON_7@@"):
        assert jsondoc.validate_tokens(source, bad) == ["JSON-TOKENS"]
    assert jsondoc.validate_tokens(source, good + " {{more}}") == ["JSON-PLACEHOLDERS"] and jsondoc.validate_tokens("plain", " ") == ["JSON-BLANK"]
    with pytest.raises(jsondoc.DocumentError):
        jsondoc.tokenize("a @@WEFT_JSON_0@@ b")
    with pytest.raises(jsondoc.DocumentError):
        jsondoc.tokenize("{{#if}}")


def test_stored_units():
    unit = stored.rebuilt("markdown", "Say `x` and `y`.")
    assert unit.kind == "Paragraph" and len(unit.spans) == 2
    assert stored.rebuilt("markdown", "Title", "Heading", "# Title\n\ntext\n").kind == "Heading"
    assert stored.rebuilt("markdown", "Title", "Paragraph", "# Title\n\ntext\n") is None and stored.rebuilt("mdx", "x") is None
    masked, _ = markdown.tokenize(unit)
    a, b = stored.reorderable("markdown", "Say `x` and `y`.")
    assert stored.validate("markdown", "Say `x` and `y`.", masked) == [] and stored.validate("markdown", "Say `x` and `y`.", f"{b} {a}") in ([], ["MD-STRUCTURE"])
    assert stored.validate("json", "a {{b}}", "a @@WEFT_JSON_0@@", interpolated=True) == [] and stored.validate("mdx", "a", "b") == ["DOCUMENT-CONTRACT"]
    assert stored.reorderable("json", "a {{b}}", True) == ["@@WEFT_JSON_0@@"] and stored.reorderable("json", "a {{b}}") == [] and stored.reorderable("mdx", "a") == []


def test_unit_findings(spark):
    rows = [("1", "markdown", "One", "Eins", False), ("2", "markdown", "One", "*Eins*", False), ("3", "json", "a {{b}}", "a", True), ("4", "json", "a", None, True), ("5", "mdx", "a", "b", None)]
    got = {r.unit_id: r.codes for r in stored.findings(spark.createDataFrame(rows, "unit_id string, format string, source string, target string, interpolated boolean")).collect()}
    assert got == {"1": [], "2": ["MD-STRUCTURE"], "3": ["JSON-TOKENS"], "4": [], "5": ["DOCUMENT-CONTRACT"]}


def test_hints_settle_duplicates(spark):
    unit = "doc_id long, ordinal long, source string, norm string, unit_kind string, context string, stable_id string, trusted boolean"
    rows = [(1, i, "Same.", "Same.", "Paragraph", "", f"s{i}", True) for i in range(2)]
    old = spark.createDataFrame(rows, unit)
    now = spark.createDataFrame(rows, unit)
    kinds = lambda new: [(r.ordinal, r.kind, r.stable_id) for r in matching.in_order(old, new).orderBy("ordinal").collect()]
    assert kinds(now) == [(0, "ambiguous", None), (1, "ambiguous", None)]
    known = spark.createDataFrame([("p", f"s{i}") for i in range(2)], "path string, unit_key string")
    new = reads.hinted(now.withColumn("path", F.lit("p")), known)
    assert kinds(new) == [(0, "exact", "s0"), (1, "exact", "s1")]
    assert kinds(reads.hinted(now.withColumn("path", F.lit("q")), known))[0][1] == "ambiguous"  # another document


def test_provenance(spark):
    row = {"path": "p", "source": "s", "kind": "k", "context": None, "contract": "c2"} | {f"now_{c}": v for c, v in {"path": "p", "source": "s", "kind": "k", "context": None}.items()}
    rows = [row, row | {"contract": "c0"}, row | {"now_path": "q"}, row | {"context": "x"}, row | {"contract": None}]
    table = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} string" for c in row))
    assert [r.valid for r in matching.provenance_ok(table, ["c1", "c2"]).collect()] == [True, False, False, False, False]


def test_selection(spark):
    repos = spark.createDataFrame([("/a/site",), ("/b/site/",), ("/c/docs",)], "path string")
    names = lambda w: sorted(r.path for r in planner.chosen(repos, "path", w, by_name=True).collect())
    assert names(None) == ["/a/site", "/b/site/", "/c/docs"] and names("site") == ["/a/site", "/b/site/"] and names("/c/docs") == ["/c/docs"]
    with pytest.raises(ValueError, match="nothing configured"):
        names("other")
    with pytest.raises(ValueError, match="nothing configured"):
        planner.chosen(spark.createDataFrame([("ja",)], "lang string"), "lang", "JA")


def test_listing(spark):
    full = "0123456789" * 4
    refs = spark.createDataFrame([("main", full), ("old", "12"), ("two", full), ("two", "f" * 40)], "name string, revision string")
    assert discovery.revision(refs, "main") == full and discovery.revision(refs, "f" * 64) == "f" * 64
    for name in ("old", "two", "none"):
        with pytest.raises(ValueError, match="one snapshot"):
            discovery.revision(refs, name)
    rules = [discovery.Rule("docs", ("**/*.md",), target="{relpath}.{lang}")]
    routed = discovery.route(spark.createDataFrame([("state/a.md",), ("b.md",)], "path string"), rules)
    got = {r.target: r.safe for r in discovery.targets(routed, spark.createDataFrame([("ja",)], "lang string"), ("state",)).collect()}
    assert got == {"state/a.md.ja": False, "b.md.ja": True}
    documents = spark.createDataFrame([("a", b"x"), ("b", b"y")], "path string, bytes binary")
    assert [(r.path, bytes(r.content), r.provenance) for r in planner.passed_through(documents, spark.createDataFrame([("a",)], "path string")).collect()] == [("b", b"y", "imported")]


def test_identity_functions(spark):
    """The rest of the identity functions, against hashlib and plain strings."""
    import hashlib
    import json

    row = spark.range(1).select(
        hashing.short_id(F.lit("x")).alias("short"), hashing.invocation_key(*[F.lit(c) for c in "abcde"]).alias("run"), hashing.json_pointer_id(F.lit("p"), F.lit("/x")).alias("pointer"),
        hashing.memory_key(b=F.lit(1), a=F.lit("é")).alias("memory"), discovery.agent_for(F.lit("repair"), {"translate": "t"}, "d").alias("agent"), text.mask(F.lit("a b a"), [("T", "a")]).alias("masked"),
    ).first()
    led = b"".join(len(x).to_bytes(8, "big") + x for x in (b"json-pointer-v1", b"p", b"/x"))
    assert row.short == hashlib.sha256(b"x").hexdigest()[:16] and row.run == "sync:a:b:c:d:e" and row.pointer == "unit-" + hashlib.sha256(led).hexdigest()[:24]
    assert row.memory == '{"a":"é","b":1}' and row.agent == "t" and row.masked == "T b T"
    own = spark.createDataFrame([("x", "y")], "a string, b string").select(hashing.self_hash(["a", "b"], ["b"]).alias("h")).first().h
    assert own == hashlib.sha256(json.dumps({"a": "x", "b": ""}, separators=(",", ":")).encode()).hexdigest()
    assert matching.placeholder_counts(["a", "b", "a"]) == {"a": 2, "b": 1}
