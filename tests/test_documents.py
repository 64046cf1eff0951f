"""Scanners and scalar rules: Markdown, JSON, configuration, placeholders."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.operators import jsondoc, markdown
from weft.sources import config, discovery

MD = """---
title: x
---
# Alpha *one*

First line with `code` and {name},
second line [link](http://a.b "title").

* tight item
* [x] done item
  continued

> quoted text

| head | two |
| ---- | --- |
| cell | `c` |

Term
: its meaning

```py
not text
```

    indented

<div>
raw
</div>

Setext
======

Repeated.

Repeated.
""".encode()


def test_markdown_units():
    units = markdown.parse(MD)
    assert [(u.kind, u.text.split("\n")[0]) for u in units] == [
        ("Heading", "Alpha *one*"), ("Paragraph", "First line with `code` and {name},"), ("ListItem", "tight item"), ("ListItem", "done item"), ("Paragraph", "quoted text"),
        ("TableCell", "head"), ("TableCell", "two"), ("TableCell", "cell"), ("DefinitionTerm", "Term"), ("Definition", "its meaning"), ("Heading", "Setext"), ("Paragraph", "Repeated."), ("Paragraph", "Repeated."),
    ]
    assert [u.kind for u in markdown.parse(b"- a\n\n- b\n\nc\n")] == ["Paragraph"] * 3
    assert all(MD[u.start : u.end].decode() == u.text for u in units)
    assert [u.id[-2:] for u in units[-2:]] == ["00", "01"]
    assert {s.kind for s in units[1].spans} == {"inline_code", "placeholder", "link_target"}


def test_markdown_golden_id():
    assert markdown.parse(b"Hello world.\n")[0].id == "md-f531bb73b1a3c75e-00"


def test_markdown_identity_and_change():
    units = markdown.parse(MD)
    assert markdown.assemble(MD, [(u.id, u.text, u.text) for u in units]) == MD
    out = markdown.assemble(MD, [(units[0].id, units[0].text, "Béta"), (units[-1].id, units[-1].text, "Again.")])
    assert "# Béta" in out.decode() and out.decode().endswith("Again.\n") and markdown.verify(MD, out)
    assert not markdown.verify(MD, MD.replace(b"# Alpha", b"## Alpha")) and not markdown.verify(MD, MD.replace(b"`code`", b"`kode`"))
    for bad in ([("md-0-00", "x", "y")], [(units[0].id, "other", "y")], [(units[0].id, units[0].text, "y")] * 2):
        with pytest.raises(ValueError):
            markdown.assemble(MD, bad)


def test_markdown_tokens():
    u = markdown.parse(MD)[1]
    masked, tokens = markdown.tokenize(u)
    assert "`code`" not in masked and markdown.restore(masked, tokens) == u.text and markdown.validate(u, masked) == []
    assert markdown.validate(u, masked.replace(tokens[0][0], "")) == ["MD-PROTECTED"]
    assert markdown.validate(u, masked + "@@WEFT_X@@") == ["MD-UNKNOWN-TOKEN"]
    assert markdown.validate(u, masked + " `new`") == ["MD-PROTECTED-CODE", "MD-STRUCTURE"]
    assert markdown.repair_strong("**Note** text", "**Hinweis**Text") == "**Hinweis** Text" and markdown.repair_strong("**a**b", "**a**c") == "**a**c"


def test_markdown_structure():
    """The whole signature counts: blocks beyond the second, and what stands within them in its order."""
    same = markdown.structure("one **two** and [three](x) `c`\nfour")
    assert same == markdown.structure("eins **zwei** und [drei](x) `k`\nvier") and same[0] == "Paragraph"
    for other in ("one two and [three](x) `c`\nfour", "one **two** and [three](y) `c`\nfour", "one [three](x) and **two** `c`\nfour", "one **two** and [three](x) `c` four", "one **two** and [three](x) `c`\nfour\n\nfive"):
        assert markdown.structure(other) != same, other
    u = markdown.parse(b"First\n")[0]
    assert markdown.validate(u, "Eins\n\nzwei\n\n# drei") == ["MD-STRUCTURE"] and markdown.validate(u, "*Eins*") == ["MD-STRUCTURE"] and markdown.validate(u, "Eins") == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# h", "text a", "- item", "", "> q", "| a | b |", "| - | - |", "```", "    code", "x `y` z", "Term", ": def", "é"]), max_size=14))
def test_markdown_identity_of_any_lines(lines):
    data = "\n".join(lines).encode()
    units = markdown.parse(data)
    assert markdown.assemble(data, [(u.id, u.text, u.text) for u in units]) == data
    assert all(a.end <= b.start for a, b in zip(units, units[1:], strict=False))


JS = rb'{"b": {"x/y": "Hi {{name}}", "~": "t\u00e9xt", "e": " "}, "a": ["one", 1.00, null, {"k": "v"}]}'


def test_json_leaves():
    leaves, signature = jsondoc.parse(JS)
    assert [(x.pointer, x.text) for x in leaves] == [("/a/0", "one"), ("/a/3/k", "v"), ("/b/x~1y", "Hi {{name}}"), ("/b/~0", "téxt")]
    assert all(json.loads(JS[x.start : x.end]) == x.text for x in leaves) and "/a/1:scalar:1.00" in signature and '/b/e:blank:" "' in signature


@pytest.mark.parametrize("bad", [b'{"a": 1, "a": 2}', b'{"a": 01}', b"[1,]", b'{"a" 1}', b'"\xff"', b'{"a": "x"} y', b'["\\ud800"]', b"[" * 70 + b"]" * 70, b'["' + b"x" * (70 << 10) + b'"]', b"nul", b""])
def test_json_refused(bad):
    with pytest.raises(ValueError):
        jsondoc.parse(bad)


def test_json_dialect():
    with pytest.raises(ValueError):
        jsondoc.parse(b'{"item_one": "x"}', interpolated=True)
    assert jsondoc.placeholders("{{ a.b }} {{a}} {{a}}") == {"{{ a.b }}": 1, "{{a}}": 2}
    assert jsondoc.validate("Hi {{n}}", "Ho {{n}}", True) == [] and jsondoc.validate("Hi {{n}}", "Ho", True) == ["JSON-PLACEHOLDERS"]
    assert jsondoc.validate("a", " ") == ["JSON-BLANK"] and jsondoc.validate("a", "x" * 70_000) == ["JSON-TOO-LONG"]


def test_json_assembly():
    assert jsondoc.assemble(JS, {"/b/~0": "téxt"}) == JS  # an unchanged literal keeps its bytes
    out = jsondoc.assemble(JS, {"/a/0": 'zwei "2"', "/b/x~1y": "Hallo"})
    assert json.loads(out)["a"][0] == 'zwei "2"' and b"t\\u00e9xt" in out and jsondoc.verify(JS, out)
    assert jsondoc.verify(b'{"a": "x", "b": 1}', b'{"b": 1, "a": "y"}') and not jsondoc.verify(b'{"a": 1}', b'{"a": 1.0}') and not jsondoc.verify(b'{"a": " "}', b'{"a": "  "}')
    with pytest.raises(ValueError):
        jsondoc.assemble(JS, {"/no": "x"})


def test_config():
    good = 'name = "r"\nlanguages = ["de", "pt-BR"]\n[[rules]]\nname = "docs"\ninclude = ["docs/**/*.md"]\nprefix = "docs"\ntarget = "i18n/{lang}/{relpath}"\n'
    s = config.parse(good)
    assert s.languages == ("de", "pt-BR") and s.rules[0].include == ("docs/**/*.md",) and s.max_tasks == 40
    for a, b in (("name =", "nome ="), ('"pt-BR"', '"de"'), ("{lang}", "x"), ("{relpath}", "{rel}"), ("i18n/", "../"), ('"pt-BR"', '"not a tag"'), ("prefix", "prefixx")):
        with pytest.raises(config.ConfigError):
            config.parse(good.replace(a, b, 1))


def test_globs():
    import re

    hit = lambda g, p: bool(re.match(discovery.glob_regex(g), p))
    assert hit("**/*.md", "a.md") and hit("**/*.md", "x/y/a.md") and not hit("*.md", "x/a.md") and hit("d/**", "d/x/y") and hit("{a,b}/?.md", "b/1.md") and hit("[!x]*", "abc") and not hit("[!x]*", "xbc")


def test_edited_target_gives_its_tokens_back():
    unit = lambda text: markdown.parse(text.encode())[0]
    source, target = unit("Use `a` and `b` for {{name}}, then `a`."), unit("Pour {{name}} : `a`, `b` et `a`.")
    _, tokens = markdown.tokenize(source)
    got = markdown.recovered(source, target)
    assert got is not None and markdown.restore(got, tokens) == target.text
    assert not markdown.validate(source, got)
    assert got.index(tokens[3][0]) < got.index(tokens[0][0])  # of equal spans the last takes the first token
    assert markdown.recovered(source, unit("Pour {{name}} : `a`, `b` et `c`.")) is None
    assert markdown.recovered(source, unit("# Use `a` and `b` for {{name}}, then `a`.")) is None
