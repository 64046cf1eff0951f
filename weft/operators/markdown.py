"""Markdown documents: a line-based block scanner that finds translatable units with byte spans.

It covers headings (both styles), paragraphs, tight and loose lists with task marks, block quotes, tables, definition lists,
fenced and indented code, HTML blocks, thematic breaks, front matter and reference definitions. What it does not
know it leaves whole and untranslated, so that assembly never changes bytes outside the units.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

from ..functions.text import PLACEHOLDER

FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})(.*)$")
HEADING = re.compile(r"^( {0,3}#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
BREAK = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
BULLET = re.compile(r"^( *)([-+*]|[0-9]{1,9}[.)])([ \t]+)(\[[ xX]\][ \t]+)?")
QUOTE = re.compile(r"^ {0,3}>[ ]?")
RULE_ROW = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
REFERENCE = re.compile(r"^ {0,3}\[[^\]]+\]:")
HTML = re.compile(r"^ {0,3}<(?:[A-Za-z/!?])")
DEFINITION = re.compile(r"^( {0,3}:[ \t]+)(.*)$")
CODE = re.compile(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
INLINE_HTML = re.compile(r"<(?:[A-Za-z][^<>]*|/[A-Za-z][^<>]*|!--.*?--)>", re.S)
LINK = re.compile(r"\]\((\S+?)(?:\s+\"([^\"]*)\")?\)|\]\[([^\]]+)\]")
VISIBLE = re.compile(r"\w")


@dataclass(frozen=True)
class Span:
    kind: str
    value: str
    start: int
    end: int


@dataclass(frozen=True)
class Unit:
    kind: str
    text: str
    start: int
    end: int
    id: str
    spans: tuple[Span, ...]


def protected(text: str) -> tuple[Span, ...]:
    """Code, HTML, link targets and placeholders of a unit, in characters; nested ones are dropped, crossing ones refused."""
    found = [Span("inline_code", m[0], *m.span()) for m in CODE.finditer(text)]
    found += [Span("html", m[0], *m.span()) for m in INLINE_HTML.finditer(text)]
    for m in LINK.finditer(text):
        for g, kind in ((1, "link_target"), (2, "link_target"), (3, "link_target")):
            if m[g]:
                found.append(Span(kind, m[g], *m.span(g)))
    found += [Span("placeholder", m[0], *m.span()) for m in re.finditer(PLACEHOLDER, text)]
    out: list[Span] = []
    for s in sorted(found, key=lambda s: (s.start, -s.end)):
        if out and s.start < out[-1].end:
            if s.end > out[-1].end:
                raise ValueError("protected spans cross")
            continue
        out.append(s)
    return tuple(out)


def _blocks(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each block of prose, in characters."""
    lines, at = [], 0
    for raw in text.splitlines(keepends=True):
        lines.append((raw.rstrip("\r\n"), at))
        at += len(raw)
    out: list[tuple[str, int, int]] = []
    para: list[tuple[int, int]] = []
    items: list[int] = []  # places in out of the current list's texts
    i, loose, gap, in_item = 0, False, False, False

    def flush(kind: str = "Paragraph") -> None:
        if para:
            if in_item:
                items.append(len(out))
            out.append((kind, para[0][0], para[-1][1]))
            para.clear()

    def end_list() -> None:
        """A tight list's texts are items; those of one with blank lines between them are paragraphs."""
        for k in items:
            if not loose and out[k][0] == "Paragraph":
                out[k] = ("ListItem", *out[k][1:])
        items.clear()

    if lines and lines[0][0] in ("---", "+++"):
        end = next((k for k in range(1, len(lines)) if lines[k][0] == lines[0][0]), 0)
        i = end + 1 if end else 0
    while i < len(lines):
        line, at = lines[i]
        lead = 0
        while m := QUOTE.match(line[lead:]):
            lead += m.end()
        body = line[lead:]
        if not body.strip():
            gap = True
        else:
            if gap and (items or in_item):
                if BULLET.match(body) or body.startswith("  "):
                    loose = True
                else:
                    flush()
                    end_list()
                    in_item = loose = False
            gap = False
        if m := FENCE.match(body):
            flush()
            mark = m[2]
            i += 1
            while i < len(lines) and not re.match(rf"^[ >]*{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[i][0]):
                i += 1
        elif not body.strip():
            flush()
        elif para and SETEXT.match(body) and not lead:
            flush("Heading")
        elif m := HEADING.match(body):
            flush()
            if m[2]:
                out.append(("Heading", at + lead + m.start(2), at + lead + m.end(2)))
        elif BREAK.match(body) or (REFERENCE.match(body) and not para):
            flush()
        elif not para and (body.startswith("    ") or body.startswith("\t")) and not BULLET.match(body.lstrip()):
            pass
        elif not para and HTML.match(body) and not re.match(r"^ {0,3}<(?:a|b|i|em|strong|code|span|br|img|kbd|sub|sup)\b", body):
            while i + 1 < len(lines) and lines[i + 1][0].strip():
                i += 1
        elif not para and i + 1 < len(lines) and "|" in body and RULE_ROW.match(lines[i + 1][0][lead:]) and "-" in lines[i + 1][0]:
            k = i
            while k < len(lines) and "|" in lines[k][0] and lines[k][0].strip():
                if k != i + 1:
                    row, row_at = lines[k]
                    for cell in re.finditer(r"(?:\\.|`[^`]*`|[^|\\])+", row):
                        s = cell[0]
                        if s.strip():
                            a = row_at + cell.start() + len(s) - len(s.lstrip())
                            out.append(("TableCell", a, a + len(s.strip())))
                k += 1
            i = k - 1
        elif m := DEFINITION.match(body):
            if para:
                flush("DefinitionTerm")
            out.append(("Definition", at + lead + m.start(2), at + lead + len(body.rstrip())))
        elif m := BULLET.match(body):
            flush()
            in_item = True
            if m.end() < len(body):
                while n := BULLET.match(body, m.end()):
                    m = n
                para.append((at + lead + m.end(), at + lead + len(body.rstrip())))
        else:
            inner = len(body) - len(body.lstrip())
            para.append((at + lead + inner, at + lead + len(body.rstrip())))
        i += 1
    flush()
    end_list()
    return out


def _token(span: Span, nth: int, namespace: str) -> str:
    return f"@@{namespace}_{span.kind.upper()}_{nth:04d}_{hashlib.sha256(span.value.encode()).hexdigest()[:16]}@@"


def parse(data: bytes, namespace: str = "WEFT") -> list[Unit]:
    """Units in order, with byte spans; ids are of kind and tokenised text, and count equal ones up.

    Ids of units with protected spans depend on the tokens' namespace.
    """
    text = data.decode()
    seen: Counter[str] = Counter()
    out, last = [], -1
    for kind, a, b in sorted(set(_blocks(text)), key=lambda x: (x[1], x[2])):
        source = text[a:b]
        spans = protected(source)
        rest = source
        for s in reversed(spans):
            rest = rest[: s.start] + rest[s.end :]
        if not VISIBLE.search(rest) or a < last:
            continue
        last = b
        shown = source
        for k, s in reversed(list(enumerate(spans))):
            shown = shown[: s.start] + _token(s, k, namespace) + shown[s.end :]
        mark = hashlib.sha256(f"{kind}\0{' '.join(shown.split())}".encode()).hexdigest()[:16]
        start = len(text[:a].encode())
        out.append(Unit(kind, source, start, start + len(source.encode()), f"md-{mark}-{seen[mark]:02d}", spans))
        seen[mark] += 1
    return out


def signature(data: bytes) -> list[str]:
    """What a translation has to keep: kinds in order, protected code and HTML, and all bytes outside of units."""
    units, at, out = parse(data), 0, []
    for u in units:
        out.append("bytes:" + hashlib.sha256(data[at : u.start]).hexdigest()[:16])
        out.append(u.kind)
        out += sorted(f"{s.kind}:{s.value}" for s in u.spans)
        at = u.end
    return [*out, "bytes:" + hashlib.sha256(data[at:]).hexdigest()[:16]]


def tokenize(unit: Unit, namespace: str = "WEFT") -> tuple[str, list[tuple[str, str]]]:
    """The unit's text with tokens for its protected spans, and the tokens' values."""
    out, text = [], unit.text
    for i, s in reversed(list(enumerate(unit.spans))):
        t = _token(s, i, namespace)
        if t in unit.text:
            raise ValueError("a token collides with the text")
        text = text[: s.start] + t + text[s.end :]
        out.append((t, s.value))
    return text, out[::-1]


def restore(text: str, tokens: list[tuple[str, str]]) -> str:
    for t, value in tokens:
        text = text.replace(t, value)
    return text


def validate(unit: Unit, target: str, namespace: str = "WEFT") -> list[str]:
    """Codes of what is wrong with a tokenised translation; token faults come first and alone."""
    _, tokens = tokenize(unit, namespace)
    out = ["MD-PROTECTED" for t, _ in tokens if target.count(t) != 1]
    known = {t for t, _ in tokens}
    out += ["MD-UNKNOWN-TOKEN" for t in re.findall(rf"@@{namespace}_[^@\r\n]*@@", target) if t not in known]
    if out:
        return out
    whole = restore(target, tokens)
    code = lambda x: sorted(m[0] for m in CODE.finditer(x))
    if code(whole) != code(unit.text):
        out.append("MD-PROTECTED-CODE")
    if structure(whole) != structure(unit.text):
        out.append("MD-STRUCTURE")
    return out


# What a text's inline events are found by, the first that fits at a place.
EVENTS = {
    "escape": r"\\[!-/:-@\[-`{-~]",
    "code": r"(?P<ticks>`+)(?!`).+?(?<!`)(?P=ticks)(?!`)",
    "html": INLINE_HTML.pattern,
    "image": r"!\[(?P<alt>[^\]]*)\](?P<picture>\([^)]*\)|\[[^\]]*\])",
    "footnote": r"\[\^[^\]]+\]",
    "link": r"\[(?P<label>(?:[^\[\]]|\[[^\]]*\])*)\](?P<target>\([^)]*\)|\[[^\]]*\])",
    "strong": r"(?P<two>\*\*|__)(?=\S)(?P<bold>.+?)(?<=\S)(?P=two)",
    "del": r"~~(?=\S)(?P<struck>.+?)(?<=\S)~~",
    "em": r"(?P<one>\*|(?<!\w)_)(?=\S)(?P<slanted>[^*]+?)(?<=\S)(?P=one)",
    "hard": r"(?: {2,}|\\)\r?\n",
    "soft": r"\r?\n",
}
INLINE = re.compile("|".join(f"(?P<{k}>{v})" for k, v in EVENTS.items()), re.S)
INNER = {"image": "alt", "link": "label", "strong": "bold", "del": "struck", "em": "slanted"}


def inline(text: str) -> list[str]:
    """The inline events of a text in order: what begins and ends, and text once between two others."""
    out, at = [], 0
    for m in INLINE.finditer(text):
        kind = next(k for k in EVENTS if m[k] is not None)
        if kind == "escape":
            continue
        if text[at : m.start()].strip():
            out.append("text")
        if kind in INNER:
            out += [f"<{kind}{m['picture'] or m['target'] or ''}", *inline(m[INNER[kind]]), f"{kind}>"]
        else:
            out.append(f"{kind}:{m[0]}" if kind in ("html", "footnote") else kind)
        at = m.end()
    if text[at:].strip():
        out.append("text")
    return [x for i, x in enumerate(out) if x != "text" or i == 0 or out[i - 1] != "text"]


def structure(text: str) -> list[str]:
    """The whole signature of a text: its blocks in order, and within each its inline events."""
    return [x for kind, a, b in _blocks(text) for x in (kind, *inline(text[a:b]))]


def recovered(source: Unit, target: Unit, namespace: str = "WEFT") -> str | None:
    """The target's text with the source's tokens in place of its protected spans; None unless they pair off by kind and value.

    Of equal spans the last in the target takes the first token that is left.
    """
    wanted = Counter((s.kind, s.value) for s in source.spans)
    if source.kind != target.kind or wanted != Counter((s.kind, s.value) for s in target.spans):
        return None
    left: dict[tuple[str, str], list[str]] = {}
    for (token, _), s in zip(tokenize(source, namespace)[1], source.spans):
        left.setdefault((s.kind, s.value), []).append(token)
    pieces, end = [], len(target.text)
    for s in target.spans[::-1]:
        pieces += [target.text[s.end : end], left[s.kind, s.value].pop(0)]
        end = s.start
    text = target.text[:end] + "".join(pieces[::-1])
    return None if validate(source, text, namespace) else text


def repair_strong(source: str, target: str) -> str:
    """A blank after a leading strong run, where the source has one and the target does not."""
    m = re.match(r"^(\*\*[^*\n]+\*\*)(\S)", target)
    return f"{m[1]} {target[m.end(1):]}" if m and re.match(r"^\*\*[^*\n]+\*\*[ \t]", source) else target


def assemble(data: bytes, translations: list[tuple[str, str, str]]) -> bytes:
    """The document with units replaced; translations are (id, source, target)."""
    units = {u.id: u for u in parse(data)}
    edits, seen = [], set()
    for id_, source, target in translations:
        if id_ in seen or id_ not in units or units[id_].text != source:
            raise ValueError(f"unit {id_} is unknown, repeated or has changed")
        seen.add(id_)
        edits.append((units[id_].start, units[id_].end, target.encode()))
    edits.sort()
    if any(b > c for (_, b, _), (c, _, _) in zip(edits, edits[1:], strict=False)):
        raise ValueError("ranges overlap")
    out, at = [], 0
    for a, b, t in edits:
        out += [data[at:a], t]
        at = b
    return b"".join([*out, data[at:]])


def verify(source: bytes, target: bytes) -> bool:
    return signature(source) == signature(target)
