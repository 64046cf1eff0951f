"""JSON documents: string leaves with byte spans, strict limits, and assembly that leaves all other bytes alone."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass

# The limits of a document.
MAX_BYTES, MAX_STRING, MAX_NODES, MAX_DEPTH = 4 << 20, 64 << 10, 100_000, 64
MAX_POINTER, MAX_POINTERS, MAX_PLACEHOLDERS = 4096, 16 << 20, 256

NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
LITERAL = re.compile(rb"true|false|null")
BLANK = re.compile(rb"[ \t\n\r]*")
STRING = re.compile(rb'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
INTERPOLATION = re.compile(r"\{\{[ \t\n\r\f]*[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*[ \t\n\r\f]*\}\}")
REFUSED = re.compile(r"\{\{|\}\}|\$t\(|<[A-Za-z/0-9]")
PLURAL = re.compile(r"_(?:zero|one|two|few|many|other|plural|ordinal|[0-9]+)$|_ordinal_")


class DocumentError(ValueError):
    """Why a document is refused."""


@dataclass(frozen=True)
class Leaf:
    """A string value: its pointer, decoded text and the bytes of its literal."""

    pointer: str
    text: str
    start: int
    end: int


class _Reader:
    def __init__(self, data: bytes, interpolated: bool):
        self.data, self.at, self.interpolated = data, 0, interpolated
        self.nodes = self.pointer_bytes = 0
        self.leaves: list[Leaf] = []
        self.signature: list[str] = []

    def blank(self) -> None:
        self.at = BLANK.match(self.data, self.at).end()

    def take(self, c: bytes) -> bool:
        if self.data[self.at : self.at + 1] == c:
            self.at += 1
            return True
        return False

    def need(self, c: bytes) -> None:
        if not self.take(c):
            raise DocumentError(f"{c.decode()} expected at byte {self.at}")

    def string(self) -> tuple[str, int, int]:
        m = STRING.match(self.data, self.at)
        if not m:
            raise DocumentError(f"bad string at byte {self.at}")
        if m.end() - m.start() - 2 > MAX_STRING:
            raise DocumentError("a string is too long")
        self.at = m.end()
        text = json.loads(m[0])
        if any(0xD800 <= ord(c) < 0xE000 for c in text):
            raise DocumentError("an unpaired surrogate")
        return text, m.start(), m.end()

    def value(self, pointer: str, depth: int) -> None:
        self.nodes += 1
        self.pointer_bytes += (size := len(pointer.encode()))
        if self.nodes > MAX_NODES or depth > MAX_DEPTH or size > MAX_POINTER or self.pointer_bytes > MAX_POINTERS:
            raise DocumentError("the document is too large or too deep")
        self.blank()
        c = self.data[self.at : self.at + 1]
        if c == b"{":
            self.signature.append(f"{pointer}:object")
            self.members(pointer, depth)
        elif c == b"[":
            self.at += 1
            self.blank()
            n = 0
            if not self.take(b"]"):
                while True:
                    self.value(f"{pointer}/{n}", depth + 1)
                    n += 1
                    self.blank()
                    if self.take(b"]"):
                        break
                    self.need(b",")
            self.signature.append(f"{pointer}:array:{n}")
        elif c == b'"':
            text, a, b = self.string()
            if text.strip():
                self.signature.append(f"{pointer}:text")
                self.leaves.append(Leaf(pointer, text, a, b))
            else:
                self.signature.append(f"{pointer}:blank:{self.data[a:b].decode()}")
        else:
            m = LITERAL.match(self.data, self.at) or NUMBER.match(self.data, self.at)
            if not m:
                raise DocumentError(f"no value at byte {self.at}")
            self.at = m.end()
            self.signature.append(f"{pointer}:scalar:{m[0].decode()}")

    def members(self, pointer: str, depth: int) -> None:
        self.at += 1
        self.blank()
        keys: set[str] = set()
        if self.take(b"}"):
            return
        while True:
            self.blank()
            key, _, _ = self.string()
            if key in keys:
                raise DocumentError(f"key {key!r} comes twice")
            if self.interpolated and PLURAL.search(key):
                raise DocumentError(f"plural key {key!r}")
            keys.add(key)
            self.blank()
            self.need(b":")
            self.value(f"{pointer}/{key.replace('~', '~0').replace('/', '~1')}", depth + 1)
            self.blank()
            if self.take(b"}"):
                return
            self.need(b",")


def parse(data: bytes, interpolated: bool = False) -> tuple[list[Leaf], list[str]]:
    """Leaves and structure signature, both in the order of pointers."""
    if len(data) > MAX_BYTES:
        raise DocumentError("the document is too large")
    try:
        data.decode()
    except UnicodeDecodeError as e:
        raise DocumentError("not UTF-8") from e
    r = _Reader(data, interpolated)
    r.value("", 0)
    r.blank()
    if r.at != len(data):
        raise DocumentError(f"more text at byte {r.at}")
    if interpolated:
        for leaf in r.leaves:
            placeholders(leaf.text)
    return sorted(r.leaves, key=lambda x: x.pointer.encode()), sorted(r.signature, key=str.encode)


def placeholders(text: str) -> Counter[str]:
    """Interpolations of a message with their numbers; other markup of that dialect is refused."""
    found = INTERPOLATION.findall(text)
    if len(found) > MAX_PLACEHOLDERS:
        raise DocumentError("too many placeholders")
    if REFUSED.search(INTERPOLATION.sub("", text)):
        raise DocumentError("a placeholder or markup that is not supported")
    return Counter(found)


def tokenize(text: str, namespace: str = "WEFT") -> tuple[str, list[tuple[str, str]]]:
    """A message with a token for each interpolation, numbered in order, and the tokens' values; a text that already has such tokens is refused."""
    if f"@@{namespace}_" in text:
        raise DocumentError("a token collides with the text")
    placeholders(text)
    tokens: list[tuple[str, str]] = []

    def token(m: re.Match) -> str:
        tokens.append((f"@@{namespace}_JSON_{len(tokens)}@@", m[0]))
        return tokens[-1][0]

    return INTERPOLATION.sub(token, text), tokens


def validate_tokens(source: str, target: str, namespace: str = "WEFT") -> list[str]:
    """Codes of what is wrong with a tokenised translation of an interpolated message: every token stands in it once, in any order."""
    _, tokens = tokenize(source, namespace)
    if any(target.count(t) != 1 for t, _ in tokens):
        return ["JSON-TOKENS"]
    for t, value in tokens:
        target = target.replace(t, value)
    return ["JSON-TOKENS"] if f"@@{namespace}_" in target else validate(source, target, True)


def encode(text: str) -> bytes:
    return json.dumps(text, ensure_ascii=False).encode()


def validate(source: str, target: str, interpolated: bool = False) -> list[str]:
    """Codes of what is wrong with a translated message."""
    out = []
    if not target.strip():
        out.append("JSON-BLANK")
    if len(encode(target)) - 2 > MAX_STRING:
        out.append("JSON-TOO-LONG")
    if interpolated:
        try:
            if placeholders(source) != placeholders(target):
                out.append("JSON-PLACEHOLDERS")
        except DocumentError:
            out.append("JSON-PLACEHOLDERS")
    return out


def assemble(data: bytes, translations: dict[str, str], interpolated: bool = False) -> bytes:
    """The document with some leaves' texts replaced; literals that do not change keep their bytes."""
    leaves = {x.pointer: x for x in parse(data, interpolated)[0]}
    if unknown := set(translations) - set(leaves):
        raise DocumentError(f"unknown pointers {sorted(unknown)}")
    edits = sorted((leaves[p].start, leaves[p].end, encode(t)) for p, t in translations.items() if t != leaves[p].text)
    if len(data) + sum(len(t) - (b - a) for a, b, t in edits) > MAX_BYTES:
        raise DocumentError("the result would be too large")
    out, at = [], 0
    for a, b, t in edits:
        out += [data[at:a], t]
        at = b
    return b"".join([*out, data[at:]])


def verify(source: bytes, target: bytes, interpolated: bool = False) -> bool:
    """Whether the target has the source's structure: keys, scalars and blanks alike, members in any order."""
    return parse(source, interpolated)[1] == parse(target, interpolated)[1]
