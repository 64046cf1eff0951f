"""Operator 6, secret scans: patterns find candidates, a random forest drops the false positives.

The forest is trained on the driver from labelled findings (value, text before, text after, path,
label), of which at most `MAX_FINDINGS` are used. It weighs each candidate's length, its
transitions from character to character, its coverage by dictionary words, its path and the
words beside it. `findings()` makes the labelled findings that the queries train on, from a seed:
issued-looking keys on one side; placeholders, checksums, commit ids, UUIDs, identifiers, addresses, hosts, file names and
numbers on the other. A table of findings that people have labelled takes their place as `labelled`; of more than the bound
those with the least hashes are taken, whatever the order of the rows. Whole texts are scanned, batch by batch, and nothing is shuffled.

Defined results: null and empty texts have no findings; equal candidates are found once at each
place; of candidates that overlap the first stays, private keys and
assigned values before others, a name counting as the begin of what is assigned to it;
repeated rows repeat their findings; a null path counts as an empty one; an empty table gives no
rows; further columns are ignored. Without both kinds of label training is refused.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import slices

MAX_FINDINGS = 20_000
THRESHOLD = 0.5
TREES, DEPTH, LEAF = 24, 9, 3
SCHEMA = "doc_id long, kind string, start_char long, end_char long, probability double, is_secret boolean"

TOKEN = re.compile(
    r"\b(?:(?P<cloud_key>(?:AKIA|ASIA)[0-9A-Z]{16}\b)"
    r"|(?P<vendor_token>gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})"
    r"|(?P<high_entropy>[A-Za-z0-9+/_=-]{32,}\b|[A-Za-z0-9+/_=.@-]{20,}\b))"
)
PEM = re.compile(r"-----(BEGIN|END) [A-Z ]*PRIVATE KEY-----")
KEYWORD = re.compile(r"password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key", re.I)
VALUE = re.compile(r"\s{0,3}[\"']?(?P<assigned>[^\s\"'<>]{8,})")
ASSIGN, NAME_END, LETTER, DIGIT = re.compile("[:=]"), re.compile(r"[\"']?\s{0,3}\Z"), re.compile("[A-Za-z]"), re.compile("[0-9]")
# Words that the dictionary feature knows, and words that speak for and against a secret nearby.
WORDS = "access account admin api app auth change client code config count data default demo dev dummy example file foo form get group hash host http id image index item key lang lib line list local log main me model my name new node null number object page param pass password path placeholder prod query read request response result root sample script secret server service session set sort source state string system table temp test text this time title token true type url user value version view web word world write xxx your".split()
FOR = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access", "auth", "credential", "private", "key")
AGAINST = ("example", "sample", "dummy", "placeholder", "test", "commit", "sha", "md5", "checksum", "digest", "hash", "uuid", "integrity", "etag", "revision", "blob")
PATHS = ("test", "example", "sample", "doc", "fixture", "mock", "lock", "vendor")
NEAR = 40


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(value: str, before: str, after: str, path: str) -> list[float]:
    """What the forest weighs; see FEATURES for the order."""
    n = len(value)
    low, kinds = value.lower(), [_kind(c) for c in value]
    counts = [kinds.count(k) / n for k in range(4)]
    moves = [a != b for a, b in zip(kinds, kinds[1:], strict=False)]
    entropy = -sum(p * math.log2(p) for p in (value.count(c) / n for c in set(value)))
    same = sum(a == b for a, b in zip(value, value[1:], strict=False)) / n
    steps = sum(ord(b) - ord(a) == 1 for a, b in zip(value, value[1:], strict=False)) / n
    covered = [False] * n
    for w in WORDS:
        at = low.find(w) if len(w) > 2 else -1
        while at >= 0:
            covered[at : at + len(w)] = [True] * len(w)
            at = low.find(w, at + 1)
    vowels = sum(c in "aeiou" for c in low) / max(1, sum(c.isalpha() for c in low))
    near, path = (before[-NEAR:] + " " + after[:NEAR]).lower(), path.lower()
    hexa = all(c in "0123456789abcdef-" for c in low)
    return [math.log2(n), *counts, sum(moves) / n, entropy, same, steps, sum(covered) / n, vowels, float(hexa), float(value.count("-") == 4 and n == 36), float(any(w in near for w in FOR)), float(any(w in near for w in AGAINST)), float(any(w in path for w in PATHS)), float(value.startswith(("AKIA", "ASIA", "gh", "xox", "sk-", "eyJ", "-----"))), float("@" in value), value.count(".") / n]


FEATURES = "log2_length digits lower upper other transitions entropy repeats runs dictionary vowels hex uuid words_for words_against path prefix address dots".split()


class Forest:
    """Binary trees as arrays; grown on bootstrap samples with Gini splits over random features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        if len(np.unique(y)) < 2:
            raise ValueError("labelled findings of both kinds are needed")
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(TREES):
            rows = rng.integers(0, len(y), len(y))
            tree: list[list[float]] = []
            self._grow(tree, x[rows], y[rows].astype(float), 0, rng)
            self.trees.append(np.array(tree))

    def _grow(self, tree: list, x: np.ndarray, y: np.ndarray, depth: int, rng) -> int:
        me = len(tree)
        tree.append([-1, 0, 0, 0, y.mean()])
        if depth == DEPTH or len(y) < 2 * LEAF or y.min() == y.max():
            return me
        best = (np.inf, 0, 0.0)
        for f in rng.choice(x.shape[1], max(2, round(math.sqrt(x.shape[1]))), replace=False):
            cuts = np.unique(np.quantile(x[:, f], np.linspace(0.04, 0.96, 12)))
            left = x[:, f, None] <= cuts
            n = left.sum(axis=0)
            ok = (n >= LEAF) & (len(y) - n >= LEAF)
            if not ok.any():
                continue
            p = (left * y[:, None]).sum(axis=0) / np.maximum(n, 1)
            q = (y.sum() - p * n) / np.maximum(len(y) - n, 1)
            gini = np.where(ok, n * p * (1 - p) + (len(y) - n) * q * (1 - q), np.inf)
            if gini.min() < best[0]:
                best = (gini.min(), int(f), float(cuts[gini.argmin()]))
        if best[0] < np.inf:
            side = x[:, best[1]] <= best[2]
            a = self._grow(tree, x[side], y[side], depth + 1, rng)
            b = self._grow(tree, x[~side], y[~side], depth + 1, rng)
            tree[me] = [best[1], best[2], a, b, tree[me][4]]
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), int)
            while (inner := t[at, 0] >= 0).any():
                f = t[at, 0].astype(int)
                down = np.where(x[np.arange(len(x)), f] <= t[at, 1], t[at, 2], t[at, 3]).astype(int)
                at = np.where(inner, down, at)
            out += t[at, 4]
        return out / len(self.trees)


def findings(n: int = 4000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings made from a seed: half issued-looking secrets, half look-alikes."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    one = lambda options: options[int(rng.integers(len(options)))]
    lower, upper, digits, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    prose = lambda: " ".join(pick(lower, int(rng.integers(2, 9))) for _ in range(6))
    out = []
    for i in range(n):
        path = one(["src/app", "config", "", "src0", "web/main", "deploy"])
        if i % 2:
            value, lead = one([
                lambda: ("AKIA" + pick(upper + digits, 16), one(["", "key ", "aws_access_key_id = "])),
                lambda: (pick(hexa, int(rng.integers(16, 24))), one(["password=", "pwd: ", "secret="])),
                lambda: (pick(hexa, int(rng.choice([32, 40, 64]))), one(['token = "', "api_key=", "secret: "])),
                lambda: (pick(lower + upper + digits + "+/", 40), one(["secret_access_key = ", "auth_key: "])),
                lambda: (pick(lower + upper + digits + "!#_", int(rng.integers(10, 20))), one(["password = ", "passwd: "])),
                lambda: ("ghp_" + pick(lower + upper + digits, 36), one(["", "token "])),
            ])()
            out.append((value, prose() + " " + lead, " " + prose(), path, 1))
            continue
        word = lambda: one(WORDS)
        value, lead = one([
            lambda: (pick(hexa, 40), one(["commit ", "revision ", "blob ", "sha1 "])),
            lambda: (pick(hexa, int(rng.choice([32, 64]))), one(["md5 ", "checksum: ", "sha256:", "etag ", "integrity "])),
            lambda: ("-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), one(["", "uuid ", "id "])),
            lambda: (one(["changeme", "example", "yourpassword", "placeholder", "xxxxxxxx", "dummy"]) + one(["", "123", "_here", "_value"]), one(["password=", "token: ", "secret = "])),
            lambda: (one("x*0a-.") * int(rng.integers(8, 40)), one(["password=", "api_key: ", "token = "])),
            lambda: ("_".join(word() for _ in range(int(rng.integers(2, 7)))) + one(["", "1", "_v2"]), one(["token=", "", "key: ", "secret: "])),
            lambda: ("".join(word().title() for _ in range(int(rng.integers(4, 9)))) + pick(digits, 1), ""),
            lambda: (pick(digits, int(rng.choice([12, 16, 20]))), one(["", "token ", "key="])),
            lambda: ("0123456789abcdef" * 2, one(["key = ", ""])),
            lambda: (pick(lower, int(rng.integers(3, 9))) + one([".", "_", ""]) + pick(digits, int(rng.integers(1, 4))) + "@" + one(["mail", "mx", "post"]) + pick(digits, 1) + one([".example.com", ".example.org", "." + pick(lower, 6) + ".net"]), one(["", "mail ", "to: "])),
            lambda: (".".join(pick(lower + digits, int(rng.integers(2, 9))) for _ in range(int(rng.integers(3, 6)))) + one([".com", ".internal", ".org"]), one(["", "host ", "at "])),
            lambda: (one(["report", "backup", "photo", "scan"]) + "_" + "-".join([pick(digits, 4), pick(digits, 2), pick(digits, 2)]) + "_" + word() + one([".csv", ".tar.gz", ".jpeg", ".v2.pdf"]), one(["", "file ", "see "])),
            lambda: (one(["${" + word().upper() + "_" + word().upper() + "}", "os.environ[" + word() + "]", "get_" + word() + "(" + word() + ")"]), one(["password=", "token = "])),
        ])()
        out.append((value, prose() + " " + lead, " " + prose(), one([path, "tests/fixtures", "docs/example"]), 0))
    return out


def train(labelled: list[tuple[str, str, str, str, int]] | DataFrame | None = None) -> Forest:
    if isinstance(labelled, DataFrame):
        of = ["value", "before", "after", "path", "label"]
        labelled = [tuple(r) for r in labelled.select(*of).orderBy(F.xxhash64(*of), *of).limit(MAX_FINDINGS).collect()]
    labelled = (findings() if labelled is None else labelled)[:MAX_FINDINGS]
    x = np.array([features(v, b or "", a or "", p or "") for v, b, a, p, _ in labelled if v])
    return Forest(x, np.array([r[4] for r in labelled if r[0]]))


def _keys(text: str) -> Iterator[tuple[str, int, int, int]]:
    """PEM bodies from a BEGIN to the END that follows, with no other BEGIN between; all as (kind, where it is led in, start, end)."""
    begin = None
    for m in PEM.finditer(text):
        if m[1] == "BEGIN":
            begin = m.start()
        elif begin is not None:
            yield "private_key", begin, begin, m.end()
            begin = None


def _assigned(text: str) -> Iterator[tuple[str, int, int, int]]:
    """Values given to names of which a keyword is any part."""
    done = 0
    for m in ASSIGN.finditer(text):
        if m.start() < done:
            continue
        end = max(0, m.start() - 4)
        end += NAME_END.search(text[end : m.start()]).start()
        at = end
        while at > done and (text[at - 1].isalnum() or text[at - 1] in "_-."):
            at -= 1
        if at < end and KEYWORD.search(text, at, end) and (v := VALUE.match(text, m.end())):
            yield "assigned", at, *v.span("assigned")
            done = v.end()


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    found, done = [], 0
    for f in sorted([*_keys(text), *_assigned(text)], key=lambda f: (f[1], -f[3])):
        if f[1] >= done:
            found.append(f)
            done = f[3]
    at = 0
    for f in [*found, ("", len(text), 0, len(text))]:
        for m in TOKEN.finditer(text, at, f[1]):
            a, b = m.span(kind := m.lastgroup)
            if kind == "high_entropy":
                if not (digit := DIGIT.search(text, a, b)) or not LETTER.search(text, a, b):
                    continue
                # a long name without a digit is not part of what is assigned to it
                cut = text.rfind("=", a, digit.start()) + 1
                if digit.start() - a > 38 and b - cut >= 32 and LETTER.search(text, cut, b):
                    a = max(a, cut)
            yield kind, a, b
        if f[0]:
            yield f[0], *f[2:]
        at = f[3]


def scan(text: str, path: str, forest: Forest) -> list[tuple[str, int, int, float]]:
    found = list(candidates(text))
    if not found:
        return []
    x = np.array([features(text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR], path) for _, a, b in found])
    return [(*f, float(p)) for f, p in zip(found, forest.predict(x), strict=True)]


def _scan(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            paths, ids, rows = s.batch.column("path").to_pylist(), s.batch.column("doc_id").to_pylist(), []
            for i in range(s.n):
                rows += [(ids[i], *f) for f in scan(s.text(i).decode("utf-8", "replace"), paths[i] or "", held.value)]
            if rows:
                d, kind, a, b, p = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(kind), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(p, pa.float64()), pa.array([x >= THRESHOLD for x in p])], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def _redact(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            paths = s.batch.column("source").cast(pa.string()).to_pylist()
            texts = None
            for i in range(s.n):
                text = s.text(i).decode("utf-8", "replace")
                found = [f for f in scan(text, paths[i] or "", held.value) if f[3] >= THRESHOLD]
                if not found:
                    continue
                texts = s.batch.column("text").to_pylist() if texts is None else texts
                for kind, a, b, _ in reversed(found):
                    text = f"{text[:a]}[{kind}]{text[b:]}"
                texts[i] = text
            if texts is None:
                yield s.batch
                continue
            columns = dict(zip(s.batch.schema.names, s.batch.columns, strict=True))
            was = columns["text"].to_pylist()
            columns["text"] = pa.array(texts, columns["text"].type)
            lengths = columns["n_chars"].to_pylist()
            columns["n_chars"] = pa.array([n if a == b else len(b) for n, a, b in zip(lengths, was, texts, strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def find(docs: DataFrame, path: str = "source", labelled: DataFrame | None = None) -> DataFrame:
    """A row for each candidate in docs(doc_id, text, path): its place, probability and verdict."""
    held = docs.sparkSession.sparkContext.broadcast(train(labelled))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(path).cast("string").alias("path"))
    return rows.mapInArrow(_scan(held), SCHEMA)


def redact(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """docs(doc_id, text, source, n_chars, ...) with each secret replaced by the name of its kind."""
    held = docs.sparkSession.sparkContext.broadcast(train(labelled))
    return docs.mapInArrow(_redact(held), docs.schema)
