"""The model of `quality_rules` over 32 folded symbols, as dense arrays of one language.

A plain reading of modified Kneser-Ney, which the tests hold the tables of `quality_rules` to. No query is computed by it.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np

from .kit import mix

A = 32
ORDER = 4
SIZE = A**ORDER


def _alphabet() -> np.ndarray:
    """Symbol of each code point up to 0x24F; of those above see `beyond`."""
    out = np.full(0x250, 30, np.uint8)
    for i in range(0x250):
        c = chr(i)
        base = unicodedata.normalize("NFD", c)[0]
        if c in " \t\n\r\v\f":
            out[i] = 28
        elif c.isdigit():
            out[i] = 27
        elif c.isupper():
            out[i] = 26
        elif "a" <= base <= "z":
            out[i] = ord(base) - 97
        elif c.isalpha():
            out[i] = 31
        elif c in ".,;:'\"!?()-":
            out[i] = 29
    return out


ALPHABET = _alphabet()


_beyond: list[np.ndarray] = []


def beyond() -> np.ndarray:
    """Symbol of each code point from 0x250 on, made once a worker that meets one."""
    if not _beyond:
        points = np.arange(len(ALPHABET), 0x110000)
        kinds = np.array([unicodedata.category(chr(i)) for i in points.tolist()])
        by = {"Lu": 26, "Nd": 27, "Zs": 28, "Zl": 28, "Zp": 28}
        kind, of = np.unique(kinds, return_inverse=True)
        fixed = np.array([by.get(k, 29 if k[0] == "P" else 30) for k in kind], np.uint8)[of]
        letter = np.array([k[0] in "LM" and k != "Lu" for k in kind])[of]
        hashed = (mix(points.astype(np.uint64)) % np.uint64(26)).astype(np.uint8)
        _beyond.append(np.where(letter, hashed, fixed))
    return _beyond[0]


def codes(text: bytes) -> np.ndarray:
    """Codes of all 4-grams of a text, which is led in by three blanks."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    symbols = np.full(len(points) + ORDER - 1, 28, np.int64)
    far = points >= len(ALPHABET)
    symbols[ORDER - 1 :] = ALPHABET[np.where(far, 0, points)]
    if far.any():
        symbols[ORDER - 1 :][far] = beyond()[points[far] - len(ALPHABET)]
    out = symbols[: len(points)]
    for j in range(1, ORDER):
        out = out * A + symbols[j : j + len(points)]
    return out


@dataclass
class Model:
    """Sorted hash arrays: by order, the seen n-grams with log10 probabilities, and contexts with back-off weights."""

    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    entropy: float
    deviation: float

    def score(self, code: np.ndarray) -> np.ndarray:
        """log10 P of the last symbol of each 4-gram, given the three before it."""
        out = np.zeros(len(code))
        todo = np.arange(len(code))
        for n in range(ORDER, 0, -1):
            gram = code[todo] % A**n
            at, found = _find(self.keys[n - 1], gram)
            out[todo[found]] += self.logp[n - 1][at[found]]
            todo, gram = todo[~found], gram[~found]
            at, found = _find(self.contexts[n - 1], gram // A)
            out[todo[found]] += self.backoff[n - 1][at[found]]
        out[todo] += -np.log10(A)
        return out


def _find(keys: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(code.astype(np.uint64) + np.uint64(1))
    at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
    return at, (keys[at] == h) if len(keys) else np.zeros(len(h), bool)


def kneser_ney(counts: np.ndarray) -> Model:
    """Modified, interpolated Kneser-Ney from the raw counts of the 4-grams of one language."""
    by_order = [counts.reshape((A,) * ORDER).astype(np.float64)]
    while by_order[0].ndim > 1:  # below the top: in how many different left contexts
        by_order.insert(0, (by_order[0] > 0).sum(axis=0).astype(np.float64))
    lower, model = np.full((), 1 / A), Model([], [], [], [], 0, 0)
    for c in by_order:
        n = [float((c == k).sum()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
        d = [0.0] + [min(k - 0.01, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
        discount = np.array(d)[np.minimum(c, 3).astype(int)]
        total = c.sum(axis=-1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            gamma = np.where(total > 0, discount.sum(axis=-1, keepdims=True) / total, 1.0)
            p = np.where(total > 0, (c - discount) / total, 0.0) + gamma * lower
        flat, seen = p.reshape(-1), np.flatnonzero(c.reshape(-1))
        for keys, values, code, value in ((model.keys, model.logp, seen, np.log10(flat[seen])), (model.contexts, model.backoff, held := np.flatnonzero(total.reshape(-1)), np.log10(gamma.reshape(-1)[held]))):
            h = mix(code.astype(np.uint64) + np.uint64(1))
            order = np.argsort(h)
            keys.append(h[order])
            values.append(value[order].astype(np.float32))
        lower = p
    seen = np.flatnonzero(counts)
    if len(seen):
        nll, w = -np.log10(lower.reshape(-1)[seen]), counts[seen]
        model.entropy = float((nll * w).sum() / w.sum())
        model.deviation = float(np.sqrt((w * (nll - model.entropy) ** 2).sum() / w.sum()))
    return model
