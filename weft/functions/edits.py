"""Edit distances of many pairs of texts, each worked out only as far as it matters.

Most pairs that are met are far apart. One edit changes `GRAM` runs of so many characters on either side at most, so pairs whose counts of runs differ by more than the
edits allowed could make are told by adding up, a slice of a batch at once. What is left is settled by Myers' bit vectors (a column of the table is the bits of two
integers) between what both texts begin and end with, and given up where the rest of the text can no longer make up for the edits so far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

GRAM = 3
# Counters of runs that a slice of pairs holds at a time, and characters.
CELLS, SLICE_CHARS = 1 << 21, 1 << 20


class _Places(dict):
    """The places of each character of a text that is asked for, as the bits of an integer."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes

    def __missing__(self, c: int) -> int:
        self[c] = out = int.from_bytes(np.packbits(self.codes == c, bitorder="little").tobytes(), "little")
        return out


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edits between two texts of code points; -1 if they are more than `most`."""
    for _ in range(2):  # off with what both begin with, then, turned around, with what both end with
        n = min(len(a), len(b))
        other = a[:n] != b[:n]
        same = int(other.argmax()) if other.any() else n
        a, b = a[same:][::-1], b[same:][::-1]
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return -1
    if not len(b):
        return len(a)
    at, full, top = _Places(a), (1 << len(a)) - 1, len(a) - 1
    # `least` is the distance so far, less the characters to come: each of them can bring it down by one at most
    up, down, least = full, 0, len(a) - len(b)
    for c in b.tolist():
        same = at[c]
        vertical = same | down
        across = ((((same & up) + up) ^ up) | same) & full
        plus, minus = down | (full ^ (across | up)), up & across
        least += 1 + (plus >> top) - (minus >> top)
        if least > most:
            return -1
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | (full ^ (vertical | plus)), plus & vertical
    return least


def _grams(codes: np.ndarray, starts: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """For each run of GRAM characters of the texts of lengths n, which begin at starts, its counter among `width` of its row."""
    runs = np.maximum(n - GRAM + 1, 0)
    row = np.repeat(np.arange(len(n)), runs)
    at = np.repeat(starts - (np.cumsum(runs) - runs), runs) + np.arange(len(row))
    mixed = np.zeros(len(row), np.uint32)
    for i in range(GRAM):
        mixed = (mixed + codes[at + i]) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
    return row * width + (mixed & np.uint32(width - 1))


def apart(codes: np.ndarray, starts: np.ndarray, n: np.ndarray, p_starts: np.ndarray, p_n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the counts of runs alone tell that a pair is more than `most` edits apart; texts are spans of codes."""
    longer = np.maximum(n, p_n)
    widths = 1 << np.clip(np.ceil(np.log2(np.maximum(longer, 1))).astype(int) + 2, 8, 16)
    out = np.zeros(len(n), bool)
    # where the edits allowed could change every run nothing is told
    useful = GRAM * most < longer
    for width in np.unique(widths[useful]):
        rows = np.flatnonzero(useful & (widths == width))
        for i in range(0, len(rows), step := max(1, CELLS // int(width))):
            r = rows[i : i + step]
            size = len(r) * int(width)
            differ = np.bincount(_grams(codes, starts[r], n[r], int(width)), minlength=size) - np.bincount(_grams(codes, p_starts[r], p_n[r], int(width)), minlength=size)
            out[r] = np.abs(differ).reshape(len(r), int(width)).sum(axis=1) > 2 * GRAM * most[r]
    return out


def within(a: pa.Array, b: pa.Array, most: pa.Array) -> pa.Array:
    """The edits between the texts of each pair; -1 if they are more than its `most`."""
    texts = [x.cast(pa.large_binary()) for x in (a, b)]
    most, out = np.asarray(most).astype(np.int64), np.full(len(a), -1, np.int32)
    at = 0
    while at < len(out):
        end, chars, decoded = at, 0, []
        while end < len(out) and (end == at or chars < SLICE_CHARS):
            pair = [x[end].as_py().decode("utf-8", "replace") for x in texts]
            decoded += pair
            chars, end = chars + len(pair[0]) + len(pair[1]), end + 1
        codes = np.frombuffer("".join(decoded).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.fromiter(map(len, decoded), np.int64, len(decoded))
        starts = np.cumsum(n) - n
        far = apart(codes, starts[::2], n[::2], starts[1::2], n[1::2], most[at:end])
        for i in np.flatnonzero(~far).tolist():
            x, y = (codes[starts[j] : starts[j] + n[j]] for j in (2 * i, 2 * i + 1))
            out[at + i] = distance(x, y, int(most[at + i]))
        at = end
    return pa.array(out)
