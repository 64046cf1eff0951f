"""Operator 9, LM scoring by Brown class-based bigrams.

Spark counts every token of the training texts, as 64-bit hashes, with partial sums in the Python
workers and one shuffle by token. Exchange clustering then assigns words to classes, in two steps:

1. the most frequent words, `PER_CLASS` to a class, and `SHAPES` groups of all others (by length and last byte) are
   clustered on the driver: their bigram counts, over all training tokens, form a small matrix, on which the exchange
   algorithm moves one item at a time to the class that raises the likelihood of the class bigrams most;
2. every word with `MIN_COUNT` occurrences or more is exchanged in Spark, `ROUNDS` times: a pass counts how often
   each class stands before and after each word, the counts are gathered by word, and each word moves to the class where it
   raises the likelihood most, all words against the same class bigrams. A round that does not raise the
   likelihood of the whole, which moves at the same time may do, is undone.

The clustered vocabulary thus grows with the corpus, and the number of classes with its cube root. Words below the
count stay in the class of their group. A token has the probability P(class | class before) * P(token | class): the
first by absolute discounting into the class unigrams, the second by add-one over the class's known tokens and one
unknown one.

The most frequent 2**20 tokens at most are broadcast with their counts and classes (24 MB) and are clustered one by one; with
more tokens than that the least count that is clustered rises. The counts of the rest, few in any text, are looked up
by a join, so the vocabulary may grow without bound. Tokens are told apart by their 64 bits.

Defined results: a null or empty text is one end token; a null doc_id counts as an empty string for the
split; without training texts all counts are 0 and scores follow from the add-one rule; repeated rows
are scored each; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kit import Scratch, Slice, prefix_hash, signed, slices, span_hash

SHAPES = 64
CLASSES, CLASSES_BY_ROOT, PER_CLASS = 48, 1.5, 4
MIN_COUNT = 8
ROUNDS = 1
SWEEPS = 8
DISCOUNT = 0.75
FREQUENT = 1 << 20
END = np.uint64(0xE0D0E0D0E0D0E0D1)
END_SHAPE = SHAPES


def tokens(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape of every token, each text's closed by the end token; where each text's begin."""
    starts, ends, first = s.words()
    h = span_hash(prefix_hash(s.data, lower=True), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    last = s.data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    shape = np.minimum(ends - starts, 15) // 4 * 16 + (np.where((last >= 65) & (last < 91), last + 32, last) & 15)
    at = first[1:] + np.arange(s.n)
    every, shapes = np.full(len(h) + s.n, END), np.full(len(h) + s.n, END_SHAPE, np.int64)
    words = np.ones(len(every), bool)
    words[at] = False
    every[words], shapes[words] = h, shape
    return every, shapes, first + np.arange(s.n + 1)


def _tally(h: np.ndarray, n: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, n, shape = h[order], n[order], shape[order]
    begins = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[begins], np.add.reduceat(n, begins), shape[begins]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, shape, n) sums of what a task has read; passed on whenever they grow large."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        h, n, shape = _tally(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(shape.astype(np.int32)), pa.array(n)], names=["h", "shape", "n"])

    for s in slices(batches):
        h, shape, _ = tokens(s)
        held.append(_tally(h, np.ones(len(h), np.int64), shape))
        size += len(held[-1][0])
        if size > 6_000_000:
            yield out()
            held, size = [], 0
    if held:
        yield out()


class Vocabulary:
    """Frequent tokens, sorted by hash, with their counts and groups: items while classes are made, classes then."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, of: np.ndarray, of_shape: np.ndarray):
        self.hashes, self.counts, self.of, self.of_shape = hashes, counts, of, of_shape
        self.end = int(of_shape[END_SHAPE])
        self.begin: np.ndarray | None = None

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each token, or -1: buckets of leading bits, of which most hold a token at most."""
        bits = max(1, int(2 * len(self.hashes)).bit_length())
        if self.begin is None:
            self.begin = np.concatenate(([0], np.cumsum(np.bincount((self.hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits))))
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
        at, end, out = self.begin[bucket], self.begin[bucket + 1], np.full(len(h), -1)
        todo = np.flatnonzero(at < end)
        while len(todo):
            hit = self.hashes[at[todo]] == h[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out

    def groups(self, at: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Group of each token, by its place and shape."""
        return np.where(at >= 0, self.of[at], self.of_shape[shape]) if len(self.of) else self.of_shape[shape]

    def before(self, group: np.ndarray) -> np.ndarray:
        """Group before each token: every text ends with the end token, so the next begins after it."""
        return np.concatenate(([self.end], group[:-1]))


def _pairs(held, n: int):
    """(code, n): how often each group follows each, over all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, v = np.zeros(n * n, np.int64), held.value
        for s in slices(batches):
            h, shape, _ = tokens(s)
            group = v.groups(v.find(h), shape)
            sums += np.bincount(v.before(group) * n + group, minlength=len(sums))
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(sums[seen])], names=["code", "n"])

    return run


def _bigrams(training: DataFrame, v: Vocabulary, n: int) -> np.ndarray:
    held = training.sparkSession.sparkContext.broadcast(v)
    got = training.mapInArrow(_pairs(held, n), "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n * n)
    out[got.column("code").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(n, n)


def _contexts(held, classes: int):
    """(at, side, n): of each word to be exchanged, by its place, the classes before (2c), after (2c + 1) and itself (2 * classes), with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, width = held.value, 2 * classes + 1
        parts: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(parts), return_counts=True)
            word = code // width
            begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            offsets = pa.array(np.append(begins, len(code)).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(word[begins].astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array((code % width).astype(np.int16))), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32)))], names=["at", "side", "n"])

        for s in slices(batches):
            h, shape, _ = tokens(s)
            at = v.find(h)
            group = v.groups(at, shape)
            last = np.concatenate(([-1], at[:-1]))
            own = (at >= 0) & (at == last) & (h != END)
            moved = (at >= 0) & (v.counts[at] >= MIN_COUNT) & (h != END) if len(v.counts) else at >= 0
            into, onto = moved & ~own, np.concatenate((moved[:-1] & ~own[1:], [False]))  # the last token of a slice is an end
            after = np.concatenate((group[1:], [0]))
            parts += [at[into] * width + 2 * v.before(group)[into], at[onto] * width + 2 * after[onto] + 1, at[moved & own] * width + 2 * classes]
            size += len(h)
            if size > 1_500_000:
                yield out()
                parts, size = [], 0
        if sum(len(p) for p in parts):
            yield out()

    return run


def best_class(g: np.ndarray, a: np.ndarray, word: np.ndarray, side: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where an exchange puts each word, given the class bigrams g and its class now: sides as of `_contexts`, words ascending."""
    k, b = len(g), len(a)
    f = lambda x: x * np.log(np.maximum(x, 1))
    table = np.bincount(word * (2 * k + 1) + side, n, b * (2 * k + 1)).reshape(b, 2 * k + 1)
    into, out, own = table[:, : 2 * k : 2], table[:, 1 : 2 * k : 2], table[:, 2 * k]
    rows, mine = np.arange(b), np.zeros((b, k), bool)
    mine[rows, a] = True
    gain = np.zeros((b, k))
    for way, m in ((0, g), (1, g.T)):  # m[c] is what each class has with class c on that side
        fm = f(m)
        chosen = np.flatnonzero((side < 2 * k) & (side % 2 == way))
        for at in range(0, len(chosen), 8192):
            e = chosen[at : at + 8192]
            c, w, i = side[e] // 2, word[e], np.arange(len(e))
            delta = f(m[c] + n[e, None]) - fm[c]
            delta[i, a[w]] = fm[c, a[w]] - f(m[c, a[w]] - n[e])  # in its own class it is counted already
            delta[i, c] = 0  # see the diagonal
            first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            gain[w[first]] += np.add.reduceat(delta, first, axis=0)
        # beside its own class, bigrams of the word with the class at hand have left
        to, back = (into[rows, a], out) if way == 0 else (out[rows, a], into)
        there, less = m[a], m[a] - back
        gain += np.where(mine, 0, f(less + to[:, None]) - f(less) - f(there + to[:, None]) + f(there))
    d, both = np.diag(g), out + into + own[:, None]
    gain += np.where(mine, f(d) - f(d - both), f(d + both) - f(d))
    for total, extra in ((g.sum(axis=1), out.sum(axis=1) + own), (g.sum(axis=0), into.sum(axis=1) + own)):
        gain -= np.where(mine, f(total) - f(total - extra[:, None]), f(total + extra[:, None]) - f(total))
    gain[:, -1] = -np.inf
    best = gain.argmax(axis=1)
    return np.where(gain[rows, best] > gain[rows, a] + 1e-9, best, a)


def _moved(held, classes: int, words: int = 2048):
    """(at, class) of the words that an exchange moves; a word's rows come one after the other."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        v, g = held.value
        t = t.combine_chunks()
        lists = t.column("side").combine_chunks() if isinstance(t.column("side"), pa.ChunkedArray) else t.column("side")
        counts = t.column("n").combine_chunks() if isinstance(t.column("n"), pa.ChunkedArray) else t.column("n")
        at = np.repeat(t.column("at").to_numpy(), np.diff(lists.offsets.to_numpy()))
        place, word = np.unique(at, return_inverse=True)
        code, which = np.unique(word * (2 * classes + 1) + lists.flatten().to_numpy(), return_inverse=True)
        n = np.bincount(which, counts.flatten().to_numpy())
        a = v.of[place].astype(np.int64)
        best = best_class(g, a, code // (2 * classes + 1), code % (2 * classes + 1), n)
        gone = np.flatnonzero(best != a)
        return pa.RecordBatch.from_arrays([pa.array(place[gone].astype(np.int32)), pa.array(best[gone].astype(np.int16))], names=["at", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []
        for batch in batches:
            left.append(batch)
            t = pa.Table.from_batches(left)
            at = t.column("at").to_numpy()
            if len(at) and len(np.unique(at)) > words:
                cut = int(np.searchsorted(at, at[-1]))
                yield solve(t.slice(0, cut))
                left = t.slice(cut).combine_chunks().to_batches()
        if left:
            yield solve(pa.Table.from_batches(left))

    return run


def fit(g: np.ndarray) -> float:
    """Log-likelihood of class bigrams, but for what no exchange alters."""
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return float(f(g) - f(g.sum(axis=0)) - f(g.sum(axis=1)))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each item: the last item, the end, keeps a class of its own; no move lowers the likelihood."""
    n = len(bigrams)
    weight = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    of = np.zeros(n, int)
    of[np.argsort(-weight[:-1], kind="stable")] = np.arange(n - 1) % (classes - 1)
    of[-1] = classes - 1
    one = np.eye(classes)[of]
    log = lambda x: x * np.log(np.maximum(x, 1))
    for _ in range(sweeps):
        moved = 0
        g = one.T @ bigrams @ one
        for w in range(n - 1):
            a = of[w]
            out, into, own = bigrams[w] @ one, bigrams[:, w] @ one, bigrams[w, w]
            out[a] -= own
            into[a] -= own
            g[a, :] -= out
            g[:, a] -= into
            g[a, a] -= own
            rows, cols = g.sum(axis=1), g.sum(axis=0)
            # the likelihood that each class gains when the item joins it
            d = np.diag(g)
            gain = (log(g + out) - log(g)).sum(axis=1) + (log(g.T + into) - log(g.T)).sum(axis=1)
            gain += log(d + out + into + own) - log(d + out) - log(d + into) + log(d)
            ow, iw = out.sum() + own, into.sum() + own
            gain -= log(rows + ow) - log(rows) + log(cols + iw) - log(cols)
            gain[-1] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            g[b, :] += out
            g[:, b] += into
            g[b, b] += own
            if b != a:
                one[w, a], one[w, b], of[w] = 0, 1, b
                moved += 1
        if not moved:
            break
    return of


@dataclass
class Model:
    vocabulary: Vocabulary
    moves: np.ndarray
    emits: np.ndarray


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        v = m.vocabulary
        gained = np.append(np.log10(v.counts + 1.0), 0.0)
        for s in slices(batches):
            h, shape, first = tokens(s)
            at = v.find(h)
            group, found = v.groups(at, shape), at >= 0
            local = m.moves[v.before(group), group] - m.emits[group]
            seen = gained[at]
            total = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  each text has a token
            gap = np.concatenate(([0], np.cumsum(~found)))
            rare = pa.ListArray.from_arrays(pa.array(gap[first].astype(np.int32)), pa.array(signed(h[~found])))
            n = np.diff(first)
            yield pa.RecordBatch.from_arrays([s.batch.column("doc_id"), s.batch.column("held_out"), pa.array(n), pa.array(total(found.astype(np.int64))), pa.array(total(seen)), pa.array(total(local)), rare], names=["doc_id", "held_out", "n_tokens", "known", "seen", "local", "rare"])

    return run


def split(doc_id: Column) -> Column:
    """Whether a document is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def cluster(training: DataFrame, h: np.ndarray, n: np.ndarray, shape: np.ndarray) -> tuple[Vocabulary, np.ndarray]:
    """The tokens h, sorted, with n occurrences, and their classes; the class bigrams of training(text)."""
    spark = training.sparkSession
    classes = max(CLASSES, round(CLASSES_BY_ROOT * int((n >= MIN_COUNT).sum()) ** (1 / 3)))
    items = PER_CLASS * classes
    best = [i for i in np.lexsort((h, -n)) if h[i] != END][:items]
    of = items + shape
    of[best] = np.arange(len(best))
    bigrams = _bigrams(training, Vocabulary(h, n, of, items + np.arange(SHAPES + 1)), items + SHAPES + 1)
    class_of = exchange(bigrams, classes)
    one = np.eye(classes)[class_of]
    v, g = Vocabulary(h, n, class_of[of].astype(np.int16), class_of[items:]), one.T @ bigrams @ one
    for _ in range(ROUNDS):
        contexts = training.mapInArrow(_contexts(spark.sparkContext.broadcast(v), classes), "at int, side array<short>, n array<int>")
        by_word = contexts.repartition("at").sortWithinPartitions("at")
        moved = by_word.mapInArrow(_moved(spark.sparkContext.broadcast((v, g)), classes), "at int, class short").toArrow()
        after = v.of.copy()
        after[moved.column("at").to_numpy()] = moved.column("class").to_numpy()
        new = Vocabulary(h, n, after, v.of_shape)
        new_g = _bigrams(training, new, classes)
        if fit(new_g) <= fit(g):
            break
        v, g = new, new_g
    return v, g


def train(training: DataFrame, scratch: Scratch) -> tuple[Model, DataFrame, int, int]:
    """The model of training(text), the counts (h, shape, n) of its tokens, how many there are, and of how many kinds."""
    counts = scratch.keep(training.mapInArrow(_count, "h long, shape int, n long").groupBy("h").agg(F.first("shape").alias("shape"), F.sum("n").alias("n")))
    n_all, n_types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the lowest step of the counts, of some 16 to each doubling, above which at most FREQUENT tokens lie
    step = F.floor(F.log2("n") * 16).cast("int")
    steps, floor, total = counts.groupBy(step.alias("step")).count().collect(), None, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        if total + r["count"] > FREQUENT:
            break
        total, floor = total + r["count"], r["step"]
    top = counts.filter(step >= (floor if floor is not None else 1 << 20)).toArrow()
    h, n, shape = (top.column(c).to_numpy() for c in ("h", "n", "shape"))
    order = np.argsort(h.view(np.uint64))
    h, n, shape = h.view(np.uint64)[order], n[order], shape[order]
    v, g = cluster(training, h, n, shape)
    # tokens and types of each class: of the vocabulary's, and of what is left of each shape
    classes = len(g)
    class_n, class_v = np.bincount(v.of, n, classes).astype(float), np.bincount(v.of, minlength=classes).astype(float)
    rest_n, rest_v = -np.bincount(shape, n, SHAPES + 1).astype(float), -np.bincount(shape, minlength=SHAPES + 1).astype(float)
    for r in counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        rest_n[r["shape"]] += r["n"]
        rest_v[r["shape"]] += r["v"]
    class_n += np.bincount(v.of_shape, rest_n, classes)
    class_v += np.bincount(v.of_shape, rest_v, classes)
    unigram = (class_n + 1) / (class_n.sum() + classes)
    context = g.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        moves = np.where(context > 0, (np.maximum(g - DISCOUNT, 0) + DISCOUNT * (g > 0).sum(axis=1, keepdims=True) * unigram) / context, unigram)
    return Model(v, np.log10(moves), np.log10(class_n + class_v + 1)), counts, n_all, n_types


def score(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """A row for each row of docs(doc_id, text): counts, the add-one unigram base score and the class model's."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), split(F.col("doc_id").cast("long")).alias("held_out"))
    model, counts, n_all, n_types = train(rows.filter("not held_out").select("text"), scratch)
    floor = float(np.log10(n_all + n_types + 1))
    scored = rows.mapInArrow(_score(spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, n_tokens long, known long, seen double, local double, rare array<long>")
    scored = scratch.keep(scored.withColumn("row", F.monotonically_increasing_id()))
    found = scored.select("row", F.explode("rare").alias("h")).join(counts, "h").groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count("*").alias("more_known"))
    full = scored.drop("rare").join(found, "row", "left")
    seen = F.col("seen") + F.coalesce("more", F.lit(0.0))
    return full.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), (seen - F.col("n_tokens") * F.lit(floor)).alias("base_score"), (seen + F.col("local")).alias("score"))
