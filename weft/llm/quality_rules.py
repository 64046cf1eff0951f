"""Operator 1, quality rules: base rules of shape, then an n-gram perplexity band per language.

The n-grams are of characters, code point by code point: nothing is folded, so a language's model tells its letters, accents,
capitals and punctuation apart, in every script, and invented or inflected words are no problem. Languages go by their own name (the part
before a hyphen or underscore, in lower case; null is one of its own) and never share counts. Spark counts the 4-grams of every whole text, led in by
three blanks, and makes the model by joins and sums: modified Kneser-Ney (three discounts an order, continuation counts below the top),
each order's probabilities interpolated with the next lower one's by the back-off weights of its contexts. All texts are counted, so a text has no
4-gram without a probability, and those of the top order are what scoring needs. They are broadcast as sorted arrays of hashes that are
searched by bisection, in blocks of at most `BLOCK` entries, each with a pass of its own over its languages' texts. A language with
more entries is cut into parts by hash, with a pass for each; a text's scores are whole numbers, so their sum is the same however it is cut. A long text's 4-grams are made
piece by piece; only the base rules take memory by the longest text.

All texts count, so a language's junk is known to its model; it stands out by the band. A further pass
makes a histogram of the cross-entropies of each language's texts of `MIN_WORDS` words and more, and its median
and median deviation are the band's robust centre and spread: a text is kept from the higher of
`LOW * centre` and `centre - SPREADS * spread`, to the lower of `HIGH * centre` and `centre + ABOVE * spread`, both widened by a slack of `SIGMAS`
standard deviations of the mean over the text's length, so that short texts are not judged by noise. The model has read the texts that it
judges, so a few of another script or of signs that no other text has are no surprise to themselves once they have begun: their cross-entropy by the plain shares of the language's
characters (`alone`) must not lie above an upper band of its own, of `ALONE` spreads, either. Below, all rows make the centre and the spread, so that a text of
many copies is judged by itself; above, different texts do (counted by a sketch for each bin), so that such copies
do not make a band that the others lie outside of. The upper spread also counts `PRIOR_TEXTS` texts of a spread of `PRIOR` of the centre, for a few texts make no spread.

Defined results: a null or empty text has no words and fails the base rules; where a language has no
text of `MIN_WORDS` words there is no band (0 to 0) and none of its texts is kept; repeated rows give repeated results; an
empty table gives an empty result; further columns are ignored, whatever their names. Languages, 4-grams and texts are told apart by hashes (64 bits, texts by 128).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folded import SIZE, beyond, codes, kneser_ney  # noqa: F401  what the tests compare with
from .kit import BASE, Scratch, Slice, mix, settle, shingles, slices, prefix_hash, signed, span_hash

ORDER = 4
BITS = 21  # of a code point; a context of three fits a long
BLOCK = 8 * SIZE
MERGE = 1 << 19  # counts that a task holds before it sums them up
SLICE = 1 << 18  # bytes of texts that are read at a time, or a single longer text
PIECE = 1 << 16  # characters that are made into 4-grams at a time, twice as many at most; counts in a batch
MIN_WORDS = 50
LOW, HIGH, SIGMAS = 0.80, 1.55, 1.0
SPREADS, ABOVE, ALONE = 3.0, 5.0, 12.0
PRIOR_TEXTS, PRIOR = 4, 0.1
BINS = 10_000  # of the histogram, to each unit of entropy
UNIT = 1_000_000  # scores are whole numbers of this part of a power of ten
SYMBOLS = b"#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, entropy double, low double, high double, alone double, alone_high double"
LEAD = " " * (ORDER - 1)
COSTS = ("cost", "alone")


def language() -> Column:
    """What a language goes by; null for null."""
    return F.lower(F.trim(F.split(F.col("lang").cast("string"), "[-_]").getItem(0)))


def _key(name: Column) -> Column:
    return F.xxhash64(name.isNull(), name)


@dataclass
class Grams:
    """4-grams of some texts of a slice, or of a piece of one: the first three characters, the last one, the key, where each piece's begin, and the piece's row."""

    context: np.ndarray
    last: np.ndarray
    key: np.ndarray
    first: np.ndarray
    rows: np.ndarray


def _pieces(s: Slice) -> Iterator[tuple[int, str]]:
    """(row, characters): a text of more than PIECE bytes is cut between characters, and each piece is led in by the three characters before it."""
    for i in range(s.n):
        at, end, lead = int(s.offsets[i]), int(s.offsets[i + 1]), LEAD
        while at < end:
            cut = min(at + PIECE, end)
            if cut < end:  # four bytes within characters are none of a character's, so any cut among them will do
                cut -= next((k for k in range(4) if s.data[cut - k] & 0xC0 != 0x80), 0)
            text = lead + s.data[at:cut].tobytes().decode("utf-8", "replace")
            yield i, text
            at, lead = cut, text[-len(LEAD) :]


def _grams(s: Slice, pieces: list[tuple[int, str]]) -> Grams:
    parts = [np.frombuffer(text.encode("utf-32-le"), np.uint32) for _, text in pieces]
    rows = np.array([i for i, _ in pieces], np.int64)
    lengths = np.array([len(p) - len(LEAD) for p in parts], np.int64)
    first = np.concatenate(([0], np.cumsum(lengths)))
    points = np.concatenate(parts).astype(np.uint64)
    owner = np.repeat(np.arange(len(parts)), lengths)
    at = np.arange(first[-1]) + len(LEAD) * owner
    b = np.uint64(BITS)
    context = points[at] << b + b | points[at + 1] << b | points[at + 2]
    last = points[at + 3]
    lang = s.batch.column("lang").to_numpy(zero_copy_only=False).view(np.uint64)
    return Grams(context, last, mix(mix(context * BASE + last) + mix(lang[rows])[owner]), first, rows)


def grams(s: Slice) -> Iterator[Grams]:
    """All 4-grams of a slice's texts, so many at a time that memory does not follow a text's length."""
    held: list[tuple[int, str]] = []
    size = 0
    for i, text in _pieces(s):
        held.append((i, text))
        size += len(text)
        if size >= PIECE:
            yield _grams(s, held)
            held, size = [], 0
    if held:
        yield _grams(s, held)


def _merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The sums by key, in the order of the keys; empties the list, column by column."""
    columns = list(zip(*held, strict=True))[::-1]
    held.clear()
    seen, at, into = np.unique(np.concatenate(columns.pop()), return_index=True, return_inverse=True)
    rest = [np.concatenate(columns.pop())[at] for _ in range(len(columns) - 1)]
    return seen, *rest, np.bincount(into, np.concatenate(columns.pop()), len(seen)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, context, last, n): sums over a task's texts, or over as many of them as have MERGE different 4-grams."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        key, lang, context, last, n = _merged(held)
        for i in range(0, len(key), PIECE):
            part = slice(i, i + PIECE)
            yield pa.RecordBatch.from_arrays([pa.array(lang[part]), pa.array(signed(key[part])), pa.array(signed(context[part])), pa.array(last[part]), pa.array(n[part])], names=["lang", "key", "context", "last", "n"])

    for s in slices(batches, limit=SLICE):
        lang = s.batch.column("lang").to_numpy(zero_copy_only=False)
        for g in grams(s):
            seen, at, n = np.unique(g.key, return_index=True, return_counts=True)
            of = lang[g.rows][np.searchsorted(g.first, at, side="right") - 1]
            held.append((seen, of, g.context[at], g.last[at].astype(np.int32), n))
            size += len(seen)
            if size > MERGE:
                held[:] = [_merged(held)]
                size = len(held[0][0])
                if size > MERGE // 2:
                    yield from rows()
                    size = 0
    if held:
        yield from rows()
    settle()


def kneser_ney_tables(counts: DataFrame) -> DataFrame:
    """(lang, key, n, cost, alone): modified, interpolated Kneser-Ney from counts(lang, key, context, last, n).

    cost is -log10 of the probability of the last character after the three before it, in units; alone is that of its share of the language's characters.
    """
    tail = lambda k: F.col("context").bitwiseAND(F.lit((1 << BITS * k) - 1))  # noqa: E731  the last k characters of a context
    orders = [counts]
    for k in range(ORDER - 2, -1, -1):  # below the top: in how many different left contexts
        orders.insert(0, orders[0].groupBy("lang", tail(k).alias("context"), "last").agg(F.count("*").alias("n")))
    lower = None
    for k, c in enumerate(orders):
        seen = [F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.when(F.col("n1") + F.col("n2") > 0, F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0))).otherwise(0.5)
        d = lambda i: F.when(F.col(f"n{i}") > 0, F.least(F.lit(i - 0.01), F.greatest(F.lit(0.05), i - (i + 1) * F.col("y") * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0))))).otherwise(0.5 * i).alias(f"d{i}")
        discounts = F.broadcast(c.groupBy("lang").agg(*seen, F.count("*").alias("types")).withColumn("y", y).select("lang", d(1), d(2), d(3), "types"))  # a row a language
        # whole numbers, so that sums do not hang on their order
        totals = c.groupBy("lang", "context").agg(F.sum("n").alias("total"), *[F.sum((F.least("n", F.lit(3)) == i).cast("long")).alias(f"t{i}") for i in (1, 2, 3)])
        rows = c.join(totals, ["lang", "context"]).join(discounts, "lang")
        discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        backoff = (F.col("d1") * F.col("t1") + F.col("d2") * F.col("t2") + F.col("d3") * F.col("t3")) / F.col("total")
        if lower is None:
            p = F.lit(1.0) / F.col("types")  # of all characters of the language
            often = counts.groupBy("lang", "last").agg(F.sum("n").alias("m"))
            share = often.join(F.broadcast(often.groupBy("lang").agg(F.sum("m").alias("all"))), "lang").select("lang", "last", (F.col("m") / F.col("all")).alias("share"))
            rows = rows.join(share, ["lang", "last"])
        else:
            rows = rows.withColumn("below", tail(k - 1)).join(lower, ["lang", "below", "last"])
            p = F.col("p_below")
        rows = rows.withColumn("p", (F.col("n") - discount) / F.col("total") + backoff * p)
        lower = rows.select("lang", F.col("context").alias("below"), "last", F.col("p").alias("p_below"), "share")
    units = lambda c: F.round(-UNIT * F.log10(c)).cast("int")
    return rows.select("lang", "key", "n", units("p").alias("cost"), units("share").alias("alone"))


@dataclass
class Band:
    """What a language's texts are judged by: the deviations of its 4-grams' scores, and the centre and spread of its texts, if any is long enough."""

    deviation: float
    alone: float
    centre: float | None = None
    spread: float = 0.0
    top: float = 0.0
    alone_top: float = 0.0


@dataclass
class Block:
    """Some languages with their bands, and their model in one part or more: keys in order, with the costs of each."""

    langs: list[int]
    model: DataFrame
    parts: int
    bands: dict[int, Band] = field(default_factory=dict)

    def part(self, i: int):
        rows = self.model.filter((F.col("lang").isin(self.langs) if self.langs else F.lit(False)) & (F.pmod("key", F.lit(self.parts)) == i)).select("key", *COSTS).toArrow()
        key, *costs = (rows.column(c).to_numpy() for c in ("key", *COSTS))
        order = np.argsort(key)
        return self.model.sparkSession.sparkContext.broadcast((key[order], np.stack([c[order] for c in costs])))


def _costs(part, s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The summed costs, of either kind, of each text of a slice, by a part of a model or as they came with the rows, and its number of 4-grams."""
    sums, n = np.zeros((len(COSTS), s.n), np.int64), np.zeros(s.n, np.int64)
    for g in grams(s):
        np.add.at(n, g.rows, np.diff(g.first))
        if part is None or not len(part.value[0]):
            continue
        key, costs = part.value
        seen, into = np.unique(signed(g.key), return_inverse=True)
        at = np.minimum(np.searchsorted(key, seen), len(key) - 1)
        found = key[at] == seen
        for total, c in zip(sums, costs, strict=True):
            x = np.concatenate(([0], np.cumsum(np.where(found, c[at], 0).astype(np.int64)[into])))
            np.add.at(total, g.rows, np.diff(x[g.first]))
    return sums if part is not None else np.stack([s.batch.column(c).to_numpy(zero_copy_only=False) for c in COSTS]), n


def _entropies(part, s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The cross-entropies of each text, 0 for an empty one, and its number of 4-grams."""
    costs, n = _costs(part, s)
    return costs / np.maximum(n, 1) / UNIT, n


def _parted(part):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, limit=SLICE):
            yield pa.RecordBatch.from_arrays([s.batch.column("one"), s.batch.column("two"), *map(pa.array, _costs(part, s)[0])], names=["one", "two", *COSTS])

    return run


def _with_costs(rows: DataFrame, block: Block, lang: str, names: dict[str, str]) -> DataFrame:
    """The rows of a language whose model has several parts, with their texts' costs, summed over the parts."""
    scratch = Scratch(rows.sparkSession)
    one, two = names["one"], names["two"]
    marked = rows.withColumns({one: F.xxhash64("text"), two: F.xxhash64(F.lit(1), "text")})
    out = None
    for i in range(block.parts):
        got = marked.select(F.col("text").cast("string").alias("text"), F.col(lang).alias("lang"), F.col(one).alias("one"), F.col(two).alias("two"))
        got = got.mapInArrow(_parted(block.part(i)), f"one long, two long, {', '.join(f'{c} long' for c in COSTS)}")
        got = scratch.keep(got.groupBy("one", "two").agg(*[F.first(c).alias(c) for c in COSTS]))
        out = got if out is None else out.union(got)
    sums = out.groupBy(F.col("one").alias(one), F.col("two").alias(two)).agg(*[F.sum(c).alias(names[c]) for c in COSTS])
    return marked.join(sums, [one, two]).select(*rows.columns, *[names[c] for c in COSTS])


def train(docs: DataFrame) -> list[Block]:
    """Counts every text's 4-grams; the models of docs(lang, text), lang being a hash, by blocks of languages, with their deviations."""
    scratch = Scratch(docs.sparkSession)
    counts = scratch.keep(docs.mapInArrow(_counts, "lang long, key long, context long, last int, n long").groupBy("lang", "key", "context", "last").agg(F.sum("n").alias("n")))
    model = scratch.keep(kneser_ney_tables(counts))
    scratch.drop(counts)
    n, square = F.col("n").cast("decimal(18,0)"), lambda c: (F.col(c).cast("long") * F.col(c)).cast("decimal(18,0)")  # whole numbers again
    sums = [x for c in COSTS for x in (F.sum(n * F.col(c).cast("decimal(18,0)")).alias(f"{c}_1"), F.sum(n * square(c)).alias(f"{c}_2"))]
    about = model.groupBy("lang").agg(F.count("*").alias("entries"), F.sum("n").alias("n"), *sums)
    blocks: list[Block] = []
    size = BLOCK
    for r in sorted(about.collect(), key=lambda r: r["lang"]):
        if size + r["entries"] > BLOCK:
            blocks.append(Block([], model, max(1, -(-r["entries"] // BLOCK))))
            size = 0
        blocks[-1].langs.append(r["lang"])
        size += r["entries"]
        wide = [max(0.0, int(r[f"{c}_2"]) / r["n"] - (int(r[f"{c}_1"]) / r["n"]) ** 2) ** 0.5 / UNIT for c in COSTS]
        blocks[-1].bands[r["lang"]] = Band(*wide)
    return blocks or [Block([], model, 1)]


def _histogram(part):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, limit=SLICE):
            rows = np.flatnonzero(np.diff(s.words()[2]) >= MIN_WORDS)
            for kind, x in zip(COSTS, _entropies(part, s)[0], strict=True):
                bins = (x[rows] * BINS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([s.batch.column("lang").take(pa.array(rows)), pa.repeat(kind, len(rows)), pa.array(bins), s.batch.column("hash").take(pa.array(rows))], names=["lang", "kind", "bin", "hash"])

    return run


def _middle(x: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(x)
    return float(x[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)])


def _robust(x: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """The median and the scaled median deviation of a histogram."""
    middle = _middle(x, n)
    return (middle + 0.5) / BINS, 1.4826 * _middle(np.abs(x - middle), n) / BINS


def _banded(docs: DataFrame, part, bands: dict[int, Band]) -> None:
    """Sets the centre and the spread of the languages' texts."""
    by: dict[tuple[int, str], list[tuple[int, int, int]]] = {}
    rows = docs.withColumn("hash", F.xxhash64("text")).mapInArrow(_histogram(part), "lang long, kind string, bin int, hash long")
    # sketches of the texts of a bin, which are combined before they are shuffled
    for r in rows.groupBy("lang", "kind", "bin").agg(F.count("*").alias("n"), F.approx_count_distinct("hash").alias("texts")).collect():
        by.setdefault((r["lang"], r["kind"]), []).append((r["bin"], r["n"], r["texts"]))
    for (lang, kind), bins in by.items():
        x, n, texts = (np.array(v, float) for v in zip(*bins, strict=True))
        m = bands[lang]
        centre, spread = _robust(x, texts)
        wide = np.sqrt((texts.sum() * spread**2 + PRIOR_TEXTS * (PRIOR * centre) ** 2) / (texts.sum() + PRIOR_TEXTS))
        top = float(min(HIGH * centre, centre + (ABOVE if kind == "cost" else ALONE) * wide))
        if kind == "alone":
            m.alone_top = top
        else:
            m.centre, m.spread = _robust(x, n)
            m.top = top


def base(s: Slice) -> dict[str, np.ndarray]:
    """The counts of the base rules for each text of a slice."""
    starts, ends, first = s.words()
    n_words = np.diff(first)
    lead = np.concatenate(([0], np.cumsum((s.data & 0xC0) != 0x80)))  # code points before each byte
    in_words = np.concatenate(([0], np.cumsum(lead[ends] - lead[starts])))
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    symbols = np.concatenate(([0], np.cumsum(symbol[s.data])))
    prefix = prefix_hash(s.data)
    h = span_hash(prefix, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(s.n), n_words)
    # words in three-word windows that the text has twice or more
    repeat = np.zeros(len(h) + 1, np.int64)
    tri = shingles(h, 3)
    inside = np.flatnonzero(owner[: len(tri)] == owner[2:]) if len(tri) else np.zeros(0, np.int64)
    if len(inside):
        twice = _repeated(owner[inside], tri[inside])
        at = inside[twice]
        np.add.at(repeat, at, 1)
        np.add.at(repeat, at + 3, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(repeat[:-1]) > 0)))
    # lines with a word, equal to an earlier one
    breaks = np.flatnonzero(s.data == 10)
    line_start = np.unique(np.concatenate((s.offsets[:-1][np.diff(s.offsets) > 0], breaks + 1)))
    line_start = line_start[line_start < len(s.data)]
    line_owner = np.searchsorted(s.offsets, line_start, side="right") - 1
    line_end = np.concatenate((line_start[1:], [len(s.data)])) if len(line_start) else line_start
    line_end = np.where((line_end > line_start) & (s.data[np.maximum(line_end - 1, 0)] == 10), line_end - 1, line_end) if len(line_start) else line_end
    full = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_owner, line_start, line_end = line_owner[full], line_start[full], line_end[full]
    dup = np.zeros(s.n, np.int64)
    if len(line_start):
        hashes = span_hash(prefix, line_start, line_end)
        order = np.lexsort((hashes, line_owner))
        same = (line_owner[order][1:] == line_owner[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
        dup = np.bincount(line_owner[order][1:][same], minlength=s.n)
    return {"n_words": n_words, "word_chars": np.diff(in_words[first]), "n_symbols": np.diff(symbols[s.offsets]), "n_dup_lines": dup, "n_repeat_words": np.diff(covered[first])}


def _repeated(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    order = np.lexsort((h, owner))
    o, x = owner[order], h[order]
    same = (o[1:] == o[:-1]) & (x[1:] == x[:-1])
    flag = np.zeros(len(h), bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return flag


def _judge(part, bands: dict[int, Band]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, limit=SLICE):
            b = base(s)
            failed = (b["n_words"] < MIN_WORDS) | (100 * b["n_repeat_words"] > 50 * b["n_words"])
            (mean, alone), n = _entropies(part, s)
            low, high, most, banded = np.zeros(s.n), np.zeros(s.n), np.zeros(s.n), np.zeros(s.n, bool)
            for i, lang in enumerate(s.batch.column("lang").to_pylist()):
                m = bands.get(lang)
                if m is None or m.centre is None or not n[i]:
                    continue
                slack = SIGMAS * m.deviation / np.sqrt(n[i])
                low[i], high[i] = max(LOW * m.centre, m.centre - SPREADS * m.spread) - slack, m.top + slack
                most[i] = m.alone_top + SIGMAS * m.alone / np.sqrt(n[i])
                banded[i] = True
            kept = ~failed & banded & (mean >= low) & (mean <= high) & (alone <= most)
            ids = s.batch.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(b[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(kept), pa.array(mean), pa.array(low), pa.array(high), pa.array(alone), pa.array(most)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def _by_block(docs: DataFrame, lang: str, run) -> DataFrame:
    """run(rows, part, bands, costs) for each block of languages; `lang` is the column of a row's language, costs name those added where a model has several parts."""
    taken = {c.lower() for c in docs.columns}
    names = {x: next(n for n in (f"{x}_{i}" for i in range(len(taken) + 1)) if n not in taken) for x in (*COSTS, "one", "two")}
    texts = lambda df, *more: df.select(F.col(lang).alias("lang"), F.col("text").cast("string").alias("text"), *more)
    blocks = train(texts(docs))
    later = [x for b in blocks[1:] for x in b.langs]
    out = None
    for i, block in enumerate(blocks):
        # the first block also has the languages without a single character
        rows = docs if len(blocks) == 1 else docs.filter(F.col(lang).isin(block.langs) if i else ~F.col(lang).isin(later))
        part, costs = block.part(0), {}
        if block.parts > 1:
            rows, part, costs = _with_costs(rows, block, lang, names), None, {c: names[c] for c in COSTS}
        _banded(texts(rows, *[F.col(x).alias(c) for c, x in costs.items()]), part, block.bands)
        done = run(rows, part, block.bands, costs)
        out = done if out is None else out.union(done)
    return out


def judge(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text, lang): counts of the base rules and the verdict."""
    rows = docs.select("doc_id", "text", _key(language()).alias("lang"))
    return _by_block(rows, "lang", lambda x, part, bands, costs: x.withColumnsRenamed({n: c for c, n in costs.items()}).mapInArrow(_judge(part, bands), SCHEMA))


def _keep(part, bands: dict[int, Band], columns: dict[str, str]):
    judged = _judge(part, bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                asked = pa.RecordBatch.from_arrays([batch.column(c) for c in columns.values()], names=list(columns))
                verdicts = pa.Table.from_batches(list(judged(iter([asked]))))
                added = {columns[c] for c in ("lang", *COSTS) if c in columns}
                yield batch.select([x for x in batch.schema.names if x not in added]).filter(verdicts.column("kept").combine_chunks())

    return run


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs whose verdict is kept, with all their columns."""
    name = "lang_key"
    while name in docs.columns:
        name += "_"
    columns = {"doc_id": "doc_id", "text": "text", "lang": name}
    return _by_block(docs.withColumn(name, _key(language())), name, lambda x, part, bands, costs: x.mapInArrow(_keep(part, bands, columns | costs), docs.schema))
