"""Operator 2, license scans: TF-IDF cosine of headers and licence files to templates, inherited by path.

Two kinds of template: short notices by which authors put a text under a licence, and full licence texts, which are files of
`licenses/` beside this module, a folder that is a parameter. As sparse TF-IDF vectors each line and each paragraph of a text is held against
the notices, and the whole text against notices and licence texts; document frequencies of the
templates' words are counted over all texts, and a word of no template weighs as one that no text has. The
templates are a few constants, so what is broadcast is bounded. A first pass over hashed words gives every span
an upper bound of its cosine from prefix sums; only spans that reach the threshold are scored exactly. What the
whole text says comes before what a line or paragraph says: a licence text that contains another's notice, or reserves
rights, is still its own licence. A text that as a whole is a full licence text is a licence file and speaks for its
directory; one that as a whole is a notice is one only where its file is named as licence files are, so that a source file of a
header alone speaks for itself. A line that names its licence by an SPDX identifier is a notice like the others, but matches only with
that very identifier. A document without a licence of its own takes
that of the nearest directory at or above its own which has a licence file: directories, not documents, are
exploded to their ancestors and joined by path, and the documents then join their directory's row.

Defined results: null and empty texts have no licence of their own; marks at the ends of words do not count, and words of marks
alone are none; equal scores go to the template that comes first; a
directory with several licence files takes the best, then the least path; a null path inherits nothing; repeated
rows repeat; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import IS_SPACE, Scratch, Slice, prefix_hash, slices, span_hash

THRESHOLD = 0.6
# Notices by which authors put their texts under a licence.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0 Universal."),
    ("Proprietary", "All rights reserved."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
]
# Identifiers that a line may name after TAG.
TAG = "SPDX-License-Identifier:"
IDENTIFIERS = [
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
]
TEMPLATES += [(i, f"{TAG} {i}") for i in IDENTIFIERS]
# names of licence files
NAMES = r"(?i)(^|/)(un)?(licen[cs]es?|copying|copyright|notice)([-_][a-z0-9+-]+(\.[0-9]+)*)?(\.(md|txt|rst|html|lesser))?$"
PUNCT = np.zeros(256, bool)
PUNCT[list(b".,;:!?()[]{}\"'`*#/|-_<>")] = True
SCHEMA = "doc_id long, path string, own string, own_score double, own_whole boolean, own_full boolean"


TEXTS = Path(__file__).with_name("licenses")


def templates(folder: Path | str = TEXTS) -> list[tuple[str, str, bool]]:
    """(licence, text, whether it is a full text): the notices, then the folder's files by name."""
    return [(n, t, False) for n, t in TEMPLATES] + [(f.stem, f.read_text(), True) for f in sorted(Path(folder).glob("*.txt"))]


def words(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words, lower-cased and stripped of marks at their ends; their starts; where each text's begin."""
    starts, ends, first = s.words()
    if not len(starts):
        return np.zeros(0, np.uint64), starts, first
    solid = np.flatnonzero(~PUNCT[s.data] & ~IS_SPACE[s.data])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    kept = low < high
    at, to = solid[low[kept]], solid[high[kept] - 1] + 1
    return span_hash(prefix_hash(s.data, lower=True), at, to), at, np.searchsorted(at, s.offsets)


@dataclass
class Model:
    names: list[str]
    full: np.ndarray  # by template: whether it is a full text
    vocabulary: np.ndarray
    idf: np.ndarray
    unknown: float
    weights: np.ndarray  # by word and template: idf squared times frequency, over the template's norm
    threshold: float
    tag: np.ndarray  # by template: the hash of the identifier that an SPDX line has to name, or 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place in the vocabulary of each word, or its length."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, len(self.vocabulary))

    def cosine(self, h: np.ndarray, place: np.ndarray) -> np.ndarray:
        counts = Counter(h.tolist())
        idf = dict(zip(h.tolist(), np.append(self.idf, self.unknown)[place].tolist(), strict=True))
        cos = self.weights[place[place < len(self.idf)]].sum(axis=0) / math.sqrt(sum((n * idf[w]) ** 2 for w, n in counts.items()))
        return np.where((self.tag == 0) | np.isin(self.tag, h), cos, -1.0)

    def best(self, s: Slice) -> list[tuple[int, float, bool]]:
        """(template or -1, score, whether the whole text matches) for each text."""
        h, starts, first = words(s)
        out = [(-1, 0.0, False)] * s.n
        if not len(h):
            return out
        place = self.find(h)
        idf2 = np.append(self.idf, self.unknown)[place] ** 2
        owner = np.repeat(np.arange(s.n), np.diff(first))
        breaks = np.flatnonzero(s.data == 10)
        blank = breaks[1:][_blank(s, breaks)] if len(breaks) > 1 else breaks[:0]
        begins = lambda at: np.flatnonzero(np.concatenate(([True], (np.diff(np.searchsorted(at, starts)) != 0) | (np.diff(owner) != 0))))
        hit = np.flatnonzero(place < len(self.idf))
        sums = np.concatenate((np.zeros((1, self.weights.shape[1])), np.cumsum(self.weights[place[hit]], axis=0)))
        # a word's own weight never is below its share of the norm, so this bounds the cosine from above; the whole text comes first
        for span, whole in ((np.unique(first[:-1][np.diff(first) > 0]), True), (begins(breaks), False), (begins(blank), False)):
            ends = np.append(span[1:], len(h))
            got = sums[np.searchsorted(hit, ends)] - sums[np.searchsorted(hit, span)]
            bound = (got if whole else got[:, ~self.full]).max(axis=1) / np.sqrt(np.add.reduceat(idf2, span))
            for i in np.flatnonzero(bound >= self.threshold - 1e-9):
                a, b, o = span[i], ends[i], int(owner[span[i]])
                if out[o][2]:
                    continue
                cos = self.cosine(h[a:b], place[a:b])
                if not whole:
                    cos = np.where(self.full, -1.0, cos)
                t = int(np.flatnonzero(cos >= cos.max() - 1e-12)[0])
                was = out[o]
                if cos[t] >= self.threshold and (cos[t] > was[1] + 1e-12 or (was[0] > t and abs(cos[t] - was[1]) <= 1e-12)):
                    out[o] = (t, float(cos[t]), whole)
        return out


def _blank(s: Slice, breaks: np.ndarray) -> np.ndarray:
    """Whether nothing but space stands between each line's end and the one before."""
    solid = np.concatenate(([0], np.cumsum(~IS_SPACE[s.data])))
    return solid[breaks[1:]] == solid[breaks[:-1]]


def _template_words(given: list[tuple[str, str, bool]]) -> list[np.ndarray]:
    s = Slice(pa.RecordBatch.from_arrays([pa.array([t for _, t, _ in given])], names=["text"]), "text")
    h, _, first = words(s)
    return [h[first[i] : first[i + 1]] for i in range(s.n)]


def _frequencies(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(len(vocabulary), np.int64)
        for s in slices(batches):
            h, _, first = words(s)
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            known = vocabulary[at] == h
            owner = np.repeat(np.arange(s.n), np.diff(first))[known]
            pairs = np.unique(owner * len(vocabulary) + at[known])
            df += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
            n += s.n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(vocabulary))), pa.array(np.append(n, df))], names=["word", "n"])

    return run


def train(docs: DataFrame, threshold: float = THRESHOLD, folder: Path | str = TEXTS) -> Model:
    """Document frequencies of the templates' words over all texts, and the templates' vectors."""
    given = templates(folder)
    by_template = _template_words(given)
    vocabulary = np.unique(np.concatenate(by_template))
    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_frequencies(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"]: r["n"] for r in got}
    df = np.array([n.get(i, 0) for i in range(len(vocabulary))])
    total = n.get(-1, 0)
    idf = np.log((1 + total) / (1 + df)) + 1
    weights = np.zeros((len(vocabulary), len(given)))
    for t, h in enumerate(by_template):
        at, tf = np.unique(np.searchsorted(vocabulary, h), return_counts=True)
        weights[at, t] = idf[at] ** 2 * tf / math.sqrt(((idf[at] * tf) ** 2).sum())
    tag = np.array([h[-1] if text.startswith(TAG) else 0 for h, (_, text, _) in zip(by_template, given, strict=True)], np.uint64)
    return Model([n for n, _, _ in given], np.array([f for _, _, f in given]), vocabulary, idf, math.log(1 + total) + 1, weights, threshold, tag)


def _scan(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            best = held.value.best(s)
            yield pa.RecordBatch.from_arrays([s.batch.column("doc_id"), s.batch.column("path"), pa.array([held.value.names[t] if t >= 0 else None for t, _, _ in best], pa.string()), pa.array([x for _, x, _ in best], pa.float64()), pa.array([w for _, _, w in best]), pa.array([w and bool(held.value.full[t]) for t, _, w in best])], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def scan(docs: DataFrame, scratch: Scratch | None = None, threshold: float = THRESHOLD, folder: Path | str = TEXTS) -> DataFrame:
    """A row for each row of docs(doc_id, path, text): its own licence, and the one that holds for it, with where from."""
    scratch = scratch or Scratch(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(train(docs, threshold, folder))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    dir_ = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    named = F.coalesce(F.col("path").rlike(NAMES), F.lit(False))
    found = scratch.keep(rows.mapInArrow(_scan(held), SCHEMA).withColumn("own_file", F.col("own_full") | (F.col("own_whole") & named)).withColumn("dir", dir_))
    files = found.filter("own_file and path is not null").groupBy(F.col("dir").alias("of")).agg(F.min_by("own", F.struct(-F.col("own_score"), F.col("path"))).alias("license"))
    # every directory once, exploded to itself and those above it
    steps = F.split("dir", "/")
    above = found.filter("path is not null and own is null").select("dir").distinct().withColumn("of", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.concat_ws("/", F.slice(steps, 1, i)))))
    nearest = above.distinct().join(files, "of").groupBy("dir").agg(F.max_by(F.struct("license", "of"), F.length("of")).alias("got"))
    out = found.join(nearest, "dir", "left")
    inherited = F.col("own").isNull() & F.col("path").isNotNull()
    return out.select(
        "doc_id", "path", "own", "own_score", "own_whole", "own_file",
        F.coalesce("own", F.when(inherited, F.col("got.license"))).alias("license"),
        F.when(F.col("own").isNotNull(), "own").when(inherited & F.col("got.license").isNotNull(), "inherited").alias("origin"),
        F.when(inherited, F.col("got.of")).alias("from_dir"),
    )
