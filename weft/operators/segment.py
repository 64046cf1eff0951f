"""Documents to units, as tables: prose in SQL functions, Markdown and JSON by their scanners in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.text import normalized
from . import jsondoc, markdown, running

UNITS = "path string, ordinal long, unit_id string, kind string, pointer string, source string, start long, end long, n_spans long, error string"


def prose_units(docs: DataFrame, *more: str) -> DataFrame:
    """A unit for each line with text of docs(doc_id, text, ...): ordinal counts the document's units from 0; nothing is shuffled."""
    lines = docs.select("doc_id", *more, F.posexplode(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))).alias("nth", "source"))
    return lines.select("doc_id", F.col("nth").cast("long").alias("ordinal"), "source", normalized(F.col("source")).alias("norm"), *more)


def fingerprinted(units: DataFrame) -> DataFrame:
    return units.withColumn("fp", hashing.fingerprint(F.lit("Paragraph"), F.col("source")))


def with_ids(units: DataFrame) -> DataFrame:
    """Adds the occurrence-counting id and the stable id to fingerprinted units; a text that a document repeats without end is numbered piece by piece."""
    counted = running.numbered(units, ["doc_id", "fp"], running.pieces("ordinal"), [F.col("ordinal")], "_nth")
    named = counted.withColumn("unit_id", hashing.occurrence_id(F.col("fp"), F.col("_nth") - 1)).drop("_nth")
    return named.withColumn("stable_id", hashing.stable_id(F.col("doc_id"), F.col("unit_id"), F.col("ordinal")))


def _rows(path: str, kind: str, data: bytes) -> list[tuple]:
    try:
        if kind == "json":
            return [(path, i, None, "StringValue", x.pointer, x.text, x.start, x.end, 0, None) for i, x in enumerate(jsondoc.parse(data)[0])]
        if kind == "markdown":
            return [(path, i, u.id, u.kind, None, u.text, u.start, u.end, len(u.spans), None) for i, u in enumerate(markdown.parse(data))]
        raise ValueError(f"format {kind} is not supported")
    except ValueError as e:  # a refused document is one row that says why
        return [(path, -1, None, None, None, None, None, None, 0, f"PARSE: {e}")]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in UNITS.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in UNITS.split(", ")]
    for b in batches:
        rows = [r for p, k, d in zip(b.column("path").to_pylist(), b.column("format").to_pylist(), b.column("bytes").to_pylist(), strict=True) for r in _rows(p, k, d or b"")]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def document_units(files: DataFrame) -> DataFrame:
    """Units of files(path, format, bytes) with byte spans; documents that are refused have one row with an error."""
    return files.select("path", "format", F.col("bytes").cast("binary").alias("bytes")).mapInArrow(_parse, UNITS)
