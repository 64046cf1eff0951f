"""Single units outside of their documents: checked by their format, rebuilt from what was stored of them, and what their tokens may do."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import jsondoc, markdown


def rebuilt(format_: str, source: str, kind: str | None = None, parsed: str | None = None) -> markdown.Unit | str | None:
    """The unit that a stored text was: a message is its text, prose is parsed again, from the text it stood in if that was kept; None if it is not found there."""
    if format_ == "json":
        return source
    if format_ != "markdown":
        return None
    found = [u for u in markdown.parse((source if parsed is None else parsed).encode()) if u.text == source and (parsed is None or u.kind == kind)]
    return found[0] if found else None


def validate(format_: str, source: str, target: str, kind: str | None = None, interpolated: bool = False) -> list[str]:
    """Codes of what is wrong with a tokenised translation, by the unit's format."""
    try:
        unit = rebuilt(format_, source, kind)
        if unit is None:
            return ["DOCUMENT-CONTRACT"]
        if isinstance(unit, str):
            return jsondoc.validate_tokens(unit, target) if interpolated else jsondoc.validate(unit, target)
        return markdown.validate(unit, target)
    except ValueError:
        return ["DOCUMENT-CONTRACT"]


def reorderable(format_: str, source: str, interpolated: bool = False) -> list[str]:
    """The tokens of a unit that a translation may put elsewhere: those of inline code, and of interpolations."""
    unit = rebuilt(format_, source)
    if isinstance(unit, str):
        return [t for t, _ in jsondoc.tokenize(unit)[1]] if interpolated else []
    if unit is None:
        return []
    return [t for (t, _), s in zip(markdown.tokenize(unit)[1], unit.spans, strict=True) if s.kind == "inline_code"]


def findings(units: DataFrame) -> DataFrame:
    """units(unit_id, format, source, target, interpolated) with the codes of what is wrong with each target; a null target has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("format", "source", "target", "interpolated")), strict=True)
            codes = [[] if t is None else validate(f, s or "", t, interpolated=bool(i)) for f, s, t, i in rows]
            yield pa.RecordBatch.from_arrays([b.column("unit_id").cast(pa.string()), pa.array(codes, pa.list_(pa.string()))], names=["unit_id", "codes"])

    return units.select("unit_id", "format", "source", "target", "interpolated").mapInArrow(run, "unit_id string, codes array<string>")
