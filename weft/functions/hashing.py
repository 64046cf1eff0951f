"""Identity functions as Column expressions; all of SHA-256 over bytes whose layout is pinned."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalized


def content_hash(x: Column) -> Column:
    """Hex SHA-256 of the bytes themselves."""
    return F.sha2(x, 256)


def parts_hash(*parts: Column) -> Column:
    """Hex SHA-256 of the parts, each led by its length as eight bytes, big end first."""
    pieces = []
    for p in parts:
        data = F.encode(p.cast("string"), "UTF-8")
        pieces += [F.unhex(F.lpad(F.hex(F.octet_length(data).cast("long")), 16, "0")), data]
    return F.sha2(F.concat(*pieces), 256)


def fingerprint(kind: Column, source: Column) -> Column:
    """Sixteen hex digits that name a unit's kind and normalised source."""
    return F.substring(F.sha2(F.concat(kind, F.lit("\0"), normalized(source)), 256), 1, 16)


def occurrence_id(print_: Column, nth: Column) -> Column:
    """md-<fingerprint>-<nth>, at least two digits wide."""
    return F.format_string("md-%s-%02d", print_, nth)


def stable_id(*parts: Column) -> Column:
    return F.concat(F.lit("unit-"), F.substring(parts_hash(*parts), 1, 24))


def json_pointer_id(path: Column, pointer: Column) -> Column:
    return stable_id(F.lit("json-pointer-v1"), path, pointer)


def short_id(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 16)


def memory_key(**fields: Column) -> Column:
    """JSON of the fields in the order of their names, for use as a key."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def self_hash(fields: list[str], cleared: list[str]) -> Column:
    """Hash of a row's JSON with some of its own fields emptied."""
    return F.sha2(F.to_json(F.struct(*[(F.lit("") if f in cleared else F.col(f)).alias(f) for f in fields])), 256)


def manifest_hash(order: str, *fields: str) -> Column:
    """Aggregate: hash of the JSON list of a group's rows in the order given."""
    rows = F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order])))
    return F.sha2(F.to_json(rows), 256)


def invocation_key(repo: Column, lang: Column, revision: Column, policy: Column, config: Column) -> Column:
    return F.concat_ws(":", F.lit("sync"), repo, lang, revision, policy, config)


def token(namespace: str, label: Column, index: Column, value: Column) -> Column:
    """A placeholder that stands for a protected value: namespace, label, place and a digest."""
    return F.format_string(f"@@{namespace}_%s_%04d_%s@@", label, index, F.substring(F.sha2(value, 256), 1, 16))


def led_hash(*parts: str) -> str:
    """`parts_hash` of constants, on the driver: fingerprints of policies and configurations."""
    digest = hashlib.sha256()
    for p in parts:
        digest.update(len(p.encode()).to_bytes(8, "big") + p.encode())
    return digest.hexdigest()


def provider_fingerprint(provider: str, model: str, adapter: str, command: tuple[str, ...] = (), endpoint: str | None = None, max_tokens: int | None = None, effort: str | None = None) -> str:
    """Who answers: names, what an endpoint adds, and the command line."""
    more = [] if max_tokens is None else [str(max_tokens)]
    return led_hash(provider, model, adapter, *([endpoint] if endpoint else []), *more, *(["reasoning_effort", effort] if effort else []), *command)


def configuration_fingerprint(stages: dict[str, tuple[str, str | None]]) -> str | None:
    """Of each stage's (provider fingerprint, effort), in order, those with an effort; None without any."""
    parts = [x for name, (print_, effort) in stages.items() if effort is not None for x in (name, print_)]
    return led_hash(*parts) if parts else None
