"""Column functions on text: whitespace, placeholders, similarity, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The placeholder forms that translation must keep, in order of precedence.
PLACEHOLDERS = (
    r"\{\{[^{}\r\n]+\}\}",
    r"\$\{[A-Za-z_][A-Za-z0-9_.-]*\}",
    r"%\([A-Za-z_][A-Za-z0-9_.-]*\)[#0 +\-]?[0-9]*(?:\.[0-9]+)?[A-Za-z]",
    r"%(?:[1-9][0-9]*\$)?[#0 +\-]?[0-9]*(?:\.[0-9]+)?[A-Za-z%]",
    r"\{[A-Za-z_][A-Za-z0-9_.-]*(?::[^{}\r\n]+)?\}",
    r"@@[A-Za-z_][A-Za-z0-9_.*-]*@@",
)
PLACEHOLDER = "|".join(PLACEHOLDERS)
TAG = "</?[A-Za-z][^<>]*>"
# The floor of a fuzzy match, the weights of text and place, and the margin to the runner-up.
FUZZY_FLOOR, TEXT_WEIGHT, PLACE_WEIGHT, MARGIN = 0.72, 0.85, 0.15, 0.03
# Place adds its full weight at most, so a text less similar than this never reaches the floor.
LEAST_SIMILARITY = (FUZZY_FLOOR - PLACE_WEIGHT) / TEXT_WEIGHT


def normalized(text: Column) -> Column:
    """Runs of Unicode whitespace as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def placeholders(text: Column) -> Column:
    """Every placeholder in order of its place."""
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))


def html_tags(text: Column) -> Column:
    """Every opening and closing tag in order of its place."""
    return F.regexp_extract_all(text, F.lit(TAG), F.lit(0))


def similarity(a: Column, b: Column, distance: Column | None = None) -> Column:
    """1 - edit distance over the longer length, in characters; 1 for two empty texts."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1.0 - (F.levenshtein(a, b) if distance is None else distance) / longer)


def fuzzy_score(a: Column, b: Column, steps: Column, distance: Column | None = None) -> Column:
    """Text similarity and nearness of place, weighted."""
    return TEXT_WEIGHT * similarity(a, b, distance) + PLACE_WEIGHT / (1.0 + F.abs(steps))


def rfind(text: Column, part: str) -> Column:
    """Place of the last occurrence, from 0; -1 if there is none."""
    at = F.instr(F.reverse(text), part[::-1])
    return F.when(at == 0, -1).otherwise(F.char_length(text) - at - len(part) + 1)


def mask(text: Column, tokens: list[tuple[str, str]]) -> Column:
    for token, value in tokens:
        text = F.replace(text, F.lit(value), F.lit(token))
    return text


def occurrences(text: Column, part: Column) -> Column:
    """How often a part occurs, without overlaps; part is taken literally."""
    return ((F.char_length(text) - F.char_length(F.replace(text, part, F.lit("")))) / F.char_length(part)).cast("long")


def strip_prefix(path: Column, prefix: str) -> Column:
    """The path below a directory, by whole components; null outside of it."""
    if not prefix:
        return path
    return F.when(path.startswith(prefix + "/"), F.substr(path, F.lit(len(prefix) + 2)))


def target_path(template: Column, lang: Column, relpath: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{lang}"), lang), F.lit("{relpath}"), relpath)


def ancestors(path: Column) -> Column:
    """Each directory above a path and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def safe_target(path: Column) -> Column:
    """Whether a path is relative and made of ordinary components."""
    return ~F.exists(F.split(path, "/"), lambda c: c.isin("", ".", "..")) & ~path.contains("\\") & (F.char_length(path) > 0)


def plural_key(key: Column) -> Column:
    return key.rlike("_(zero|one|two|few|many|other|plural|ordinal|[0-9]+)$") | key.contains("_ordinal_")


def backoff_ms(attempt: Column) -> Column:
    """Delay before a retry: 200 ms doubled up to four times, 30 s at most."""
    return F.least(F.lit(200) * F.pow(F.lit(2), F.least(attempt, F.lit(4))), F.lit(30_000)).cast("long")


def ascii_equal(a: Column, b: Column) -> Column:
    """Equality that overlooks the case of A-Z only."""
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low(a) == low(b)


def branch(pattern: Column, locale: Column) -> Column:
    """The branch of a locale, or null where pattern and locale make none that is valid."""
    name = F.replace(pattern, F.lit("{lang}"), locale)
    good = locale.rlike(r"^[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)*$") & pattern.contains("{lang}")
    bad = name.rlike(r"^[-/]|[/.]$|\.lock$|\.\.|//|@\{|[\x00-\x20\x7f~^:?*\[\\]")
    return F.when(good & ~bad, name)


def reserved(path: Column, roots: list[str]) -> Column:
    """Whether a path is one of the reserved ones or lies below one."""
    out = F.lit(False)
    for r in roots:
        out = out | (path == r) | path.startswith(r + "/")
    return out


def rfc3339(at: Column) -> Column:
    """A timestamp in UTC to the second."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def elapsed(begun: Column, at: Column) -> Column:
    """Seconds between two timestamps, to the millisecond."""
    return F.round((F.unix_micros(at) - F.unix_micros(begun)) / 1e6, 3)
