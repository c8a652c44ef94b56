"""Path, id and text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parent(path: Column) -> Column:
    """what stands before the last slash; empty if there is none."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """What stands after the last dot of the last segment, if that isn't its first character; else empty."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def module_of(path: Column) -> Column:
    """The parent directory, or the path itself where it has none."""
    up = parent(path)
    return F.when(up == "", path).otherwise(up)


def leaf(name: Column, separators: str = r"[.:]") -> Column:
    """What stands after the last separator."""
    return F.regexp_extract(name, rf"([^{separators.strip('[]')}]*)$", 1)


def scope_of(ident: Column) -> Column:
    """What stands before the first ``::``, without leading ``@``."""
    return F.regexp_replace(F.substring_index(ident, "::", 1), "^@+", "")


def sanitize_id(ident: Column) -> Column:
    """F2: keeps ASCII letters, digits, hyphen and underscore."""
    return F.regexp_replace(ident, "[^A-Za-z0-9_-]", "")


def safe_diagram_id(ident: Column) -> Column:
    """an identifier of letters, digits and underscores."""
    return F.regexp_replace(ident, "[^A-Za-z0-9_]", "_")


def diagram_label(text: Column) -> Column:
    """A label in double quotes, without what would end it."""
    return F.regexp_replace(F.regexp_replace(text, '"', "'"), r"[\r\n]+", " ")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def ratio(part: Column, whole: Column, empty: float = 1.0) -> Column:
    """part / whole, and what stands for that if whole is 0."""
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def content_hash(text: Column) -> Column:
    """F8: SHA-256, lowercase hex."""
    return F.sha2(text, 256)


def tags(*pairs: tuple[Column, Column | str]) -> Column:
    """CS6, F12: the values whose condition holds, in order, as an array."""
    return F.array_compact(F.array(*(F.when(condition, F.lit(value) if isinstance(value, str) else value) for condition, value in pairs)))
