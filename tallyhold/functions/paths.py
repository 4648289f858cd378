"""Object keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRIM = r"(?U)^\s+|(?U)\s+$"


def key_parts(key: Column) -> Column:
    """Segments of a key: backslashes count as slashes, segments are trimmed as Unicode has it, empty ones dropped."""
    trimmed = F.transform(F.split(F.translate(F.coalesce(key, F.lit("")), "\\", "/"), "/", -1), lambda s: F.regexp_replace(s, TRIM, ""))
    return F.filter(trimmed, lambda s: s != "")


def is_valid_key(key: Column) -> Column:
    return ~F.exists(key_parts(key), lambda s: s.isin(".", ".."))


def normalize_key(key: Column) -> Column:
    """The key with single slashes; raises on dot segments."""
    fault = F.raise_error(F.concat(F.lit("dot segment in object key "), key)).cast("string")
    return F.when(is_valid_key(key), F.array_join(key_parts(key), "/")).otherwise(fault)


def normalize_prefix(prefix: Column) -> Column:
    return F.nullif(normalize_key(prefix), F.lit(""))


def combine(prefix: Column, path: Column) -> Column:
    return F.concat_ws("/", normalize_prefix(prefix), normalize_prefix(path))


def is_under(key: Column, prefix: Column) -> Column:
    """A key is under itself; all keys are under the empty prefix."""
    return (prefix == "") | (key == prefix) | F.startswith(key, F.concat(prefix, F.lit("/")))


def remove_prefix(key: Column, prefix: Column) -> Column:
    rest = F.when(prefix == "", key).when(key == prefix, F.lit("")).otherwise(F.substr(key, F.char_length(prefix) + 2))
    return F.when(is_under(key, prefix), rest).otherwise(F.raise_error(F.concat(key, F.lit(" is not under "), prefix)).cast("string"))


def parent(key: Column) -> Column:
    return F.regexp_replace(key, r"(?s)/?[^/]*$", "")


def base_name(key: Column) -> Column:
    return F.element_at(F.split(key, "/", -1), -1)


def depth(key: Column) -> Column:
    return F.size(F.split(key, "/", -1)) - 1


def ancestors(key: Column) -> Column:
    """All proper ancestors of a key, the root (empty) left out."""
    parts = F.split(key, "/", -1)
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def ordinal(key: Column) -> Column:
    """What to sort by for UTF-16 code unit order."""
    return F.encode(key, "UTF-16BE")
