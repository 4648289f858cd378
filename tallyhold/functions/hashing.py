"""Content hashes, file name tokens, fingerprints and history names."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

VALID_HASH = r"^xxh128:[A-Za-z0-9_-]{21}[AQgw]$"
VALID_FINGERPRINT = r"^[a-z0-9][a-z0-9.-]*:\S+$"
#: Ticks of 100 ns from 0001-01-01 to 1970-01-01, and 1980-01-01, which stands for an unknown time.
EPOCH_TICKS = 621_355_968_000_000_000
UNKNOWN_TICKS = 624_511_296_000_000_000


def format_hash(digest: bytes) -> str:
    return "xxh128:" + base64.urlsafe_b64encode(digest).decode().rstrip("=")


def content_hash_of(content: bytes) -> str:
    return format_hash(xxhash.xxh128_digest(content))


def token_of(digest: bytes) -> str:
    """Lower-case base32hex without padding."""
    return "xxh128-" + base64.b32hexencode(digest).decode().rstrip("=").lower()


def content_hash(content: Column) -> Column:
    """XXH128 of a binary column; Spark has no such function, so Arrow batches go to Python."""

    @F.pandas_udf("string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda x: None if x is None else content_hash_of(bytes(x)))

    return digest(content)


def stand_in_hash(text: Column) -> Column:
    """A hash of the same form from MD5, for what SQL must be able to follow."""
    return F.concat(F.lit("xxh128:"), F.translate(F.rtrim(F.base64(F.unhex(F.md5(text))), F.lit("=")), "+/", "-_"))


def is_valid_hash(value: Column) -> Column:
    return F.coalesce(value.rlike(VALID_HASH), F.lit(False))


def is_valid_fingerprint(value: Column) -> Column:
    return F.coalesce(value.rlike(VALID_FINGERPRINT), F.lit(False))


def algorithm(value: Column) -> Column:
    return F.when(F.contains(value, F.lit(":")), F.substring_index(value, ":", 1))


def stat_fingerprint(ticks: Column, length: Column) -> Column:
    """stat-v1:<UTC, seven digits>:<length>, null unless both are known."""
    micros = F.floor((ticks - EPOCH_TICKS) / 10).cast("long")
    stamp = F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.lit("stat-v1:"), stamp, (ticks % 10).cast("string"), F.lit("Z:"), length.cast("string"))


def history_segment(at: Column) -> Column:
    """yyyyMMddTHHmmss, the fraction without trailing zeros, Z."""
    fraction = F.regexp_replace(F.date_format(at, "SSSSSS"), "0+$", "")
    return F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss"), fraction, F.lit("Z"))


def segment_sequence(segment: Column, run: Column) -> Column:
    """0 for the run's own segment, n for the segment with -n appended, else null."""
    rest = F.substr(segment, F.char_length(run) + 2)
    numbered = F.startswith(segment, F.concat(run, F.lit("-"))) & rest.rlike("^[0-9]+$")
    n = rest.try_cast("int")
    return F.when(segment == run, 0).when(numbered & (n > 0), n)


def historical_path(path: Column, segment: Column, sequence: Column) -> Column:
    return F.concat(segment, F.when(sequence > 0, F.concat(F.lit("-"), sequence.cast("string"))).otherwise(""), F.lit("/"), path)


def reference_path(path: Column, sequence: Column, suffix: str) -> Column:
    return F.concat(path, F.when(sequence > 0, F.concat(F.lit("."), sequence.cast("string"))).otherwise(""), F.lit(suffix))


def is_reference_for(path: Column, stored: Column, suffix: str) -> Column:
    middle = F.substr(stored, F.char_length(path) + 2, F.char_length(stored) - F.char_length(path) - 1 - len(suffix))
    numbered = F.startswith(stored, F.concat(path, F.lit("."))) & F.endswith(stored, F.lit(suffix)) & middle.rlike("^[1-9][0-9]*$") & middle.try_cast("int").isNotNull()
    return (stored == F.concat(path, F.lit(suffix))) | numbered


def package_digest(entries: list[tuple[str, int | None, int, str]], level: int, domain: str) -> bytes:
    """XXH128 over (path, length, ticks, fingerprint) of a package's entries in order."""
    text = lambda s: struct.pack(">i", len(b := s.encode())) + b
    hashed = xxhash.xxh128(domain.encode() + struct.pack(">i", level))
    for path, length, ticks, fingerprint in entries:
        hashed.update(text(path) + (b"\0" if length is None else b"\1" + struct.pack(">q", length)) + struct.pack(">q", ticks) + text(fingerprint))
    return hashed.digest()


def safe_file_name(name: Column) -> Column:
    """What can't be in a file name on Linux becomes an underscore; a blank name is the root's."""
    return F.regexp_replace(F.when(F.trim(name) == "", F.lit("root")).otherwise(name), r"[\x00/]", "_")


def package_name(folder: Column, token: Column) -> Column:
    return F.concat(safe_file_name(F.element_at(F.split(folder, "/", -1), -1)), F.lit("."), token, F.lit(".zip"))
