"""Projection of a source inventory by folder policies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, paths
from ..functions.names import Names


def is_reserved(key: Column, names: Names, ignore_case: bool = True) -> Column:
    """Keys and prefixes that are the archive's own (P8); on the target side whatever their case, none below a live prefix."""
    low = F.lower(key) if ignore_case else key
    found = low.isin(*[k.lower() if ignore_case else k for k in names.reserved_keys] or [""]) if names.reserved_keys else F.lit(False)
    for p in names.reserved_prefixes:
        found = found | paths.is_under(low, F.lit(p.lower() if ignore_case else p))
    return found


def visible(objects: DataFrame, names: Names) -> DataFrame:
    """The source without reserved objects (S20); here case counts."""
    return objects.filter(~is_reserved(F.col("key"), names, ignore_case=False))


def is_empty_marker(key: Column, names: Names) -> Column:
    return paths.base_name(key) == names.empty_marker


def mirror(objects: DataFrame, folders: DataFrame, prefix: str, names: Names) -> DataFrame:
    """(path, length, hash, fingerprint): objects below prefix, and a marker for each folder with nothing in it."""
    under = objects.filter(paths.is_under(F.col("key"), F.lit(prefix)))
    path = paths.remove_prefix(F.col("key"), F.lit(prefix))
    rows = under.select(path.alias("path"), "length", "hash", F.coalesce("fingerprint", hashing.stat_fingerprint(F.col("ticks"), F.col("length"))).alias("fingerprint"))
    parents = objects.select(paths.parent(F.col("key")).alias("folder")).unionByName(folders.select(paths.parent(F.col("folder")).alias("folder"))).distinct()
    empty = folders.filter(paths.is_under(F.col("folder"), F.lit(prefix))).join(parents, "folder", "left_anti")
    marks = empty.select(F.concat_ws("/", F.nullif(paths.remove_prefix(F.col("folder"), F.lit(prefix)), F.lit("")), F.lit(names.empty_marker)).alias("path"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("string").alias("hash"), F.lit(names.empty_fingerprint).alias("fingerprint"))
    return rows.unionByName(marks)


def nearest_policy(objects: DataFrame, policies: DataFrame) -> DataFrame:
    """Adds scope and format of the closest folder at or above the object's folder that has a policy (P4, J9); policies: (folder, format)."""
    up = objects.select("key", F.explode(F.concat(F.array(F.lit("")), paths.ancestors(F.col("key")))).alias("folder"))
    found = up.join(policies, "folder").groupBy("key").agg(F.max_by(F.struct("folder", "format"), F.char_length("folder")).alias("p"))
    return objects.join(found, "key", "left").select(*objects.columns, F.col("p.folder").alias("scope"), F.coalesce("p.format", F.lit("mirror")).alias("format"))


def placed_key(scope: Column, format_: Column, path: Column) -> Column:
    """A package stands beside its folder, mirrored objects stay inside (P5)."""
    return F.when(format_ == "zip", F.concat_ws("/", F.nullif(paths.parent(scope), F.lit("")), path)).otherwise(F.concat_ws("/", F.nullif(scope, F.lit("")), path))


def children(keys: DataFrame, folder: str) -> DataFrame:
    """The immediate children of a folder: (name, is_folder)."""
    rest = paths.remove_prefix(F.col("key"), F.lit(folder))
    below = keys.filter(paths.is_under(F.col("key"), F.lit(folder)) & (F.col("key") != folder))
    return below.select(F.substring_index(rest, "/", 1).alias("name"), F.contains(rest, F.lit("/")).alias("is_folder")).groupBy("name", "is_folder").agg(F.count("*").alias("n_objects"))


def collisions(projected: DataFrame, siblings: DataFrame) -> DataFrame:
    """Projected keys that a source item has already, or that occur twice (P7). Callers raise if there are any."""
    twice = projected.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    return projected.select("key").distinct().join(siblings.select("key").distinct(), "key", "left_semi").unionByName(twice).distinct()


def zip_entries(objects: DataFrame) -> DataFrame:
    """Fills in what a package's digest needs (F23, F24): the fingerprint, else size and time, else the hash; an unknown time is 1980."""
    mark = F.coalesce("fingerprint", hashing.stat_fingerprint(F.col("ticks"), F.col("length")), "hash")
    return objects.select("folder", "path", "length", F.coalesce("ticks", F.lit(hashing.UNKNOWN_TICKS)).alias("ticks"), mark.alias("fingerprint"))


def packages(entries: DataFrame, level: int = 0, domain: str | None = None) -> DataFrame:
    """One row per folder: (folder, n_entries, fingerprint, name) (P3, A17). Sorted rows stream through one digest at a time, so a folder may have any number of entries."""
    domain = domain or Names().zip_domain
    ordered = entries.repartition("folder").sortWithinPartitions("folder", paths.ordinal(F.col("path")))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import struct

        import xxhash

        text = lambda s: struct.pack(">i", len(b := s.encode())) + b
        now, hashed, n = None, None, 0
        close = lambda: (now, n, hashing.format_hash(hashed.digest()), hashing.token_of(hashed.digest()))
        for b in batches:
            rows = []
            for folder, path, length, ticks, mark in zip(b["folder"], b["path"], b["length"], b["ticks"], b["fingerprint"], strict=True):
                if hashed is None or folder != now:
                    if hashed is not None:
                        rows.append(close())
                    now, hashed, n = folder, xxhash.xxh128(domain.encode() + struct.pack(">i", level)), 0
                n += 1
                hashed.update(text(path) + (b"\0" if length is None or length != length else b"\1" + struct.pack(">q", int(length))) + struct.pack(">q", int(ticks)) + text(mark))
            yield pd.DataFrame(rows, columns=["folder", "n_entries", "fingerprint", "token"])
        if hashed is not None:
            yield pd.DataFrame([close()], columns=["folder", "n_entries", "fingerprint", "token"])

    found = ordered.mapInPandas(digest, "folder string, n_entries long, fingerprint string, token string")
    return found.select("folder", "n_entries", "fingerprint", hashing.package_name(F.col("folder"), F.col("token")).alias("name"))
