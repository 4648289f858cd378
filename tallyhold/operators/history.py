"""History deduplication and history names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing, paths
from ..functions.names import Names

TINY = 4096
KEY = ("content_hash", "content_length")


def is_eligible(path: Column, names: Names) -> Column:
    """No marker, reference, root, policy or manifest by its last segment (P10)."""
    base = paths.base_name(path)
    fixed = [names.empty_marker, names.root, names.policy, names.change_manifest, names.change_manifest_brotli, names.change_manifest_invalid, names.history_manifest, names.history_manifest_invalid]
    return ~base.isin(*fixed) & ~F.endswith(base, F.lit(names.reference_suffix))


def is_control(path: Column, names: Names) -> Column:
    return path.isin(names.history_manifest, names.history_manifest_invalid)


def is_reference_document(text: Column, names: Names) -> Column:
    """Whether a text is JSON of the reference type; invalid JSON isn't."""
    return F.coalesce(F.get_json_object(text, "$.documentType") == names.document_type("historyContentReference"), F.lit(False))


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """(content_hash, content_length, n) of eligible content that is there more than once."""
    return rows.filter("eligible").groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1")


def select_occurrences(actual: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actual rows and, of references to paths that have none, the first by stored path; and the references that are left over."""
    first = W.partitionBy("relative_path").orderBy(paths.ordinal(F.col("stored_path")))
    ranked = references.join(actual.select("relative_path", F.lit(True).alias("is_actual")), "relative_path", "left").withColumn("rank", F.row_number().over(first))
    chosen = F.col("is_actual").isNull() & (F.col("rank") == 1)
    return actual.unionByName(ranked.filter(chosen).select(*actual.columns)), ranked.filter(~chosen).select(*references.columns)


def disagreements(actual: DataFrame, references: DataFrame, columns: list[str]) -> DataFrame:
    """References that differ from the actual object at their path (C9, J7): unknown equals unknown. Callers raise if there are any."""
    other = references.select("relative_path", *[F.col(c).alias(f"r_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    return actual.join(other, "relative_path").filter(~same).select("relative_path")


def orphan_groups(rows: DataFrame) -> DataFrame:
    """Content that is referenced but stored nowhere (J8). Callers raise if there is any."""
    flags = rows.groupBy(*KEY).agg(F.bool_or(F.col("representation") == "reference").alias("referenced"), F.bool_or(F.col("representation") == "materialized").alias("stored"))
    return flags.filter(F.col("referenced") & ~F.col("stored")).select(*KEY)


def replacement_candidates(rows: DataFrame, tiny: int = TINY) -> DataFrame:
    """Stored duplicates above the tiny size, each with its canonical copy, the first by path (A8). One sort within a group; a group of any size has a canonical row by aggregation."""
    stored = rows.filter(F.col("eligible") & (F.col("representation") == "materialized") & (F.col("content_length") > tiny))
    canonical = stored.groupBy(*KEY).agg(F.min_by("relative_path", paths.ordinal(F.col("relative_path"))).alias("canonical"), F.count("*").alias("n")).filter("n > 1")
    return stored.join(canonical.drop("n"), list(KEY)).filter(F.col("relative_path") != F.col("canonical"))


def content_conflicts(pairs: DataFrame, content: DataFrame) -> DataFrame:
    """Candidates whose bytes differ from their canonical's despite equal hash and length (J10). Callers raise if there are any."""
    a = content.select(F.col("relative_path"), F.col("content").alias("own"))
    b = content.select(F.col("relative_path").alias("canonical"), F.col("content").alias("kept"))
    return pairs.join(a, "relative_path").join(b, "canonical").filter(F.col("own") != F.col("kept")).select("relative_path", "canonical")


def allocate_references(candidates: DataFrame, taken: DataFrame, suffix: str) -> DataFrame:
    """Adds reference_path: the first of path+suffix, path.1+suffix, ... that isn't among taken (path)."""
    held = taken.filter(F.endswith("path", F.lit(suffix))).select(F.regexp_replace(F.substr("path", F.lit(1), F.char_length("path") - len(suffix)), r"\.[1-9][0-9]*$", "").alias("stem"), "path")
    whole = taken.filter(F.endswith("path", F.lit(suffix))).select(F.substr("path", F.lit(1), F.char_length("path") - len(suffix)).alias("stem"), "path")
    numbers = held.unionByName(whole).distinct().filter(hashing.is_reference_for(F.col("stem"), F.col("path"), suffix))
    digits = F.regexp_extract(F.substr("path", F.char_length("stem") + 1), r"^\.([1-9][0-9]*)\.", 1)
    used = numbers.select(F.col("stem").alias("relative_path"), F.when(F.col("path") == F.concat("stem", F.lit(suffix)), 0).otherwise(digits.cast("int")).alias("n"))
    order = W.partitionBy("relative_path").orderBy("n")
    gaps = used.distinct().withColumn("place", F.row_number().over(order) - 1).groupBy("relative_path").agg(F.min(F.when(F.col("n") != F.col("place"), F.col("place"))).alias("gap"), F.count("*").alias("n"))
    free = gaps.select("relative_path", F.coalesce("gap", "n").cast("int").alias("sequence"))
    numbered = candidates.join(free, "relative_path", "left").withColumn("sequence", F.coalesce("sequence", F.lit(0)))
    return numbered.withColumn("reference_path", hashing.reference_path(F.col("relative_path"), F.col("sequence"), suffix)).drop("sequence")


def net_saving(length: Column, reference_bytes: Column, path: Column, reference: Column) -> Column:
    """Bytes gained by a replacement (C8): the content less the reference and what the catalog grows by."""
    growth = F.octet_length(reference) - F.octet_length(path) + F.lit(len("reference") - len("materialized"))
    return length - reference_bytes - growth


def metrics(rows: DataFrame, replaced: DataFrame, tiny: int = TINY) -> DataFrame:
    """One row: scanned, existing references, duplicate groups, tiny objects, replaced objects and bytes saved (replaced: bytes_saved)."""
    counts = rows.agg(
        F.count("*").alias("scanned_object_count"), F.count_if(F.col("representation") == "reference").alias("existing_reference_count"),
        F.count_if(F.col("eligible") & (F.col("content_length") <= tiny)).alias("tiny_object_count"),
    )
    groups = duplicate_groups(rows).agg(F.count("*").alias("duplicate_group_count"))
    saved = replaced.agg(F.count("*").alias("replaced_object_count"), F.coalesce(F.sum("bytes_saved"), F.lit(0)).alias("bytes_saved"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731  each side is a single row
    return one(counts).join(one(groups), "_one").join(one(saved), "_one").drop("_one")


def highest_sequences(history: DataFrame, segment: str) -> DataFrame:
    """(relative_path, highest): history rows (segment, relative_path) of this run's timestamp (A10)."""
    n = hashing.segment_sequence(F.col("segment"), F.lit(segment))
    return history.withColumn("n", n).groupBy("relative_path").agg(F.coalesce(F.max("n"), F.lit(-1)).alias("highest"))


def allocate_history(moves: DataFrame, history: DataFrame, segment: str) -> DataFrame:
    """Adds history_path to moves (relative_path, step): 0 first, then one more than the highest there is."""
    rank = F.row_number().over(W.partitionBy("relative_path").orderBy("step"))
    n = F.coalesce("highest", F.lit(-1)) + rank
    joined = moves.join(highest_sequences(history, segment), "relative_path", "left").withColumn("sequence", n)
    return joined.withColumn("history_path", hashing.historical_path(F.col("relative_path"), F.lit(segment), F.col("sequence"))).drop("highest")


def merge_entries(entries: DataFrame, replaced: DataFrame, key: str = "relative_path") -> DataFrame:
    """Entries with the replaced ones in place of theirs."""
    return entries.join(replaced.select(key), key, "left_anti").unionByName(replaced)


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once (A15, P7). Callers raise if there are any."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
