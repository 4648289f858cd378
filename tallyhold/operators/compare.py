"""Classification of a source against a target inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, paths
from ..functions.names import Names


def quick_match(names: Names) -> Column:
    """Metadata alone shows that the target is unchanged (C2); unknown values never match."""
    expected = F.coalesce("s_length", "p_length")
    trusted = (F.trim("s_fingerprint") != "") & hashing.is_valid_hash(F.col("p_hash")) & (F.col("s_fingerprint") == F.col("p_fingerprint"))
    length = F.when(F.col("t_length").isNull(), paths.base_name(F.col("path")) == names.empty_marker).otherwise(F.col("t_length") == expected)
    clash = (hashing.algorithm(F.col("t_hash")) == hashing.algorithm(F.col("p_hash"))) & (F.col("t_hash") != F.col("p_hash"))
    return F.coalesce(trusted & expected.isNotNull() & length & ~F.coalesce(clash, F.lit(False)), F.lit(False))


def _side(df: DataFrame, letter: str, columns: dict[str, str]) -> DataFrame:
    return df.select("path", F.lit(True).alias(f"in_{letter}"), *[F.col(c).alias(f"{letter}_{n}") for n, c in columns.items()])


def classify(source: DataFrame, target: DataFrame, prior: DataFrame, names: Names | None = None, byte_for_byte: bool = False) -> DataFrame:
    """Inventories (path, length, hash, fingerprint) and prior manifest (path, length, hash, fingerprint) to one row per path.

    status is new, changed, unchanged or extra; evidence says what decided: length, metadata or content.
    hash stands for the content: where metadata can't decide, contents are equal if hashes are. Only
    such rows need a content scan, so callers may give hashes for undecided rows alone.
    """
    names = names or Names()
    facts = {"length": "length", "hash": "hash", "fingerprint": "fingerprint"}
    s, t, p = (_side(df, x, facts) for df, x in ((source, "s"), (target, "t"), (prior, "p")))
    both = s.join(t, "path", "full_outer").join(p, "path", "left")
    expected = F.col("s_length") if byte_for_byte else F.coalesce("s_length", "p_length")
    other_length = F.coalesce(expected != F.col("t_length"), F.lit(False))
    quick = F.lit(False) if byte_for_byte else quick_match(names)
    status = (
        F.when(F.col("in_t").isNull(), "new").when(F.col("in_s").isNull(), "extra").when(other_length, "changed")
        .when(quick, "unchanged").when(F.col("s_hash").eqNullSafe(F.col("t_hash")), "unchanged").otherwise("changed")
    )
    matched = F.col("in_s") & F.col("in_t")
    evidence = F.when(matched & other_length, "length").when(matched & quick, "metadata").when(matched, "content")
    return both.withColumn("status", status).withColumn("evidence", evidence)


STATUSES = ("new", "changed", "extra", "unchanged")


def summary(classified: DataFrame) -> DataFrame:
    """One row of counts, and whether a verification would be complete."""
    counts = classified.agg(*[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in STATUSES])
    return counts.withColumn("completed", (F.col("new_count") + F.col("changed_count") + F.col("extra_count")) == 0)


def message(operation: str = "sync") -> Column:
    count = lambda s: F.col(f"{s}_count").cast("string")
    return F.concat(
        F.lit(f"Archive {operation} completed; "), count("new"), F.lit(" new object(s), "), count("changed"), F.lit(" changed object(s), "),
        count("extra"), F.lit(" extra object(s), and "), count("unchanged"), F.lit(" unchanged object(s)."),
    )


def plan_actions(classified: DataFrame) -> DataFrame:
    """(path, step, action) in the order that is safe to apply: what is replaced goes to history before its successor comes."""
    actions = F.when(F.col("status") == "new", F.array(F.lit("upload"))).when(F.col("status") == "changed", F.array(F.lit("historize"), F.lit("upload")))
    actions = actions.when(F.col("status") == "extra", F.array(F.lit("historize"))).otherwise(F.array(F.lit("keep")))
    return classified.select("path", F.posexplode(actions).alias("step", "action"))


def next_manifest(classified: DataFrame) -> DataFrame:
    """The manifest after the run (C6): the fingerprint falls back to the hash, the length is kept only where the source didn't state one."""
    kept = F.when(F.col("evidence") == "metadata", F.col("p_hash")).otherwise(F.col("s_hash"))
    rows = classified.filter("in_s").withColumn("content_hash", kept)
    blank = F.coalesce(F.trim("s_fingerprint"), F.lit("")) == ""
    length = F.when(F.col("s_length").isNull(), F.coalesce(F.when(F.col("evidence") == "metadata", F.col("p_length")), F.col("t_length")))
    return rows.select("path", F.when(blank, F.col("content_hash")).otherwise(F.col("s_fingerprint")).alias("change_fingerprint"), length.alias("artifact_length"), "content_hash")


def length_faults(projected: DataFrame) -> DataFrame:
    """Rows whose content has another length than declared (C5); callers raise if there are any."""
    return projected.filter(F.col("length").isNotNull() & (F.col("length") != F.col("actual_length")))
