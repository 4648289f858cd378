"""Extra folders by ancestors (J4-J6, W5): containment is an equi-join on exploded ancestors, never a nested loop over prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def ancestor_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, ancestor) for all proper ancestors."""
    return df.select(key, F.explode(paths.ancestors(F.col(key))).alias("ancestor"))


def extra_folders(target_folders: DataFrame, desired: DataFrame) -> DataFrame:
    """Target folders (folder) that are no ancestor of a desired object (path) and lie under no other such folder."""
    needed = ancestor_rows(desired, "path").select(F.col("ancestor").alias("folder")).distinct()
    extra = target_folders.select("folder").distinct().join(needed, "folder", "left_anti")
    nested = ancestor_rows(extra, "folder").join(extra.select(F.col("folder").alias("ancestor")), "ancestor", "left_semi").select("folder").distinct()
    return extra.join(nested, "folder", "left_anti")


def outside_folders(objects: DataFrame, folders: DataFrame) -> DataFrame:
    """Objects (path) that lie strictly below none of the folders; one of the same name as a folder stays."""
    below = ancestor_rows(objects, "path").join(folders.select(F.col("folder").alias("ancestor")), "ancestor", "left_semi").select("path").distinct()
    return objects.join(below, "path", "left_anti")


def folder_moves(objects: DataFrame, folders: DataFrame) -> DataFrame:
    """(folder, n_objects): each folder that moves as a unit counts what is visible in it, one at least."""
    inside = ancestor_rows(objects, "path").withColumnRenamed("ancestor", "folder").groupBy("folder").agg(F.count("*").alias("n"))
    return folders.join(inside, "folder", "left").select("folder", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("n_objects"))
