"""Differences between two states of a file tree or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame, key: list[str], value: str, left_only: bool = False) -> DataFrame:
    """One row per key that was added, removed or changed. With ``left_only``, keys only in ``after`` are ignored.

    Both sides go through one aggregation on the key instead of a full outer
    join; two null values are equal.
    """
    tag = lambda df, name: df.select(*key, F.lit(name).alias("_side"), F.col(value).alias("_v"))
    sides = tag(before, "b").unionByName(tag(after, "a"))
    both = sides.groupBy(*key).agg(
        F.bool_or(F.col("_side") == "b").alias("_in_b"),
        F.bool_or(F.col("_side") == "a").alias("_in_a"),
        F.max(F.when(F.col("_side") == "b", F.col("_v"))).alias("before"),
        F.max(F.when(F.col("_side") == "a", F.col("_v"))).alias("after"),
    )
    change = F.when(~F.col("_in_a"), "removed").when(~F.col("_in_b"), F.lit(None) if left_only else F.lit("added")).when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.select(*key, "before", "after", change.alias("change")).where("change IS NOT NULL")


def new_entries(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``after`` whose key is not in ``before``; repeats in ``after`` stay."""
    return after.join(before.select(*key).distinct(), key, "left_anti")


def writes_outside(files: DataFrame, allowed_prefix: str) -> DataFrame:
    """Files that are neither the allowed folder nor below it."""
    path = F.col("path")
    return files.where(~((path == allowed_prefix.rstrip("/")) | path.startswith(allowed_prefix.rstrip("/") + "/")))
