"""Keeping stored relations in step with what is there now."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """rel_path, change (added, changed, removed) by size and mtime; equal files have no row."""
    a = stored.select("rel_path", F.col("size").alias("s0"), F.col("mtime").alias("m0"), F.lit(1).alias("had"))
    b = current.select("rel_path", F.col("size").alias("s1"), F.col("mtime").alias("m1"), F.lit(1).alias("has"))
    change = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").when((F.col("s0") != F.col("s1")) | (F.col("m0") != F.col("m1")), "changed")
    return a.join(b, "rel_path", "full_outer").select("rel_path", change.alias("change")).where("change is not null")


def replace_keys(base: DataFrame, gone: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `base` without the keys in `gone`, and the new rows."""
    return base.join(gone.select(key).distinct(), key, "left_anti").select(base.columns).unionByName(new)


def upsert(base: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key wins, new rows after old ones."""
    both = base.withColumn("_g", F.lit(0)).unionByName(new.withColumn("_g", F.lit(1)))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_g"), F.desc(order)))
    return both.withColumn("_n", nth).where("_n = 1").drop("_g", "_n")


def refreshed(stored: DataFrame, current: DataFrame, build) -> DataFrame:
    """A relation keyed by rel_path brought up to date: only added and changed files are built again.

    Equals `build(current)` whenever build works file by file.
    """
    diff = snapshot_diff(stored, current)
    todo = current.join(diff.where("change <> 'removed'").select("rel_path"), "rel_path", "left_semi").select(current.columns)
    return replace_keys(build(stored), diff, build(todo), "rel_path")
