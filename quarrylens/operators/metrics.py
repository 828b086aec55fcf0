"""Counts and scores over edges, churn and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.paths import dir_of, ext_of, top_segment


def fan_out(imports: DataFrame) -> DataFrame:
    return imports.groupBy(F.col("source_path").alias("rel_path")).agg(F.count("*").alias("fan_out"))


def fan_in(imports: DataFrame) -> DataFrame:
    return imports.groupBy(F.col("target_path").alias("rel_path")).agg(F.count("*").alias("fan_in"))


def file_metrics(imports: DataFrame, churn: DataFrame) -> DataFrame:
    """fan_in, fan_out, churn and the hotspot score of every file that has any of them.

    The full outer join of three counts is one union and one aggregation; the largest product is a
    one-row side, so that no window gathers all files in one partition.
    """
    zero = F.lit(0).cast("long")
    parts = imports.select(F.col("target_path").alias("rel_path"), F.lit(1).cast("long").alias("i"), zero.alias("o"), zero.alias("c"))
    parts = parts.unionAll(imports.select("source_path", zero, F.lit(1).cast("long"), zero)).unionAll(churn.select("file_path", zero, zero, F.col("commits").cast("long")))
    counts = parts.groupBy("rel_path").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.sum("c").alias("churn"))
    top = counts.agg(F.max(F.col("fan_in") * F.col("churn")).alias("top"))
    score = F.coalesce(F.col("fan_in") * F.col("churn") / F.nullif(F.col("top"), zero), F.lit(0.0))
    return counts.crossJoin(F.broadcast(top)).select("rel_path", "fan_in", "fan_out", "churn", score.cast("double").alias("hotspot_score"))  # one row


def hotspots(metrics: DataFrame, n: int = 20) -> DataFrame:
    """Files with a positive score, highest first; all of them for n <= 0."""
    ordered = metrics.where("hotspot_score > 0").orderBy(F.desc("hotspot_score"), "rel_path")
    return ordered.limit(n) if n > 0 else ordered


def high_fan_in(metrics: DataFrame, percentile: float) -> DataFrame:
    """Files at or above the fan-in at floor(p * (n - 1)) of the sorted positive ones.

    Ranks come from cumulative counts of the distinct values, which are few.
    """
    some = metrics.where("fan_in > 0")
    values = some.groupBy("fan_in").agg(F.count("*").alias("k"))
    total = values.agg(F.sum("k").alias("n"))
    upto = values.withColumn("upto", F.sum("k").over(Window.orderBy("fan_in").rowsBetween(Window.unboundedPreceding, 0)))
    bound = upto.crossJoin(F.broadcast(total)).where(F.col("upto") > F.floor(F.lit(percentile) * (F.col("n") - 1))).agg(F.min("fan_in").alias("bound"))
    return some.crossJoin(F.broadcast(bound)).where("fan_in >= bound").drop("bound").orderBy(F.desc("fan_in"), "rel_path")


def languages(files: DataFrame) -> DataFrame:
    """Files, share and extensions of each language among source and test files."""
    own = files.where(F.col("class").isin("source", "test") & (F.col("lang") != "")).groupBy("lang").agg(F.count("*").alias("files"), F.array_sort(F.collect_set(ext_of(F.col("rel_path")))).alias("extensions"))
    total = own.agg(F.sum("files").alias("total"))
    return own.crossJoin(F.broadcast(total)).select("lang", "files", (F.col("files") * 100.0 / F.col("total")).alias("percent"), "extensions").orderBy(F.desc("files"), "lang")


def top_dirs(files: DataFrame) -> DataFrame:
    langs = F.array_sort(F.collect_set(F.when(F.col("lang") != "", F.col("lang"))))
    return files.groupBy(top_segment(F.col("rel_path")).alias("dir")).agg(F.count("*").alias("files"), langs.alias("languages")).orderBy(F.desc("files"), "dir")


def file_counts(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.count_if(F.col("class") == "test").alias("tests"), F.countDistinct(dir_of(F.col("rel_path"))).alias("dirs"))


def import_coverage(stats: DataFrame) -> DataFrame:
    """Specifiers by language and fate, most unresolved first."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("extracted", "resolved", "external", "unresolved")]
    return stats.groupBy("lang").agg(F.count("*").alias("files"), *sums).orderBy(F.desc("unresolved"), "lang")


def import_stats(specs: DataFrame, sample: int = 20) -> DataFrame:
    """Tallies of specs(rel_path, lang, spec, ord, bucket), with the first distinct unresolved ones."""
    missed = F.array_sort(F.collect_list(F.when(F.col("bucket") == "unresolved", F.struct("ord", "spec"))))
    count = lambda b: F.count_if(F.col("bucket") == b).alias(b)
    rows = specs.groupBy("rel_path", "lang").agg(F.count("*").alias("extracted"), count("resolved"), count("external"), count("unresolved"), missed.alias("m"))
    return rows.withColumn("unresolved_specs", F.slice(F.array_distinct(F.transform("m", lambda x: x["spec"])), 1, sample)).drop("m")
