"""Churn, co-change and coverage from commit_files(hash, file) and commits(hash, date, files, is_root)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.paths import top_segment

#: Commits with more files than this give churn but no pairs. The bound is part of the meaning: it is set
#: before the self-join, which is quadratic in a commit's files.
MAX_COMMIT_FILES = 50


def commit_files(commits: DataFrame) -> DataFrame:
    return commits.select("hash", F.explode("files").alias("file")).distinct()


def churn(files: DataFrame) -> DataFrame:
    """Commits that touch each file, oversized ones among them."""
    return files.groupBy(F.col("file").alias("file_path")).agg(F.count("*").alias("commits"))


def cochange(files: DataFrame, max_files: int = 0) -> DataFrame:
    """Unordered pairs changed together; 0 means the usual bound, a negative one no bound.

    The files of a commit are gathered once. Each goes to the task of its pairs with the list of those behind it, and is
    paired there: half of the names travel, and no task before that holds pairs, of which few repeat within a task.
    """
    most = MAX_COMMIT_FILES if max_files == 0 else max_files
    sets = files.groupBy("hash").agg(F.array_sort(F.collect_set("file")).alias("fs"))
    if most > 0:
        sets = sets.where(F.size("fs") <= most)
    lists = sets.where("size(fs) > 1").select(F.expr("inline(transform(slice(fs, 1, size(fs) - 1), (a, i) -> struct(a as file_a, slice(fs, i + 2, size(fs)) as behind)))"))
    # a stated number of partitions: merged by the size of the lists they would grow with the square of the commits' files
    spread = lists.repartition(pair_partitions(files), "file_a")
    return spread.select("file_a", F.explode("behind").alias("file_b")).groupBy("file_a", "file_b").agg(F.count("*").alias("count"))


#: Bytes of (hash, file) for each partition of pairs, and the most partitions; sizes beyond what is plausible are not known.
PAIR_BYTES, PAIR_PARTITIONS, PLAUSIBLE = 512 << 10, 4096, 1 << 44


def pair_partitions(files: DataFrame) -> int:
    """As many partitions as the session shuffles to, or more where the estimated input asks for it, so that one task's pairs stay about as many."""
    n, size = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(n, min(PAIR_PARTITIONS, size // PAIR_BYTES)) if size < PLAUSIBLE else n


def neighbours(pairs: DataFrame, path: str, min_count: int = 1) -> DataFrame:
    """Files that changed together with one, most often first."""
    both = pairs.where(F.col("file_a") == path).select(F.col("file_b").alias("file"), "count").unionByName(pairs.where(F.col("file_b") == path).select(F.col("file_a").alias("file"), "count"))
    return both.where(F.col("count") >= min_count).orderBy(F.desc("count"), "file")


def top_churn(counts: DataFrame, n: int) -> DataFrame:
    ordered = counts.orderBy(F.desc("commits"), "file_path")
    return ordered.limit(n) if n > 0 else ordered


def areas(files: Column) -> Column:
    """Distinct first segments in the order in which they first appear."""
    return F.array_distinct(F.transform(files, top_segment))


def recent(commits: DataFrame, start: Column) -> DataFrame:
    """Commits from a moment on, newest first, with their areas."""
    return commits.where(F.col("date") >= start).withColumn("areas", areas(F.col("files"))).orderBy(F.desc("date"), "hash")


def coverage(commits: DataFrame, max_files: int = MAX_COMMIT_FILES) -> DataFrame:
    """How much history was looked at."""
    n = F.size("files")
    return commits.agg(F.count("*").alias("scanned"), F.count_if(n > 0).alias("with_files"), F.count_if(n > max_files).alias("oversized"), F.count_if("is_root").alias("root"), F.max(n).cast("long").alias("largest"))


def trust(cover: DataFrame, in_repo: bool = True, shallow: bool = False) -> DataFrame:
    """Whether churn can be believed, and the first reason why not."""
    reason = (
        F.when(F.lit(not in_repo), "not a repository").when(F.coalesce(F.col("scanned"), F.lit(0)) == 0, "no commits").when(F.col("with_files") == 0, "no commit lists files")
        .when(F.lit(shallow), "shallow history").when(F.col("root") >= F.col("with_files"), "only root commits").otherwise("")
    )
    return cover.withColumn("reason", reason).withColumn("trustworthy", F.col("reason") == "")
