"""Churn kept up to date from a stream of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def churn_stream(commits: DataFrame, late: str = "1 day") -> DataFrame:
    """Commits of each file by day; a commit that comes twice within the watermark counts once."""
    once = commits.withWatermark("date", late).dropDuplicatesWithinWatermark(["hash"])
    return once.select(F.explode("files").alias("file_path"), "date").groupBy(F.window("date", "1 day").alias("day"), "file_path").agg(F.count("*").alias("commits"))


def keep(commits: DataFrame, path: str, checkpoint: str, late: str = "1 day", once: bool = True) -> StreamingQuery:
    """Appends days to a Parquet table as the watermark closes them; exactly once, by the sink's own log."""
    out = churn_stream(commits, late).select(F.col("day.start").alias("day"), "file_path", "commits").writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def total(table: DataFrame) -> DataFrame:
    return table.groupBy("file_path").agg(F.sum("commits").alias("commits"))
