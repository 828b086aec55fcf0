"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text are worked on in slices of about so many bytes, however many rows Arrow hands over.
SLICE_BYTES = 4 << 20


#: Spark hands Python up to 64 MB at once, held on both sides; texts are cut in smaller slices anyway.
BATCH_BYTES, BATCH_KEY = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def modest(spark: SparkSession) -> None:
    """Smaller batches between Spark and Python, where the session has Spark's own default."""
    if spark.conf.get(BATCH_KEY, "67108864b") == "67108864b":
        spark.conf.set(BATCH_KEY, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Hands memory that earlier tasks of a reused worker have freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; set here only where a local session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quarrylens-")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Folders that results still read; `swept` removes them once those results are written elsewhere.
_results: list[str] = []


def kept_path(spark: SparkSession, label: str) -> str:
    path = scratch_path(spark, label)
    _results.append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage through a table in the shared folder: it outlives any executor. It stays until `swept`."""
    spark, path = df.sparkSession, kept_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Removes what `written` left; for callers who have written their results."""
    while _results:
        dropped(spark, _results.pop())


class Scratch:
    """Tables that one operator writes and removes before it returns."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        while self.paths:
            dropped(self.spark, self.paths.pop())


#: Up to so many ids (48 MB as longs) are broadcast; more meet by a shuffle.
BROADCAST_IDS = 6_000_000


def small(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast if it is small enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system, whatever its scheme."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds at most about `most` bytes of text, or one row."""
    give_back()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = [x or 0 for x in pc.binary_length(batch.column(text)).to_pylist()]
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)
    give_back()


MARK = np.zeros(0x110000, bool)
MARK[[c for c in (*range(0x300, 0x1F000), *range(0xE0100, 0xE01F0)) if unicodedata.category(chr(c)) in ("Mn", "Mc", "Me")]] = True
_edges = np.flatnonzero(MARK[1:] != MARK[:-1]).tolist()
_marks = "".join(f"{chr(a + 1)}-{chr(b)}" for a, b in zip(_edges[::2], _edges[1::2], strict=True))
WORD, PLAIN_WORD, ASCII_WORD = re.compile(rf"[\w{_marks}]+"), re.compile(r"\w+"), re.compile(r"[a-z0-9_]+")


def lower_words(text: str) -> list[str]:
    """Words in lower case, combining marks among them: a vowel sign doesn't end a word.

    Each character is lowered by itself, as in SQL: a sigma's form doesn't depend on what is around it.
    """
    low = text.replace("İ", "i").replace("Σ", "σ").lower()
    if low.isascii():
        return ASCII_WORD.findall(low)
    marked = MARK[np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)].any()
    return (WORD if marked else PLAIN_WORD).findall(low)


def one_text(rows: DataFrame) -> DataFrame:
    """doc_id, text with one row for each id that isn't null: of several texts the one that sorts first."""
    rows = rows.where("doc_id is not null")
    again = rows.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return rows
    again = small(written(again, "repeated"))
    return rows.join(again, "doc_id", "left_anti").unionByName(rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under names of its own: extra columns never clash."""
    modest(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
