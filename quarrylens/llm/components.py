"""Connected components by alternating large and small stars.

Up to `ONE_TASK` edges (16 MB) a single task solves them by lowering labels; both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import Scratch, dropped, kept_path, scratch_path


ONE_TASK = 1_000_000


def lowest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and the smallest id of the component of each."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for end in (x, y, root[x], root[y]):
            np.minimum.at(new, end, low)
        new = new[new]
        if np.array_equal(new, root):
            return ids, ids[root]
        root = new


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [[np.empty(0, np.int64)], [np.empty(0, np.int64)]]
    for batch in batches:
        for own, name in zip(ends, "ab", strict=True):
            own.append(batch.column(name).to_numpy())
    yield pa.record_batch(list(map(pa.array, lowest(*map(np.concatenate, ends)))), names=["id", "root"])


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links neighbours to the smallest of them: the larger ones, or (small star) the smaller ones.

    The smallest is aggregated on the map side and joined back, so a vertex with a third of all edges is
    no task of its own.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    got = both.join(both.groupBy("a").agg(F.min("b").alias("m")), "a").withColumn("m", F.least("a", "m"))
    if large:
        out = got.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = got.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(got.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """id, root (the smallest id of its component) for every id with an edge a <> b.

    Each round is written to the shared folder, so that lineage stays short and an executor's loss
    costs no more than its own tasks; the folder of the round before is removed.
    """
    spark, tmp, out = edges.sparkSession, Scratch(edges.sparkSession), kept_path(edges.sparkSession, f"{label}-found")
    now, path, seen = tmp.table(edges.select("a", "b").where("a <> b"), label), None, None
    if now.count() <= ONE_TASK:
        now.coalesce(1).mapInArrow(_solved, "id long, root long").write.parquet(out)
        tmp.clear()
        return spark.read.schema("id long, root long").parquet(out)
    while True:
        # the half round in between is read twice, so it is written too
        half, new = Scratch(spark), scratch_path(spark, label)
        nxt = _stars(half.table(_stars(now, True), label), False)
        nxt.write.parquet(new)
        half.clear()
        if path:
            dropped(spark, path)
        tmp.clear()
        now, path = spark.read.schema("a long, b long").parquet(new), new
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("root"))
    now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots).write.parquet(out)
    dropped(spark, path)
    return spark.read.schema("id long, root long").parquet(out)
