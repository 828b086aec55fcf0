"""Files related to one file, by additive signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.paths import dir_of, soft_cap, stem_of

#: Whether files at the root count as being in one directory.
ROOT_IS_A_DIRECTORY = False


def _dir(path: str) -> str:
    return path.rpartition("/")[0]


def _stem(path: str) -> str:
    name = path.rpartition("/")[2]
    return name.rpartition(".")[0] if "." in name else name


def related(path: str, files: DataFrame, imports: DataFrame, tests: DataFrame, cochange: DataFrame, metrics: DataFrame, owners: DataFrame, limit: int = 20) -> DataFrame:
    """rel_path, score and signals (in fixed order) of the best files.

    owners is (rel_path, owners array). Each relation is scanned once and gives all its signals; they meet
    in one union and one aggregation. Ownership is looked at only for files that have another signal.
    """
    own, parent = _dir(path), _dir(_dir(path))
    here, col = F.lit(path), F.col
    give = lambda cond, w, name, order: F.when(cond, F.struct(w.cast("double").alias("w") if hasattr(w, "cast") else F.lit(float(w)).alias("w"), F.lit(name).alias("signal"), F.lit(order).alias("ord")))
    told = lambda df, other, *signals: df.select(other.alias("rel_path"), F.explode(F.array_compact(F.array(*signals))).alias("g")).select("rel_path", "g.*")
    d = dir_of(col("rel_path"))
    by_name = [give((stem_of(col("rel_path")) == _stem(path)) & (d != own), 0.6, "same-name", 6)]
    if own or ROOT_IS_A_DIRECTORY:
        by_name.append(give(d == own, 0.3, "same-directory", 0))
    if parent:
        by_name.append(give((dir_of(d) == parent) & (d != own), 0.2, "adjacent-package", 5))
    pairs = tests.where((col("source_path") == here) | ((col("test_path") == here) & (col("source_path") != "")))
    edges = imports.where((col("source_path") == here) | (col("target_path") == here))
    # what the metrics say of the file itself and of the hot ones: one scan of them
    rated_ = metrics.where((col("hotspot_score") > 0.1) | (col("rel_path") == here)).select("rel_path", (col("hotspot_score") > 0.1).alias("hot"), ((col("rel_path") == here) & (col("fan_in") > 10)).alias("central"))
    central = rated_.where("central").select(F.lit(True).alias("yes")).limit(1)
    linked = edges.select(F.when(col("source_path") == here, col("target_path")).otherwise(col("source_path")).alias("rel_path"), (col("source_path") == here).alias("out"))
    linked = linked.join(rated_.where("hot").select("rel_path", "hot"), "rel_path", "left")
    co = cochange.where((col("file_a") == here) | (col("file_b") == here)).select(F.when(col("file_a") == here, col("file_b")).otherwise(col("file_a")).alias("rel_path"), "count").join(F.broadcast(central), F.lit(True), "left")
    parts = [
        told(files, col("rel_path"), *by_name),
        told(pairs, F.when(col("source_path") == here, col("test_path")).otherwise(col("source_path")), give(F.lit(True), 0.9, "test-pair", 1)),
        told(linked, col("rel_path"), give(col("out"), 0.7, "imports", 2), give(~col("out"), 0.7, "imported-by", 3), give(col("hot"), 0.3, "hotspot-dep", 7)),
        told(co, col("rel_path"), give(col("count") >= 2, F.when(col("count") >= 10, 0.8).when(col("count") >= 5, 0.7).otherwise(0.5), "co-change", 4), give(col("yes"), 0.2, "hotspot-cochange", 8)),
    ]
    found = reduce(DataFrame.unionByName, parts).where(col("rel_path") != here)
    rated = found.groupBy("rel_path").agg(F.sum("w").alias("w"), F.array_sort(F.collect_set(F.struct("ord", "signal"))).alias("s"))
    rated = rated.join(files.select("rel_path"), "rel_path", "left_semi")
    mine = owners.where(col("rel_path") == here).select(col("owners").alias("mine")).limit(1)
    shared = rated.join(owners, "rel_path", "left").join(F.broadcast(mine), F.lit(True), "left")
    same = F.coalesce(F.arrays_overlap("owners", "mine"), F.lit(False))
    names = F.transform("s", lambda x: x["signal"])
    out = shared.select("rel_path", (col("w") + F.when(same, 0.15).otherwise(0.0)).alias("w"), F.when(same, F.concat(names, F.array(F.lit("same-owner")))).otherwise(names).alias("signals"))
    return out.select("rel_path", F.round(soft_cap(F.round("w", 9)), 9).alias("score"), "signals").orderBy(F.desc("score"), "rel_path").limit(limit)
