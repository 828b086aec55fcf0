"""Embedding near-duplicates by collision-counting projections.

Every vector is scaled to length one and projected on `PROJECTIONS` random directions. A pair collides on a
direction if one lies in the window centred on the other; vectors at the threshold collide on a known share
of the directions, so a pair is verified by its exact cosine if its collisions reach the count that
`RECALL` of such pairs reach (a binomial quantile).

A window of one random direction that holds near vectors also holds a fifth of all the others, so windows
over whole sorted projections would meet a square of pairs. The vectors are therefore first dealt into
cells: a table cuts some projections at their means, a cell holds about `LOAD` unrelated vectors whatever
the size of the corpus, and the number of tables is what `RECALL` needs. Inside a cell the vectors are sorted
by one projection and swept: only pairs whose places differ by at most the widest window are counted at
all, and a pair is counted in the first cell that it shares. Rows that move are an id and one byte for each
projection, not vectors; those are fetched for the pairs that pass.

Equal vectors are one class: only the smallest id of it is filed. A cell of more than `UNIT` rows (thousands
of near copies) is cut into blocks and its pairs of blocks are swept apart, so no task holds an unbounded
cell; the pairs counted there are links, so the work follows the result.

Defined results: one row for each id and for each row without one; vectors of each dimension are compared
with their own kind; null, empty, zero or non-finite vectors, and rows without an id, are in a class of their
own and have no links; rows that repeat an id count as one with the vector that sorts first; equal vectors
are linked; an empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import Scratch, small, written
from quarrylens.llm.components import components

THRESHOLD = 0.95
PROJECTIONS = 32
RECALL = 0.98
LOAD = 64
UNIT = 8192
#: Cells cut the projections at their means over so many vectors at most (by the hash of the id).
SAMPLE = 4096
CHUNK = 32768
PAIRS = 500_000


class Plan:
    """Directions, cells, windows and counts for so many vectors of a dimension."""

    def __init__(self, n: int, dim: int, mean: np.ndarray | None = None, threshold: float = THRESHOLD, projections: int = PROJECTIONS, recall: float = RECALL, seed: int = 11):
        rng = np.random.default_rng(seed + dim)
        near = max(math.sqrt(2 * (1 - threshold)) / math.sqrt(dim), 1e-6)  # deviation of a difference at the threshold
        self.threshold, self.dim = threshold, dim
        miss = (1 - recall) / 2  # half for the cells, half for the count
        self.depth = min(40, max(0, math.ceil(math.log2(max(n, 1) / LOAD))))
        together = (1 - math.acos(threshold) / math.pi) ** self.depth
        self.tables = 1 if not self.depth else math.ceil(math.log(miss) / math.log1p(-together))
        self.cells = self._unit(rng, dim, self.tables * self.depth)
        self.lines = self._unit(rng, dim, projections)
        mean = np.zeros(dim, np.float32) if mean is None else mean.astype(np.float32)
        self.cut, self.middle = mean @ self.cells, mean @ self.lines
        # a byte for each projection, eight steps to a deviation; what is cut off at the ends only comes nearer
        self.step, self.window, self.sweep = near / 8, 11, 26
        p = math.erf(10.0 / 8 / math.sqrt(2))
        below, self.count = 0.0, 0
        while (below := below + math.comb(projections, self.count) * p**self.count * (1 - p) ** (projections - self.count)) <= miss:
            self.count += 1

    @staticmethod
    def _unit(rng: np.random.Generator, dim: int, n: int) -> np.ndarray:
        a = rng.standard_normal((dim, n))
        return (a / np.maximum(np.linalg.norm(a, axis=0), 1e-12)).astype(np.float32)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Cell of each vector in each table, [n, tables]."""
        bits = (x @ self.cells > self.cut).reshape(len(x), self.tables, self.depth)
        return (bits * (1 << np.arange(self.depth, dtype=np.int64))).sum(2, dtype=np.int64)

    def places(self, x: np.ndarray) -> np.ndarray:
        """Places on the projections, in steps, [n, projections]."""
        return np.clip(np.rint((x @ self.lines - self.middle) / self.step), -127, 127).astype(np.int8)


def swept_pairs(plan: Plan, table: np.ndarray, cell: np.ndarray, at: np.ndarray, every: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of equal `cell` (an integer for each run) whose first common table this is and that collide often enough.

    Rows are sorted by cell, then by the place on the table's own projection. Where a cell's rows have
    sides 0 and 1, only pairs across them count.
    """
    own = at[np.arange(len(at)), table % at.shape[1]].astype(np.int64)
    line = cell * 1024 + own
    ends = np.searchsorted(line, line + plan.sweep, side="right")
    many = ends - np.arange(len(at)) - 1
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)]]
    edges, total = [0], np.cumsum(many)
    while edges[-1] < len(at):  # slices of about PAIRS pairs
        edges.append(max(edges[-1] + 1, int(np.searchsorted(total, (total[edges[-1] - 1] if edges[-1] else 0) + PAIRS))))
    for a, b in zip(edges, edges[1:], strict=False):
        m = many[a:b]
        i = np.repeat(np.arange(a, min(b, len(at))), m)
        if not len(i):
            continue
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
        hits = np.zeros(len(i), np.int16)
        for k in range(at.shape[1]):
            line_k = at[:, k].astype(np.int16)
            hits += np.abs(line_k[i] - line_k[j]) <= plan.window
        ok = hits >= plan.count
        i, j = i[ok], j[ok]
        ok = ((side[i] != side[j]) | (side[i] == 2)) & ((every[i] == every[j]).argmax(1) == table[i])
        out[0].append(i[ok])
        out[1].append(j[ok])
    return np.concatenate(out[0]), np.concatenate(out[1])


def _unit_rows(col: pa.Array) -> np.ndarray:
    flat = np.asarray(col.flatten(), np.float64).reshape(len(col), -1)
    return (flat / np.linalg.norm(flat, axis=1, keepdims=True)).astype(np.float32)


FILED = "d int, t int, k long, id long, p binary, e binary"


def _filed(rows: DataFrame, plans) -> DataFrame:
    """A row for each vector and table: dimension, table, cell, id, bytes of the projections and of all cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("d"))
            for d in np.unique(dims).tolist():
                part, plan = batch.filter(pa.array(dims == d)), plans.value[d]
                for at in range(0, part.num_rows, 1024):
                    own = part.slice(at, 1024)
                    x = _unit_rows(own.column("v"))
                    keys, places = plan.keys(x), plan.places(x)
                    n, t = keys.shape
                    which = pa.array(np.tile(np.arange(n), t))
                    p, e = (pa.array([row.tobytes() for row in m], pa.binary()).take(which) for m in (places, keys))
                    yield pa.record_batch([pa.array(np.full(n * t, d, np.int32)), pa.array(np.repeat(np.arange(t, dtype=np.int32), n)), pa.array(keys.T.reshape(-1)), own.column("id").take(which), p, e], names=["d", "t", "k", "id", "p", "e"])

    return rows.select("id", "v", F.size("v").alias("d")).mapInArrow(run, FILED)


def _counted(filed: DataFrame, plans) -> DataFrame:
    """a, b of the pairs whose collisions reach the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def closed(part: pa.Table) -> pa.RecordBatch:
            d, t, k, u, ids, side = (part.column(c).to_numpy() for c in ("d", "t", "k", "u", "id", "side"))
            out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)]]
            for dim in np.unique(d).tolist():
                mine, plan = np.flatnonzero(d == dim), plans.value[dim]
                some = part.take(pa.array(mine))
                at, every = (np.frombuffer(b"".join(some.column(c).to_pylist()), kind).reshape(len(mine), -1) for c, kind in (("p", np.int8), ("e", np.int64)))
                ts, new = t[mine], np.append(True, (t[mine][1:] != t[mine][:-1]) | (k[mine][1:] != k[mine][:-1]) | (u[mine][1:] != u[mine][:-1]))
                cell = np.cumsum(new)
                order = np.lexsort((at[np.arange(len(at)), ts % at.shape[1]], cell))
                i, j = swept_pairs(plan, ts[order], cell[order], at[order], every[order], side[mine][order])
                x, y = ids[mine][order][i], ids[mine][order][j]
                out[0].append(np.minimum(x, y))
                out[1].append(np.maximum(x, y))
            return pa.record_batch(list(map(pa.array, map(np.concatenate, out))), names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < CHUNK:
                continue
            part = pa.Table.from_batches(held)
            d, t, k, u = (part.column(c).to_numpy() for c in ("d", "t", "k", "u"))
            edge = np.flatnonzero((d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (u[1:] != u[:-1]))
            if len(edge):  # the last cell may go on in the next batch
                yield closed(part.slice(0, int(edge[-1]) + 1))
                held = part.slice(int(edge[-1]) + 1).to_batches()
        if held:
            yield closed(pa.Table.from_batches(held))

    return filed.mapInArrow(run, "a long, b long")


def _cosines(pairs: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes = np.asarray(part.column("va").value_lengths())
                good = np.zeros(len(sizes), bool)
                for d in np.unique(sizes).tolist():
                    own = np.flatnonzero(sizes == d)
                    x, y = (np.asarray(part.column(c).take(pa.array(own)).flatten(), np.float64).reshape(len(own), d) for c in ("va", "vb"))
                    good[own] = np.einsum("nd,nd->n", x, y) >= threshold * np.sqrt(np.einsum("nd,nd->n", x, x) * np.einsum("nd,nd->n", y, y))
                yield part.select(["a", "b"]).filter(pa.array(good))

    return pairs.mapInArrow(run, "a long, b long")


def links(rows: DataFrame, threshold: float, recall: float, tmp: Scratch) -> DataFrame:
    """a, b (a < b) of every pair of vectors (id, v; ids distinct) at least that similar."""
    spark = rows.sparkSession
    sizes = {r["d"]: r["n"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    plans = {}
    for d, n in sizes.items():
        own = np.array([r["v"] for r in sample if len(r["v"]) == d], np.float64)
        mean = (own / np.linalg.norm(own, axis=1, keepdims=True)).mean(0) if len(own) else None
        plans[d] = Plan(n, d, mean, threshold, recall=recall)
    shared = spark.sparkContext.broadcast(plans)
    filed = _filed(rows, shared)
    big = tmp.table(filed.groupBy("d", "t", "k").count().where(F.col("count") > UNIT).select("d", "t", "k", F.ceil(F.col("count") / UNIT).cast("int").alias("blocks")), "big")
    if big.isEmpty():
        units = filed.withColumn("u", F.lit(0)).withColumn("side", F.lit(2))
    else:  # rows of a cell in blocks; a block meets each other one, and itself, in a unit of its own
        block = filed.join(F.broadcast(big) if big.count() <= 100_000 else big, ["d", "t", "k"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        each = block.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        units = each.withColumn("u", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).withColumn("side", F.expr("case when own = other then 2 when own < other then 0 else 1 end")).drop("blocks", "own", "other")
    found = _counted(units.repartition("d", "t", "k", "u").sortWithinPartitions("d", "t", "k", "u"), shared)
    pairs = tmp.table(found, "counted")
    one, two = (rows.select(F.col("id").alias(x), F.col("v").alias(f"v{x}")) for x in "ab")
    return tmp.table(_cosines(pairs.join(one, "a").join(two, "b"), threshold), "links")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, class_id (the smallest id that links lead to) and n_links, the number of other ids at least that similar."""
    tmp = Scratch(vectors.sparkSession)
    every = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    known = every.where("id is not null")
    again = tmp.table(known.groupBy("id").count().where("count > 1").select("id"), "repeated")
    if not again.isEmpty():
        known = known.join(small(again), "id", "left_anti").unionByName(known.join(small(again), "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")))
    rows = known.where("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < 1e18) and exists(v, x -> abs(x) > 1e-18)")
    hashed = rows.select("id", F.xxhash64("v").alias("h"), F.hash("v").alias("i"))
    classes = hashed.groupBy("h", "i").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1")
    copies = tmp.table(hashed.join(classes, ["h", "i"]).select("id", "first", "c"), "copies")
    gone = copies.where("id <> first").select("id")
    found = links(rows.join(small(gone), "id", "left_anti"), threshold, recall, tmp)
    roots = components(found)
    # a link to a class is one to each of its members
    size = copies.where("id = first").select("id", "c")
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(size.withColumnRenamed("id", "b"), "b", "left").groupBy(F.col("a").alias("first")).agg(F.sum(F.coalesce("c", F.lit(1))).alias("n"))
    placed = known.select("id").join(copies, "id", "left").select("id", F.coalesce("first", "id").alias("first"), (F.coalesce("c", F.lit(1)) - 1).alias("c"))
    placed = placed.join(degree, "first", "left").join(roots.withColumnRenamed("id", "first"), "first", "left")
    named = placed.select(F.col("id").alias("vec_id"), F.coalesce("root", "first").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("c")).cast("long").alias("n_links"))
    none = every.where("id is null").select(F.col("id").alias("vec_id"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    out = written(named.unionByName(none), "classes")
    tmp.clear()
    return out


ORACLE = """
with recursive e as (
  select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.vec_id < b.vec_id
  where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.95),
both_ways as (select a, b from e union select b, a from e),
r(id, root) as (select a, a from both_ways union select b, root from r join both_ways on id = a where root < b),
f as (select id, min(root) as root from r group by id),
n as (select a as id, count(*) as n from both_ways group by a)
select v.vec_id, coalesce(f.root, v.vec_id) as class_id, cast(coalesce(n.n, 0) as bigint) as n_links
from embeddings v left join f on f.id = v.vec_id left join n on n.id = v.vec_id
"""
