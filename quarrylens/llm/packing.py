"""Best-fit packing by minimum bin slack.

A document of n words is cut into pieces of at most `capacity`; a full piece is a bin by itself and enters
no group. The others, one for a document at most, are spread over groups of about `group_items` by a hash of
(id, piece, text), and each group is packed on its own: a bin is opened by the longest piece left, a bitset
subset-sum dynamic program over the lengths that remain finds the fullest feasible combination,
and what it uses is removed. Rows that repeat an id and a text more often than `HOT` times are spread by their
place in the input too, so that no group grows with them. The number of groups follows the input; a task
holds the pieces of one group, while full pieces stream past.

Words are runs without ASCII white space. `pack` gives the places alone; `packed_texts` gives the documents' own
columns with each piece's text, so that the texts of a document's pieces, joined in the order of `chunk`, are
its text again.

Defined results: a null or empty text, or one of white space only, has length 0 and gets no piece and no row; a
null id is packed like any other; repeated rows are pieces of their own; ties go to the smaller (doc_id, chunk),
null ids first; an empty table gives no rows. `pack` never reads other columns. `packed_texts` keeps them; a
column n_chars is brought up to date, and a new column whose name is taken gets underscores behind it.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.llm.common import give_back, modest, slices, small, written

CAPACITY = 2048
GROUP_ITEMS = 4096
HOT = 256
WORD = re.compile(rb"[^ \t\n\x0b\f\r]+")
PLACES = ["chunk", "length", "bin_group", "bin", "position", "offset", "slack"]


def lengths(text: str, capacity: int) -> list[int]:
    """Words of each piece of a text."""
    n = len(text.encode("utf-8", "surrogatepass").split())
    return [capacity] * (n // capacity) + ([n % capacity] if n % capacity else [])


def cut(text: str, capacity: int, pieces: int) -> list[str]:
    """The pieces themselves: white space stays with the word before it, at the start with the one after it."""
    if pieces == 1:
        return [text]
    raw, at = text.encode("utf-8", "surrogatepass"), [0]
    at += [m.start() for i, m in enumerate(WORD.finditer(raw)) if i and i % capacity == 0]
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(at, [*at[1:], len(raw)], strict=True)]


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths (with multiplicity at most `counts`) whose sum is the largest that is <= room.

    reach[i] is the bitset of sums that the i longest usable pieces can give; the scan stops as
    soon as the room can be filled to the last unit.
    """
    mask, reach, taken = (1 << (room + 1)) - 1, [1], []
    for size in sorted((s for s in counts if s <= room), reverse=True):
        for _ in range(min(counts[size], room // size)):
            new = (reach[-1] | reach[-1] << size) & mask
            if new == reach[-1]:
                break
            reach.append(new)
            taken.append(size)
            if new >> room & 1:
                break
        if reach[-1] >> room & 1:
            break
    total, out = reach[-1].bit_length() - 1, []
    for i in range(len(taken), 0, -1):
        if not reach[i - 1] >> total & 1:
            out.append(taken[i - 1])
            total -= taken[i - 1]
    return out


def minimum_slack(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Bins of indices into `lengths`, each the fullest that the longest piece left allows."""
    at: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        at[lengths[i]].append(i)
    counts = {k: len(v) for k, v in at.items()}
    bins = []

    def take(size: int) -> int:
        counts[size] -= 1
        if not counts[size]:
            del counts[size]
        return at[size].pop()

    for first in sorted(counts, reverse=True):
        while first in counts:
            own = [take(first)]
            own += [take(s) for s in fullest(counts, capacity - first)]
            bins.append(own)
    return bins


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _pieces(docs: DataFrame, text: str, size: str | None, texts: bool, capacity: int, group_items: int) -> DataFrame:
    """A row for each piece: the given columns (p_id, p_x, p_hot and, with `texts`, all others), p_chunk, p_length and p_group."""
    # full pieces stay out of the groups, so documents bound the pieces in them
    groups = max(1, math.ceil(docs.count() / group_items))
    names = [n for n in docs.columns if texts or n != text]
    schema = T.StructType([f for f in docs.schema if f.name in names]).add("p_chunk", "integer").add("p_length", "integer").add("p_group", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen = np.uint64(TaskContext.get().partitionId()) << np.uint64(40)
        for batch in slices(batches, text):
            values = batch.column(text).to_pylist()
            sizes = [lengths(t, capacity) if t else [] for t in values]
            row = np.repeat(np.arange(len(sizes)), list(map(len, sizes)))
            chunk = np.concatenate([np.empty(0, np.int32), *(np.arange(len(s), dtype=np.int32) for s in sizes)]).astype(np.int32)
            h = _mix(np.asarray(batch.column("p_x"), np.int64).view(np.uint64)[row] + _mix(batch.column("p_id").fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64)[row] + np.uint64(1)))
            hot = np.asarray(batch.column("p_hot").to_numpy(zero_copy_only=False), np.uint64)[row]
            h = _mix(h + chunk.astype(np.uint64) + hot * _mix(seen + row.astype(np.uint64) + np.uint64(7)))
            seen += np.uint64(len(values))
            cols = {n: batch.column(n).take(pa.array(row)) for n in names}
            if texts:
                cuts = [c for t, s in zip(values, sizes, strict=True) if s for c in cut(t, capacity, len(s))]
                cols[text] = pa.array(cuts, batch.column(text).type)
                if size:
                    cols[size] = pa.array(list(map(len, cuts)), cols[size].type)
            own = [pa.array(chunk), pa.array([n for s in sizes for n in s], pa.int32()), pa.array((h % np.uint64(groups)).astype(np.int64))]
            yield pa.record_batch([*cols.values(), *own], names=[*names, "p_chunk", "p_length", "p_group"])

    return docs.mapInArrow(run, schema)


def _placed(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds p_bin, p_position, p_offset and p_slack; the rows of a group follow each other, full pieces first."""
    schema = T.StructType(pieces.schema.fields).add("p_bin", "long").add("p_position", "integer").add("p_offset", "integer").add("p_slack", "integer")
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        group, held, bins = None, [], 0

        def with_places(rows: pa.Table, places: list[tuple]) -> Iterator[pa.RecordBatch]:
            for i, (name, kind) in enumerate(zip(schema.names[-4:], kinds, strict=True)):
                rows = rows.append_column(name, pa.array([p[i] for p in places], kind))
            yield from rows.to_batches()

        def closed() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            rows = pa.Table.from_batches(held)
            sizes, order, places = rows.column("p_length").to_pylist(), [], []
            for b, own in enumerate(minimum_slack(sizes, capacity)):
                free, offset = capacity - sum(sizes[i] for i in own), 0
                for position, i in enumerate(own):
                    order.append(i)
                    places.append((bins + b, position, offset, free))
                    offset += sizes[i]
            for at in range(0, len(order), 1024):
                yield from with_places(rows.take(pa.array(order[at : at + 1024])), places[at : at + 1024])

        for batch in batches:
            if not batch.num_rows:
                continue
            g, full = batch.column("p_group").to_numpy(), batch.column("p_length").to_numpy() == capacity
            edges = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (full[1:] != full[:-1])) + 1).tolist(), len(g)]
            for a, b in zip(edges, edges[1:], strict=False):
                if g[a] != group:
                    yield from closed()
                    group, held, bins = g[a], [], 0
                part = batch.slice(a, b - a)
                if full[a]:
                    yield from with_places(pa.Table.from_batches([part]), [(bins + i, 0, 0, 0) for i in range(b - a)])
                    bins += b - a
                else:
                    held.append(part)
        yield from closed()

    order = ["p_group", F.desc(F.col("p_length") == capacity), F.asc_nulls_first("p_id"), "p_chunk", "p_x"]
    return pieces.repartition("p_group").sortWithinPartitions(*order).mapInArrow(run, schema)


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds p_id, p_x (hash of the text) and whether the row is one of many alike."""
    modest(docs.sparkSession)
    own = docs.withColumn("p_id", F.col(id_col).cast("long")).withColumn("p_x", F.xxhash64(text_col))
    hot = written(own.groupBy("p_id", "p_x").count().where(F.col("count") > HOT).select("p_id", "p_x"), "hot")
    if hot.isEmpty():
        return own.withColumn("p_hot", F.lit(0))
    # only hashes are compared: a row held to be hot by chance is spread differently, nothing more
    marks = small(hot.select(F.xxhash64("p_id", "p_x").alias("p_mark")).distinct())
    return own.withColumn("p_mark", F.xxhash64("p_id", "p_x")).join(marks.withColumn("p_hot", F.lit(1)), "p_mark", "left").withColumn("p_hot", F.coalesce("p_hot", F.lit(0))).drop("p_mark")


def pack(docs: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: its bin, its place in it and the words the bin leaves free."""
    docs = _marked(docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")), "i", "t")
    placed = _placed(_pieces(docs, "t", None, False, capacity, group_items), capacity)
    return placed.select(F.col("p_id").alias("doc_id"), *(F.col(f"p_{n.removeprefix('bin_')}").alias(n) for n in PLACES))


def packed_texts(docs: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: the document's columns with the piece's text, then its place as in `pack`."""
    names, taken = list(docs.columns), {n.lower() for n in docs.columns}
    inner = {n: f"c{i}" for i, n in enumerate(names)}
    new = []
    for n in PLACES:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        new.append(n)
    marked = _marked(docs.toDF(*inner.values()), inner[id_col], inner[text_col])
    placed = _placed(_pieces(marked, inner[text_col], inner.get("n_chars"), True, capacity, group_items), capacity)
    return placed.select(*(F.col(c).alias(n) for n, c in inner.items()), *(F.col(f"p_{n.removeprefix('bin_')}").alias(o) for n, o in zip(PLACES, new, strict=True)))
