"""Document fingerprints from prefix polynomial hashes.

For a token sequence w the arrays H[i] = sum of w[k] * B^k over k < i, modulo two primes below 2^31,
are prefix sums of one vectorised product. Any span's hash is a difference of two entries, spans of
equal length are compared across texts by scaling to a common power, and the longest common extension
of two places is found by binary search over such comparisons. Tokens are lower-case words.

`fingerprints` gives each document the hash of its whole word sequence, the smallest id with the same
one, and the maximal passages it shares with the benchmark items: windows of `WINDOW` words are looked
up by their span hash and extended both ways by binary search. The items are broadcast, as one hash
for each of their windows, while they take up at most `BROADCAST_BYTES`; beyond that the windows are
joined by a shuffle and the same extension runs for the documents that hold one.

Passages that documents share with each other are found exactly: `repeated` covers the words of every
window of `REPEAT` words that another word sequence holds too. Each such window is filed under the lowest
hash of its spans of half that length. Only these lowest hashes of all documents meet, a few for a hundred
words; then the whole windows under the hashes that several word sequences hold. A window's class is the
place where the document with the smallest id holds it first, and windows that follow each other in both
texts are one passage, so what thousands share costs each of them a line. Two documents whose
passages overlap by `REPEAT` words or more in the same first document share those words.

Defined results: a null or empty text, or one without words, has 0 words, fingerprint 0 and no
passages, and is a copy of the smallest such id; null ids are kept and never are the first copy of
a document that has an id; repeated rows get equal results; of equal passages of several items all are
listed, ordered by (item_id, start, item_start); copies of a word sequence have the same `repeated`, ordered
by start, and don't make a passage repeated by themselves; first_doc is null where
only documents without an id hold the passage; n_texts is the most word sequences that hold one window of it;
an empty table gives no rows. Other columns are never
read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import id_text, slices, written
from quarrylens.llm.common import small as few

WORD = re.compile(r"\w+")
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1597334677)
WINDOW = 8
#: A common passage has so many words at least.
MIN_WORDS = 13
#: A passage that documents share with each other has so many words at least.
REPEAT = 50
BROADCAST_BYTES = 64 << 20
SCHEMA = "doc_id long, x long, n_words int, fingerprint long, passages array<struct<item_id:long,start:int,item_start:int,n_words:int>>, lows array<long>"


class Codes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        b = word.encode("utf-8", "surrogatepass")
        got = self[word] = (zlib.crc32(b) & 0x7FFFFFFF) << 31 | zlib.crc32(b, 77) & 0x7FFFFFFF
        return got


def codes(text: str, known: Codes) -> np.ndarray:
    words = WORD.findall(text.lower())
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


_powers: list[np.ndarray] = [np.ones(1, np.int64), np.ones(1, np.int64)]


def powers(j: int, n: int) -> np.ndarray:
    """B^0 .. B^n modulo the j-th prime, doubled when a longer text comes."""
    while len(_powers[j]) <= n:
        p, have = PRIMES[j], _powers[j]
        step = pow(BASES[j], len(have), p)
        _powers[j] = np.concatenate([have, have * step % p])
    return _powers[j][: n + 1]


class Prefix:
    """Prefix arrays of one sequence."""

    def __init__(self, w: np.ndarray):
        self.n = len(w)
        parts = (w >> 31, w & 0x7FFFFFFF)
        # the sum stays below 2^63 for any text of under 2^32 words
        self.h = [np.concatenate([[0], np.cumsum(parts[j] % PRIMES[j] * powers(j, self.n)[: self.n] % PRIMES[j]) % PRIMES[j]]) for j in range(2)]

    def whole(self) -> int:
        return int(self.h[0][-1]) << 31 | int(self.h[1][-1])

    def windows(self, size: int) -> np.ndarray:
        """Hash of every span of `size` words, free of its place."""
        n = self.n - size + 1
        if n <= 0:
            return np.empty(0, np.int64)
        out = []
        for j, p in enumerate(PRIMES):
            inverse = inverse_powers(j, n)
            out.append((self.h[j][size : size + n] - self.h[j][:n]) % p * inverse[:n] % p)
        return out[0] << 31 | out[1]


def lows(p: Prefix, size: int) -> np.ndarray:
    """For each window of `size` words, the lowest of the mixed hashes of its spans of half that length."""
    if p.n < size:
        return np.empty(0, np.int64)
    out = (p.windows(size // 2).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    most, have = size - size // 2 + 1, 1
    while have < most:
        step = min(have, most - have)
        out, have = np.minimum(out[:-step], out[step:]), have + step
    return out


_inverse: list[np.ndarray] = [np.ones(1, np.int64), np.ones(1, np.int64)]


def inverse_powers(j: int, n: int) -> np.ndarray:
    p = PRIMES[j]
    back = pow(BASES[j], p - 2, p)
    while len(_inverse[j]) <= n:
        have = _inverse[j]
        _inverse[j] = np.concatenate([have, have * pow(back, len(have), p) % p])
    return _inverse[j]


def equal(a: Prefix, i: int, b: Prefix, j: int, n: int) -> bool:
    """Whether a[i:i+n] and b[j:j+n] are the same words."""
    for q, p in enumerate(PRIMES):
        x, y = int(a.h[q][i + n] - a.h[q][i]) % p, int(b.h[q][j + n] - b.h[q][j]) % p
        pw = powers(q, max(i, j))
        if x * int(pw[max(0, j - i)]) % p != y * int(pw[max(0, i - j)]) % p:
            return False
    return True


def extend(a: Prefix, i: int, b: Prefix, j: int, most: int | None = None) -> int:
    """Length of the longest common extension to the right of a[i:] and b[j:]."""
    lo, hi = 0, min(a.n - i, b.n - j) if most is None else most
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if equal(a, i, b, j, mid) else (lo, mid - 1)
    return lo


def extend_left(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """Length of the longest common extension that ends before a[i] and b[j]."""
    lo, hi = 0, min(i, j)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if equal(a, i - mid, b, j - mid, mid) else (lo, mid - 1)
    return lo


class Items:
    """Sorted window hashes of all items, with the item and place of each."""

    def __init__(self, rows: list[tuple[int, str]], window: int):
        known, hashes, self.ids = Codes(), [], [r[0] for r in rows]
        self.prefix = [Prefix(codes(text, known)) for _, text in rows]
        for k, p in enumerate(self.prefix):
            w = p.windows(window)
            hashes.append(np.stack([w, np.full(len(w), k), np.arange(len(w))]))
        every = np.concatenate(hashes, axis=1) if hashes else np.empty((3, 0), np.int64)
        self.hash, self.item, self.place = every[:, np.argsort(every[0], kind="stable")]


def passages(p: Prefix, items: Items, window: int = WINDOW, least: int = MIN_WORDS) -> list[tuple[int, int, int, int]]:
    """(item_id, start, item_start, n_words) of every maximal common passage of at least `least` words."""
    w = p.windows(window)
    if not len(w) or not len(items.hash):
        return []
    at = np.searchsorted(items.hash, w)
    hit = np.flatnonzero(items.hash[np.minimum(at, len(items.hash) - 1)] == w)
    out, covered = set(), {}
    for i in hit.tolist():
        k = int(at[i])
        while k < len(items.hash) and items.hash[k] == w[i]:
            item, j = int(items.item[k]), int(items.place[k])
            k += 1
            if covered.get((item, j - i), -1) >= i + window:  # inside a passage on this diagonal already
                continue
            q = items.prefix[item]
            left, right = extend_left(p, i, q, j), extend(p, i, q, j)
            covered[item, j - i] = i + right
            if left + right >= least:
                out.add((items.ids[item], i - left, j - left, left + right))
    return sorted(out, key=lambda r: (r[0], r[1], r[2]))


def fingerprints(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", repeat: int = REPEAT) -> DataFrame:
    """One row for each document: fingerprint, first copy, passages shared with the items and with other documents."""
    spark, rows = docs.sparkSession, id_text(docs, id_col, text_col).withColumn("x", F.xxhash64("text"))
    bench = id_text(benchmark.where(F.col(item_col).isNotNull()), item_col, text_col).distinct()
    # an item takes up about 48 bytes for each word: two prefix arrays, the sorted window hashes and their places
    size = bench.agg(F.sum(F.octet_length("text") + 48 * F.regexp_count("text", F.lit(r"\w+")) + 8)).first()[0] or 0
    small = size <= BROADCAST_BYTES
    shared = spark.sparkContext.broadcast(Items([tuple(r) for r in bench.orderBy("doc_id", "text").collect()], window)) if small else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, items = Codes(), shared.value if shared else None
        for batch in slices(batches):
            ns, prints, found, low = [], [], [], []
            for text in batch.column("text").to_pylist():
                p = Prefix(codes(text, known))
                ns.append(p.n)
                prints.append(p.whole())
                low.append(np.unique(lows(p, repeat)))
                found.append([dict(zip(("item_id", "start", "item_start", "n_words"), r, strict=True)) for r in passages(p, items, window, least)] if items else [])
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("item_start", pa.int32()), ("n_words", pa.int32())]))
            ends = np.cumsum([0, *map(len, low)]).astype(np.int32)
            cols = [batch.column("doc_id"), batch.column("x"), pa.array(ns, pa.int32()), pa.array(prints, pa.int64()), pa.array(found, kind), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(low)))]
            yield pa.record_batch(cols, names=["doc_id", "x", "n_words", "fingerprint", "passages", "lows"])

    marked = written(rows.mapInArrow(run, SCHEMA).withColumn("t", F.xxhash64("fingerprint", "n_words")), "marked")
    again = _repeated(rows, marked, repeat)
    if not small:
        marked = marked.drop("passages").join(_shuffled(rows.select(F.col("x").alias("doc_id"), "text").dropDuplicates(["doc_id"]), bench, window, least).withColumnRenamed("doc_id", "x"), "x", "left").withColumn("passages", F.coalesce("passages", F.expr("cast(array() as array<struct<item_id:long,start:int,item_start:int,n_words:int>>)")))
    same = Window.partitionBy("t")
    none = F.expr("cast(array() as array<struct<start:int,n_words:int,first_doc:long,first_start:int,n_texts:long>>)")
    return marked.withColumn("first_copy", F.min("doc_id").over(same)).join(again, "t", "left").select("doc_id", "n_words", "fingerprint", "first_copy", "passages", F.coalesce("repeated", none).alias("repeated"))


def _repeated(rows: DataFrame, marked: DataFrame, size: int) -> DataFrame:
    """t, repeated: the passages of each word sequence t that another one holds too."""
    held = Window.partitionBy("h")
    met = marked.select("t", F.explode("lows").alias("h")).withColumn("lo", F.min("t").over(held)).withColumn("hi", F.max("t").over(held))
    open_ = met.where("lo < hi").groupBy("t").agg(F.collect_set("h").alias("lows"))
    # one text for each word sequence, under one id
    one = marked.groupBy("t").agg(F.min("doc_id").alias("first"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "x")).alias("one"))
    open_ = written(open_.join(one, "t").select("t", "lows", "first", "one.doc_id", "one.x"), "open")
    there = rows.join(few(written(open_.select("x").distinct(), "texts")), "x", "left_semi")
    size_ = open_.agg(F.sum(8 * F.size("lows") + 40)).first()[0] or 0
    texts = there.alias("r").join((F.broadcast(open_) if size_ <= BROADCAST_BYTES else open_).alias("o"), (F.col("r.x") == F.col("o.x")) & F.col("r.doc_id").eqNullSafe(F.col("o.doc_id"))).select("t", "first", "text", "lows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Codes()
        for batch in slices(batches):
            out: list[list] = [[], [], [], []]
            for i, text in enumerate(batch.column("text").to_pylist()):
                p = Prefix(codes(text, known))
                low, w = lows(p, size), p.windows(size)
                at = np.flatnonzero(np.isin(low, batch.column("lows")[i].values.to_numpy()))
                # windows in a row under the same lowest hash
                for own in np.split(at, np.flatnonzero((np.diff(at) > 1) | (np.diff(low[at]) != 0)) + 1):
                    for col, x in zip(out, (i, low[own[0]], own[0], w[own]), strict=True):
                        col.append(x)
            row, ends = pa.array(out[0], pa.int64()), np.cumsum([0, *map(len, out[3])]).astype(np.int32)
            ws = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *out[3]])))
            yield pa.record_batch([batch.column("t").take(row), batch.column("first").take(row), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), ws], names=["t", "first", "h", "start", "ws"])

    # equal windows have the same lowest hash, so all that follows up to the runs is within its partition
    windows = texts.mapInArrow(run, "t long, first long, h long, start int, ws array<long>").repartition("h")
    windows = windows.select("t", "first", "h", F.posexplode("ws").alias("k", "w"), "start").withColumn("at", F.col("start") + F.col("k"))
    ranked = Window.partitionBy("h", "w").orderBy(F.col("first").isNull(), "first", "t", "at")
    hub = [F.first(c).over(ranked).alias(n) for c, n in (("t", "hub"), ("first", "first_doc"), ("at", "first_at"))]
    # of rows that repeat an id and a text each brings the same windows
    placed = windows.select("t", "h", "w", "at", *hub, F.row_number().over(ranked).alias("nth"), F.lag("t").over(ranked).alias("t0"), F.lag("at").over(ranked).alias("at0"))
    placed = placed.where("nth = 1 or t0 <> t or at0 <> at").withColumn("new", F.when(F.col("t0") == F.col("t"), 0).otherwise(1))
    placed = placed.withColumn("n_texts", F.sum("new").over(Window.partitionBy("h", "w"))).where("n_texts > 1").withColumn("line", F.col("first_at") - F.col("at"))
    nth = F.row_number().over(Window.partitionBy("h", "t", "hub", "line").orderBy("at"))
    parts = placed.withColumn("run", F.col("at") - nth).groupBy("h", "t", "hub", "first_doc", "line", "run").agg(F.min("at").alias("at"), F.count("*").alias("k"), F.max("n_texts").alias("n_texts"))
    line = Window.partitionBy("t", "hub", "line").orderBy("at")
    # windows of one line are all different places: those before a part tell whether it follows without a gap
    runs = parts.withColumn("run", F.col("at") - (F.sum("k").over(line) - F.col("k"))).groupBy("t", "hub", "first_doc", "line", "run")
    runs = runs.agg(F.min("at").alias("start"), (F.sum("k") + size - 1).cast("int").alias("n_words"), F.max("n_texts").alias("n_texts")).withColumn("first_start", F.col("start") + F.col("line"))
    return runs.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("start", "n_words", "first_doc", "first_start", "n_texts"))).alias("repeated"))


def _shuffled(rows: DataFrame, bench: DataFrame, window: int, least: int) -> DataFrame:
    """The passages by a join on window hashes, for items that are too many to broadcast; doc_id is a hash of the text, each once."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Codes()
        for batch in slices(batches):
            found = [np.unique(Prefix(codes(t, known)).windows(window)) for t in batch.column("text").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.record_batch([batch.column("doc_id").take(at), pa.array(np.concatenate([np.empty(0, np.int64), *found]))], names=["doc_id", "h"])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Codes()
        for batch in slices(batches):
            out = []
            for d, text, item, other in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "item_id", "item_text")), strict=True):
                out += [(d, *r) for r in passages(Prefix(codes(text, known)), Items([(item, other)], window), window, least)]
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "start", "item_start", "n_words"])

    w = rows.mapInArrow(hashes, "doc_id long, h long")
    b = bench.mapInArrow(hashes, "doc_id long, h long").withColumnRenamed("doc_id", "item_id")
    pairs = w.join(b, "h").select("doc_id", "item_id").distinct()
    found = pairs.join(rows, "doc_id").join(bench.select(F.col("doc_id").alias("item_id"), F.col("text").alias("item_text")), "item_id").select("doc_id", "text", "item_id", "item_text").mapInArrow(both, "doc_id long, item_id long, start int, item_start int, n_words int")
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("item_id", "start", "item_start", "n_words"))).alias("passages"))
