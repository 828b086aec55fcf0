"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

Tokens (words, runs of marks, and the shape of each) are hashed into `WIDTH` features. One pass over
all documents gives the document frequencies and, in the same scan, the features of a bounded sample
of labelled documents. A truncated singular value decomposition of their tf-idf rows gives the latent
axes. The labelled vectors (`MAX_LABELS` rows of `AXES` floats: 0.5 MB, whatever the corpus) are
broadcast, and every document gets its exact cosine to each of them, block by block; the `NEIGHBOURS`
nearest vote with their similarity as weight.

Defined results: a null or empty text has no features, scores 0 and isn't kept; null labels are no
labels; a document labelled more than once counts with the mean of its labels, rounded (a half to even); a labelled id with
several texts counts with the one whose features sort first; similarities are rounded to six places, and
of equal ones the earlier sample row is nearer; null ids are scored like others, and never labelled;
with no labels at all every document that has features scores 0.5 and is kept; an empty table gives no
rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import id_text, slices

WIDTH = 8192
SHAPES = 16
AXES = 64
#: The classifier is fitted on so many labelled documents at most, chosen by the hash of their id.
MAX_LABELS = 2000
NEIGHBOURS = 25
THRESHOLD = 0.5
TOKEN = re.compile(r"\w+|[^\w\s]+")
BLOCK = 512


def shape(token: str) -> int:
    """0 lower, 1 title, 2 upper, 3 mixed case, 4 digits, 5 letters and digits, 6.. marks by length."""
    if token[0].isalnum() or token[0] == "_":
        if token.isdigit():
            return 4
        if not token.isalpha():
            return 5
        return 0 if token.islower() else 2 if token.isupper() and len(token) > 1 else 1 if token.istitle() else 3
    return 6 + min(len(token), 4)


class Ids(dict):
    """Token -> word feature << 8 | shape; forgets all when it has grown large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        got = self[token] = (zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) % WIDTH) << 8 | shape(token)
        return got


def features(text: str, ids: Ids) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers and their counts."""
    tokens = TOKEN.findall(text)
    if not tokens:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    both = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
    word, counts = np.unique(both >> 8, return_counts=True)
    shapes = np.bincount(both & 255, minlength=SHAPES)
    shapes[SHAPES - 1] = np.count_nonzero(both[1:] == both[:-1])  # a token right after itself
    own = np.flatnonzero(shapes)
    # shapes are shares of the text, on the scale of a common word's count
    return np.concatenate([word, WIDTH + own]), np.concatenate([1 + np.log(counts), 8 * shapes[own] / len(tokens)]).astype(np.float32)


@dataclass
class Model:
    """`weight` is idf times axes, so that one gather gives a document's latent vector."""

    weight: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray

    def embed(self, feats: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(feats), self.weight.shape[1]), np.float32)
        for i, (f, v) in enumerate(feats):
            if len(f):
                out[i] = v @ self.weight[f]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def score(self, latent: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        out = np.full(len(latent), 0.5)
        if not len(self.vectors):
            return out
        k = min(neighbours, len(self.vectors))
        for at in range(0, len(latent), BLOCK):
            sims = np.round(latent[at : at + BLOCK] @ self.vectors.T, 6)
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.tile(np.arange(k), (len(sims), 1))
            least = np.take_along_axis(sims, near, 1).min(1)
            for i in np.flatnonzero((sims >= least[:, None]).sum(1) > k):  # ties at the edge
                near[i] = np.argsort(-sims[i], kind="stable")[:k]
            w = np.maximum(np.take_along_axis(sims, near, 1), 0) ** 4
            out[at : at + BLOCK] = ((w * self.votes[near]).sum(1) + 1e-9) / (w.sum(1) + 2e-9)
        return out


def _gather(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, df_counts, n = Ids(), np.zeros(WIDTH + SHAPES, np.int64), 0
        for batch in slices(batches):
            keep = {"y": [], "order": [], "f": [], "v": []}
            for text, y, order in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), batch.column("sample_order").to_pylist(), strict=True):
                f, v = features(text, ids)
                df_counts[f] += 1
                n += 1
                if y is not None:
                    for k, x in zip(keep, (y, order, f, v), strict=True):
                        keep[k].append(x)
            if keep["y"]:
                yield pa.record_batch([pa.array([None] * len(keep["y"]), pa.int32()), pa.array([None] * len(keep["y"]), pa.int64()), pa.array(keep["y"], pa.float64()), pa.array(keep["order"], pa.int64()), pa.array(keep["f"], pa.list_(pa.int64())), pa.array(keep["v"], pa.list_(pa.float32()))], names=["feature", "n", "y", "sample_order", "f", "v"])
        at = np.append(np.flatnonzero(df_counts), -1)
        counts = np.append(df_counts[at[:-1]], n)
        none = [None] * len(at)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(counts, pa.int64()), pa.array(none, pa.float64()), pa.array(none, pa.int64()), pa.array(none, pa.list_(pa.int64())), pa.array(none, pa.list_(pa.float32()))], names=["feature", "n", "y", "sample_order", "f", "v"])

    return df.mapInArrow(run, "feature int, n long, y double, sample_order long, f array<long>, v array<float>")


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, axes: int = AXES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Document frequencies over all documents; latent axes and votes from the bounded sample."""
    rows = id_text(docs, id_col, text_col)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).dropna().groupBy("doc_id").agg(F.avg("y").alias("y"))
    sample = known.withColumn("sample_order", F.xxhash64("doc_id")).orderBy("sample_order", "doc_id").limit(max_labels)
    # at most max_labels rows of 24 bytes, so this side can always be broadcast
    flagged = rows.join(F.broadcast(sample), "doc_id", "left").select("text", "y", "sample_order")
    got = _gather(flagged)
    every = got.groupBy("feature", "sample_order").agg(F.sum("n").alias("n"), F.min(F.struct("f", "v", "y")).alias("one")).select("feature", "sample_order", "n", "one.y", "one.f", "one.v").toPandas()
    counts = np.zeros(WIDTH + SHAPES + 1)
    freq = every[every["feature"].notna()]
    counts[freq["feature"].to_numpy(np.int64)] = freq["n"].to_numpy(float)
    n = counts[-1]
    idf = np.log((1 + n) / (1 + counts[:-1])).astype(np.float32)
    idf[WIDTH:] = 1.0
    hand = every[every["y"].notna()].sort_values("sample_order", kind="stable")
    x = np.zeros((len(hand), WIDTH + SHAPES), np.float32)
    for i, (f, v) in enumerate(zip(hand["f"], hand["v"], strict=True)):
        x[i, np.asarray(f, np.int64)] = np.asarray(v, np.float32)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    k = max(1, min(axes, *x.shape)) if len(x) else 1
    rng = np.random.default_rng(0)
    if len(x):
        q = x.T @ rng.standard_normal((len(x), k + 8)).astype(np.float32)
        for _ in range(3):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        q = np.linalg.qr(q)[0]
        u = np.linalg.svd((x @ q).T @ (x @ q))[0]
        v = (q @ u)[:, :k].astype(np.float32)
    else:
        v = np.zeros((WIDTH + SHAPES, k), np.float32)
    vec = x @ v
    vec /= np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12)
    return Model(idf[:, None] * v, vec.astype(np.float32), np.rint(hand["y"].to_numpy(float)))


def _scores(batches: Iterator[pa.RecordBatch], model: Model, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    ids = Ids()
    for batch in slices(batches, text):
        feats = [features(t or "", ids) for t in batch.column(text).to_pylist()]
        score = model.score(model.embed(feats))
        score[[not len(f) for f, _ in feats]] = 0.0
        yield batch, np.round(score, 6)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, quality_score and keep for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in _scores(batches, shared.value, "text"):
            yield pa.record_batch([batch.column("doc_id"), pa.array(score), pa.array(score >= threshold)], names=["doc_id", "quality_score", "keep"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, quality_score double, keep boolean")


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that the vote keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in _scores(batches, shared.value, text_col):
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)
