"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in frames of `FRAME` bytes, each from both ends by a gated recurrent
unit of `HIDDEN` cells (gates and candidate squashed by softsign, for speed); every byte gets a probability for each language and a document's are the mean
over its bytes. Frames make the cost proportional to the bytes (no document waits for a long one) and
are also what the network is trained on: backpropagation through time in numpy, over a bounded sample
of labelled documents (`SAMPLE_DOCS` different ones for each language, by the hash of id and text). Each
step of the descent draws documents and, anywhere in the whole text of each, a frame; the draws are made
where the texts are, so the driver gets the frames of `STEPS` steps however long the texts. Inference
covers whole texts.

Defined results: a null or empty text has no language (null), confidence 0 and isn't kept; documents
with a null language, or without text, aren't trained on but are labelled; null ids are trained on and labelled
like others; repeated rows count once in the sample and get equal results; ties go to the language that sorts
first; with no labelled document at all nothing is decided (null, 0); more than `MAX_LANGUAGES`
languages are an error, for then the column doesn't name languages; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import id_text, slices

FRAME = 64
HIDDEN = 6
SAMPLE_DOCS = 150
MAX_LANGUAGES = 256
STEPS = 300
BATCH = 128
#: Documents whose best language has a lower mean probability than this aren't kept.
MIN_CONFIDENCE = 0.35
ROWS = 2048


def softsign(x: np.ndarray, work: np.ndarray) -> None:
    """x / (1 + |x|) in place: a squashing function of three cheap vector operations."""
    np.abs(x, out=work)
    work += 1
    x /= work


@dataclass
class Network:
    """For each direction: byte table [3h, 256] (biases inside), recurrent [3h, h]; then the output."""

    names: list[str]
    table: list[np.ndarray]
    rec: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def states(self, x: np.ndarray, mask: np.ndarray, d: int, keep: bool = False):
        """x [T, N] bytes; hidden states [T, h, N]. Bytes past the end leave the state at zero."""
        steps, n = x.shape
        table, rec, h3 = self.table[d], self.rec[d], self.rec[d].shape[0]
        h = h3 // 3
        got, state, held = np.empty((steps, h, n), np.float32), np.zeros((h, n), np.float32), []
        a, g, work = (np.empty((rows, n), np.float32) for rows in (h3, h3, 2 * h))
        full = mask.all(1)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            np.take(table, x[t].astype(np.intp), axis=1, out=a, mode="clip")
            np.matmul(rec, state, out=g)
            zr = a[: 2 * h]
            zr += g[: 2 * h]
            softsign(zr, work)
            zr *= 0.5
            zr += 0.5
            c = a[2 * h :]
            if keep:
                held.append((t, state, zr.copy(), g[2 * h :].copy()))
            np.multiply(zr[h:], g[2 * h :], out=work[:h])
            c += work[:h]
            softsign(c, work[:h])
            if keep:
                held[-1] += (c.copy(),)
            new = got[t]
            np.subtract(state, c, out=new)
            new *= zr[:h]
            new += c
            if not full[t]:
                new *= mask[t]
            state = new
        return (got, held) if keep else got

    def label(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probabilities [T, k, N]; zero past the end."""
        h = self.rec[0].shape[1]
        p = np.matmul(self.out[:, :h], self.states(x, mask, 0))
        p += np.matmul(self.out[:, h:], self.states(x, mask, 1))
        p += self.bias[None, :, None]
        np.exp(p, out=p)
        p *= (mask / p.sum(1))[:, None, :]
        return p


def frames(texts: list[bytes], size: int = FRAME) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes [T, N], mask [T, N] and the number of frames of each text."""
    lengths = np.array([len(t) for t in texts], np.int64)
    per = -(-lengths // size)
    total = int(per.sum())
    flat, mask = np.zeros(total * size, np.uint8), np.zeros(total * size, np.float32)
    at = 0
    for t, n in zip(texts, per, strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        mask[at : at + len(t)] = 1
        at += int(n) * size
    return np.ascontiguousarray(flat.reshape(total, size).T), np.ascontiguousarray(mask.reshape(total, size).T), per


def train(texts: list[bytes], langs: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7, rate: float = 0.02) -> Network:
    """Adam on mean cross-entropy of every byte's label, unrolled over whole frames.

    Every text is a run of frames; a step draws as many of them from each language.
    """
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    k, h = len(names), hidden
    init = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    net = Network(names, [init(3 * h, 256) for _ in range(2)], [init(3 * h, h) for _ in range(2)], init(k, 2 * h), np.zeros(k, np.float32))
    x, mask, per = frames(texts)
    y = np.repeat([names.index(v) for v in langs], per)
    by = [np.flatnonzero(y == c) for c in range(k)]
    params = [*net.table, *net.rec, net.out, net.bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = np.concatenate([b[rng.integers(0, len(b), BATCH // k + 1)] for b in by if len(b)])
        bx, bm, by_ = np.ascontiguousarray(x[:, pick]), np.ascontiguousarray(mask[:, pick]), y[pick]
        grads = gradients(net, bx, bm, by_)
        for i, (p, g) in enumerate(zip(params, grads, strict=True)):
            g = np.clip(g, -1, 1)
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.01 * (g * g - v[i])
            p -= rate * (1 - step / (steps + 1)) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return net


def gradients(net: Network, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Backpropagation through time of mean cross-entropy over all bytes of the frames."""
    h, k = net.rec[0].shape[1], len(net.names)
    runs = [net.states(x, mask, d, keep=True) for d in range(2)]
    p = np.matmul(net.out[:, :h], runs[0][0]) + np.matmul(net.out[:, h:], runs[1][0]) + net.bias[None, :, None]
    p = np.exp(p - p.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[:, y, np.arange(len(y))] -= 1
    p *= (mask / max(1.0, float(mask.sum())))[:, None, :]
    both = np.concatenate([runs[0][0], runs[1][0]], axis=1)
    g_out, g_bias = np.einsum("tkn,thn->kh", p, both), p.sum((0, 2))
    g_table, g_rec = [], []
    for d in range(2):
        up = np.matmul(net.out[:, d * h : d * h + h].T, p)
        gt, gr, carry = np.zeros((256, 3 * h), np.float32), np.zeros_like(net.rec[d]), np.zeros((h, x.shape[1]), np.float32)
        for t, before, zr, gc, c in reversed(runs[d][1]):
            dh = (up[t] + carry) * mask[t]
            z, r = zr[:h], zr[h:]
            dc = dh * (1 - z) * (1 - np.abs(c)) ** 2
            dz = dh * (before - c) * (1 - np.abs(2 * z - 1)) ** 2 / 2
            dr = dc * gc * (1 - np.abs(2 * r - 1)) ** 2 / 2
            da = np.concatenate([dz, dr, dc])
            dg = np.concatenate([dz, dr, dc * r])
            gr += dg @ before.T
            np.add.at(gt, x[t], da.T)
            carry = dh * z + net.rec[d].T @ dg
        g_table.append(np.ascontiguousarray(gt.T))
        g_rec.append(gr)
    return [*g_table, *g_rec, g_out.astype(np.float32), g_bias]


def drawn(text: bytes, seed: int, draws: int) -> list[bytes]:
    """Frames from anywhere in a text: all of them if it has no more than `draws`, else so many at random."""
    n = -(-len(text) // FRAME)
    at = range(n) if n <= draws else np.random.default_rng(seed & 0xFFFFFFFF).integers(0, n, draws).tolist()
    return [text[i * FRAME : (i + 1) * FRAME] for i in at]


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> Network:
    """Trains on at most `sample_docs` documents of each language, by the hash of their id and text."""
    own = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("o"))
    own = own.where("lang is not null and length(text) > 0")
    # hashes alone are shuffled; texts are then read for the chosen few
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("o"))
    rows = own.select("lang", "o").distinct().withColumn("nth", nth).where(F.col("nth") <= sample_docs).select("lang", "o").limit(MAX_LANGUAGES * sample_docs + 1).collect()
    many: dict[str, int] = {}
    for r in rows:
        many[r["lang"]] = many.get(r["lang"], 0) + 1
    if len(many) > MAX_LANGUAGES or len(rows) > MAX_LANGUAGES * sample_docs:
        raise ValueError(f"{lang_col} holds more than {MAX_LANGUAGES} languages")
    if not rows:
        return Network([], [], [], np.zeros((0, 0)), np.zeros(0))
    # as many frames from a text as the descent will draw from it, whatever the number of texts
    steps = how.get("steps", STEPS)
    draws = {lang: max(1, steps * (BATCH // len(many) + 1) // n) for lang, n in many.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [drawn(t.encode("utf-8", "surrogatepass"), o, draws[lang]) for lang, o, t in zip(*(batch.column(c).to_pylist() for c in ("lang", "o", "text")), strict=True)]
            yield pa.record_batch([batch.column("lang"), batch.column("o"), pa.array(got, pa.list_(pa.binary()))], names=["lang", "o", "frames"])

    # at most MAX_LANGUAGES * sample_docs rows
    want = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in rows], "lang string, o long"))
    got = own.join(want, ["lang", "o"]).mapInArrow(run, "lang string, o long, frames array<binary>").dropDuplicates(["lang", "o"]).collect()
    got = sorted((r["lang"], r["o"], bytes(f)) for r in got for f in r["frames"])
    return train([r[2] for r in got], [r[0] for r in got], **how)


def pooled(net: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Mean probabilities [n, k] and shares of positions by label [n, k]."""
    k = len(net.names)
    prob, share = np.zeros((len(texts), k)), np.zeros((len(texts), k))
    if not k:
        return prob, share
    x, mask, per = frames(texts)
    owner = np.repeat(np.arange(len(texts)), per)
    for at in range(0, x.shape[1], ROWS):
        own, mk = owner[at : at + ROWS], mask[:, at : at + ROWS]
        p = net.label(np.ascontiguousarray(x[:, at : at + ROWS]), mk)
        best = p.argmax(1)
        for c in range(k):
            prob[:, c] += np.bincount(own, p[:, c].sum(0), len(texts))
            share[:, c] += np.bincount(own, ((best == c) * mk).sum(0), len(texts))
    size = np.maximum(1, [len(t) for t in texts])[:, None]
    return prob / size, share / size


def _decide(batches: Iterator[pa.RecordBatch], net: Network, text: str):
    for batch in slices(batches, text):
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(text).to_pylist()]
        yield batch, texts, *pooled(net, texts)


def identified(docs: DataFrame, net: Network, min_confidence: float = MIN_CONFIDENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every document: the language, its mean probability, and the share of bytes of each label."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch, texts, prob, share in _decide(batches, net, "text"):
            some = np.array([len(t) > 0 for t in texts]) & bool(net.names)
            best = prob.argmax(1) if net.names else np.zeros(len(texts), int)
            conf = np.where(some, prob.max(1) if net.names else 0.0, 0.0)
            names = [net.names[b] if s else None for b, s in zip(best, some, strict=True)]
            spread = [[(n, float(v)) for n, v in zip(net.names, row, strict=True)] if s else [] for row, s in zip(np.round(share, 6), some, strict=True)]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.round(conf, 6)), pa.array([len(t) for t in texts], pa.int64()), pa.array(spread, pa.map_(pa.string(), pa.float64())), pa.array(conf >= min_confidence)],
                names=["doc_id", "lang_found", "confidence", "n_bytes", "label_shares", "keep"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_found string, confidence double, n_bytes long, label_shares map<string,double>, keep boolean")


def kept(docs: DataFrame, net: Network, min_confidence: float = MIN_CONFIDENCE, text_col: str = "text") -> DataFrame:
    """The documents written in one of the known languages, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, prob, _ in _decide(batches, shared.value, text_col):
            best = prob.max(1) if prob.shape[1] else np.zeros(len(texts))
            yield batch.filter(pa.array((best >= min_confidence) & [len(t) > 0 for t in texts]))

    return docs.mapInArrow(run, docs.schema)
