"""SentencePiece encoding and decoding with scores shared along common prefixes.

A normalised text is cut into marked words (runs of the word mark and what follows them); no piece of
the vocabularies served crosses such a cut, which is checked when a model is loaded. The distinct words of
a slice that weren't met before are sorted, which lays them out as a depth-first walk through their
trie, and forward values are kept on a stack by depth: a word starts from those of the prefix that it
shares with the one before, so each node of the trie is solved once.

The forward value depends on the kind of model. For a unigram model it is Viterbi's: the best sum of scores
that ends here. For a byte-pair model maximal sums give wrong ids, since merges are greedy by rank; there
the value is the last piece of the prefix's encoding, and it is extended by the one piece that ends here
and is compatible with the last piece before it (two pieces are compatible if the merges applied to their
joined text give them back). That recursion equals the merges over the whole word, at the same cost.

Characters outside the vocabulary become byte pieces (or the unknown id in a model without them).

Defined results: a null or empty text has no ids; null ids of documents are carried along; repeated rows
get equal ids; ties between segmentations of equal score go to the longer last piece; an empty table
gives no rows. Decoding an empty or null array gives the empty text; ids outside the vocabulary and
control ids give nothing. Other columns are never read.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import id_text, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CACHED_WORDS = 800_000
CACHED_PAIRS = 1_000_000


class Model:
    """Vocabulary of a model file, read once in each process."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.score: list[float] = []
        self.piece: list[str] = []
        self.bytes_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            self.score.append(sp.get_score(i))
            self.piece.append(piece)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b" \xe2\x81\x87 " if sp.is_unknown(i) else b"")
            else:
                self.ids[piece] = i
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece of this model crosses words")
        self.unk = sp.unk_id()
        self.known = {c for p in self.ids for c in p if c in self.ids}
        self.bpe = self._is_bpe()
        self.dummy_prefix = sp.normalize("a").startswith(MARK) if hasattr(sp, "normalize") else True
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        if self.bpe:  # pieces that merges never make can't end a prefix
            self.ids = {p: i for p, i in self.ids.items() if self.merged(p) == [i]}
        self.ends = self._ends()

    def _is_bpe(self) -> bool:
        """Byte-pair models score a piece by its rank, a whole number; unigram models by a logarithm."""
        return all(float(self.score[i]).is_integer() for i in self.ids.values())

    def _ends(self) -> dict[str, tuple[int, ...]]:
        """Last two, three or four characters -> sizes of the pieces that can end there, longest first; the longest key that is there holds all."""
        sizes: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 1:
                end = p[-4:]
                sizes.setdefault(end, {1} | {k for k in range(2, len(end)) if end[-k:] in self.ids}).add(len(p))
        return {k: tuple(sorted(v, reverse=True)) for k, v in sizes.items()}

    def merged(self, text: str) -> list[int]:
        """Greedy merges by rank, leftmost first: what the recursion must equal."""
        ids, score, parts = self.ids, self.score, list(text)
        found = [ids.get(x + y) for x, y in zip(parts, parts[1:], strict=False)]
        while True:
            k, best = -1, -np.inf
            for at, i in enumerate(found):
                if i is not None and score[i] > best:
                    k, best = at, score[i]
            if k < 0:
                return [ids[p] for p in parts]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del found[k]
            if k:
                found[k - 1] = ids.get(parts[k - 1] + parts[k])
            if k < len(found):
                found[k] = ids.get(parts[k] + parts[k + 1])

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) > CACHED_PAIRS:
            self.pairs.clear()
        got = self.pairs[a << 20 | b] = self.merged(self.piece[a] + self.piece[b]) == [a, b]
        return got

    def solve(self, words: Iterable[str]) -> None:
        """Adds sorted words to `words`; the stacks hold one entry for each depth of the trie."""
        before, last, score = "", [-1], [0.0]
        ids, bpe, ends, known, pairs, length = self.ids, self.bpe, self.ends, self.known, self.pairs, list(map(len, self.piece))
        for word in words:
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], score[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best, value = -1, -np.inf
                if word[end - 1] in known:
                    for size in (end > 3 and ends.get(word[end - 4 : end])) or (end > 2 and ends.get(word[end - 3 : end])) or (end > 1 and ends.get(word[end - 2 : end])) or (1,):
                        if size > end:
                            continue
                        i = ids.get(word[end - size : end])
                        if i is None:
                            continue
                        at = last[end - size]
                        if bpe:
                            if at < 0 or (ok := pairs.get(at << 20 | i)) or (ok is None and self.compatible(at, i)):
                                best = i
                                break
                        elif score[end - size] + self.score[i] > value:
                            best, value = i, score[end - size] + self.score[i]
                if best < 0:  # a character of its own: bytes, which nothing merges with
                    best = -2
                    value = score[end - 1] - 100.0
                last.append(best)
                score.append(0.0 if bpe else value)
            out: list[int] = []
            end = len(word)
            while end:
                i = last[end]
                if i == -2:
                    raw = word[end - 1].encode("utf-8", "surrogatepass")
                    out += [self.byte_id[b] for b in reversed(raw)] if self.byte_id else [self.unk]
                    end -= 1
                else:
                    out.append(i)
                    end -= length[i]
            self.words[word] = tuple(reversed(out))
            before = word

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [WORD.findall(self.sp.normalize(t)) if t else [] for t in texts]
        new = set(chain.from_iterable(cut)) - self.words.keys()
        if len(self.words) + len(new) > CACHED_WORDS:
            self.words.clear()
            new = set(chain.from_iterable(cut))
        collecting = gc.isenabled()
        gc.disable()  # millions of tuples and no cycle among them
        self.solve(sorted(new))
        if collecting:
            gc.enable()
        get = self.words.__getitem__
        return [np.fromiter(chain.from_iterable(map(get, ws)), np.int32) for ws in cut]

    def decode(self, ids: Iterable[int]) -> str:
        n, table = len(self.bytes_of), self.bytes_of
        text = b"".join([table[i] for i in ids if 0 <= i < n]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encoded(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, token_ids and whether decoding gives the normalised text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            found = m.encode(texts)
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            back = [m.decode(ids.tolist()) == t for ids, t in zip(found, texts, strict=True)]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found))), pa.array(back)],
                names=["doc_id", "n_tokens", "token_ids", "round_trip"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens int, token_ids array<int>, round_trip boolean")


def decoded(rows: DataFrame, path: str = MODEL, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """doc_id and the text of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array([m.decode(x for x in ids or [] if x is not None) for ids in batch.column("token_ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("token_ids")).mapInArrow(run, "doc_id long, text string")
