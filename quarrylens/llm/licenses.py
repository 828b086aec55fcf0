"""Licence scan with a generalised suffix automaton of licence tokens.

The automaton holds every substring of every template. A document's tokens are streamed through it: at
each token the state is the longest suffix of what was read that some template contains (its matching
statistic), and where that can't grow the match is maximal. Maximal matches of at least `MIN_MATCH` tokens
are placed in the templates they occur in, and chained: in a chain both the document's and the template's
places increase, and gaps are at most `MAX_GAP` tokens. A chain that covers `MIN_COVER` of its template, or
`MIN_TOKENS` tokens, is a span. Tokens outside the templates end every match, so only runs of known tokens
of at least `MIN_MATCH` are streamed; shorter runs can't hold a match.

Where spans overlap the one with more covered tokens stays, then the one that covers more of its template,
then the template that sorts first.

Defined results: a null or empty text has no span and no row; null ids are carried along; repeated rows
have spans of their own; an empty table, or no template, gives no rows. Other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarrylens.llm.common import id_text, slices
from quarrylens.llm.licence_texts import TEMPLATES

MIN_MATCH = 3
MAX_GAP = 6
MIN_COVER = 0.8
MIN_TOKENS = 16
TOKEN = re.compile(r"\w+")
SCHEMA = "doc_id long, template string, token_start int, token_end int, covered int, coverage double, char_start int, char_end int"

class Automaton:
    """Suffix automaton of several token sequences; `ends` are (template, end) of a state's strings."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.ends = [-1], [0], [[]]
        for k, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._add(last, c)
                self.ends[last].append((k, i + 1))
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.ends[self.link[s]] += self.ends[s]
        self.ends = [sorted(set(e)) for e in self.ends]

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.len.append(length)
        self.ends.append([])
        return len(self.len) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._new(self.len[p] + 1)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # another template went this way
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, c)
        new, p = self._new(self.len[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, c)
        return new

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each token."""
        s = n = 0
        for c in tokens:
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.len[s]
            if c in self.next[s]:
                s, n = self.next[s][c], n + 1
            yield s, n

    def maximal(self, tokens: list[int], least: int) -> list[tuple[int, int, int]]:
        """(end, length, state) of matches that can't be extended to either side."""
        stats = list(self.statistics(tokens))
        return [(i + 1, n, s) for i, (s, n) in enumerate(stats) if n >= least and (i + 1 == len(stats) or stats[i + 1][1] <= n)]


class Scanner:
    def __init__(self, templates: dict[str, str], min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER, min_tokens: int = MIN_TOKENS):
        self.names = sorted(templates)
        words = [[t.lower() for t in TOKEN.findall(templates[n])] for n in self.names]
        self.sizes = [len(w) for w in words]
        self.ids: dict[str, int] = {}
        self.auto = Automaton([[self.ids.setdefault(t, len(self.ids)) for t in w] for w in words])
        # a template shorter than the least match is found by a match of its own size
        self.least = max(1, min([min_match, *(s for s in self.sizes if s)]))
        self.max_gap, self.min_cover, self.min_tokens = max_gap, min_cover, min_tokens

    def runs(self, tokens: list[str]) -> Iterator[tuple[int, list[int]]]:
        ids = np.fromiter((self.ids.get(t, -1) for t in tokens), np.int32, len(tokens)) if len(tokens) < 64 else np.fromiter(map(self._get, tokens), np.int32, len(tokens))
        known = np.concatenate([[False], ids >= 0, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= self.least:
                yield a, ids[a:b].tolist()

    def _get(self, token: str) -> int:
        return self.ids.get(token, -1)

    def spans(self, text: str) -> list[tuple[str, int, int, int]]:
        """(template, first token, token past the last, covered) of a text."""
        tokens = TOKEN.findall(text.lower())
        by: dict[int, list[tuple[int, int, int]]] = {}
        for at, run in self.runs(tokens):
            for end, n, state in self.auto.maximal(run, self.least):
                for k, place in self.auto.ends[state]:
                    by.setdefault(k, []).append((at + end - n, place - n, n))
        found = [c for k, hits in by.items() for c in self._chains(k, hits)]
        found.sort(key=lambda c: (-c[3], -c[3] / self.sizes[c[0]], c[0], c[1]))
        out: list[tuple[int, int, int, int]] = []
        taken = bytearray(len(tokens))
        for c in found:
            if taken.find(1, c[1], c[2]) < 0:
                taken[c[1] : c[2]] = b"\1" * (c[2] - c[1])
                out.append(c)
        return [(self.names[k], a, b, n) for k, a, b, n in sorted(out, key=lambda c: c[1])]

    def _chains(self, k: int, hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Best chains of (document place, template place, length), each hit used once."""
        hits = sorted(set(hits))
        best, back = [h[2] for h in hits], [-1] * len(hits)
        for i, (d, t, n) in enumerate(hits):
            for j in range(i - 1, -1, -1):
                pd, pt, pn = hits[j]
                if d - pd > self.max_gap + self.sizes[k]:
                    break
                over = max(0, pd + pn - d, pt + pn - t)  # the overlap counts once
                if pd < d and pt < t and d - pd - pn <= self.max_gap and t - pt - pn <= self.max_gap and over < n and best[j] + n - over > best[i]:
                    best[i], back[i] = best[j] + n - over, j
        out, used = [], set()
        for i in sorted(range(len(hits)), key=lambda i: (-best[i], hits[i])):
            path, j = [], i
            while j >= 0 and j not in used:
                path.append(j)
                j = back[j]
            if not path or i in used:
                continue
            used.update(path)
            covered = best[i] - (best[j] if j >= 0 else 0)
            if covered >= self.min_cover * self.sizes[k] or covered >= self.min_tokens:
                out.append((k, hits[path[-1]][0], hits[i][0] + hits[i][2], covered))
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each licence span of each document."""
    scanner = Scanner(TEMPLATES if templates is None else templates, **how)
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            out = []
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                spans = own.spans(text)
                if spans:
                    # lower case can change a text's length, so places are taken from the text itself
                    at = [m.span() for m in TOKEN.finditer(text)]
                    for name, a, b, n in spans:
                        first, last = (at[a][0], at[b - 1][1]) if b <= len(at) else (None, None)
                        out.append((d, name, a, b, n, round(n / own.sizes[own.names.index(name)], 6), first, last))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
            names = ["doc_id", "template", "token_start", "token_end", "covered", "coverage", "char_start", "char_end"]
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
