"""Personal data by bootstrapped contextual extraction.

Candidates are runs of characters that could be identifiers (an at sign, or `MIN_DIGITS` digits or more,
dotted quads of any digits, `SECRET_CHARS` characters or more after a secret word whatever their digits, fewer
if they mix letters and digits behind a colon or an equals sign, and phone and card numbers that contain blanks). Validators mark some as seed entities of a kind. Every
occurrence has patterns: the shape of the identifier, and the three lexical tokens before it together
with its class. Spark scores the graph of patterns and instances in rounds: a pattern's score for a kind
is the mean reliability of its distinct instances, a pattern with enough reliable instances and score is
accepted, and an instance that an accepted pattern matches becomes as reliable as the pattern, which can
lift further patterns, until a round accepts nothing new. A pattern keeps the kind and score that it was
accepted with, so the accepted ones only grow and the rounds end. They then find identifiers that no
validator knows; what a validator rules out (a card number that fails its check digit) no pattern brings back.

The graph grows with the identifiers in the corpus, not with its text. Accepted patterns are broadcast
while they take up at most `BROADCAST_BYTES`; beyond that, occurrences meet them by a shuffled join.

Defined results: a null or empty text has no findings and stays as it is; null ids are carried along;
repeated rows have findings of their own, and an instance counts once in a score however often it is
copied; of kinds with equal scores the one that sorts last wins; an empty table gives no rows. Other columns
are never read, and pass through `redacted` unchanged, except that a column `n_chars` is brought up to date.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import Scratch, id_text, slices, written

MIN_DIGITS = 6
#: A shape is accepted at three times the share of random numbers that pass a check digit; words before
#: an identifier must be much surer.
MIN_SCORE = {"s": 0.3, "l": 0.8}
MIN_SUPPORT = {"s": 3, "l": 5}
BROADCAST_BYTES = 32 << 20

MULTI = re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w.-])\d{4}(?:[ -]\d{4}){3}(?!\w)")
RUN = re.compile(r"[\w.+@-]++")
BEFORE = re.compile(r"\w+|[^\w\s]")
EMAIL = re.compile(r"[\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:\.[\w-]+)+")
PHONE = re.compile(r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}")
IP = re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)")
SECRET = re.compile(r"[A-Za-z0-9+_.-]+")
#: So long a value could be a secret, if one of the SECRET_WORDS is before it; HINT finds each of them.
SECRET_CHARS = 16
SHORT_SECRET = 8
HINT = "(?i)token|key|secret|passw|pwd|bearer|auth"
SECRET_WORDS = {"token", "key", "apikey", "api_key", "secret", "password", "passwd", "pwd", "bearer", "auth"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def seed_kind(value: str, left: list[str]) -> str | None:
    """The kind that a validator vouches for."""
    if EMAIL.fullmatch(value):
        return "email"
    if PHONE.fullmatch(value):
        return "phone"
    if IP.fullmatch(value):
        return "ip"
    digits = value.replace(" ", "").replace("-", "")
    if digits.isascii() and digits.isdigit() and 13 <= len(digits) <= 19 and luhn(digits):
        return "card"
    if SECRET_WORDS & set(left) and (len(value) >= SECRET_CHARS or mixed(value) and {"=", ":"} & set(left)) and not ("@" in value):
        return "secret" if SECRET.fullmatch(value) and {"=", ":"} & set(left) else None
    return None


def mixed(value: str) -> bool:
    """Whether a value of at least `SHORT_SECRET` characters holds letters and digits."""
    return len(value) >= SHORT_SECRET and any(map(str.isdigit, value)) and any(map(str.isalpha, value))


def refuted(value: str) -> str | None:
    """The kind that a validator rules out, whatever the patterns say: a card number whose check digit fails."""
    digits = value.replace(" ", "").replace("-", "")
    return "card" if digits.isascii() and digits.isdigit() and 13 <= len(digits) <= 19 and not luhn(digits) else None


def shape(value: str) -> str:
    """Digits as 9 with the length where there is nothing else; long hexadecimal runs as h with theirs."""
    if value.isdigit():
        return f"9x{len(value)}"
    if re.fullmatch(r"[0-9a-f]{16,}", value):
        return f"hx{len(value)}"
    return re.sub(r"a(?:[9a_]*a)?", "a", re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "9", value)))


def before(text: str, start: int) -> list[str]:
    """The three lexical tokens before a place, whole ones however long."""
    reach = 60
    while True:
        found = BEFORE.findall(text[max(0, start - reach) : start])
        if reach >= start or len(found) > 3:  # the first one found may be cut
            return [t.lower() for t in found[-3:]]
        reach *= 4


def likely(text: str, start: int, value: str) -> bool:
    """Whether a run is a candidate."""
    if "@" in value or sum(map(str.isdigit, value)) >= MIN_DIGITS or IP.fullmatch(value):
        return True
    if len(value) < SHORT_SECRET or len(value) < SECRET_CHARS and not mixed(value):
        return False
    left = set(before(text, start))
    return bool(SECRET_WORDS & left) and (len(value) >= SECRET_CHARS or bool({"=", ":"} & left))


def candidates(text: str) -> list[tuple[int, str, str | None, list[str]]]:
    """(start, value, seed kind, patterns) of every identifier-like run, in order."""
    out, spans = [], [(m.start(), m.group()) for m in MULTI.finditer(text)]
    taken = [(s, s + len(v)) for s, v in spans]
    at = 0
    for m in RUN.finditer(text):
        value = m.group()
        if "@" not in value and len(value) < MIN_DIGITS:
            continue
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at < len(taken) and taken[at][0] < m.end():
            continue
        cut = value.lstrip(".+-@")
        start, value = m.start() + len(value) - len(cut), cut.rstrip(".+-@")
        if value and likely(text, start, value):
            spans.append((start, value))
    for start, value in sorted(spans):
        left = before(text, start)
        form = shape(value)
        kind = "n" if not any(c.isalpha() for c in value) else "@" if "@" in value else "a"
        out.append((start, value, seed_kind(value, left), [f"s|{form}", f"l|{' '.join(left)}|{kind}"] if len(left) == 3 else [f"s|{form}"]))
    return out


def _found(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, list]]:
    """(row, candidates) of the rows that hold a digit, an at sign or a secret word: RE2 looks first, over all bytes."""
    some = pc.match_substring_regex(batch.column(text), f"[0-9@]|[^\\x00-\\x7F]\\p{{Nd}}|{HINT}").to_pylist()
    for i, yes in enumerate(some):
        if yes:
            got = candidates(batch.column(text)[i].as_py())
            if got:
                yield i, got


def occurrences(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cols: list[list] = [[], [], [], [], [], []]
            for i, got in _found(batch, "text"):
                d = batch.column("doc_id")[i].as_py()
                for start, value, kind, patterns in got:
                    for col, x in zip(cols, (d, start, value, kind, refuted(value), patterns), strict=True):
                        col.append(x)
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "start", "value", "seed", "never", "patterns"])

    return docs.mapInArrow(run, "doc_id long, start int, value string, seed string, never string, patterns array<string>")


def bootstrap(found: DataFrame) -> DataFrame:
    """pattern, kind, score of the accepted patterns, from the graph of patterns and instances."""
    tmp = Scratch(found.sparkSession)
    graph = tmp.table(found.select(F.explode("patterns").alias("pattern"), "value", "seed", "never").groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.max("never").alias("never")), "graph")
    seeds = graph.where("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("r")).distinct()
    total = graph.groupBy("pattern").agg(F.count("*").alias("n"))
    group = F.substring("pattern", 1, 1)
    least = F.when(group == "s", MIN_SCORE["s"]).otherwise(MIN_SCORE["l"])
    support = F.when(group == "s", MIN_SUPPORT["s"]).otherwise(MIN_SUPPORT["l"])
    accepted = tmp.table(found.sparkSession.createDataFrame([], "pattern string, kind string, score double"), "patterns")
    while True:
        lifted = graph.where("seed is null").join(accepted, "pattern").where("not kind <=> never").groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("r"))
        sure = seeds.unionByName(lifted.join(seeds.select("value"), "value", "left_anti"))
        scores = graph.select("pattern", "value").join(sure, "value").groupBy("pattern", "kind").agg(F.sum("r").alias("r"), F.count("*").alias("held"))
        scored = scores.join(total, "pattern").withColumn("score", F.round(F.col("r") / F.col("n"), 9)).where((F.col("score") >= least) & (F.col("held") >= support))
        best = scored.groupBy("pattern").agg(F.max_by("kind", F.struct("score", F.col("kind"))).alias("kind"), F.max("score").alias("score"))
        new = tmp.table(best.join(accepted.select("pattern"), "pattern", "left_anti"), "patterns")
        if new.isEmpty():
            out = written(accepted, "accepted")
            tmp.clear()
            return out
        accepted = accepted.unionByName(new)


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, value, kind, score and origin (seed or pattern) of every identifier."""
    rows = id_text(docs, id_col, text_col)
    found = written(occurrences(rows), "occurrences")
    accepted = bootstrap(found)
    numbered = found.withColumn("o", F.monotonically_increasing_id())
    best = numbered.where("seed is null").select("o", "never", F.explode("patterns").alias("pattern")).join(accepted, "pattern").where("not kind <=> never").groupBy("o").agg(F.max_by("kind", F.struct("score", "kind")).alias("found"), F.max("score").alias("score"))
    known = numbered.where("seed is not null").select("doc_id", "start", "value", F.col("seed").alias("kind"), F.lit(1.0).alias("score"), F.lit("seed").alias("origin"))
    new = numbered.where("seed is null").join(best, "o").select("doc_id", "start", "value", F.col("found").alias("kind"), F.round("score", 6).alias("score"), F.lit("pattern").alias("origin"))
    return known.unionByName(new).select("doc_id", "start", F.length("value").alias("length"), "value", "kind", "score", "origin")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, with each identifier in the text replaced by its kind, such as [EMAIL]."""
    accepted = bootstrap(written(occurrences(id_text(docs, id_col, text_col)), "occurrences"))
    size = accepted.agg(F.sum(F.octet_length("pattern") + 24)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        shared = docs.sparkSession.sparkContext.broadcast({p: (s, k) for p, k, s in accepted.select("pattern", "kind", "score").collect()})
        return _masked(docs, text_col, lambda batch: [shared.value] * batch.num_rows)
    # each row brings the accepted patterns among its own
    own = occurrences(docs.select(F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")))
    held = own.select("doc_id", F.explode("patterns").alias("pattern")).distinct().join(accepted, "pattern").groupBy(F.col("doc_id").alias("__t")).agg(F.collect_list(F.struct("pattern", "kind", "score")).alias("__held"))
    both = docs.withColumn("__t", F.xxhash64(F.coalesce(text_col, F.lit("")))).join(held, "__t", "left").drop("__t")
    return _masked(both, text_col, lambda batch: [{h["pattern"]: (h["score"], h["kind"]) for h in row or []} for row in batch.column("__held").to_pylist()], drop="__held")


def _masked(docs: DataFrame, text_col: str, patterns, drop: str | None = None) -> DataFrame:
    schema = docs.drop(drop).schema if drop else docs.schema
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts, own = batch.column(text_col), None
            new, sizes = {}, {}
            for i, got in _found(batch, text_col):
                own = own or patterns(batch)
                text, at, parts = texts[i].as_py(), 0, []
                for start, value, kind, forms in got:
                    never = refuted(value)
                    kind = kind or max((own[i][p] for p in forms if p in own[i] and own[i][p][1] != never), default=(0, None))[1]
                    if kind:
                        parts += [text[at:start], f"[{kind.upper()}]"]
                        at = start + len(value)
                if parts:
                    new[i] = "".join([*parts, text[at:]])
                    sizes[i] = len(new[i])
            if new:
                cols = {n: batch.column(n) for n in names}
                cols[text_col] = pa.array([new.get(i, t) for i, t in enumerate(texts.to_pylist())], texts.type)
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([sizes.get(i, n) for i, n in enumerate(cols["n_chars"].to_pylist())], cols["n_chars"].type)
                yield pa.record_batch([cols[n] for n in names], names=names)
            else:
                yield batch.select(names)

    return docs.mapInArrow(run, schema)
