"""Source trees as a Spark data source.

Spark's own file sources drop every path with a component that begins with `_` or `.`, so the tree is
walked here, ignore rules applied on the way down.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarrylens.functions.classify import file_class, language
from quarrylens.functions.paths import dir_of, glob_regex
from quarrylens.operators.detect import is_manifest

#: Directories that are never entered, whatever the ignore files say.
SKIPPED = set("__pycache__ node_modules .angular .git .gradle .idea .mypy_cache .next .nuxt .pytest_cache .quarrylens .svelte-kit .terraform .tox .turbo .vercel .vs .vscode".split())
SCHEMA = "rel_path string, size long, mtime long, content binary"


@dataclass(frozen=True)
class Rule:
    regex: str
    negated: bool
    dir_only: bool
    anchored: bool


def parse_rules(text: str) -> list[Rule]:
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.removeprefix("!")
        dir_only, line = line.endswith("/"), line.rstrip("/")
        if line:
            anchored = "/" in line
            out.append(Rule(glob_regex(line.removeprefix("/")), negated, dir_only, anchored))
    return out


def verdict(rules: list[Rule], path: str, is_dir: bool) -> bool | None:
    """What the last matching rule of one file says: ignored, kept, or nothing."""
    said = None
    for r in rules:
        if (is_dir or not r.dir_only) and re.match(r.regex, path if r.anchored else path.rpartition("/")[2]):
            said = not r.negated
    return said


def ignored(levels: list[tuple[str, list[Rule]]], path: str, is_dir: bool) -> bool:
    """The deepest ignore file that has a matching rule decides."""
    for base, rules in reversed(levels):
        said = verdict(rules, path[len(base) + 1 :] if base else path, is_dir)
        if said is not None:
            return said
    return False


def dropped(levels: list[tuple[str, list[Rule]]], path: str) -> bool:
    """Whether a walk never reaches a file: it, or a directory above it, is ignored or skipped."""
    parts = path.split("/")
    above = ("/".join(parts[:n]) for n in range(1, len(parts)))
    return any(p.rpartition("/")[2] in SKIPPED or ignored(levels, p, True) for p in above) or ignored(levels, path, False)


def kept(files: DataFrame, ignore_files: dict[str, str]) -> DataFrame:
    """files without what the ignore files (directory -> text, "" being the root) leave out."""
    levels = [(d, parse_rules(text)) for d, text in sorted(ignore_files.items(), key=lambda kv: kv[0].count("/") + bool(kv[0]))]

    @F.pandas_udf("boolean")
    def stays(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: not dropped([(d, r) for d, r in levels if not d or p.startswith(d + "/")], p)).astype(bool)

    return files.where(stays("rel_path"))


def _rules_in(root: str, rel: str) -> list[Rule]:
    out = []
    for name in (".gitignore", ".quarrylensignore") if not rel else (".gitignore",):
        try:
            with open(os.path.join(root, rel, name), encoding="utf-8", errors="replace") as f:
                out += parse_rules(f.read())
        except OSError:
            continue
    return out


def walk(root: str, rel: str, levels: list[tuple[str, list[Rule]]]) -> Iterator[tuple[str, os.stat_result]]:
    """Files below a directory in name order; symbolic links and unreadable directories are passed over."""
    try:
        entries = sorted(os.scandir(os.path.join(root, rel)), key=lambda e: e.name)
    except OSError:
        return
    own = [*levels, (rel, _rules_in(root, rel))]
    for e in entries:
        path = f"{rel}/{e.name}" if rel else e.name
        is_dir = e.is_dir(follow_symlinks=False)
        if ignored(own, path, is_dir) or (is_dir and e.name in SKIPPED):
            continue
        if e.is_symlink():
            if is_manifest(path) and not os.path.exists(e.path):  # listed, though it can't be read: not the same as absent
                yield path, e.stat(follow_symlinks=False)
            continue
        if is_dir:
            yield from walk(root, path, own)
        elif e.is_file(follow_symlinks=False):
            yield path, e.stat(follow_symlinks=False)


class _Part(InputPartition):
    def __init__(self, found: list[tuple[str, int, int]]):
        self.found = found


#: A partition ends where it holds so many bytes or files.
PART_BYTES, PART_FILES = 16 << 20, 1000


class TreeReader(DataSourceReader):
    def __init__(self, root: str, with_content: bool):
        self.root, self.with_content = root, with_content

    def partitions(self) -> list[InputPartition]:
        """The tree is listed once, as any file source does; the files are then cut in partitions of even size."""
        out, part, size = [], [], 0
        for path, stat in walk(self.root, "", []):
            part.append((path, stat.st_size, stat.st_mtime_ns))
            size += stat.st_size
            if size >= PART_BYTES or len(part) >= PART_FILES:
                out.append(_Part(part))
                part, size = [], 0
        return [*out, _Part(part)] if part or not out else out

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path, size, mtime in partition.found:
            content = None
            if self.with_content:
                try:
                    with open(os.path.join(self.root, path), "rb") as f:
                        content = f.read()
                except OSError:
                    content = None
            rows.append((path, size, mtime, content))
            held += size
            if held >= 4 << 20:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["rel_path", "size", "mtime", "content"])


class TreeSource(DataSource):
    """Options: path (the root), content (false to list only)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], self.options.get("content", "true") == "true")


def read_tree(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").option("path", root).option("content", str(content).lower()).load()


def files(tree: DataFrame) -> DataFrame:
    """The files relation: rel_path, dir, lang, class, size, mtime."""
    p = F.col("rel_path")
    return tree.select("rel_path", dir_of(p).alias("dir"), language(p).alias("lang"), file_class(p).alias("class"), "size", "mtime")


def decode(raw: bytes | None) -> str | None:
    """Text of a file, or None where it is binary, unreadable or UTF-32."""
    if raw is None:
        return None
    if raw.startswith((b"\xff\xfe\0\0", b"\0\0\xfe\xff")):
        return None
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    head = raw[:512]
    if b"\0" in head:
        even, odd = head[::2].count(0), head[1::2].count(0)
        if odd > 0.4 * len(head) / 2 and not even:
            return raw.decode("utf-16-le", "replace")
        if even > 0.4 * len(head) / 2 and not odd:
            return raw.decode("utf-16-be", "replace")
        return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        control = sum(b < 32 and b not in (9, 10, 12, 13) for b in head)
        return None if control >= 0.1 * len(head) else raw.decode("utf-8", "replace")


#: Files are decoded in slices of about so many bytes, or one file, however many Arrow hands over; the session's batches are kept small, too.
SLICE_BYTES, BATCH_BYTES, BATCH_KEY = 1 << 20, 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rel_path, content of those that are text, slice by slice; memory follows neither the batch nor the partition."""
    for batch in batches:
        paths, raw = batch.column("rel_path"), batch.column("content")
        sizes = pc.fill_null(pc.binary_length(raw), 0).to_pylist()
        at = 0
        while at < len(sizes):
            end, held = at + 1, sizes[at]
            while end < len(sizes) and held + sizes[end] <= SLICE_BYTES:
                held += sizes[end]
                end += 1
            texts = pa.array([decode(x.as_py()) for x in raw.slice(at, end - at)], pa.string())
            yield pa.RecordBatch.from_arrays([paths.slice(at, end - at), texts], ["rel_path", "content"])
            at = end
        pa.default_memory_pool().release_unused()


def contents(tree: DataFrame) -> DataFrame:
    """rel_path and decoded text of the files that are text."""
    spark = tree.sparkSession
    if spark.conf.get(BATCH_KEY, "67108864b") == "67108864b":
        spark.conf.set(BATCH_KEY, f"{BATCH_BYTES}b")
    return tree.select("rel_path", F.col("content").cast("binary").alias("content")).mapInArrow(decoded, "rel_path string, content string").where("content is not null")
