"""Relations kept as Parquet, one folder each, with version stamps.

A snapshot is written under a new name and then pointed to, so a reader never sees half of one. Stamps of
another shape or logic make the snapshot count as absent.
"""

from __future__ import annotations

import json
import os
import re
import uuid

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

SHAPE, LOGIC = 1, 1
KEY_FILES = ("package.json", "go.mod", "Cargo.toml", "pyproject.toml", "requirements.txt", "Gemfile", "mix.exs", "pom.xml", "build.gradle", "build.gradle.kts", "pubspec.yaml", "build.sbt", "composer.json", "tsconfig.json", "Package.swift", ".gitignore")


class Store:
    """A folder on any file system that Spark reaches; a path without a scheme lies where Spark's default says."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _newest(self) -> str | None:
        """The highest pointer: pointers are numbered and only ever added whole, so none is seen half written."""
        fs, path = self._fs()
        if not fs.exists(path):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max((n for n in names if re.fullmatch(r"current-\d{12}\.json", n)), default=None)

    def meta(self) -> dict | None:
        try:
            name = self._newest()
            got = json.loads(self.spark.read.text(f"{self.folder}/{name}", wholetext=True).first()[0]) if name else None
        except (Py4JError, PySparkException, ValueError, TypeError):
            return None
        return got if got and (got.get("shape"), got.get("logic")) == (SHAPE, LOGIC) else None

    def save(self, relations: dict[str, DataFrame], **facts) -> None:
        name, before, pointer = uuid.uuid4().hex, self.meta(), self._newest()
        for k, df in relations.items():
            df.write.parquet(f"{self.folder}/{name}/{k}")
        text = json.dumps({"shape": SHAPE, "logic": LOGIC, "snapshot": name, "relations": sorted(relations), **facts})
        fs, part = self._fs(f"part-{name}.json")
        out = fs.create(part)
        out.write(bytearray(text.encode()))
        out.close()
        number = int(pointer[8:20]) + 1 if pointer else 1
        fs.rename(part, self._fs(f"current-{number:012d}.json")[1])
        for old in ([pointer] if pointer else []) + ([before["snapshot"]] if before else []):
            fs.delete(self._fs(old)[1], True)

    def load(self) -> dict[str, DataFrame] | None:
        meta = self.meta()
        if meta is None:
            return None
        return {k: self.spark.read.parquet(f"{self.folder}/{meta['snapshot']}/{k}") for k in meta["relations"]}

    def clear(self) -> None:
        fs, path = self._fs()
        fs.delete(path, True)


def staleness(meta: dict | None, head: str, key_mtimes: dict[str, int]) -> str:
    """not_stale, no_data, head_changed or key_file_changed."""
    if meta is None:
        return "no_data"
    if meta.get("head", "") != head:
        return "head_changed"
    return "not_stale" if meta.get("key_mtimes", {}) == key_mtimes else "key_file_changed"


def key_mtimes(root: str) -> dict[str, int]:
    out = {}
    for name in KEY_FILES:
        try:
            out[name] = os.stat(os.path.join(root, name)).st_mtime_ns
        except OSError:
            continue
    return out
