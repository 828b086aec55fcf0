"""Commits from `git log`, parsed from a stream of records."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAX_COMMITS = 500
RECORD, FIELD = "\x1e", "\x1f"
FORMAT = f"{RECORD}%H{FIELD}%an{FIELD}%ai{FIELD}%P{FIELD}%s{FIELD}"
SCHEMA = "hash string, author string, date string, message string, files array<string>, is_root boolean"


@dataclass
class Log:
    rows: list[tuple] = field(default_factory=list)
    scanned: int = 0
    malformed: int = 0
    outside: int = 0


def parse(stream: str, prefix: str = "") -> Log:
    """Records of the log; paths outside the prefix are dropped, broken records counted and never guessed at."""
    out = Log()
    for raw in stream.split(RECORD)[1:]:
        out.scanned += 1
        parts = raw.split(FIELD)
        if len(parts) != 6 or len(parts[0]) not in (40, 64):
            out.malformed += 1
            continue
        commit, author, date, parents, subject, names = parts
        every = [n for n in names.strip("\n").replace("\n", "\0").split("\0") if n]
        files = [n[len(prefix) :] for n in every if n.startswith(prefix)]
        out.outside += len(every) - len(files)
        if files or not every:
            out.rows.append((commit, author, date, subject, files, not parents.strip()))
    return out


def commits_of(records: DataFrame, prefix: str = "") -> DataFrame:
    """Commits of a stored log (one record in a row, as `spark.read.text(path, lineSep=RECORD)` gives them), parsed where they are."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = parse("".join(RECORD + r for r in frame["value"] if r), prefix).rows
            yield pd.DataFrame(rows, columns=["hash", "author", "date", "message", "files", "is_root"])

    return records.select("value").mapInPandas(run, SCHEMA)


def _git(root: str, *args: str) -> str | None:
    got = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=120)
    return got.stdout.decode("utf-8", "surrogateescape") if got.returncode == 0 else None


def facts(root: str) -> dict:
    """head, prefix of the root in its repository, shallow, in_repo."""
    inside = (_git(root, "rev-parse", "--is-inside-work-tree") or "").strip() == "true"
    if not inside:
        return {"in_repo": False, "head": "", "prefix": "", "shallow": False}
    return {"in_repo": True, "head": (_git(root, "rev-parse", "HEAD") or "").strip(), "prefix": (_git(root, "rev-parse", "--show-prefix") or "").strip(), "shallow": (_git(root, "rev-parse", "--is-shallow-repository") or "").strip() == "true"}


def read_log(spark: SparkSession, root: str, most: int = MAX_COMMITS) -> tuple[DataFrame, Log, dict]:
    """The newest commits (`most` is the feature's own window), the parser's counts and the repository's facts."""
    about = facts(root)
    log = Log()
    if about["in_repo"] and about["head"]:
        where = ["--", "."] if about["prefix"] else []
        log = parse(_git(root, "log", "-z", "--name-only", "--no-merges", f"-n{most}", f"--format={FORMAT}", *where) or "", about["prefix"])
    return spark.createDataFrame(log.rows, SCHEMA), log, about
