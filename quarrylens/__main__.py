"""Command line: python -m quarrylens [--root DIR] [--human] COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

VERSION = "0.1.0"


def rows(df: DataFrame) -> list:
    return [r.asDict(recursive=True) for r in df.collect()]


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quarrylens")
    p.add_argument("--root", default=".")
    p.add_argument("--cache-dir")
    p.add_argument("--human", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("overview", "refresh", "rebuild", "version"):
        sub.add_parser(name)
    for name, arg, n in (("related", "path", 20), ("tests", "path", 20), ("symbols", "query?", 30), ("search", "query", 30), ("docs", "query?", 50)):
        c = sub.add_parser(name)
        c.add_argument("q", nargs="?" if arg.endswith("?") else None, default="")
        c.add_argument("-n", type=int, default=n)
    for name in ("context", "callers"):
        sub.add_parser(name).add_argument("q")
    sub.add_parser("hotspots").add_argument("-n", type=int, default=20)
    sub.add_parser("changes").add_argument("--since", default="7d")
    g = sub.add_parser("grep")
    g.add_argument("q")
    g.add_argument("-n", type=int, default=20)
    g.add_argument("-t", default=None)
    case = g.add_mutually_exclusive_group()
    case.add_argument("-i", action="store_true")
    case.add_argument("-s", action="store_true")
    a = p.parse_args(args)
    if a.command == "version":
        print(VERSION)
        return 0
    from quarrylens.engine import Repository

    spark = SparkSession.builder.appName("quarrylens").getOrCreate()
    repo = Repository(spark, a.root, a.cache_dir)
    if a.command == "rebuild":
        repo.rebuild()
    got = {
        "overview": lambda: {k: rows(v) for k, v in repo.overview().items()}, "refresh": lambda: {"files": repo["files"].count()}, "rebuild": lambda: {"files": repo["files"].count()},
        "related": lambda: rows(repo.related(a.q, a.n)), "tests": lambda: dict(zip(("tests", "status"), map(rows, repo.tests(a.q, a.n)), strict=True)), "symbols": lambda: rows(repo.symbols(a.q, a.n)), "search": lambda: rows(repo.search(a.q, a.n)),
        "docs": lambda: rows(repo.docs(a.q, a.n)), "context": lambda: rows(repo.context(a.q)), "callers": lambda: dict(zip(("definitions", "references"), map(rows, repo.callers(a.q)), strict=True)), "hotspots": lambda: rows(repo.hotspots(a.n)),
        "changes": lambda: rows(repo.changes(a.since)), "grep": lambda: dict(zip(("files", "summary"), map(rows, repo.grep(a.q, a.n, a.t, "insensitive" if a.i else "sensitive" if a.s else "smart")), strict=True)),
    }[a.command]()
    if a.command in ("symbols", "search", "callers"):  # what the answer may lack; never mixed into the document
        for r in repo.parse_coverage().collect():
            print(f"quarrylens: {r.rel_path}: {r.status}: {r.detail}", file=sys.stderr)
    if a.human:
        for title, part in got.items() if isinstance(got, dict) else [("", got)]:
            print(title) if title else None
            for r in part if isinstance(part, list) else [part]:
                print("\t".join(str(v) for v in (r.values() if isinstance(r, dict) else [r])))
    else:
        json.dump(got, sys.stdout, indent=2, default=str)
        print()
    return 0


if __name__ == "__main__":
    sys.exit(main())
