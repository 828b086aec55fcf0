"""Ownership rules from the first file that has any."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

PLACES = (".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS")


def parse(text: str) -> list[tuple[int, str, list[str]]]:
    """(line, pattern, owners); a rule without owners is no rule."""
    out = []
    for i, line in enumerate(text.splitlines(), 1):
        parts = line.split("#", 1)[0].split() if line.lstrip().startswith("#") else line.split()
        parts = parts[: next((k for k, p in enumerate(parts) if p.startswith("#")), len(parts))]
        if len(parts) > 1:
            out.append((i, parts[0], parts[1:]))
    return out


def read_rules(spark: SparkSession, root: str) -> DataFrame:
    rows: list = []
    for place in PLACES:
        try:
            with open(os.path.join(root, place), encoding="utf-8", errors="replace") as f:
                rows = parse(f.read())
        except OSError:
            continue
        if rows:
            break
    return spark.createDataFrame(rows, "priority int, pattern string, owners array<string>")
