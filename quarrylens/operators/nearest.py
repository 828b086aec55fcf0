"""Nearest, last and longest matches as equi-joins with an aggregate, never nested loops over files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.paths import dir_of

#: Rules of an ownership file come from one file that people write; beyond this they aren't broadcast.
BROADCAST_RULES = 100_000


def owner_regex(pattern: str) -> str:
    """Regular expression of an ownership pattern.

    A lone star matches everything. A pattern that ends in a slash is a prefix from the root. One with
    another slash is anchored; others match a name anywhere. A star never crosses a slash, except `**`.
    """
    if pattern in ("*", "/*", "**"):
        return ".*" if pattern != "/*" else "^[^/]*$"
    body = pattern.removeprefix("/")
    if body.endswith("/"):
        return "^" + re.escape(body)
    anchored = "/" in body or pattern.startswith("/")
    form = re.escape(body).replace(r"\*\*/", "(?:.+/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    tail = "$" if body.endswith("*") else "(?:/.*)?$"
    return ("^" if anchored else "(?:^|/)") + form + tail


def owners(files: DataFrame, rules: DataFrame) -> DataFrame:
    """rel_path, owners, pattern of the last rule that matches; rules is (priority, pattern, owners).

    The rules are collected to be compiled (they are lines of one file, and their number is checked) and
    tested from the last to the first inside one projection: no join, no shuffle.
    """
    rows = sorted(rules.collect(), key=lambda r: -r["priority"])
    if len(rows) > BROADCAST_RULES:
        raise ValueError("too many ownership rules")
    made = files.sparkSession.createDataFrame([(i, r["pattern"], list(r["owners"]), owner_regex(r["pattern"])) for i, r in enumerate(rows)], "i int, pattern string, owners array<string>, re string")
    if not rows:
        return files.limit(0).select("rel_path").crossJoin(made.select("owners", "pattern"))
    pick = None
    if len(rows) <= 200:
        for i, r in enumerate(rows):
            cond = F.col("rel_path").rlike(owner_regex(r["pattern"]))
            pick = F.when(cond, i) if pick is None else pick.when(cond, i)
        return files.select("rel_path", pick.alias("i")).where("i is not null").join(F.broadcast(made), "i").select("rel_path", "owners", "pattern")
    hits = files.select("rel_path").join(F.broadcast(made), F.expr("rel_path rlike re"))
    return hits.groupBy("rel_path").agg(F.min_by(F.struct("owners", "pattern"), "i").alias("r")).select("rel_path", "r.owners", "r.pattern")


def ancestors(df: DataFrame, path_col: str = "dir") -> DataFrame:
    """Adds every ancestor of a directory, itself and the root "" among them, with its depth."""
    parts = F.when(F.col(path_col) == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(path_col, "/"))
    walked = df.withColumn("_p", parts).select("*", F.explode(F.sequence(F.lit(0), F.size("_p"))).alias("depth"))
    return walked.withColumn("ancestor", F.array_join(F.slice("_p", 1, F.col("depth")), "/")).drop("_p")


def nearest_configs(dirs: DataFrame, configs: DataFrame) -> DataFrame:
    """dir, config_type, config_path: the nearest on the way up; configs is (config_dir, config_type, config_path)."""
    best = configs.groupBy("config_dir", "config_type").agg(F.min("config_path").alias("config_path"))
    met = ancestors(dirs.select("dir").distinct()).join(best, F.col("ancestor") == F.col("config_dir"))
    return met.groupBy("dir", "config_type").agg(F.max_by("config_path", "depth").alias("config_path"))


CONFIG_TYPES = {
    "package_manifest": r"^(package\.json|go\.mod|cargo\.toml|pyproject\.toml|pom\.xml|build\.gradle(\.kts)?|gemfile|composer\.json|pubspec\.yaml|mix\.exs|build\.sbt|package\.swift)$|\.(csproj|fsproj)$",
    "dockerfile": r"^(dockerfile.*|docker-compose.*\.ya?ml)$", "ci": r"^(\.gitlab-ci\.yml|\.travis\.yml|jenkinsfile|azure-pipelines\.yml)$", "makefile": r"^(makefile|justfile|rakefile|taskfile\.ya?ml)$",
    "readme": r"^readme(\..*)?$", "env": r"^\.env(\..*)?$", "lint": r"^(\.eslintrc.*|\.golangci\.ya?ml|\.prettierrc.*|\.rubocop\.yml|ruff\.toml|\.flake8|\.pylintrc|eslint\.config\..*)$", "tsconfig": r"^(ts|js)config(\..*)?\.json$",
}


def config_files(files: DataFrame) -> DataFrame:
    """config_dir, config_type, config_path; workflow folders count for the directory that holds them."""
    name, d = F.lower(F.substring_index("rel_path", "/", -1)), dir_of(F.col("rel_path"))
    kind = F.lit(None).cast("string")
    for k, form in reversed(CONFIG_TYPES.items()):
        kind = F.when(name.rlike(form), k).otherwise(kind)
    flow = r"^(.*?)/?(\.github/workflows|\.circleci)$"
    kind = F.when(d.rlike(flow), "ci").otherwise(kind)
    return files.select(F.when(d.rlike(flow), F.regexp_extract(d, flow, 1)).otherwise(d).alias("config_dir"), kind.alias("config_type"), F.col("rel_path").alias("config_path")).where("config_type is not null")


def longest_prefix(specs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """spec, prefix: the longest prefix (whole segments) of each specifier, by exploding its own prefixes."""
    own = ancestors(specs.select("spec").distinct(), "spec").where("ancestor <> ''")
    return own.join(prefixes.select("prefix").distinct(), F.col("ancestor") == F.col("prefix")).groupBy("spec").agg(F.max_by("prefix", "depth").alias("prefix"))


def following(notes: DataFrame, symbols: DataFrame, reach: int = 10) -> DataFrame:
    """Notes (file_path, end_line, body) with the first symbol at most `reach` lines below.

    The interval is cut in slots of `reach` lines: a note looks in its slot and the next, so the join is
    on (file, slot) and the range is a residual condition.
    """
    slot = F.floor(F.col("line") / reach)
    defs = symbols.select("file_path", F.col("line").alias("symbol_line"), "name", slot.alias("slot"))
    asks = notes.withColumn("slot", F.explode(F.sequence(F.floor((F.col("end_line") + 1) / reach), F.floor((F.col("end_line") + reach) / reach))))
    met = asks.join(defs, ["file_path", "slot"]).where(F.col("symbol_line").between(F.col("end_line") + 1, F.col("end_line") + reach))
    first = met.groupBy("file_path", "end_line").agg(F.min(F.struct("symbol_line", "name")).alias("s"))
    return notes.join(first, ["file_path", "end_line"], "left").select("file_path", "end_line", "body", F.coalesce("s.name", F.lit("")).alias("symbol"), F.coalesce("s.symbol_line", F.lit(0)).alias("line"))
