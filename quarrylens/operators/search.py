"""Ranked search over symbols, paths, previews and contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.paths import all_tokens_in, base_of, stem_of, trimmed

CLASSES = ("source", "test", "config")
TEST_WORDS = {"test", "tests", "testing", "spec", "specs"}
DEMOTION = 0.85


def _first_line(text, query: str):
    """First line that holds all tokens, else the first line."""
    lines = F.split(text, "\n", -1)
    own = F.filter(lines, lambda line: all_tokens_in(line, query))
    return F.substring(trimmed(F.coalesce(F.try_element_at(own, F.lit(1)), F.element_at(lines, 1))), 1, 200)


def search(files: DataFrame, symbols: DataFrame, previews: DataFrame, contents: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """rel_path, score, tier, context: one row for each file, best first.

    Tiers are symbols (1.0 exact, 0.9 prefix, 0.7), paths (0.6 in the name, else 0.4), previews (0.3)
    and contents of files that no other tier matched (0.2). A file's score is the sum up to 1; the
    match shown is the heaviest, of the earliest tier. Tests give way to other files unless the query
    asks for tests or names the file exactly.
    """
    q, tokens = query.lower(), query.lower().split()
    classes = files.select("rel_path", "class")
    name = F.lower("name")
    exact = name == q
    # a query of blanks has no tokens: it matches every path and text but no symbol
    of_symbols = symbols.where(all_tokens_in(F.col("name"), query) if tokens else F.lit(False)).select(
        F.col("file_path").alias("rel_path"), F.when(exact, 1.0).when(name.startswith(q), 0.9).otherwise(0.7).alias("w"), F.lit(0).alias("tier"), F.col("line").cast("long").alias("seq"), F.col("signature").alias("context"), exact.alias("exact")
    )
    path = F.col("rel_path")
    own = classes.where(F.col("class").isin(*CLASSES) & all_tokens_in(path, query))
    of_paths = own.select("rel_path", F.when(F.lower(base_of(path)).contains(q), 0.6).otherwise(0.4).alias("w"), F.lit(1).alias("tier"), F.lit(0).cast("long").alias("seq"), path.alias("context"), (F.lower(stem_of(path)) == q).alias("exact"))
    of_previews = previews.where(all_tokens_in(F.col("preview"), query)).join(classes.where("class = 'source'").select("rel_path"), "rel_path", "left_semi").select(
        "rel_path", F.lit(0.3).alias("w"), F.lit(2).alias("tier"), F.lit(0).cast("long").alias("seq"), _first_line(F.col("preview"), query).alias("context"), F.lit(False).alias("exact")
    )
    named = of_symbols.unionByName(of_paths).unionByName(of_previews)
    # the content tier carries the context only: it never meets the other tiers' rows
    held = contents.where(all_tokens_in(F.col("content"), query)).join(classes.where(F.col("class").isin(*CLASSES)).select("rel_path"), "rel_path", "left_semi")
    of_contents = held.select("rel_path", F.lit(0.2).alias("w"), F.lit(3).alias("tier"), F.lit(0).cast("long").alias("seq"), _first_line(F.col("content"), query).alias("context"), F.lit(False).alias("exact"))
    found = named.unionByName(of_contents)
    # one aggregation does what an anti-join on the other tiers would: content counts where it is alone
    best = F.max_by(F.struct("tier", "context"), F.struct(F.col("w"), -F.col("tier"), -F.col("seq")))
    scored = found.groupBy("rel_path").agg(F.sum(F.when(F.col("tier") < 3, F.col("w"))).alias("s"), best.alias("b"), F.bool_or("exact").alias("exact"))
    scored = scored.join(classes, "rel_path").select("rel_path", "class", F.least(F.lit(1.0), F.coalesce("s", F.lit(0.2))).alias("score"), "b.tier", "b.context", "exact")
    if not TEST_WORDS & set(tokens):
        other = scored.agg(F.coalesce(F.bool_or(F.col("class") != "test"), F.lit(False)).alias("other"))
        down = (F.col("class") == "test") & F.col("other") & ~F.col("exact")
        scored = scored.crossJoin(F.broadcast(other)).withColumn("score", F.when(down, F.col("score") * DEMOTION).otherwise(F.col("score")))
    tiers = F.array(*map(F.lit, ("symbol", "file_path", "preview", "content")))
    return scored.select("rel_path", F.round("score", 9).alias("score"), F.element_at(tiers, F.col("tier") + 1).alias("tier"), "context").orderBy(F.desc("score"), "rel_path").limit(limit)
