"""Line search with classified, enriched, grouped and collapsed matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.paths import matcher, matches, trimmed, whole_text_form

CLASSES = ("source", "test", "config")
MAX_BYTES = 1 << 20
TEXT_CHARS = 200
COMMENT = r"^(//|/\*|#|\* |@doc|@moduledoc|@spec)"
TYPES = ("definition", "reference", "comment", "test")


def _line_array() -> Column:
    return F.split(F.regexp_replace("content", r"\n\z", ""), "\n", -1)


def lines(contents: DataFrame) -> DataFrame:
    """rel_path, line (from 1) and text of contents(rel_path, content); a final line end opens no line."""
    return contents.where("content <> ''").select("rel_path", F.posexplode(_line_array()).alias("line", "text")).withColumn("line", F.col("line").cast("long") + 1)


def hits(files: DataFrame, contents: DataFrame, pattern: str, case: str = "smart") -> DataFrame:
    """Matching lines of eligible files; other files go first, and whole texts are tested before they are split."""
    kind, form, sensitive = matcher(pattern, case)
    fit = files.where(F.col("class").isin(*CLASSES) & F.col("size").between(1, MAX_BYTES)).select("rel_path", "class")
    texts = contents.where(~F.substring("content", 1, 512).contains("\0"))
    if kind == "literal":
        texts = texts.where(F.col("content").contains(form) if sensitive else F.lower("content").contains(form.lower()))
    elif whole := whole_text_form(pattern, sensitive):
        texts = texts.where(F.col("content").rlike(whole))
    split = F.posexplode(_line_array()).alias("line", "text")
    rows = texts.where("content <> ''").join(fit, "rel_path").select("rel_path", "class", split).withColumn("line", F.col("line").cast("long") + 1)
    return rows.where(matches(F.col("text"), pattern, case))


def grep(files: DataFrame, contents: DataFrame, symbols: DataFrame, metrics: DataFrame, pattern: str, case: str = "smart", type_filter: str | None = None) -> DataFrame:
    """rel_path, line, text, type, symbol, hotspot_score of every match."""
    if type_filter and type_filter not in TYPES:
        raise ValueError(f"unknown type {type_filter}")
    defs = symbols.groupBy(F.col("file_path").alias("rel_path"), "line").agg(F.min("name").alias("symbol"))
    found = hits(files, contents, pattern, case).join(defs, ["rel_path", "line"], "left").join(metrics.select("rel_path", "hotspot_score"), "rel_path", "left")
    text = trimmed(F.col("text"))
    kind = F.when(F.col("symbol").isNotNull(), "definition").when(text.rlike(COMMENT), "comment").when(F.col("class") == "test", "test").otherwise("reference")
    out = found.select("rel_path", "line", F.substring(text, 1, TEXT_CHARS).alias("text"), kind.alias("type"), F.coalesce("symbol", F.lit("")).alias("symbol"), F.coalesce("hotspot_score", F.lit(0.0)).alias("hotspot_score"))
    return out.where(F.col("type") == type_filter) if type_filter else out


def summary(found: DataFrame) -> DataFrame:
    """Counts over all matches, before any limit."""
    return found.agg(F.count("*").alias("total"), *[F.count_if(F.col("type") == t).alias(t + "s") for t in TYPES], F.countDistinct("rel_path").alias("files"))


def collapsed(found: DataFrame) -> DataFrame:
    """Equal (text, type) of a file as one row: its first line and how many others there are."""
    return found.groupBy("rel_path", "text", "type", "hotspot_score").agg(F.min("line").alias("line"), (F.count("*") - 1).alias("similar"))


def by_file(found: DataFrame, max_files: int = 20) -> DataFrame:
    """The first files in match order, with their collapsed matches; `truncated` files are left out."""
    first = F.struct((F.col("type") != "definition").alias("later"), (-F.col("hotspot_score")).alias("cold"), "rel_path", "line")
    rows = collapsed(found)
    items = F.array_sort(F.collect_list(F.struct("line", "text", "type", "similar")))
    files = rows.groupBy("rel_path").agg(F.min(first).alias("o"), items.alias("matches"))
    total = files.agg(F.count("*").alias("n"))
    kept = files.orderBy("o").limit(max_files).crossJoin(F.broadcast(total))
    rank = F.row_number().over(Window.orderBy("o"))  # over max_files rows
    return kept.select(rank.alias("rank"), "rel_path", "matches", F.greatest(F.col("n") - max_files, F.lit(0)).alias("truncated"))
