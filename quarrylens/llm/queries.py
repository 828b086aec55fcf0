"""The corpus operators with their production parameters, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import fingerprint, jaccard, language, licenses, neardup, packing, pieces, pii, quality, warc
from quarrylens.llm.common import scratch_path, table, written


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through whole-file streams and members, each read again at its offset."""
    streams = written(warc.monolithic(table(spark, sf_dir, "pages"), scratch_path(spark, "streams")), "files")
    index = written(warc.normalised(streams, scratch_path(spark, "members")), "index")
    return warc.read_back(index).select("page_id", "url", F.md5(F.encode("html", "UTF-8")).alias("html_md5"), F.octet_length("html").cast("long").alias("html_bytes"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identified(docs, language.fit(docs))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.findings(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_neardup": op1_embedding_neardup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_warc": op3_warc,
    "op4_license_scan": op4_license_scan,
    "op5_language_id": op5_language_id,
    "op6_pieces": op6_pieces,
    "op7_fingerprints": op7_fingerprints,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_pii": op10_pii,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_neardup": neardup.ORACLE,
    "op2_jaccard_join": jaccard.ORACLE,
    "op3_warc": "select page_id, url, md5(html) as html_md5, cast(octet_length(encode(html)) as bigint) as html_bytes from pages",
}
