"""Point, prefix and name lookups over the relations."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.paths import dir_of, under

PARSED_CLASSES = ("source", "test", "script")


def _limited(df: DataFrame, limit: int) -> DataFrame:
    return df if limit < 0 else df.limit(limit)


def symbols(table: DataFrame, query: str = "", limit: int = 30) -> DataFrame:
    """All, those of one file ("file:<path>"), or those whose name holds the query, ignoring case."""
    if query.startswith("file:"):
        table = table.where(F.col("file_path") == query[5:])
    elif query:
        table = table.where(F.lower("name").contains(query.lower()))
    return _limited(table.orderBy("file_path", "line", "name", "kind"), limit)


def docs(table: DataFrame, query: str = "", limit: int = 50) -> DataFrame:
    """Notes of a file, of a symbol (exact), or whose symbol or file holds the query."""
    if query.startswith("file:"):
        table = table.where(F.col("file_path") == query[5:])
    elif query.startswith("symbol:"):
        table = table.where(F.col("symbol") == query[7:])
    elif query:
        table = table.where(F.lower("symbol").contains(query.lower()) | F.lower("file_path").contains(query.lower()))
    return _limited(table.orderBy("file_path", "line", "symbol"), limit)


def definitions(table: DataFrame, name: str) -> DataFrame:
    return table.where(F.col("name") == name).orderBy("file_path", "line", "kind")


def callers(references: DataFrame, table: DataFrame, imports: DataFrame, name: str) -> DataFrame:
    """Every reference of a name, and whether a definition is in its file, its directory or a file it imports.

    References are a bag and stay one: the three tests are joins against distinct keys.
    """
    defs = table.where(F.col("name") == name).select(F.col("file_path").alias("def")).distinct()
    refs = references.where(F.col("name") == name)
    files = defs.select(F.col("def").alias("file_path"), F.lit(True).alias("in_file"))
    dirs = defs.select(dir_of(F.col("def")).alias("d")).distinct().withColumn("in_dir", F.lit(True))
    over = imports.join(defs, F.col("target_path") == F.col("def"), "left_semi").select(F.col("source_path").alias("file_path")).distinct().withColumn("by_import", F.lit(True))
    got = refs.withColumn("d", dir_of(F.col("file_path"))).join(files, "file_path", "left").join(dirs, "d", "left").join(over, "file_path", "left")
    return got.select("name", "file_path", "line", F.coalesce("in_file", "in_dir", "by_import", F.lit(False)).alias("resolved")).orderBy("file_path", "line", "name")


def imports_of(imports: DataFrame, path: str) -> DataFrame:
    return imports.where(F.col("source_path") == path).select("target_path").orderBy("target_path")


def imported_by(imports: DataFrame, path: str) -> DataFrame:
    return imports.where(F.col("target_path") == path).select("source_path").orderBy("source_path")


def tests_for(tests: DataFrame, files: DataFrame, path: str, limit: int = 20) -> DataFrame:
    """Tests of a source; the subject of a test; or the tests of all sources below a directory.

    tests is (test_path, source_path, kind); the result's `relation` says which of the three it is.
    """
    direct = tests.where(F.col("source_path") == path).select(F.col("test_path").alias("rel_path"), "kind", F.lit("test").alias("relation"))
    subject = tests.where((F.col("test_path") == path) & (F.col("source_path") != "")).select(F.col("source_path").alias("rel_path"), "kind", F.lit("subject").alias("relation"))
    inside = files.where(under(F.col("rel_path"), path) & (F.col("class") == "source") & (F.col("rel_path") != path)).select(F.col("rel_path").alias("source_path"))
    below = tests.join(inside, "source_path", "left_semi").select(F.col("test_path").alias("rel_path"), "kind", F.lit("test").alias("relation"))
    return _limited(direct.unionByName(subject).unionByName(below).distinct().orderBy("relation", "rel_path", "kind"), limit)


def test_status(mapped: DataFrame, files: DataFrame, mappable: DataFrame) -> DataFrame:
    """test_path, status of every test file: mapped, no_match, or unsupported for its extension."""
    own = files.where("class = 'test'").select(F.col("rel_path").alias("test_path"), F.regexp_extract("rel_path", r"\.([^./]*)$", 1).alias("ext"))
    hit = mapped.where("source_path <> ''").select("test_path", F.lit(1).alias("m")).distinct()
    known = mappable.select("ext", F.lit(1).alias("k")).distinct()
    status = F.when(F.col("m").isNotNull(), "mapped").when(F.col("k").isNotNull(), "no_match").otherwise("unsupported")
    return own.join(hit, "test_path", "left").join(F.broadcast(known), "ext", "left").select("test_path", status.alias("status"))


def unmapped_tests(tests: DataFrame, files: DataFrame) -> DataFrame:
    hit = tests.where("source_path <> ''").select(F.col("test_path").alias("rel_path"))
    return files.where("class = 'test'").join(hit, "rel_path", "left_anti").select("rel_path").orderBy("rel_path")


def parse_coverage(parses: DataFrame, files: DataFrame) -> DataFrame:
    """Files that weren't parsed cleanly, and those for which there is no record at all."""
    bad = parses.where("status <> 'ok'").select("rel_path", "lang", "extractor", "status", "symbol_count", "detail")
    none = files.where(F.col("class").isin(*PARSED_CLASSES)).join(parses.select("rel_path"), "rel_path", "left_anti")
    unknown = none.select("rel_path", "lang", F.lit("").alias("extractor"), F.lit("unknown").alias("status"), F.lit(0).alias("symbol_count"), F.lit("no record").alias("detail"))
    return bad.unionByName(unknown).orderBy("rel_path")


def file_context(path: str, files: DataFrame, extras: DataFrame, metrics: DataFrame, owners: DataFrame, nearby: DataFrame, notes: DataFrame, stats: DataFrame) -> DataFrame:
    """One row that gathers what is known of a file; an unknown one has status not_indexed."""
    want = files.sparkSession.createDataFrame([(path,)], "rel_path string")
    own = lambda df, key="rel_path": df.where(F.col(key) == path)
    configs = own(nearby).groupBy("rel_path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("config_type", "config_path")))).alias("configs"))
    docs_ = own(notes, "file_path").groupBy(F.col("file_path").alias("rel_path")).agg(F.array_sort(F.collect_list(F.struct("line", "symbol", "body"))).alias("docs"))
    out = want.join(own(files).select("rel_path", "class", "lang", "size", F.lit("indexed").alias("status")), "rel_path", "left")
    for part in (own(extras), own(metrics), own(owners), configs, docs_, own(stats).drop("lang")):
        out = out.join(part, "rel_path", "left")
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("fan_in", "fan_out", "churn", "extracted", "resolved", "external", "unresolved", "size")}
    text = {c: F.coalesce(c, F.lit("")).alias(c) for c in ("class", "lang", "preview", "content_hash")}
    return out.select(*[zero.get(c) if c in zero else text.get(c) if c in text else F.coalesce(c, F.lit("not_indexed")).alias(c) if c == "status" else F.coalesce(c, F.lit(0.0)).alias(c) if c == "hotspot_score" else F.col(c) for c in out.columns])


def path_candidates(path: str, root: str = "") -> list[str]:
    """Spellings of a path that are tried in order; one that leaves the root gives none."""
    out: list[str] = []
    for form in (path, path.replace("\\", "/")):
        for p in (form, posixpath.normpath(form) if form else form):
            if root and p.startswith(root.rstrip("/") + "/"):
                p = p[len(root.rstrip("/")) + 1 :]
            p = p.removeprefix("./")
            if p and not p.startswith(("/", "../")) and p != ".." and p not in out:
                out.append(p)
    return out


def resolve_paths(files: DataFrame, asked: DataFrame, root: str = "") -> DataFrame:
    """asked(path) with the indexed path that each means, null where there is none."""
    forms = F.udf(lambda p: path_candidates(p, root), "array<string>", useArrow=True)
    tries = asked.select("path").distinct().select("path", F.posexplode(forms("path")).alias("o", "rel_path"))
    hit = tries.join(files.select("rel_path"), "rel_path").groupBy("path").agg(F.min_by("rel_path", "o").alias("rel_path"))
    return asked.join(hit, "path", "left").select("path", "rel_path")


def resolve_path(files: DataFrame, path: str, root: str = "") -> str | None:
    """The first candidate that is indexed."""
    forms = path_candidates(path, root)
    have = {r[0] for r in files.where(F.col("rel_path").isin(forms)).select("rel_path").collect()} if forms else set()
    return next((f for f in forms if f in have), None)
