"""One repository: scanned, kept as Parquet, and asked."""

from __future__ import annotations

import datetime as dt
import os
import sys

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.paths import since_start
from quarrylens.operators import build, detect, grep, history, lookup, maintain, metrics, related, search, testmap
from quarrylens.sources import gitlog, owners, tree
from quarrylens.sources.store import Store, key_mtimes, staleness


class Repository:
    """Opens a source tree: a stored snapshot that is out of date is brought up to date, a missing one is built."""

    def __init__(self, spark: SparkSession, root: str, cache_dir: str | None = None):
        self.spark, self.root = spark, os.path.abspath(root)
        self.store = Store(spark, cache_dir or os.path.join(self.root, ".quarrylens"))
        self.relations: dict[str, DataFrame] = {}
        if staleness(self.store.meta(), gitlog.facts(self.root)["head"], key_mtimes(self.root)) == "no_data":
            self.rebuild()
        else:
            self.refresh()

    def _scan(self) -> tuple[DataFrame, DataFrame]:
        mine = os.path.relpath(self.store.folder, self.root)
        found = tree.read_tree(self.spark, self.root)
        found = found.where(~F.col("rel_path").startswith(mine + "/")) if not mine.startswith("..") else found
        return tree.files(found), tree.contents(found)

    def _derived(self, files: DataFrame, contents: DataFrame, made: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Relations that depend on several files; always computed anew, so refreshing equals rebuilding."""
        commits, log, about = gitlog.read_log(self.spark, self.root)
        out = build.derived(files, contents, made, commits, owners.read_rules(self.spark, self.root))
        cover = history.trust(history.coverage(commits), about["in_repo"], about["shallow"])
        facts = {"malformed": log.malformed, "outside": log.outside, "window_full": log.scanned >= gitlog.MAX_COMMITS}
        return out | {"coverage": cover.withColumns({k: F.lit(v) for k, v in facts.items()})}

    def _save(self, files: DataFrame, contents: DataFrame, made: dict[str, DataFrame]) -> None:
        head = gitlog.facts(self.root)["head"]
        kept = {k: v for k, v in made.items() if k != "facts"}
        self.store.save({"files": files, "contents": contents, **kept, **self._derived(files, contents, made)}, head=head, key_mtimes=key_mtimes(self.root))
        self.relations = self.store.load() or {}

    def rebuild(self) -> None:
        files, contents = (df.persist() for df in self._scan())
        made = build.by_file(files, contents)
        self._save(files, contents, made)
        for df in (files, contents, made["facts"]):
            df.unpersist()

    def refresh(self) -> None:
        """Extracts only from files that were added or changed; any trouble with the store leads to a rebuild."""
        try:
            stored = self.store.load()
            if stored:
                return self._bring_up(stored)
        except (PySparkException, Py4JError) as e:
            print(f"quarrylens: the snapshot can't be used, building anew: {type(e).__name__}", file=sys.stderr)
        self.rebuild()

    def _bring_up(self, stored: dict[str, DataFrame]) -> None:
        files, contents = (df.persist() for df in self._scan())
        diff = maintain.snapshot_diff(stored["files"], files).persist()
        todo = files.join(diff.where("change <> 'removed'").select("rel_path"), "rel_path", "left_semi")
        new = build.by_file(todo, contents.join(todo.select("rel_path"), "rel_path", "left_semi"))
        made = {}
        for name, df in new.items():
            if name == "facts":
                continue
            key = "file_path" if "file_path" in df.columns else "rel_path"
            made[name] = maintain.replace_keys(stored[name], diff.select(F.col("rel_path").alias(key)), df, key)
        self._save(files, contents, made)
        for df in (files, contents, diff, new["facts"]):
            df.unpersist()

    def __getitem__(self, name: str) -> DataFrame:
        return self.relations[name]

    def _path(self, path: str) -> str:
        return lookup.resolve_path(self["files"], path, self.root) or path

    def overview(self) -> dict[str, DataFrame]:
        return {"languages": metrics.languages(self["files"]), "structure": metrics.top_dirs(self["files"]), "counts": metrics.file_counts(self["files"]), "import_coverage": self.import_coverage(), **detect.detect(self.spark, self["files"], self["contents"])}

    def search(self, query: str, limit: int = 30) -> DataFrame:
        return search.search(self["files"], self["symbols"], self["file_extras"], self["contents"], query, limit)

    def grep(self, pattern: str, max_files: int = 20, type_filter: str | None = None, case: str = "smart") -> tuple[DataFrame, DataFrame]:
        """(matches by file, summary of all)."""
        found = grep.grep(self["files"], self["contents"], self["symbols"], self["file_metrics"], pattern, case, type_filter)
        return grep.by_file(found, max_files), grep.summary(found)

    def related(self, path: str, limit: int = 20) -> DataFrame:
        return related.related(self._path(path), self["files"], self["imports"], self["tests"], self["cochange"], self["file_metrics"], self["owners"].select("rel_path", "owners"), limit)

    def symbols(self, query: str = "", limit: int = 30) -> DataFrame:
        return lookup.symbols(self["symbols"], query, limit)

    def callers(self, name: str) -> tuple[DataFrame, DataFrame]:
        return lookup.definitions(self["symbols"], name), lookup.callers(self["references"], self["symbols"], self["imports"], name)

    def context(self, path: str) -> DataFrame:
        at = self["files"].select("rel_path", "dir").join(self["nearby"], "dir").select("rel_path", "config_type", "config_path")
        return lookup.file_context(self._path(path), self["files"].select("rel_path", "class", "lang", "size"), self["file_extras"], self["file_metrics"], self["owners"].select("rel_path", "owners"), at, self._notes(), self["import_stats"])

    def hotspots(self, n: int = 20) -> DataFrame:
        return metrics.hotspots(self["file_metrics"], n)

    def tests(self, path: str, limit: int = 20) -> tuple[DataFrame, DataFrame]:
        """(tests, status of the test files): the state of the answer comes with it."""
        known = self.spark.createDataFrame([(e,) for e in testmap.MAPPABLE], "ext string")
        return lookup.tests_for(self["tests"], self["files"], self._path(path), limit), lookup.test_status(self["tests"], self["files"], known)

    def changes(self, since: str = "7d", now: dt.datetime | None = None) -> DataFrame:
        start = since_start(since, now or dt.datetime.now(dt.UTC).replace(tzinfo=None))
        when = self["commits"].withColumn("date", F.to_timestamp("date", "yyyy-MM-dd HH:mm:ss Z"))
        return history.recent(when, F.lit(start.replace(tzinfo=dt.UTC)))  # an instant, whatever the session's time zone

    def _notes(self) -> DataFrame:
        return self["notes"].unionByName(self["sidecars"])

    def docs(self, query: str = "", limit: int = 50) -> DataFrame:
        return lookup.docs(self._notes(), query, limit)

    def imports_of(self, path: str) -> DataFrame:
        return lookup.imports_of(self["imports"], self._path(path))

    def imported_by(self, path: str) -> DataFrame:
        return lookup.imported_by(self["imports"], self._path(path))

    def co_changed_with(self, path: str, min_count: int = 1) -> DataFrame:
        return history.neighbours(self["cochange"], self._path(path), min_count)

    def is_test_file(self, path: str) -> bool:
        return not self["files"].where((F.col("rel_path") == self._path(path)) & (F.col("class") == "test")).isEmpty()

    def file_detail(self, path: str) -> DataFrame:
        return self["file_extras"].where(F.col("rel_path") == self._path(path))

    def parse_coverage(self) -> DataFrame:
        return lookup.parse_coverage(self["file_parse"], self["files"])

    def import_coverage(self) -> DataFrame:
        return metrics.import_coverage(self["import_stats"])

    def import_stats_for(self, path: str) -> DataFrame:
        return self["import_stats"].where(F.col("rel_path") == self._path(path))

    def indexed(self, path: str) -> bool:
        return lookup.resolve_path(self["files"], path, self.root) is not None

    def unmapped_tests(self) -> DataFrame:
        return lookup.unmapped_tests(self["tests"], self["files"])

    def high_fan_in(self, percentile: float) -> DataFrame:
        return metrics.high_fan_in(self["file_metrics"], percentile)

    def top_churn(self, n: int) -> DataFrame:
        return history.top_churn(self["churn"], n)
