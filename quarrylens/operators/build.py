"""All relations of a project, from its files, texts, commits and ownership rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.paths import dir_of
from quarrylens.operators import extract, history, metrics, nearest, resolve, testmap

MANIFESTS = r"(^|/)(go\.mod|[tj]sconfig\.json|composer\.json|pubspec\.yaml)$"


def by_file(files: DataFrame, contents: DataFrame) -> dict[str, DataFrame]:
    """Relations that are made file by file, by one pass over the texts; the caller persists `facts`."""
    found = extract.facts(files, contents).persist()
    return {"facts": found, **extract.relations(found), "file_extras": extract.extras(files, contents)}


def context(files: DataFrame, contents: DataFrame | None) -> resolve.Context:
    """What manifests say about paths: of module files all, of Python packages the roots alone."""
    found = files.where(F.col("rel_path").rlike(MANIFESTS) & (F.col("class") != "vendor"))
    texts = (found if contents is None else found.select("rel_path").join(contents, "rel_path")).select("rel_path", "content").where("content is not null").collect()
    packages = files.where("rel_path like '%__init__.py'").select(dir_of(F.col("rel_path")).alias("dir")).distinct()
    roots = packages.withColumn("up", dir_of(F.col("dir"))).join(packages.select(F.col("dir").alias("up")), "up", "left_anti")
    return resolve.context_of({r["rel_path"]: r["content"] for r in texts}, [r["dir"] for r in roots.select("dir").collect()])


def derived(files: DataFrame, contents: DataFrame, made: dict[str, DataFrame], commits: DataFrame, rules: DataFrame) -> dict[str, DataFrame]:
    """Relations that depend on several files."""
    imports, fates = resolve.resolve(made["specs"], resolve.key_table(files, None, made["keys"]), context(files, contents))
    touched = history.commit_files(commits)
    churn = history.churn(touched)
    dirs = files.where("class = 'source'").select("dir").distinct()
    return {
        "imports": imports, "import_stats": metrics.import_stats(fates), "tests": testmap.tests(files, imports), "commits": commits, "churn": churn, "cochange": history.cochange(touched), "file_metrics": metrics.file_metrics(imports, churn),
        "owners": nearest.owners(files, rules), "nearby": nearest.nearest_configs(dirs, nearest.config_files(files)), "sidecars": extract.sidecars(files, contents),
    }
