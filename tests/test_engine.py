import json
import subprocess

import pytest

from quarrylens.engine import Repository
from quarrylens.sources.store import Store, staleness
from quarrylens.streaming import upkeep

TREE = {
    "go.mod": "module ex.com/a\nrequire github.com/gin-gonic/gin v1.9.0\n", "main.go": 'package main\nimport "ex.com/a/util"\nfunc main() { util.Help() }\n', "util/help.go": "package util\n// @context: careful\nfunc Help() {}\n",
    "util/help_test.go": "package util\nfunc TestHelp() { Help() }\n", "app/_core.py": "from app import thing\ndef run(): return thing.go()\n", "app/__init__.py": "", "app/thing.py": "def go():\n    return 1\n", ".github/CODEOWNERS": "* @all\n", ".gitignore": "*.log\n.quarrylens/\n", "a.log": "x", "app/.context/thing.md": "about thing",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory, spark):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    for args in (["init"], ["add", "."], ["commit", "-m", "one"]):
        subprocess.run(["git", "-C", root, "-c", "user.email=a@b.c", "-c", "user.name=n", *args], check=True, capture_output=True)
    return Repository(spark, str(root), str(tmp_path_factory.mktemp("cache")))


def test_questions(repo):
    paths = {r.rel_path for r in repo["files"].collect()}
    assert {"app/_core.py", ".github/CODEOWNERS", "app/.context/thing.md"} <= paths
    assert "a.log" not in paths
    assert [r.target_path for r in repo.imports_of("main.go").collect()] == ["util/help.go"]
    assert [r.rel_path for r in repo.tests("./util/help.go")[0].collect()] == ["util/help_test.go"]
    assert repo.is_test_file("util/help_test.go")
    assert repo.search("help").first().rel_path == "util/help.go"
    assert repo.related("util/help.go").first().rel_path in ("util/help_test.go", "main.go")
    assert repo.context("util/help.go").first().status == "indexed"
    assert repo.context("nope").first().status == "not_indexed"
    assert {r.symbol for r in repo.docs("help").collect()} == {"Help"}
    assert {r.source for r in repo.docs("file:app/thing.py").collect()} == {"sidecar"}
    assert [r.name for r in repo.overview()["frameworks"].collect()] == ["Gin"]
    assert repo.callers("go")[1].first().resolved


def test_refresh_equals_rebuild(repo):
    with open(f"{repo.root}/util/more.go", "w") as f:
        f.write("package util\nfunc More() { Help() }\n")
    with open(f"{repo.root}/app/thing.py", "a") as f:
        f.write("def late(): pass\n")
    keys = ("symbols", "references", "imports", "tests", "file_metrics", "file_parse", "notes")
    repo.refresh()
    got = {k: sorted(map(str, repo[k].select(sorted(repo[k].columns)).collect())) for k in keys}
    repo.rebuild()
    assert got == {k: sorted(map(str, repo[k].select(sorted(repo[k].columns)).collect())) for k in keys}
    assert any("late" in s for s in got["symbols"])


def test_store_versions(tmp_path, spark):
    s = Store(spark, str(tmp_path / "s"))
    assert s.load() is None
    s.save({"x": spark.range(3).toDF("a")}, head="h", key_mtimes={})
    assert s.load()["x"].count() == 3
    assert staleness(s.meta(), "h", {}) == "not_stale"
    assert staleness(s.meta(), "i", {}) == "head_changed"
    assert staleness(s.meta(), "h", {"go.mod": 1}) == "key_file_changed"
    at = next((tmp_path / "s").glob("current-*.json"))
    (tmp_path / "s" / "current-000000000009.json").write_text(json.dumps(json.loads(at.read_text()) | {"logic": 99}))
    assert s.load() is None
    assert staleness(s.meta(), "h", {}) == "no_data"


def test_stream_counts_a_commit_once(tmp_path, spark):
    src = str(tmp_path / "in")
    rows = "select '1' as hash, timestamp'2024-01-01 10:00:00' as date, array('a', 'b') as files union all select '1', timestamp'2024-01-01 10:00:00', array('a', 'b') union all select '2', timestamp'2024-01-01 11:00:00', array('a') union all select '3', timestamp'2024-01-09 00:00:00', array('z')"
    spark.sql(rows).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("hash string, date timestamp, files array<string>").parquet(src)
    upkeep.keep(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = upkeep.total(spark.read.parquet(str(tmp_path / "out")))
    assert {r.file_path: r.commits for r in got.collect()} == {"a": 2, "b": 1}
