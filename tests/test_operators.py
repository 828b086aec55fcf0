from pyspark.sql import functions as F

from quarrylens.operators import grep, history, lookup, maintain, metrics, nearest, related, search


def rows(df):
    return [tuple(r) for r in df.collect()]


def commit_files(spark, data):
    return spark.createDataFrame([(h, f) for h, fs in data.items() for f in fs], "hash string, file string")


def test_cochange_bound_keeps_churn(spark):
    files = commit_files(spark, {"1": ["a", "b", "c"], "2": ["a", "b"], "3": ["c"]})
    assert sorted(rows(history.churn(files))) == [("a", 2), ("b", 2), ("c", 2)]
    assert sorted(rows(history.cochange(files, 2))) == [("a", "b", 1)]
    assert sorted(rows(history.cochange(files, -1))) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]
    assert rows(history.neighbours(history.cochange(files), "b", 2)) == [("a", 2)]
    assert rows(history.top_churn(history.churn(files), 1)) == [("a", 2)]


def test_trust_reasons(spark):
    schema = "hash string, files array<string>, is_root boolean"
    none = history.trust(history.coverage(spark.createDataFrame([], schema)))
    assert none.first()["reason"] == "no commits"
    root = history.trust(history.coverage(spark.createDataFrame([("1", ["a"], True)], schema)))
    assert not root.first()["trustworthy"]
    fine = history.coverage(spark.createDataFrame([("1", ["a"], True), ("2", ["b"], False)], schema))
    assert history.trust(fine).first()["trustworthy"]
    assert history.trust(fine, shallow=True).first()["reason"] == "shallow history"


def test_hotspots_guard_division(spark):
    imports = spark.createDataFrame([("a", "b"), ("c", "b"), ("a", "c")], "source_path string, target_path string")
    churn = spark.createDataFrame([("b", 3), ("c", 1), ("z", 9)], "file_path string, commits long")
    got = metrics.file_metrics(imports, churn)
    assert {r.rel_path: (r.fan_in, r.fan_out, r.churn, round(r.hotspot_score, 3)) for r in got.collect()} == {"a": (0, 2, 0, 0.0), "b": (2, 0, 3, 1.0), "c": (1, 1, 1, 0.167), "z": (0, 0, 9, 0.0)}
    assert [r.rel_path for r in metrics.hotspots(got).collect()] == ["b", "c"]
    assert [r.rel_path for r in metrics.high_fan_in(got, 1.0).collect()] == ["b"]
    calm = metrics.file_metrics(imports, churn.limit(0))
    assert {r.hotspot_score for r in calm.collect()} == {0.0}


def grep_inputs(spark):
    files = spark.createDataFrame([("a.py", "source", 30), ("test_a.py", "test", 30), ("x.md", "doc", 9), ("big.py", "source", 2 << 20)], "rel_path string, class string, size long")
    contents = spark.createDataFrame([("a.py", "def Foo():\n# Foo\nFoo()\nFoo()\n"), ("test_a.py", "  Foo()\n"), ("x.md", "Foo"), ("big.py", "Foo")], "rel_path string, content string")
    symbols = spark.createDataFrame([("a.py", "Foo", 1)], "file_path string, name string, line int")
    scores = spark.createDataFrame([("a.py", 0.5)], "rel_path string, hotspot_score double")
    return files, contents, symbols, scores


def test_grep_types_and_collapse(spark):
    found = grep.grep(*grep_inputs(spark), "Foo")
    assert sorted((r.rel_path, r.line, r.type) for r in found.collect()) == [("a.py", 1, "definition"), ("a.py", 2, "comment"), ("a.py", 3, "reference"), ("a.py", 4, "reference"), ("test_a.py", 1, "test")]
    assert tuple(grep.summary(found).first()) == (5, 1, 2, 1, 1, 2)
    assert ("Foo()", "reference", 3, 1) in [(r.text, r.type, r.line, r.similar) for r in grep.collapsed(found).collect()]
    first = grep.by_file(found, 1).collect()
    assert [(r.rel_path, r.truncated) for r in first] == [("a.py", 1)]
    assert grep.grep(*grep_inputs(spark), "foo", "sensitive").count() == 0
    assert grep.grep(*grep_inputs(spark), r"^Foo\(\)$").count() == 2


def test_lines_drop_the_last_empty_one(spark):
    df = spark.createDataFrame([("a", "x\n\ny\r\n"), ("b", "")], "rel_path string, content string")
    assert sorted(rows(grep.lines(df))) == [("a", 1, "x"), ("a", 2, ""), ("a", 3, "y\r")]


def test_search_puts_code_above_its_tests(spark):
    files = spark.createDataFrame([("a/cart.py", "source"), ("a/test_shop.py", "test"), ("b.py", "source")], "rel_path string, class string")
    symbols = spark.createDataFrame([("a/cart.py", "Cart", "class", 1, "class Cart"), ("a/test_shop.py", "test_cart", "function", 2, "def test_cart")], "file_path string, name string, kind string, line int, signature string")
    previews = spark.createDataFrame([("b.py", "uses cart")], "rel_path string, preview string")
    contents = spark.createDataFrame([("b.py", "zz\nuses cart\n"), ("a/cart.py", "cart")], "rel_path string, content string")
    got = search.search(files, symbols, previews, contents, "cart").collect()
    assert [(r.rel_path, r.score, r.tier) for r in got] == [("a/cart.py", 1.0, "symbol"), ("a/test_shop.py", 0.595, "symbol"), ("b.py", 0.3, "preview")]
    asked = search.search(files, symbols, previews, contents, "test cart").collect()
    assert asked[0].rel_path == "a/test_shop.py"


def test_related_adds_signals(spark):
    files = spark.createDataFrame([("p/a.py",), ("p/b.py",), ("p/test_a.py",), ("q/r/a.py",), ("x.py",)], "rel_path string")
    imports = spark.createDataFrame([("p/a.py", "p/b.py"), ("p/a.py", "gone.py")], "source_path string, target_path string")
    tests = spark.createDataFrame([("p/test_a.py", "p/a.py", "unit")], "test_path string, source_path string, kind string")
    pairs = spark.createDataFrame([("p/a.py", "x.py", 5)], "file_a string, file_b string, count long")
    scores = spark.createDataFrame([("p/b.py", 1, 0.5)], "rel_path string, fan_in long, hotspot_score double")
    owners = spark.createDataFrame([("p/a.py", ["@u"]), ("x.py", ["@u"]), ("q/r/a.py", ["@v"])], "rel_path string, owners array<string>")
    got = {r.rel_path: (round(r.score, 6), r.signals) for r in related.related("p/a.py", files, imports, tests, pairs, scores, owners).collect()}
    assert set(got) == {"p/b.py", "p/test_a.py", "q/r/a.py", "x.py"}
    assert got["x.py"] == (round(0.8 + 0.2 * (1 - 2.718281828459045 ** (-0.05 / 1.5)), 6), ["co-change", "same-owner"])
    assert got["q/r/a.py"] == (0.6, ["same-name"])
    assert got["p/b.py"][1] == ["same-directory", "imports", "hotspot-dep"]


def test_callers_resolve_by_file_directory_or_import(spark):
    symbols = spark.createDataFrame([("d/def.py", "f")], "file_path string, name string")
    refs = spark.createDataFrame([("f", "d/def.py", 9), ("f", "d/near.py", 1), ("f", "e/imp.py", 2), ("f", "e/imp.py", 2), ("f", "e/no.py", 3)], "name string, file_path string, line int")
    imports = spark.createDataFrame([("e/imp.py", "d/def.py")], "source_path string, target_path string")
    assert [(r.file_path, r.resolved) for r in lookup.callers(refs, symbols, imports, "f").collect()] == [("d/def.py", True), ("d/near.py", True), ("e/imp.py", True), ("e/imp.py", True), ("e/no.py", False)]
    assert not lookup.callers(refs, symbols.limit(0), imports, "f").where("resolved").count()


def test_nearest_and_longest(spark):
    dirs = spark.createDataFrame([("a/b/c",), ("a",), ("",)], "dir string")
    configs = spark.createDataFrame([("", "makefile", "Makefile"), ("a/b", "makefile", "a/b/Makefile")], "config_dir string, config_type string, config_path string")
    assert sorted(rows(nearest.nearest_configs(dirs, configs))) == [("", "makefile", "Makefile"), ("a", "makefile", "Makefile"), ("a/b/c", "makefile", "a/b/Makefile")]
    specs, prefixes = spark.createDataFrame([("x.com/m/sub/p",), ("x.com/mm",)], "spec string"), spark.createDataFrame([("x.com/m",), ("x.com/m/sub",)], "prefix string")
    assert rows(nearest.longest_prefix(specs, prefixes)) == [("x.com/m/sub/p", "x.com/m/sub")]
    notes = spark.createDataFrame([("f", 1, "n"), ("f", 30, "far")], "file_path string, end_line long, body string")
    symbols = spark.createDataFrame([("f", 11, "late"), ("f", 12, "later"), ("f", 41, "out")], "file_path string, line long, name string")
    assert sorted((r.end_line, r.symbol) for r in nearest.following(notes, symbols).collect()) == [(1, "late"), (30, "")]


def test_owners_last_rule_wins(spark):
    files = spark.createDataFrame([("a/x.py",), ("b.js",)], "rel_path string")
    rules = spark.createDataFrame([(1, "*", ["@all"]), (3, "/a/", ["@a", "@b"]), (2, "*.py", ["@py"])], "priority int, pattern string, owners array<string>")
    assert {r.rel_path: r.owners for r in nearest.owners(files, rules).collect()} == {"a/x.py": ["@a", "@b"], "b.js": ["@all"]}
    assert nearest.owners(files, rules.limit(0)).count() == 0


def test_refresh_equals_rebuild(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 3)], "rel_path string, size long, mtime long")
    new = spark.createDataFrame([("a", 1, 1), ("b", 5, 2), ("d", 4, 4)], "rel_path string, size long, mtime long")
    build = lambda f: f.select("rel_path", (F.col("size") * 10).alias("v"))
    assert sorted(rows(maintain.snapshot_diff(old, new))) == [("b", "changed"), ("c", "removed"), ("d", "added")]
    assert sorted(rows(maintain.refreshed(old, new, build))) == sorted(rows(build(new)))


def test_parse_coverage_reports_missing_records(spark):
    files = spark.createDataFrame([("a.py", "python", "source"), ("b.py", "python", "source"), ("c.md", "markdown", "doc")], "rel_path string, lang string, class string")
    parses = spark.createDataFrame([("a.py", "python", "grammar", "partial", 1, "x")], "rel_path string, lang string, extractor string, status string, symbol_count int, detail string")
    assert [(r.rel_path, r.status) for r in lookup.parse_coverage(parses, files).collect()] == [("a.py", "partial"), ("b.py", "unknown")]


def test_path_candidates():
    assert lookup.path_candidates("./a/../b.py")[-1] == "b.py"
    assert lookup.path_candidates("a\\b.py") == ["a\\b.py", "a/b.py"]
    assert lookup.path_candidates("/r/x.py", "/r") == ["x.py"]
    assert lookup.path_candidates("../x") == []


def test_tasks_of_pairs_grow_in_number_not_in_size(spark):
    """Lists travel, not pairs, to as many tasks as the input asks for."""
    import re

    files = spark.createDataFrame([(h, f"f{i}") for h in range(3) for i in range(h, 4)], "hash long, file string")
    pairs = history.cochange(files)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(file_a#\d+, file_b", plan)
    assert {(r.file_a, r.file_b): r["count"] for r in pairs.collect()} == {("f0", "f1"): 1, ("f0", "f2"): 1, ("f0", "f3"): 1, ("f1", "f2"): 2, ("f1", "f3"): 2, ("f2", "f3"): 3}
    sized = lambda n: history.pair_partitions(spark.range(n).selectExpr("id as hash", "cast(id as string) as file"))
    assert sized(10) == 4 and 8 <= sized(10**6) < sized(10**7) / 5 <= sized(10**8) / 5
    assert history.pair_partitions(spark.createDataFrame([], "hash long, file string")) == 4
