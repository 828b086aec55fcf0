import datetime as dt
import math
import re

import pytest
from pyspark.sql import functions as F

from quarrylens.functions import classify, masking, paths
from quarrylens.operators.nearest import owner_regex


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("src/a.py", "source"), ("pkg/test_a.py", "test"), ("vendor/a.go", "vendor"), ("x/a_test.go", "test"), ("Shop.Tests/A.cs", "test"), ("docs/a.py", "doc"), ("go.mod", "config"), ("api/a.pb.go", "generated"),
        ("web/a.min.js", "generated"), ("img/a.PNG", "asset"), ("d.csv", "data"), ("run.sh", "script"), ("vite.config.ts", "config"), ("a.yml", "other"), ("FooTest.java", "test"), ("tests/data.json", "other"), ("a.spec.ts", "test"),
    ],
)
def test_class_of_a_path(path, want):
    assert classify.file_class_of(path) == want


def test_class_in_spark_equals_python(spark):
    names = ["a.py", "_x/test_b.py", ".github/w.yml", "gen/a.go", "Makefile", "a/docs/x.ts", "s/T.test.tsx", "q.kts", "FooIT.java", "x.Tests/y.kt", "UP.MD"]
    got = spark.createDataFrame([(n,) for n in names], "p string").select("p", classify.file_class(F.col("p")).alias("c")).collect()
    assert {r.p: r.c for r in got} == {n: classify.file_class_of(n) for n in names}


@pytest.mark.parametrize(("glob", "yes", "no"), [("*.py", "a.py", "d/a.py"), ("**/b/*", "x/y/b/c", "b2/c"), ("a?c", "abc", "a/c"), ("[!x]a", "ya", "xa"), ("src/**", "src/a/b", "lib/a")])
def test_globs(glob, yes, no):
    form = paths.glob_regex(glob)
    assert re.match(form, yes)
    assert not re.match(form, no)


def test_windows():
    now = dt.datetime(2024, 3, 31, 12)
    assert paths.since_start("", now) == dt.datetime(2024, 3, 24, 12)
    assert paths.since_start("2w", now) == dt.datetime(2024, 3, 17, 12)
    assert paths.since_start("1m", now) == dt.datetime(2024, 2, 29, 12)
    assert paths.since_start("1y", now) == dt.datetime(2023, 3, 31, 12)
    assert paths.since_start("2024-01-01", now) == dt.datetime(2024, 1, 1)


def test_patterns():
    assert paths.matcher("abc") == ("literal", "abc", False)
    assert paths.matcher("aBc")[2]
    assert not paths.matcher(r"\Wabc")[2]
    assert paths.matcher(r"a.c$") == ("regex", r"(?iu)a.c\z", False)
    for bad in ("", "(", r"(?=x)a.", r"(a)\1"):
        with pytest.raises(paths.BadPattern):
            paths.matcher(bad)


def test_soft_cap(spark):
    for x in (0.0, 0.8, 1.3, 9.0):
        got = spark.range(1).select(paths.soft_cap(F.lit(x))).first()[0]
        assert math.isclose(got, paths.soft_cap_value(x), rel_tol=1e-12)
        assert got <= 1


@pytest.mark.parametrize(
    ("lang", "text", "gone", "kept"),
    [
        ("go", 'a := "func x()" // func y()\nfunc z() {}', ["x()", "y()"], ["func z()"]), ("rust", "/* a /* b */ c */ fn d() {}", ["a", "b", "c"], ["fn d()"]), ("python", '"""def a(): pass"""\ndef b(): pass # def c', ["a()", "def c"], ["def b()"]),
        ("ruby", "x = <<~EOS\ndef no\nEOS\ndef yes", ["no"], ["def yes"]), ("elixir", '@doc """\ndef no\n"""\ndef yes', ["no"], ["def yes"]),
    ],
)
def test_masking(lang, text, gone, kept):
    got = masking.mask(text, lang)
    assert len(got) == len(text)
    assert got.count("\n") == text.count("\n")
    assert all(g not in got for g in gone)
    assert all(k in got for k in kept)


@pytest.mark.parametrize(("pattern", "yes", "no"), [("*", "a/b", None), ("/docs/", "docs/a", "x/docs/a"), ("docs/", "docs/a", "x/docs/a"), ("*.js", "a/b.js", "b.jsx"), ("/src/*", "src/a", "src/a/b"), ("apps/**/x", "apps/a/b/x", "apps/y"), ("Makefile", "a/Makefile", "Makefile2")])
def test_owner_patterns(pattern, yes, no):
    form = owner_regex(pattern)
    assert re.search(form, yes)
    assert no is None or not re.search(form, no)
