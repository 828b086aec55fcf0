import pytest

from quarrylens.operators import detect, extract, resolve, testmap
from quarrylens.sources import gitlog, owners, tree

CASES = [
    ("go", 'package a\n// func no() {}\ns := "func bad() {"\nfunc Yes() {}\ntype T struct {\n}\nfunc (t *T) M() {}\nconst K = 1\n', {("Yes", "function"), ("T", "struct"), ("M", "method"), ("K", "constant")}, {"no", "bad"}),
    ("python", '"""def no(): pass"""\nLIMIT = 1\nclass A:\n    def m(self):\n        def local(): pass\ndef f(): pass\n', {("LIMIT", "constant"), ("A", "class"), ("m", "method"), ("f", "function")}, {"no", "local"}),
    ("typescript", "interface I {}\n/* class No {} */\nexport class C {\n  run() {\n    function inner() {}\n  }\n}\nconst f = (a) => a;\n", {("I", "interface"), ("C", "class"), ("run", "method"), ("f", "function")}, {"No", "inner"}),
    ("java", "public class A {\n  // void no() {}\n  public int foo(int x) { return bar(x); }\n}\nenum E { X }\n", {("A", "class"), ("foo", "method"), ("E", "enum")}, {"no", "bar"}),
    ("rust", "pub fn a() {}\n/* /* fn no() {} */ fn no2() {} */\npub struct S {}\ntrait T {}\n", {("a", "function"), ("S", "struct"), ("T", "trait")}, {"no", "no2"}),
    ("ruby", "module M\nclass A\n  def x\n  end\nend\nend\n# def no\n", {("M", "module"), ("A", "class"), ("x", "method")}, {"no"}),
    ("csharp", "namespace N {\npublic class A {\n  public int P { get; set; }\n  public void Run() { }\n}\n}\n", {("A", "class"), ("P", "property"), ("Run", "method")}, set()),
    ("swift", "struct S {\n  func go() {}\n}\nprotocol P {}\n", {("S", "struct"), ("go", "method"), ("P", "interface")}, set()),
    ("elixir", 'defmodule A.B do\n  @doc """\n  def no\n  """\n  def yes(x), do: x\nend\n', {("A.B", "module"), ("yes", "function")}, {"no"}),
    ("shell", "foo() {\n:\n}\n# bar() {\n", {("foo", "function")}, {"bar"}),
    ("razor", '@page "/x"\n@model A.B\n@* @model No *@\n@code {\n  int Add(int a) { return a; }\n}\n', {("/x", "page"), ("A.B", "model"), ("Add", "method")}, {"No"}),
]


@pytest.mark.parametrize(("lang", "text", "want", "forbid"), CASES, ids=[c[0] for c in CASES])
def test_symbols(lang, text, want, forbid):
    found, _, status, _ = extract.symbols_of(text, lang)
    assert status == "ok"
    assert want <= {(n, k) for n, k, _, _ in found}
    assert not forbid & {n for n, _, _, _ in found}


def test_parse_states():
    assert extract.symbols_of("def f(:\n  pass\nclass A: pass", "python")[2] == "partial"
    assert extract.symbols_of("x", "clojure")[1:3] == ("none", "unsupported")
    assert extract.symbols_of(None, "go")[2] == "failed"


def test_calls_are_a_bag():
    assert extract.calls("def f(): pass\nf(); f()\na.b(1)\n", "python") == [("f", 2), ("f", 2), ("b", 3)]
    assert extract.calls("func a() { b(); b() } // c()\n", "go") == [("b", 1), ("b", 1)]


def test_specifiers_skip_comments():
    assert extract.specifiers("import x from './a';\n// import y from './b'\nconst z = require('q');", "javascript") == [("import", "./a"), ("import", "q")]
    assert extract.specifiers('import (\n\t"fmt"\n\tx "a/b"\n)\n', "go") == [("import", "fmt"), ("import", "a/b")]
    assert extract.specifiers("from . import a\nimport os.path as p", "python") == [("from", ".:a"), ("import", "os.path")]


def test_notes_attach_to_what_follows():
    text = "# @context: why\n\n@deco\ndef f():\n    pass\n\nx = 1  # unrelated\n# @context(g): named\n# @context(none): lost\ns = '# @context: string'\ndef g(): pass\n"
    got = extract.notes_of("a.py", "python", text, [("f", 4), ("g", 11)])
    assert ("f", 1, "why") in got
    assert ("g", 8, "named") in got
    assert not any("string" in b for _, _, b in got)


RESOLVE = [
    ("main.go", "go", "import", "ex.com/m/util", "resolved", {"util/u.go"}), ("main.go", "go", "import", "fmt", "external", set()), ("main.go", "go", "import", "ex.com/m/none", "unresolved", set()),
    ("web/a.ts", "typescript", "import", "./b", "resolved", {"web/b.tsx"}), ("web/a.ts", "typescript", "import", "@/lib", "resolved", {"web/lib/index.ts"}), ("web/a.ts", "typescript", "import", "react", "external", set()), ("web/a.ts", "typescript", "import", "./nope", "unresolved", set()),
    ("py/m.py", "python", "from", ".n:x", "resolved", {"py/n.py"}), ("py/m.py", "python", "import", "json", "external", set()), ("py/m.py", "python", "import", "py.gone", "unresolved", set()),
    ("J.java", "java", "import", "com.x.Foo", "resolved", {"src/main/java/com/x/Foo.java"}), ("J.java", "java", "import", "java.util.List", "external", set()), ("J.java", "java", "import", "org.no.Such", "unresolved", set()),
    ("C.cs", "csharp", "using", "Acme.Core", "resolved", {"core/Core.cs"}), ("C.cs", "csharp", "using", "System.Text", "external", set()), ("C.cs", "csharp", "using", "Acme", "unresolved", set()), ("C.cs", "csharp", "using", "core", "external", set()),
    ("r/a.rb", "ruby", "rel", "b", "resolved", {"r/b.rb"}), ("r/a.rb", "ruby", "abs", "json", "external", set()), ("rs/src/main.rs", "rust", "mod", "x", "resolved", {"rs/src/x.rs"}), ("rs/src/x.rs", "rust", "use", "crate::x::T", "resolved", set()), ("rs/src/main.rs", "rust", "use", "std::io", "external", set()),
    ("s/a.sh", "shell", "source", "$D/x.sh", "unresolved", set()), ("s/a.sh", "shell", "source", "b.sh", "resolved", {"s/b.sh"}), ("E.ex", "elixir", "module", "My.Mod", "resolved", {"my.ex"}), ("E.ex", "elixir", "module", "Ecto.Repo", "external", set()), ("z/a.zig", "zig", "import", "std", "external", set()),
    ("d/a.dart", "dart", "import", "dart:io", "external", set()), ("d/a.dart", "dart", "import", "b.dart", "resolved", {"d/b.dart"}), ("P.php", "php", "use", "App\\Model", "resolved", {"app/Model.php"}), ("P.php", "php", "use", "Symfony\\X", "external", set()),
    ("l/a.lua", "lua", "import", "b.c", "resolved", {"l/b/c.lua"}), ("j/a.jl", "julia", "dynamic", "include", "unresolved", set()), ("S.swift", "swift", "import", "Foundation", "external", set()), ("S.swift", "swift", "import", "Kit", "resolved", {"Sources/Kit/K.swift"}),
]


def test_resolution_has_edges_and_absent_edges(spark):
    texts = {"core/Core.cs": "namespace Acme.Core { class A {} }", "my.ex": "defmodule My.Mod do\nend", "src/main/java/com/x/Foo.java": "package com.x;\nclass Foo {}"}
    names = ["util/u.go", "util/u_test.go", "web/b.tsx", "web/lib/index.ts", "py/n.py", "py/m.py", "py/__init__.py", "r/b.rb", "rs/src/x.rs", "rs/src/main.rs", "s/b.sh", "d/b.dart", "app/Model.php", "l/b/c.lua", "Sources/Kit/K.swift", *texts]
    langs = {"cs": "csharp", "ex": "elixir", "java": "java", "go": "go", "tsx": "typescript", "ts": "typescript", "py": "python", "rb": "ruby", "rs": "rust", "sh": "shell", "dart": "dart", "php": "php", "lua": "lua", "swift": "swift"}
    files = spark.createDataFrame([(n, langs[n.rpartition(".")[2]]) for n in names], "rel_path string, lang string")
    contents = spark.createDataFrame([(n, texts.get(n, "")) for n in names], "rel_path string, content string")
    context = resolve.context_of({"go.mod": "module ex.com/m\n", "web/tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["./*"],},} /* x */}', "composer.json": '{"autoload": {"psr-4": {"App\\\\": "app/"}}}'}, ["py"])
    specs = spark.createDataFrame([(p, lang, i, k, s) for i, (p, lang, k, s, _, _) in enumerate(RESOLVE)], "rel_path string, lang string, ord int, kind string, spec string")
    imports, fates = resolve.resolve(specs, resolve.key_table(files, contents), context)
    bucket = {r.ord: r.bucket for r in fates.collect()}
    edges = {(r.source_path, r.target_path) for r in imports.collect()}
    for i, (path, _, _, spec, want, targets) in enumerate(RESOLVE):
        assert bucket[i] == want, (path, spec, bucket[i])
        assert all((path, t) in edges for t in targets), (path, spec, edges)
    assert ("main.go", "util/u_test.go") not in edges
    assert all(a != b for a, b in edges)


def test_test_mapping(spark):
    names = [("src/cart.py", "source"), ("tests/test_cart.py", "test"), ("a/x.go", "source"), ("a/x_test.go", "test"), ("b/x.go", "source"), ("Shop/Order.cs", "source"), ("Shop.Tests/OrderTests.cs", "test"), ("t/orphan.test.ts", "test"), ("p/one.ts", "source"), ("q/one.ts", "source"), ("t/one.test.ts", "test")]
    files = spark.createDataFrame(names, "rel_path string, class string")
    none = spark.createDataFrame([], "source_path string, target_path string")
    got = {r.test_path: r.source_path for r in testmap.tests(files, none).collect()}
    assert got == {"tests/test_cart.py": "src/cart.py", "a/x_test.go": "a/x.go", "Shop.Tests/OrderTests.cs": "Shop/Order.cs", "t/orphan.test.ts": "", "t/one.test.ts": ""}
    by_import = spark.createDataFrame([("t/one.test.ts", "q/one.ts")], "source_path string, target_path string")
    assert {r.test_path: r.source_path for r in testmap.tests(files, by_import).collect()}["t/one.test.ts"] == "q/one.ts"


def test_manifests():
    deps, frameworks, issues = detect.read_manifests({"go.mod": "module a\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.0\n\tgithub.com/x/y v1.0.0 // indirect\n)\n", "package.json": '{"dependencies": {"react": "^18"}}', "bad/package.json": "{", "pyproject.toml": '[project]\ndependencies = ["fastapi>=0.1", "x"]\n', "pom.xml": "<project><dependencies><dependency><groupId>org.springframework.boot</groupId><artifactId>spring-boot-starter</artifactId></dependency></dependencies></project>", "build.sbt": 'libraryDependencies += "org.typelevel" %% "cats-effect" % "2.0"', "Gemfile": 'gem "rails", "7.0"', "gone/go.mod": None})
    assert {f[0] for f in frameworks} == {"Gin", "React", "FastAPI", "Spring Boot", "Cats Effect", "Rails"}
    assert ("github.com/x/y", "v1.0.0", "go.mod", "go") not in deps
    assert {i[0] for i in issues} == {"bad/package.json", "gone/go.mod"}
    assert detect.grade(3, 1, True) == "incomplete"
    assert detect.grade(0, 0, False) == "unsupported"


def test_log_parser():
    h = "a" * 40
    stream = f"\x1e{h}\x1fme\x1f2024-01-01 00:00:00 +0000\x1f\x1fone\x1f\0sub/ü b.py\0out.py\0\x1e{h}\x1fbad\x1e{h}\x1fme\x1f2024-01-02 00:00:00 +0000\x1fp\x1f\x1f"
    log = gitlog.parse(stream, "sub/")
    assert (log.scanned, log.malformed, log.outside) == (3, 1, 1)
    assert [r[4] for r in log.rows] == [["ü b.py"], []]
    assert [r[5] for r in log.rows] == [True, False]


def test_ownership_file():
    assert owners.parse("# c\n* @a\n\n/x/\n*.py @b @c # why\n") == [(2, "*", ["@a"]), (5, "*.py", ["@b", "@c"])]


@pytest.mark.parametrize(("raw", "want"), [(b"\xef\xbb\xbfa", "a"), ("é".encode("utf-16"), "é"), ("abcd".encode("utf-16-be"), "abcd"), (b"\0\1\2\0", None), (b"ab\xffcd", "ab\ufffdcd"), (bytes(range(128, 256)) + b"\1\2\3" * 40, None)])
def test_decoding(raw, want):
    assert tree.decode(raw) == want


def test_ignore_rules():
    rules = tree.parse_rules("*.log\n!keep.log\nbuild/\n/top\n# x\n")
    assert tree.ignored([("", rules)], "a/x.log", False)
    assert not tree.ignored([("", rules)], "keep.log", False)
    assert tree.ignored([("", rules)], "a/build", True)
    assert not tree.ignored([("", rules)], "a/build", False)
    assert not tree.ignored([("", rules)], "a/top", False)
    assert not tree.ignored([("", rules), ("a", tree.parse_rules("!x.log"))], "a/x.log", False)


def test_grouped_go_declarations():
    text = "package a\nconst (\n\tA = iota\n\tB, C = 1, 2\n)\nvar (\n\tx = f(\n\t\ty,\n\t)\n)\ntype (\n\tS struct {\n\t\tq int\n\t}\n\tN int\n)\n"
    assert [r[:3] for r in extract.symbols_of(text, "go")[0]] == [("A", "constant", 3), ("B", "constant", 4), ("C", "constant", 4), ("x", "var", 7), ("S", "struct", 12), ("N", "type", 15)]


def test_scala_selectors():
    assert [s for _, s in extract.specifiers("import a.b.{C, D => E, F => _}\nimport x.Y, z._\n", "scala")] == ["a.b.C", "a.b.D", "x.Y", "z._"]


def test_header_of_the_other_language():
    assert ("A", "class") in [r[:2] for r in extract.symbols_of("class A {\npublic:\n  int x;\n};\n", "c")[0]]


def test_test_mapping_prefers_the_exact_case(spark):
    none = spark.createDataFrame([], "source_path string, target_path string")
    rows = [("x/test_cart.py", "test"), ("a/cart.py", "source"), ("b/Cart.py", "source"), ("t/OrderListTest.java", "test"), ("t/OrderListView.java", "source"), ("y/test_twice.py", "test"), ("c/twice.py", "source"), ("d/twice.py", "source")]
    got = {r.test_path: r.source_path for r in testmap.tests(spark.createDataFrame(rows, "rel_path string, class string"), none).collect()}
    assert got == {"x/test_cart.py": "a/cart.py", "t/OrderListTest.java": "t/OrderListView.java", "y/test_twice.py": ""}


def test_walk_lists_manifests_that_lead_nowhere(tmp_path):
    for d in (".turbo", ".venv", "a"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.py").write_text("")
    (tmp_path / "a" / "go.mod").symlink_to(tmp_path / "gone")
    (tmp_path / "a" / "y.py").symlink_to(tmp_path / "gone")
    assert [p for p, _ in tree.walk(str(tmp_path), "", [])] == [".venv/x.py", "a/go.mod", "a/x.py"]


def test_whole_texts_are_tested_as_lines_are(spark):
    from quarrylens.operators import grep

    files = spark.createDataFrame([("a.py", "source", 9)], "rel_path string, class string, size long")
    texts = spark.createDataFrame([("a.py", "one\nTwo end\r\nthree\n")], "rel_path string, content string")
    for pattern, n in (("^t", 2), ("e$", 2), (r"^\w+$", 2), ("^Two", 1), (r"\Aone", 1), ("end.$", 0), ("[^x]$", 3)):
        assert grep.hits(files, texts, pattern).count() == sum(bool(x) for x in grep.lines(texts).where(grep.matches(grep.F.col("text"), pattern)).collect()), pattern
        assert n is not None


def test_probes_meet_one_row_for_each_name(spark):
    """A root that all files share would meet every specifier that asks for it: files times specifiers."""
    names = [f"py/m{i}.py" for i in range(50)]
    files = spark.createDataFrame([(n, "python") for n in names] + [("a.cs", "csharp"), ("b.cs", "csharp")], "rel_path string, lang string")
    contents = spark.createDataFrame([(n, "") for n in names] + [("a.cs", "namespace A.B { class X {} class Y {} }"), ("b.cs", "namespace A.C { class X {} }")], "rel_path string, content string")
    keys = [(r.key, r.rel_path) for r in resolve.key_table(files, contents).collect()]
    assert [k for k, _ in keys if k.partition(":")[0] in resolve.PROBED and sum(k == other for other, _ in keys) > 1] == []
    assert {"pyroot:py", "nsroot:A", "nstree:A", "nstree:A.B", "short:X"} <= {k for k, _ in keys}
    assert [(k, p) for k, p in keys if k.startswith("only:")] == [("only:Y", "a.cs")]
    specs = spark.createDataFrame([(n, "python", 0, "from", f"py.m{i}:x") for i, n in enumerate(reversed(names))], "rel_path string, lang string, ord int, kind string, spec string")
    imports, fates = resolve.resolve(specs, resolve.key_table(files, contents), resolve.Context())
    assert imports.count() == 50 and {r.bucket for r in fates.collect()} == {"resolved"}


def test_go_module_is_found_by_the_prefixes_of_the_specifier():
    class Asked(dict):
        def __iter__(self):
            raise AssertionError("every module was looked at")

    c = resolve.Context(go_modules=Asked({f"ex.com/s{i}": f"svc/s{i}" for i in range(9)} | {"ex.com/s1/in": "deep"}))
    assert resolve.candidates("a.go", "go", "import", "ex.com/s1/in/x", c)[0] == [["dir:go:deep/x"]]
    assert resolve.candidates("a.go", "go", "import", "ex.com/s1/inner", c)[0] == [["dir:go:svc/s1/inner"]]
    assert resolve.candidates("a.go", "go", "import", "ex.com/s1", c)[0] == [["dir:go:svc/s1"]]
    assert resolve.candidates("a.go", "go", "import", "ex.com/s10/x", c) == ([], [], "external")


def leaves(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_tests_and_sources_are_each_read_once(spark):
    files = spark.range(40).selectExpr("concat(if(id % 2 = 0, 'src/m', 'tests/test_m'), id div 2, '.py') as rel_path", "if(id % 2 = 0, 'source', 'test') as class")
    found = testmap.tests(files, spark.sql("select '' as source_path, '' as target_path where false"))
    assert leaves(found, "Range (") == 2
    assert {(r.test_path, r.source_path) for r in found.collect()} == {(f"tests/test_m{i}.py", f"src/m{i}.py") for i in range(20)}


def test_beginnings_and_paired_projects(spark):
    """An equal rival leaves a test open, a nearer source decides."""
    names = [("src/order_line_item.py", "source"), ("tests/test_order_line.py", "test"), ("a/fooBarBaz.ts", "source"), ("a/fooBarQux.ts", "source"), ("a/fooBar.test.ts", "test"), ("Shop/Cart.cs", "source"), ("Other/Cart.cs", "source"), ("Shop.Tests/deep/CartTests.cs", "test"), ("t/x.test.zzz", "test")]
    got = {r.test_path: r.source_path for r in testmap.tests(spark.createDataFrame(names, "rel_path string, class string"), spark.createDataFrame([], "source_path string, target_path string")).collect()}
    assert got == {"tests/test_order_line.py": "src/order_line_item.py", "a/fooBar.test.ts": "", "Shop.Tests/deep/CartTests.cs": "Shop/Cart.cs", "t/x.test.zzz": ""}


def test_only_asked_facts_are_worked_out(spark):
    text = "# @context: why\nimport os\nclass A:\n    def f(self):\n        return g(1)\n"
    files = spark.createDataFrame([("a.py", "python", "source", text), ("b.py", "python", "source", None), ("c.md", "markdown", "doc", "x")], "rel_path string, lang string, class string, content string")
    every = extract.facts(files, None).collect()
    assert {r.tag for r in every} == set(extract.TAGS)
    for tag in extract.TAGS:
        assert sorted(map(tuple, extract.facts(files, None, (tag,)).collect())) == sorted(tuple(r) for r in every if r.tag == tag)
    apart = extract.facts(files.drop("content"), files.select("rel_path", "content"))
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, every))
    assert leaves(extract.relations(extract.facts(files, None, ("symbol",)))["symbols"], "Join") == 0


def test_tree_is_one_scan_spread_over_the_cores(spark):
    from quarrylens.plans import project

    tree = project.tree(spark, "/root/testdata/sf0.001")
    plan = tree._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and "Join" not in plan
    full = sum(len(x) > 0 for x in tree.select("rel_path").where("rel_path not like 'svc/%'").rdd.glom().collect())
    assert full >= 4


def test_plain_class_equals_the_rules(spark):
    from pyspark.sql import functions as F

    from quarrylens.functions import classify

    names = ["a", "test_a", "a_test", "ATests", "a.spec", "IT", ".eslintrc", "go", "package", "Dockerfile", "x.Test", "a_test.b", "\u017f", "\u212a", "a\n"]
    ends = ["", ".py", ".go", ".TS", ".cs", ".md", ".json", ".min.js", ".pb.go", ".config.mjs", ".tf", ".csv", ".PNG", ".sh", ".sh\n", "."]
    dirs = ["", "vendor/", "Vendor/", "a.Tests/", "tests/", "Tests/", "docs/", "x/Gen/", "a.b/"]
    rows = [d + n + e for d in dirs for n in names for e in ends]
    found = spark.createDataFrame([(r,) for r in rows], "p string").select("p", classify.file_class(F.col("p")).alias("c")).collect()
    rules = None
    for name, form in classify.RULES:
        rules = F.when(F.col("p").rlike(form), name) if rules is None else rules.when(F.col("p").rlike(form), name)
    want = {r.p: r.c for r in spark.createDataFrame([(r,) for r in rows], "p string").select("p", rules.otherwise("other").alias("c")).collect()}
    assert {r.p: r.c for r in found} == want


def test_decoding_works_in_slices(spark):
    import pyarrow as pa

    raw = [b"a" * 400_000, None, b"\xff\xfeh\0i\0", b"\0\0\1", b"b" * 3_000_000, b""] * 3
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(raw))]), pa.array(raw, pa.binary())], ["rel_path", "content"])
    out = list(tree.decoded(iter([batch])))
    assert max(b.nbytes for b in out) < 3_100_000 and len(out) > 6
    assert [x for b in out for x in b.column("content").to_pylist()] == [tree.decode(x) for x in raw]
    assert [x for b in out for x in b.column("rel_path").to_pylist()] == [str(i) for i in range(len(raw))]
    df = spark.createDataFrame([("a", bytearray(b"x"), 1), ("b", bytearray(b"\0\0\1"), 2), ("c", None, 3)], "rel_path string, content binary, n int")
    assert [tuple(r) for r in tree.contents(df).collect()] == [("a", "x")]
