"""Classification of paths: language, file class, directory purpose, kind of test."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylens.functions.paths import base_of, ext_of, stem_of

_BY_LANGUAGE = {
    "astro": "astro", "bicep": "bicep", "c": "c h", "clojure": "clj", "cpp": "cpp cc cxx hpp", "csharp": "cs", "css": "css", "dart": "dart", "elixir": "ex exs",
    "erlang": "erl", "fsharp": "fs", "go": "go", "graphql": "graphql gql", "hcl": "hcl", "html": "html htm", "ini": "ini", "java": "java", "javascript": "js jsx mjs cjs",
    "json": "json", "julia": "jl", "kotlin": "kt kts", "less": "less", "lua": "lua", "markdown": "md mdx", "nim": "nim", "php": "php", "powershell": "ps1 psm1",
    "protobuf": "proto", "python": "py pyw", "r": "r", "razor": "cshtml razor", "rst": "rst", "ruby": "rb", "rust": "rs", "sass": "sass", "scala": "scala", "scss": "scss",
    "shell": "sh bash zsh", "sql": "sql", "svelte": "svelte", "swift": "swift", "terraform": "tf", "toml": "toml", "typescript": "ts tsx mts", "vue": "vue", "xml": "xml",
    "yaml": "yaml yml", "zig": "zig",
}
LANGUAGES = {f".{e}": lang for lang, exts in _BY_LANGUAGE.items() for e in exts.split()}
NOT_SOURCE = {"bicep", "hcl", "ini", "json", "markdown", "powershell", "rst", "shell", "sql", "terraform", "toml", "xml", "yaml"}
SOURCE_EXTS = {e for e, lang in LANGUAGES.items() if lang not in NOT_SOURCE}
SCRIPT_EXTS = {f".{e}" for e in "sh bash zsh fish ps1 psm1 bat cmd".split()}
CLASSES = ["source", "test", "config", "doc", "generated", "vendor", "script", "data", "asset", "other"]

VENDOR = {"vendor", "node_modules", "third_party", "external", "deps"}
GENERATED_DIRS = {"generated", "gen", "__generated__", "auto-generated"}
GENERATED_ENDS = (".pb.go", ".pb.ts", ".generated.cs", ".designer.cs", ".min.js", ".min.css", ".g.cs", ".g.dart")
TEST_DIRS = {"__tests__", "test", "tests", "spec", "specs"}
CONFIG_NAMES = {
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.mod", "go.sum", "cargo.toml", "cargo.lock", "gemfile", "gemfile.lock", "mix.exs", "mix.lock",
    "pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "pipfile", "pipfile.lock", "poetry.lock", "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle",
    "composer.json", "pubspec.yaml", "build.sbt", "makefile", "dockerfile", "docker-compose.yml", "docker-compose.yaml", "tsconfig.json", "jsconfig.json",
    ".gitignore", ".dockerignore", ".editorconfig", ".env", ".prettierrc", "rakefile", "justfile",
}
CONFIG_EXTS = {f".{e}" for e in "csproj fsproj vbproj sln props targets tf hcl bicep".split()}
DOC_EXTS = {f".{e}" for e in "md mdx rst txt adoc".split()}
DOC_DIRS = {"docs", "doc", "documentation"}
ASSET_EXTS = {f".{e}" for e in "png jpg jpeg gif svg ico webp bmp mp4 webm mov mp3 wav ogg woff woff2 ttf otf eot pdf".split()}
DATA_EXTS = {f".{e}" for e in "csv tsv parquet avro ndjson jsonl".split()}
#: Extension -> (suffixes, prefixes) that make a file name a test's.
_JS = (".test", ".spec"), ()
_C = ("_test",), ("test_",)
AFFIXES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    ".go": (("_test",), ()), **dict.fromkeys((".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts"), _JS), ".py": (("_test",), ("test_",)), ".rb": (("_spec", "_test"), ()),
    ".exs": (("_test",), ()), ".java": (("Test", "Tests", "IT"), ()), ".kt": (("Test", "Tests"), ()), ".kts": (("Test", "Tests"), ()), ".swift": (("Tests", "Test"), ()),
    ".php": (("Test",), ()), ".dart": (("_test",), ()), ".scala": (("Spec", "Test", "Tests", "Suite"), ()), ".rs": (("_test", "_tests"), ()),
    **dict.fromkeys((".c", ".h", ".cpp", ".cc", ".cxx", ".hpp"), _C), ".zig": (("_test",), ()), ".lua": (("_spec", "_test"), ()), ".jl": (("_test",), ("test_",)),
    ".sh": (("_test", ".test"), ("test_",)), ".bash": (("_test", ".test"), ("test_",)),
}


def language(path: Column) -> Column:
    """Language by extension, "" where there is none."""
    table = F.create_map(*[F.lit(x) for kv in sorted(LANGUAGES.items()) for x in kv])
    return F.coalesce(F.element_at(table, ext_of(path)), F.lit(""))


def _alt(items) -> str:
    return "(?:" + "|".join(re.escape(x) for x in sorted(items)) + ")"


def _ends(exts) -> str:
    """Extension test: the name's last dot starts one of them."""
    return rf"(?iu:(?:^|/)[^/]*{_alt(exts)}$)"


def _test_names() -> str:
    forms: dict[tuple, list[str]] = {}
    for ext, rule in AFFIXES.items():
        forms.setdefault(rule, []).append(ext)
    parts = []
    for (suffixes, prefixes), exts in forms.items():
        parts.append(rf"[^/]*{_alt(suffixes)}(?i:{_alt(exts)})")
        if prefixes:
            parts.append(rf"{_alt(prefixes)}[^/]*(?i:{_alt(exts)})")
    return "(?:^|/)(?:" + "|".join(parts) + ")$"


_PROJECT = r"(?:^|/)[^/]*\.(?:tests|test|integrationtests|unittests)/"
#: Class -> one regular expression over the path; the first that holds wins. One test each keeps the generated code small.
RULES: list[tuple[str, str]] = [
    ("vendor", rf"(?:^|/){_alt(VENDOR)}/"),
    ("generated", rf"(?iu:(?:^|/){_alt(GENERATED_DIRS)}/|{_alt(GENERATED_ENDS)}$)"),
    ("test", _test_names()),
    ("test", rf"(?:(?:^|/){_alt(TEST_DIRS)}/|(?iu:{_PROJECT})).*(?i:{_alt((SOURCE_EXTS | SCRIPT_EXTS) - {'.cs'})})$|(?iu:(?:{_PROJECT}|(?:^|/)tests?/).*\.cs$)"),
    ("config", rf"(?iu:(?:^|/)(?:{_alt(CONFIG_NAMES)}|[^/]*{_alt(CONFIG_EXTS)}|[^/]*\.config\.(?:js|ts|mjs|cjs)|\.(?:eslintrc|babelrc)[^/]*)$)"),
    ("doc", rf"{_ends(DOC_EXTS)}|(?:^|/){_alt(DOC_DIRS)}/"),
    ("asset", _ends(ASSET_EXTS)),
    ("data", _ends(DATA_EXTS)),
    ("source", _ends(SOURCE_EXTS)),
    ("script", _ends(SCRIPT_EXTS)),
]


def _any(tests: Iterable[Column]) -> Column:
    return reduce(Column.__or__, tests)


def _plain_class(base: Column, ext: Column, stem: Column, inner: Column) -> Column:
    """RULES without regular expressions, for paths in ASCII of one line; inner is the path behind a slash."""
    low, low_inner = F.lower(base), F.lower(inner)
    within = lambda text, dirs: _any(text.contains(f"/{d}/") for d in sorted(dirs))
    forms: dict[tuple, list[str]] = {}
    for e, rule in AFFIXES.items():
        forms.setdefault(rule, []).append(e)
    named = _any(ext.isin(exts) & _any([*(stem.endswith(x) for x in suffixes), *(base.startswith(x) for x in prefixes)]) for (suffixes, prefixes), exts in forms.items())
    project = _any(low_inner.contains(f".{x}/") for x in ("tests", "test", "integrationtests", "unittests"))
    placed = (ext.isin(*sorted((SOURCE_EXTS | SCRIPT_EXTS) - {".cs"})) & (within(inner, TEST_DIRS) | project)) | ((ext == ".cs") & (project | within(low_inner, ("test", "tests"))))
    config = low.isin(*sorted(CONFIG_NAMES)) | ext.isin(*sorted(CONFIG_EXTS)) | _any([*(low.endswith(f".config.{x}") for x in ("js", "ts", "mjs", "cjs")), *(low.startswith(x) for x in (".eslintrc", ".babelrc"))])
    return (
        F.when(within(inner, VENDOR), "vendor").when(within(low_inner, GENERATED_DIRS) | _any(low_inner.endswith(x) for x in GENERATED_ENDS), "generated").when(named | placed, "test").when(config, "config")
        .when(ext.isin(*sorted(DOC_EXTS)) | within(inner, DOC_DIRS), "doc").when(ext.isin(*sorted(ASSET_EXTS)), "asset").when(ext.isin(*sorted(DATA_EXTS)), "data").when(ext.isin(*sorted(SOURCE_EXTS)), "source").when(ext.isin(*sorted(SCRIPT_EXTS)), "script").otherwise("other")
    )


def file_class(path: Column) -> Column:
    """First rule that holds, in a fixed order.

    The cases stand inside a function over one row, which Spark walks through: as generated code they would make
    the method around them too large to be compiled, and everything in it slow.
    """

    def of(x: Column) -> Column:
        at, out = x["path"], None
        for name, form in RULES:
            out = F.when(at.rlike(form), name) if out is None else out.when(at.rlike(form), name)
        plain = (F.length(at) == F.octet_length(at)) & ~at.contains("\n") & ~at.contains("\r")
        return F.when(plain, _plain_class(x["base"], x["ext"], x["stem"], x["inner"])).otherwise(out.otherwise("other"))

    parts = {"path": path, "base": base_of(path), "ext": ext_of(path), "stem": stem_of(path), "inner": F.concat(F.lit("/"), path)}
    return F.element_at(F.transform(F.array(F.struct(*[c.alias(n) for n, c in parts.items()])), of), 1)


def file_class_of(path: str) -> str:
    """The same for one path in Python."""
    return next((name for name, form in RULES if re.search(form, path)), "other")


#: Purpose -> names of the last directory segment; the first that holds one wins.
PURPOSES = {
    "entrypoint": "cmd bin", "test": "test tests spec specs __tests__ e2e", "docs": "doc docs documentation", "config": "config configs conf settings", "scripts": "script scripts tools hack",
    "infra": "infra deploy deployment terraform k8s helm ansible docker", "vendor": "vendor third_party node_modules", "build": "build dist out target", "assets": "assets static public images media",
    "frontend": "frontend web ui client views components pages", "backend": "backend server api services", "support": "support helpers util utils internal pkg lib common", "data": "data fixtures testdata migrations seeds",
}


def dir_purpose(directory: Column) -> Column:
    """Purpose by the last segment; the root is "root", anything else is "source"."""
    name, out = F.lower(base_of(directory)), F.when(directory.isin("", "."), "root")
    for purpose, names in PURPOSES.items():
        out = out.when(name.isin(names.split()), purpose)
    return out.otherwise("source")


def test_kind(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.contains("e2e") | p.contains("end-to-end"), "e2e").when(p.contains("integration"), "integration").otherwise("unit")
