"""Import resolution: specifier -> edges, as one equi-join.

Each specifier is turned into ranked keys ("file:<path>", "dir:<language>:<dir>", "pkg:", "fqn:", "ns:",
"mod:", "spm:") and into probes. The keys meet the repository's own key table; the hits of the best rank are
the edges, and they make the specifier resolved. Without a hit it is unresolved if a probe is known here (the
name belongs to this repository), else whatever its language says of unknown names. The small facts of the
repository (Go modules, path aliases, package names, source roots) are read from manifests beforehand.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.masking import mask
from quarrylens.functions.paths import dir_of

JVM_ROOTS = ("src/main/java/", "src/main/kotlin/", "src/", "app/src/main/java/", "app/src/main/kotlin/", "")
SCALA_ROOTS = ("src/main/scala/", "app/", "src/", "core/src/main/scala/", "")
JVM_STD = ("java.", "javax.", "kotlin.", "kotlinx.", "android.", "androidx.", "sun.", "com.sun.", "jdk.")
SCALA_STD = ("scala.", "java.", "javax.", "akka.", "cats.", "play.", "zio.")
CS_STD = ("System", "Microsoft", "Newtonsoft", "NUnit", "Xunit")
PHP_VENDOR = ("Symfony", "Illuminate", "Laravel", "Doctrine", "Psr", "PHPUnit", "Monolog", "GuzzleHttp", "Twig", "Composer", "Carbon", "League")
JS_EXTS = (".ts", ".tsx", ".mts", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".json")
REWRITES = {".js": (".ts", ".tsx", ".js", ".jsx"), ".jsx": (".tsx", ".jsx"), ".mjs": (".mts", ".mjs")}
SWIFT_SYSTEM = set("Foundation UIKit SwiftUI AppKit Combine CoreData CoreGraphics CoreLocation CoreML CoreImage AVFoundation Accelerate ARKit CloudKit Contacts CryptoKit Darwin Dispatch EventKit GameKit Glibc HealthKit MapKit Metal MetalKit Network NaturalLanguage ObjectiveC os OSLog PassKit PDFKit Photos PhotosUI QuartzCore RealityKit SafariServices SceneKit Security SpriteKit StoreKit Swift SwiftData Testing UniformTypeIdentifiers UserNotifications Vision WatchKit WebKit WidgetKit XCTest".split())


#: Kinds of keys that are probed only.
PROBED = ("pyroot", "short", "nsroot", "nstree", "spmdir")


@dataclass
class Context:
    """Facts of the repository that candidates depend on; all small."""

    go_modules: dict[str, str] = field(default_factory=dict)  # module -> directory
    aliases: list[tuple[str, list[str]]] = field(default_factory=list)  # pattern -> targets
    python_roots: list[str] = field(default_factory=lambda: ["", "src"])
    dart_package: str = ""
    psr4: dict[str, str] = field(default_factory=dict)


def context_of(manifests: dict[str, str], python_packages: list[str] = ()) -> Context:
    """From path -> text of go.mod, tsconfig/jsconfig, composer.json and pubspec.yaml, and the directories with an __init__."""
    c = Context()
    packages = set(python_packages)
    c.python_roots = sorted({"", "src", *(posixpath.dirname(p) for p in packages if posixpath.dirname(p) not in packages)}, key=lambda r: (-r.count("/") - bool(r), r))
    for path, text in sorted(manifests.items()):
        base, name = posixpath.dirname(path), posixpath.basename(path)
        if name == "go.mod" and (m := re.search(r"^module\s+(\S+)", text, re.M)):
            c.go_modules[m[1]] = base
        elif name in ("tsconfig.json", "jsconfig.json"):
            options = _loose_json(text).get("compilerOptions", {})
            root = posixpath.normpath(posixpath.join(base, options.get("baseUrl", ".")))
            for pattern, targets in (options.get("paths") or {}).items():
                c.aliases.append((pattern, [posixpath.normpath(posixpath.join(root, t)).removeprefix("./") for t in targets]))
        elif name == "composer.json":
            for part in ("autoload", "autoload-dev"):
                for prefix, where in (_loose_json(text).get(part, {}).get("psr-4") or {}).items():
                    c.psr4[prefix] = posixpath.join(base, where if isinstance(where, str) else where[0]).rstrip("/")
        elif name == "pubspec.yaml" and (m := re.search(r"^name:\s*(\w+)", text, re.M)):
            c.dart_package = c.dart_package or m[1]
    return c


def _loose_json(text: str) -> dict:
    """JSON with comments and trailing commas."""
    clean = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or "", text)
    try:
        got = json.loads(re.sub(r",(\s*[}\]])", r"\1", clean))
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def _norm(*parts: str) -> str:
    p = posixpath.normpath(posixpath.join(*[x for x in parts if x]) if any(parts) else "")
    return "" if p == "." else p


def _f(*paths: str) -> list[str]:
    return [f"file:{p}" for p in paths if p and not p.startswith("../")]


def _js_forms(p: str) -> list[str]:
    root, ext = posixpath.splitext(p)
    return _f(p, *(root + e for e in REWRITES.get(ext, ())), *(p + e for e in JS_EXTS), *(f"{p}/index{e}" for e in JS_EXTS))


def candidates(path: str, lang: str, kind: str, spec: str, c: Context) -> tuple[list[list[str]], list[str], str]:
    """(keys by rank, probes, bucket on a miss) of one specifier."""
    here = posixpath.dirname(path)
    if lang == "go":
        # its own prefixes, longest first: a look at every module for every specifier would be quadratic
        module = next((m for m in (spec, *(spec[:i] for i in range(len(spec) - 1, 0, -1) if spec[i] == "/")) if m in c.go_modules), None)
        return ([[f"dir:go:{_norm(c.go_modules[module], spec[len(module) + 1 :])}"]], [], "unresolved") if module is not None else ([], [], "external")
    if lang in ("javascript", "typescript"):
        if spec.startswith("."):
            return [[k] for k in _js_forms(_norm(here, spec))], [], "unresolved"
        for pattern, targets in sorted(c.aliases, key=lambda a: -len(a[0])):
            head, star, tail = pattern.partition("*")
            if spec == pattern or (star and spec.startswith(head) and spec.endswith(tail)):
                mid = spec[len(head) : len(spec) - len(tail) or None]
                return [[k] for t in targets for k in _js_forms(t.replace("*", mid))], [], "unresolved"
        return [], [], "external"
    if lang == "python":
        module, _, name = spec.partition(":")
        dots = len(module) - len(module.lstrip("."))
        tail = module[dots:].replace(".", "/")
        bases = [_norm(here, *[".."] * (dots - 1))] if dots else c.python_roots
        keys = []
        for b in bases:
            target = _norm(b, tail)
            keys.append([k for p in ([f"{target}/{name}".lstrip("/")] if name else []) for k in _f(f"{p}.py", f"{p}/__init__.py")] + _f(f"{target}.py" if target else "", f"{target}/__init__.py".lstrip("/")))
        first = tail.split("/")[0]
        return keys, [f"pyroot:{first}"], "unresolved" if dots else "external"
    if lang in ("java", "kotlin", "scala"):
        if spec.startswith(SCALA_STD if lang == "scala" else JVM_STD):
            return [], [], "external"
        wild, name = spec.endswith((".*", "._")), re.sub(r"\.[*_]$", "", spec)
        keys = [[f"pkg:{name}"]] if wild else []
        own = name.replace(".", "/")
        exts = (".scala", ".java") if lang == "scala" else (".java", ".kt")
        keys.append([f"file:{r}{own}{e}" for r in (SCALA_ROOTS if lang == "scala" else JVM_ROOTS) for e in exts])
        keys.append([f"fqn:{name}"] + ([f"pkg:{name}"] if lang == "scala" else []))
        if name.rpartition(".")[2][:1].islower():
            up = name.rpartition(".")[0]
            keys += [[f"file:{r}{up.replace('.', '/')}{e}" for r in JVM_ROOTS for e in exts], [f"fqn:{up}"]]
        return keys, [], "unresolved"
    if lang in ("csharp", "razor"):
        if kind == "type":
            return [[f"fqn:{spec}"], [f"only:{spec}"]] if "." not in spec else [[f"fqn:{spec}"]], [f"short:{spec.rpartition('.')[2]}"], "external"
        if spec.split(".")[0] in CS_STD:
            return [], [], "external"
        if kind == "static":
            return [[f"fqn:{spec}"]], [f"nsroot:{spec.split('.')[0]}"], "external"
        return [[f"ns:{spec}"]], [f"nstree:{spec}"], "external"
    if lang == "ruby":
        ext = "" if spec.endswith(".rb") else ".rb"
        if kind == "rel":
            return [_f(_norm(here, spec) + ext)], [], "unresolved"
        return [_f(_norm(r, spec) + ext) for r in ("lib", "app", "src", "")], [], "external"
    if lang == "rust":
        stem = posixpath.basename(path).rpartition(".")[0]
        inside = here if stem in ("mod", "lib", "main") else _norm(here, stem)
        if kind == "mod":
            return [_f(_norm(inside, spec) + ".rs", _norm(inside, spec) + "/mod.rs"), _f(_norm(here, spec) + ".rs", _norm(here, spec) + "/mod.rs")], [], "external"
        parts = [p for p in spec.split("::") if p]
        if not parts or parts[0] not in ("crate", "self", "super"):
            return [], [], "external"
        crate = path[: path.rindex("src/") + 3] if "src/" in path else here
        base = crate if parts[0] == "crate" else inside if parts[0] == "self" else posixpath.dirname(inside)
        rest = parts[1:]
        while rest and rest[0] == "super":
            base, rest = posixpath.dirname(base), rest[1:]
        keys = [_f(_norm(base, *rest[:n]) + ".rs", _norm(base, *rest[:n]) + "/mod.rs") for n in range(len(rest), 0, -1)]
        return [*keys, _f(f"{base}/mod.rs", f"{base}.rs", f"{base}/lib.rs", f"{base}/main.rs")], [], "unresolved"
    if lang == "zig":
        return ([_f(_norm(here, spec))], [], "unresolved") if spec.endswith(".zig") else ([], [], "external")
    if lang == "lua":
        own = spec.replace(".", "/")
        return [[k for b in dict.fromkeys((here, "", "src", "lua", "lib")) for k in _f(_norm(b, own) + ".lua", _norm(b, own) + "/init.lua")]], [], "external"
    if lang == "julia":
        return ([_f(_norm(here, spec))], [], "unresolved") if kind == "include" else ([], [], "unresolved")
    if lang == "shell":
        return ([], [], "unresolved") if re.search(r"[$`*?\[~]", spec) else ([_f(_norm(here, spec), _norm(spec))], [], "unresolved")
    if lang == "php":
        if kind == "path":
            return [_f(_norm(here, spec), _norm(spec))], [], "unresolved"
        if spec.split("\\")[0] in PHP_VENDOR:
            return [], [], "external"
        own, forms = spec.replace("\\", "/"), []
        for prefix, where in sorted(c.psr4.items(), key=lambda kv: -len(kv[0])):
            if (spec + "\\").startswith(prefix):
                forms.append(_norm(where, spec[len(prefix) :].replace("\\", "/")) + ".php")
        for root in ("src", "app", "lib", ""):
            forms += [_norm(root, own) + ".php", _norm(root, own.partition("/")[2]) + ".php"]
        return [_f(*dict.fromkeys(forms))], [], "unresolved"
    if lang == "dart":
        if spec.startswith("dart:"):
            return [], [], "external"
        if spec.startswith("package:"):
            package, _, rest = spec[8:].partition("/")
            return ([_f(_norm("lib", rest))], [], "unresolved") if package == c.dart_package else ([], [], "external")
        return [_f(_norm(here, spec))], [], "unresolved"
    if lang == "elixir":
        return [[f"mod:{spec}"]], [], "external"
    if lang == "swift":
        return ([], [], "external") if spec in SWIFT_SYSTEM else ([[f"spm:{spec}"]], [f"spmdir:{spec}"], "external")
    return [], [], "external"


def declarations(path: str, lang: str, text: str) -> Iterator[str]:
    """Keys that a file answers to beyond its own path."""
    here = posixpath.dirname(path)
    clean = mask(text, lang) if lang in ("java", "kotlin", "scala", "csharp", "elixir") else ""
    if lang in ("java", "kotlin", "scala"):
        package = ".".join(re.findall(r"^\s*package\s+([\w.]+)", clean, re.M))
        if package:
            yield f"pkg:{package}"
        for name in re.findall(r"^\s*(?:[\w@()]+\s+)*?(?:class|interface|enum|object|trait|record)\s+(\w+)", clean, re.M):
            yield f"fqn:{package}.{name}" if package else f"fqn:{name}"
    elif lang == "csharp":
        spaces = re.findall(r"\bnamespace\s+([\w.]+)", clean)
        for ns in spaces:
            yield f"ns:{ns}"
            yield f"nsroot:{ns.split('.')[0]}"
            parts = ns.split(".")
            yield from (f"nstree:{'.'.join(parts[:n])}" for n in range(1, len(parts) + 1))
        for name in re.findall(r"\b(?:class|interface|struct|enum|record)\s+(\w+)", clean):
            yield f"short:{name}"
            yield from (f"fqn:{ns}.{name}" for ns in spaces or [""])
    elif lang == "elixir":
        yield from (f"mod:{m}" for m in re.findall(r"\bdefmodule\s+([\w.]+)", clean))
    elif lang == "go" and not path.endswith("_test.go"):
        yield f"dir:go:{here}"
    elif lang == "python":
        for root in ("", "src/"):
            if path.startswith(root):
                yield f"pyroot:{path[len(root) :].split('/')[0].removesuffix('.py')}"
    elif lang == "swift":
        for m in re.finditer(r"(?:^|/)(?:Sources|Tests)/([^/]+)/", path):
            yield f"spm:{m[1]}"
            yield f"spmdir:{m[1]}"


def key_table(files: DataFrame, contents: DataFrame | None, declared: DataFrame | None = None) -> DataFrame:
    """key, rel_path: what specifiers can mean here; declared holds the keys of the files if they are known already."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, p) for p, lang, t in zip(frame["rel_path"], frame["lang"], frame["content"], strict=True) for k in dict.fromkeys(declarations(p, lang, t or ""))]
            yield pd.DataFrame(rows, columns=["key", "rel_path"])

    own = declared if declared is not None else files.join(contents, "rel_path", "left").select("rel_path", "lang", "content").mapInPandas(run, "key string, rel_path string")
    # What is only asked for its presence has one row, so that a name that all files share never meets all that ask for
    # it; an Elixir module belongs to the first file that defines it. One pass over the declared keys.
    kind = F.substring_index("key", ":", 1)
    one = own.groupBy("key", F.when(kind.isin(*PROBED, "mod"), "").otherwise(F.col("rel_path")).alias("of")).agg(F.min("rel_path").alias("rel_path"), F.max("rel_path").alias("last"))
    single = (kind == "short") & (F.col("rel_path") == F.col("last"))
    forms = F.when(single, F.array("key", F.concat(F.lit("only"), F.substring("key", 6, 1 << 30)))).otherwise(F.array("key"))
    paths = files.select(F.concat(F.lit("file:"), "rel_path").alias("key"), "rel_path")
    return one.select(F.explode(forms).alias("key"), "rel_path").unionByName(paths)


def resolve(specs: DataFrame, keys: DataFrame, context: Context) -> tuple[DataFrame, DataFrame]:
    """(imports, specs with their bucket). Edges are distinct and never to the file itself."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for p, lang, o, kind, spec in zip(*(frame[c] for c in ("rel_path", "lang", "ord", "kind", "spec")), strict=True):
                ranked, probes, miss = candidates(p, lang, kind, spec, context)
                out += [(p, o, None, None, None, r, k) for r, group in enumerate(ranked) for k in group]
                out += [(p, o, None, None, None, -1, k) for k in probes]
                out.append((p, o, lang, spec, miss, -2, f"spec:{p}:{o}"))  # every specifier has a row, under a key of its own, which alone says what it is
            yield pd.DataFrame(out, columns=["rel_path", "ord", "lang", "spec", "miss", "rank", "key"])

    asked = specs.mapInPandas(run, "rel_path string, ord int, lang string, spec string, miss string, rank int, key string")
    met = asked.join(keys.withColumnRenamed("rel_path", "target_path"), "key", "left").where("target_path is not null or rank = -2")
    hit = F.when((F.col("rank") >= 0) & F.col("target_path").isNotNull(), F.col("rank"))
    per = met.groupBy("rel_path", "ord").agg(*[F.max(c).alias(c) for c in ("lang", "spec", "miss")], F.min(hit).alias("best"), F.max((F.col("rank") == -1) & F.col("target_path").isNotNull()).alias("local"), F.collect_set(F.when(F.col("rank") >= 0, F.struct("rank", "target_path"))).alias("hits"))
    bucket = F.when(F.col("best").isNotNull(), "resolved").when(F.col("local"), "unresolved").otherwise(F.col("miss"))
    found = per.select("rel_path", "lang", "ord", "spec", bucket.alias("bucket"), F.filter("hits", lambda h: h["rank"] == F.col("best")).alias("hits"))
    edges = found.select(F.col("rel_path").alias("source_path"), F.explode("hits").alias("h")).select("source_path", F.col("h.target_path").alias("target_path"))
    return edges.where("target_path is not null and source_path <> target_path").distinct(), found.drop("hits")
