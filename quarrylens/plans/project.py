"""A source tree of twenty languages made from the part and supplier tables.

Each part is a file of one language that imports the part before it of that language; some have a test file.
Each supplier is a manifest of one ecosystem. The templates below say both what the file holds and, beside it,
which rows the engine should read from it; the SQL counterparts are made of the latter alone.

Marks: {n} the part, {m} the one it imports (NONE where there is none), {p} the part before it in number, {d} and {e}
the folder numbers of {n} and {m}, {w} the part's name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.classify import file_class, language
from quarrylens.functions.paths import dir_of
from quarrylens.plans.bind import t


@dataclass
class Shape:
    lang: str
    path: str
    lines: list[str]
    symbols: list[tuple[str, str, int]]
    references: list[tuple[str, int]] = field(default_factory=list)
    #: (kind, specifier, bucket where the imported part exists, bucket where it doesn't, path of the target or "")
    specs: list[tuple[str, str, str, str, str]] = field(default_factory=list)
    #: folder whose files a specifier means, where it means a folder: the field of the part that names it
    folder: str = ""
    test: str = ""
    kind: str = "source"


RES, EXT, UN = "resolved", "external", "unresolved"
SHAPES = [
    Shape("python", "py/p{d}/mod{n}.py", ['"""About {w}: not_called(1)."""', "import os", "from py.p{e}.mod{m} import Thing{m}", "LIMIT_{n} = 3", "", "# @context: keeps {w}", "class Thing{n}:", "    def run{n}(self):", "        return helper{n}(Thing{m}())", "", "def helper{n}(x):", "    return x"],
          [("LIMIT_{n}", "constant", 4), ("Thing{n}", "class", 7), ("run{n}", "method", 8), ("helper{n}", "function", 11)], [("helper{n}", 9), ("Thing{m}", 9)], [("import", "os", EXT, EXT, ""), ("from", "py.p{e}.mod{m}:Thing{m}", RES, UN, "py/p{e}/mod{m}.py")], test="tests/py/p{d}/test_mod{n}.py"),
    Shape("go", "go/k{d}/f{n}.go", ["package k{d}", "", "import (", '\t"fmt"', '\t"acme.dev/app/go/k{e}"', ")", "", "// @context(Box{n}): see called(2)", "const (", "\tLow{n} = 1", "\tHigh{n} = 2", ")", "type Box{n} struct {", "\tA int", "}", 'func (b *Box{n}) Run{n}() { fmt.Println("{w} no(3)") }', "func Make{n}() int { return Use{m}(1) }"],
          [("Low{n}", "constant", 10), ("High{n}", "constant", 11), ("Box{n}", "struct", 13), ("Run{n}", "method", 16), ("Make{n}", "function", 17)], [("Println", 16), ("Use{m}", 17)], [("import", "fmt", EXT, EXT, ""), ("import", "acme.dev/app/go/k{e}", RES, RES, "")], folder="e", test="go/k{d}/f{n}_test.go"),
    Shape("javascript", "js/p{d}/m{n}.js", ["import { a{m} } from '../p{e}/m{m}.js';", "import fs from 'fs';", "// {w} import x from './nope'", "export class Box{n} {", "  run{n}(x) {", "    return a{m}(x);", "  }", "}", "export const a{n} = (x) => x;"],
          [("Box{n}", "class", 4), ("run{n}", "method", 5), ("a{n}", "function", 9)], [("a{m}", 6)], [("import", "../p{e}/m{m}.js", RES, UN, "js/p{e}/m{m}.js"), ("import", "fs", EXT, EXT, "")], test="js/p{d}/__tests__/m{n}.test.js"),
    Shape("typescript", "ts/p{d}/m{n}.ts", ["import { a{m} } from '@lib/p{e}/m{m}';", "import type { B } from 'react';", "export interface Shape{n} { x: string }", "export type Alias{n} = string;", "export enum Kind{n} { A, B }", "export function go{n}(s: Shape{n}): string {", "  return a{m}(`{w}`);", "}"],
          [("Shape{n}", "interface", 3), ("Alias{n}", "type", 4), ("Kind{n}", "enum", 5), ("go{n}", "function", 6)], [("a{m}", 7)], [("import", "@lib/p{e}/m{m}", RES, UN, "ts/p{e}/m{m}.ts"), ("import", "react", EXT, EXT, "")]),
    Shape("java", "src/main/java/com/acme/q{d}/T{n}.java", ["package com.acme.q{d};", "import java.util.List;", "import com.acme.q{e}.T{m};", "/** {w} */", "public class T{n} {", "  public int run{n}(int a) {", "    return T{m}.call{m}(a);", "  }", "}"],
          [("T{n}", "class", 5), ("run{n}", "method", 6)], [("call{m}", 7)], [("import", "java.util.List", EXT, EXT, ""), ("import", "com.acme.q{e}.T{m}", RES, UN, "src/main/java/com/acme/q{e}/T{m}.java")], test="src/test/java/com/acme/q{d}/T{n}Test.java"),
    Shape("kotlin", "src/main/kotlin/org/acme/q{d}/K{n}.kt", ["package org.acme.q{d}", "import kotlin.math.max", "import org.acme.q{e}.K{m}", "class K{n} {", "  fun run{n}(a: Int): Int = call{m}(a)", "}"],
          [("K{n}", "class", 4), ("run{n}", "method", 5)], [("call{m}", 5)], [("import", "kotlin.math.max", EXT, EXT, ""), ("import", "org.acme.q{e}.K{m}", RES, UN, "src/main/kotlin/org/acme/q{e}/K{m}.kt")]),
    Shape("csharp", "cs/N{d}/C{n}.cs", ["using System.Text;", "using Acme.N{e};", "namespace Acme.N{d}", "{", "  public class C{n}", "  {", "    public int Size{n} { get; set; }", "    public int Run{n}(int a)", "    {", "      return Call{m}(a);", "    }", "  }", "}"],
          [("C{n}", "class", 5), ("Size{n}", "property", 7), ("Run{n}", "method", 8)], [("Call{m}", 10)], [("using", "System.Text", EXT, EXT, ""), ("using", "Acme.N{e}", RES, RES, "")], folder="e", test="tests/C{n}Tests.cs"),
    Shape("razor", "views/V{n}.cshtml", ['@page "/v{n}"', "@using Acme.N{d}", "@model C{p}", "<p>{w}</p>", "@code {", "  int Add{n}(int a) { return a; }", "}"],
          [("/v{n}", "page", 1), ("C{p}", "model", 3), ("Add{n}", "method", 6)], [], [("using", "Acme.N{d}", RES, RES, ""), ("type", "C{p}", RES, RES, "cs/N{d}/C{p}.cs")], folder="d"),
    Shape("ruby", "lib/r{d}/u{n}.rb", ["require 'json'", "require_relative '../r{e}/u{m}'", "# {w}", "module M{n}", "  class U{n}", "    LIMIT_{n} = 3", "    def run{n}(a)", "      call{m}(a)", "    end", "  end", "end"],
          [("M{n}", "module", 4), ("U{n}", "class", 5), ("LIMIT_{n}", "constant", 6), ("run{n}", "method", 7)], [("call{m}", 8)], [("abs", "json", EXT, EXT, ""), ("rel", "../r{e}/u{m}", RES, UN, "lib/r{e}/u{m}.rb")], test="spec/r{d}/u{n}_spec.rb"),
    Shape("rust", "crate/src/m{n}.rs", ["use std::fmt;", "use crate::m{m}::call{m};", "mod inner{n};", "pub struct S{n} { a: u8 }", "impl S{n} {", "    pub fn run{n}(&self) { call{m}(1) }", "}"],
          [("inner{n}", "module", 3), ("S{n}", "struct", 4), ("run{n}", "function", 6)], [("call{m}", 6)], [("use", "std::fmt", EXT, EXT, ""), ("use", "crate::m{m}::call{m}", RES, UN, "crate/src/m{m}.rs"), ("mod", "inner{n}", EXT, EXT, "")]),
    Shape("zig", "zig/z{n}.zig", ['const std = @import("std");', 'const z{m} = @import("z{m}.zig");', "pub const Box{n} = struct { a: u8 };", "pub fn run{n}() void { call{m}(1); }"],
          [("std", "constant", 1), ("z{m}", "constant", 2), ("Box{n}", "struct", 3), ("run{n}", "function", 4)], [("call{m}", 4)], [("import", "std", EXT, EXT, ""), ("import", "z{m}.zig", RES, UN, "zig/z{m}.zig")]),
    Shape("lua", "lua/l{n}.lua", ['local json = require("cjson")', 'local u = require("l{m}")', "-- {w} called(1)", "local function run{n}(a)", "  return call{m}(a)", "end"],
          [("run{n}", "function", 4)], [("require", 1), ("require", 2), ("call{m}", 5)], [("import", "cjson", EXT, EXT, ""), ("import", "l{m}", RES, EXT, "lua/l{m}.lua")]),
    Shape("julia", "jl/j{n}.jl", ['include("j{m}.jl")', "# {w}", "struct T{n}", "  a", "end", "function run{n}(a)", "  call{m}(a)", "end"],
          [("T{n}", "struct", 3), ("run{n}", "function", 6)], [("include", 1), ("call{m}", 7)], [("include", "j{m}.jl", RES, UN, "jl/j{m}.jl")]),
    Shape("shell", "sh/s{n}.sh", ["#!/bin/sh", ". ./s{m}.sh", 'source "$HOME/x.sh"', "run{n}() {", "  echo {w}", "}"], [("run{n}", "function", 4)], [], [("source", "./s{m}.sh", RES, UN, "sh/s{m}.sh"), ("source", "$HOME/x.sh", UN, UN, "")], kind="script"),
    Shape("php", "app/P{d}/H{n}.php", ["<?php", "namespace App\\P{d};", "use App\\P{e}\\H{m};", "use Symfony\\Console;", "class H{n} {", "  public function run{n}($a) { return call{m}($a); }", "}"],
          [("H{n}", "class", 5), ("run{n}", "method", 6)], [("call{m}", 6)], [("use", "App\\P{e}\\H{m}", RES, UN, "app/P{e}/H{m}.php"), ("use", "Symfony\\Console", EXT, EXT, "")]),
    Shape("dart", "lib/d{n}.dart", ["import 'dart:io';", "import 'package:acme/d{m}.dart';", "class D{n} {", "  int run{n}(int a) { return call{m}(a); }", "}"],
          [("D{n}", "class", 3), ("run{n}", "method", 4)], [("call{m}", 4)], [("import", "dart:io", EXT, EXT, ""), ("import", "package:acme/d{m}.dart", RES, UN, "lib/d{m}.dart")]),
    Shape("scala", "src/main/scala/net/acme/s{d}/S{n}.scala", ["package net.acme.s{d}", "import scala.util.Try", "import net.acme.s{e}.{S{m}, Gone{m}}", "class S{n} {", "  def run{n}(a: Int) = call{m}(a)", "}"],
          [("S{n}", "class", 4), ("run{n}", "method", 5)], [("call{m}", 5)], [("import", "scala.util.Try", EXT, EXT, ""), ("import", "net.acme.s{e}.S{m}", RES, UN, "src/main/scala/net/acme/s{e}/S{m}.scala"), ("import", "net.acme.s{e}.Gone{m}", UN, UN, "")]),
    Shape("elixir", "ex/e{n}.ex", ["defmodule Acme.E{n} do", "  alias Acme.E{m}", "  alias Ecto.Repo", "  def run{n}(a), do: call{m}(a)", "end"],
          [("Acme.E{n}", "module", 1), ("run{n}", "function", 4)], [("call{m}", 4)], [("module", "Acme.E{n}", RES, RES, ""), ("module", "Acme.E{m}", RES, EXT, "ex/e{m}.ex"), ("module", "Ecto.Repo", EXT, EXT, "")]),
    Shape("swift", "Sources/Mod{d}/w{n}.swift", ["import Foundation", "import Mod{e}", "struct W{n} {", "  func run{n}(a: Int) { call{m}(a) }", "}"],
          [("W{n}", "struct", 3), ("run{n}", "method", 4)], [("call{m}", 4)], [("import", "Foundation", EXT, EXT, ""), ("import", "Mod{e}", RES, RES, "")], folder="e"),
]
#: The number that stands for a part that isn't there.
K, FOLDER, NONE = len(SHAPES), 8, 999_999_999
#: (manifest, ecosystem, text, [(dependency, version)], {dependency: framework}) of a supplier's service; {j} is the supplier.
SERVICES: list[tuple[str, str, str, list[tuple[str, str]], dict[str, str]]] = [
    ("go.mod", "go", "module ex.com/s{j}\n\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.1\n\tex.org/own{j} v0.{j}.0\n\tex.org/far v1.0.0 // indirect\n)\n", [("github.com/gin-gonic/gin", "v1.9.1"), ("ex.org/own{j}", "v0.{j}.0")], {"github.com/gin-gonic/gin": "Gin"}),
    ("package.json", "npm", '{"name": "s{j}", "dependencies": {"react": "^18", "own{j}": "1.0.{j}"}, "devDependencies": {"@nestjs/testing": "10"}}', [("react", "^18"), ("own{j}", "1.0.{j}"), ("@nestjs/testing", "10")], {"react": "React", "@nestjs/testing": "NestJS"}),
    ("requirements.txt", "pypi", "# {j}\nDjango>=4.2\nown_{j}[x]==1.{j} ; python_version > '3'\n-r other.txt\n", [("django", ">=4.2"), ("own-{j}", "==1.{j}")], {"django": "Django"}),
    ("pyproject.toml", "pypi", '[project]\nname = "s{j}"\ndependencies = ["fastapi>=0.1", "own{j}"]\n[tool.poetry.dependencies]\npython = "^3.11"\nCelery = {version = "5.{j}"}\n', [("fastapi", ">=0.1"), ("own{j}", ""), ("celery", "5.{j}")], {"fastapi": "FastAPI", "celery": "Celery"}),
    ("Cargo.toml", "cargo", '[package]\nname = "s{j}"\n[dependencies]\naxum = "0.7"\nown{j} = { version = "0.{j}" }\n', [("axum", "0.7"), ("own{j}", "0.{j}")], {"axum": "Axum"}),
    ("Gemfile", "gem", "source 'https://ex.org'\ngem 'rails', '7.{j}'\ngem \"own{j}\"\n", [("rails", "7.{j}"), ("own{j}", "")], {"rails": "Rails"}),
    ("mix.exs", "hex", 'defp deps do\n  [{:phoenix, "~> 1.7"}, {:own{j}, "0.{j}"}]\nend\n', [("phoenix", "~> 1.7"), ("own{j}", "0.{j}")], {"phoenix": "Phoenix"}),
    ("app.csproj", "nuget", '<Project><ItemGroup><PackageReference Include="xunit.core" Version="2.{j}" /><PackageReference Include="Own{j}" Version="1.0" /></ItemGroup></Project>', [("xunit.core", "2.{j}"), ("Own{j}", "1.0")], {"xunit.core": "xUnit"}),
    ("pom.xml", "maven", "<project><dependencies><dependency><groupId>org.springframework.boot</groupId><artifactId>spring-boot-starter</artifactId><version>3.{j}</version></dependency></dependencies></project>", [("org.springframework.boot:spring-boot-starter", "3.{j}")], {"org.springframework.boot:spring-boot-starter": "Spring Boot"}),
    ("build.gradle", "maven", "plugins { id 'io.quarkus' }\ndependencies { implementation 'org.springframework:spring-core:6.{j}' }\n", [("org.springframework:spring-core", "6.{j}"), ("io.quarkus:quarkus-plugin", "")], {"io.quarkus:quarkus-plugin": "Quarkus"}),
    ("pubspec.yaml", "pub", "name: s{j}\ndependencies:\n  dio: ^5.{j}.0\n  own{j}: any\n", [("dio", "^5.{j}.0"), ("own{j}", "any")], {"dio": "dio"}),
    ("build.sbt", "sbt", 'libraryDependencies += "org.scalatest" %% "scalatest" % "3.{j}"\n', [("org.scalatest:scalatest", "3.{j}")], {"org.scalatest:scalatest": "ScalaTest"}),
]
SCRIPT = "if __name__ == '__main__':\n    go{j}()\n"
ROOT = [("go.mod", "module acme.dev/app\n"), ("tsconfig.json", '{"compilerOptions": {"paths": {"@lib/*": ["./ts/*"],},} /* loose */}'), ("composer.json", '{"autoload": {"psr-4": {"App\\\\": "app/"}}}'), ("pubspec.yaml", "name: acme\n")]


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def _parts(s: SparkSession, d: str) -> DataFrame:
    """k and the marks of every part."""
    n = F.col("p_partkey").cast("long")
    p = t(s, d, "part").select((n % K).alias("k"), n.alias("n"), F.when(n >= K, n - K).otherwise(NONE).alias("m"), (n - 1).alias("p"), F.col("p_name").alias("w"))
    folder = lambda c: F.floor(F.floor(F.col(c) / K) / FOLDER)
    return p.withColumns({"d": folder("n"), "e": F.when(F.col("m") == NONE, F.lit(0).cast("long")).otherwise(folder("m"))})


def _filled(form: Column, marks: str = "nmpdew") -> Column:
    for c in marks:
        form = F.replace(form, F.lit(f"{{{c}}}"), F.col(c).cast("string"))
    return form


#: (path, text) of every file that parts stand for, and which of them a part of each shape has: its own, a test, a note beside it, a test without a source.
TEMPLATES = [(x.path, "\n".join(x.lines) + "\n") for x in SHAPES]
_OF_SHAPE = [[i] for i in range(K)]
for _k, (_form, _text) in [*((k, (x.test, "")) for k, x in enumerate(SHAPES) if x.test), *((k, ("lua/.context/l{n}.md", "side of {w}")) for k, x in enumerate(SHAPES) if x.lang == "lua"), (3, ("t/lost{n}.test.ts", ""))]:
    _OF_SHAPE[_k].append(len(TEMPLATES))
    TEMPLATES.append((_form, _text))


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Short rows go to all cores before they become files: a table in one piece would be written out and read by one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def tree(s: SparkSession, d: str) -> DataFrame:
    """The files relation with the text of each file as `content`: one scan for each table, no join, and no text is made that isn't read."""
    of = F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in _OF_SHAPE]), (F.col("k") + 1).cast("int"))
    parts = _spread(_parts(s, d), "n").withColumn("i", F.explode(of))
    parts = parts.select(*(_filled(_pick([x[at] for x in TEMPLATES], F.col("i"))).alias(name) for at, name in enumerate(("rel_path", "content"))))
    k = F.col("k")
    j = _spread(t(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("j"), (F.col("s_suppkey") % len(SERVICES)).alias("k")), "j")
    broken = (k == 1) & (F.col("j") % 5 == 0)
    texts = F.when(broken, "{").otherwise(_filled(_pick([x[2] for x in SERVICES], k), "j"))
    own = F.when(k == 2, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    name = F.when(F.col("script"), "manage.py").otherwise(_pick([x[0] for x in SERVICES], k))
    services = j.withColumn("script", F.explode(own)).select(F.concat(F.lit("svc/s"), "j", F.lit("/"), name).alias("rel_path"), F.when(F.col("script"), _filled(F.lit(SCRIPT), "j")).otherwise(texts).alias("content"))
    every = parts.unionByName(services).unionByName(s.createDataFrame(ROOT, "rel_path string, content string"))
    p = F.col("rel_path")
    return every.select("rel_path", dir_of(p).alias("dir"), language(p).alias("lang"), file_class(p).alias("class"), F.length("content").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), "content")


def contents(s: SparkSession, d: str) -> DataFrame:
    return tree(s, d).select("rel_path", "content")


def files(s: SparkSession, d: str) -> DataFrame:
    return tree(s, d).drop("content")


def part_paths(s: SparkSession, d: str) -> DataFrame:
    return _parts(s, d).select(F.col("n").alias("part"), _filled(_pick([x.path for x in SHAPES], F.col("k"))).alias("rel_path"))


def commits(s: SparkSession, d: str) -> DataFrame:
    """Orders as commits of the files of their parts."""
    lines = t(s, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part")).distinct().join(part_paths(s, d), "part")
    sets = lines.groupBy(F.col("l_orderkey").alias("hash")).agg(F.collect_set("rel_path").alias("files"))
    orders = t(s, d, "orders").select(F.col("o_orderkey").alias("hash"), F.col("o_orderdate").alias("date"))
    return orders.join(sets, "hash").select("hash", "date", "files", F.lit(False).alias("is_root"))


# --- DuckDB: the rows that the templates promise ---


def _lit(v: object) -> str:
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def _fill_sql(form: str, marks: str = "nmpdew") -> str:
    for c in marks:
        form = f"replace({form}, '{{{c}}}', {c}::varchar)"
    return form


PARTS_SQL = f"parts as (select *, n // {K} // {FOLDER} as d, case when m = {NONE} then 0 else m // {K} // {FOLDER} end as e from (select p_partkey::bigint % {K} as k, p_partkey::bigint as n, case when p_partkey >= {K} then p_partkey::bigint - {K} else {NONE} end as m, p_partkey::bigint - 1 as p, p_name as w from part))"
PATHS_SQL = "own as (select parts.*, " + _fill_sql("path") + " as rel_path, lang from parts join (values " + ", ".join(f"({i}, {_lit(x.path)}, {_lit(x.lang)})" for i, x in enumerate(SHAPES)) + ") v(i, path, lang) on k = i)"


def promised(name: str, cols: str, rows: list[tuple], filled: list[str]) -> str:
    """A CTE of rows for each part; rows are (shape, ...)."""
    listed = [c.strip() for c in cols.split(",")]
    values = ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in rows)
    out = ", ".join((_fill_sql("v." + c) + f" as {c}") if c in filled else f"v.{c}" for c in listed)
    return f"{name} as (select own.rel_path, own.lang, own.k, own.n, own.m, own.d, own.e, {out} from own join (values {values}) v(i, {', '.join(listed)}) on own.k = v.i)"


SYMBOLS_SQL = promised("syms", "name, kind, line", [(i, *x) for i, f in enumerate(SHAPES) for x in f.symbols], ["name"])
REFS_SQL = promised("refs_", "name, line", [(i, *x) for i, f in enumerate(SHAPES) for x in f.references], ["name"])
SPECS_SQL = promised("specs_", "kind, spec, known, unknown, target", [(i, *x) for i, f in enumerate(SHAPES) for x in f.specs], ["spec", "target"])
TESTS_SQL = promised("tests_", "test_path", [(i, f.test) for i, f in enumerate(SHAPES) if f.test] + [(3, "t/lost{n}.test.ts")], ["test_path"])
_RUST, _RAZOR, _CSHARP = (next(i for i, x in enumerate(SHAPES) if x.lang == lang) for lang in ("rust", "razor", "csharp"))
#: Edges to single files that exist, and to the files of a folder.
EDGES_SQL = f"""edges_ as (select distinct rel_path as source_path, target as target_path, lang from specs_ where target <> '' and (m <> {NONE} or k = {_RAZOR}) and rel_path <> target
union select a.rel_path, b.rel_path, a.lang from own a join (values {", ".join(f"({i}, {_CSHARP if i == _RAZOR else i}, '{x.folder}')" for i, x in enumerate(SHAPES) if x.folder)}) v(i, j, f) on a.k = i join own b on b.k = j and b.d = case when f = 'd' then a.d else a.e end where a.rel_path <> b.rel_path)"""
BUCKETS_SQL = f"buckets_ as (select rel_path, lang, spec, case when m <> {NONE} then known else unknown end as bucket from specs_)"
SERVICES_SQL = "services as (select s_suppkey::bigint as j, s_suppkey % 12 as k, 'svc/s' || s_suppkey || '/' || manifest as manifest, ecosystem, s_suppkey % 12 = 1 and s_suppkey % 5 = 0 as broken from supplier join (values " + ", ".join(f"({i}, {_lit(x[0])}, {_lit(x[1])})" for i, x in enumerate(SERVICES)) + ") v(i, manifest, ecosystem) on s_suppkey % 12 = i)"
DEPS_SQL = "deps as (select " + _fill_sql("name", "j") + " as name, " + _fill_sql("version", "j") + " as version, manifest, ecosystem, framework from services join (values " + ", ".join(f"({i}, {_lit(n)}, {_lit(v)}, {_lit(x[4].get(n, ''))})" for i, x in enumerate(SERVICES) for n, v in x[3]) + ") v(i, name, version, framework) on k = i where not broken)"
CTES = [PARTS_SQL, PATHS_SQL, SYMBOLS_SQL, REFS_SQL, SPECS_SQL, TESTS_SQL, EDGES_SQL, BUCKETS_SQL, SERVICES_SQL, DEPS_SQL]


def sql(select: str) -> str:
    return "with " + ",\n".join(CTES) + "\n" + select
