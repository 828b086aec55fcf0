"""Which source a test file tests.

Stems come from the test's name: exact ones (affixes stripped, longest first, then the name itself), then
fuzzy ones (trailing name parts dropped). A candidate is a source or script file of a fitting extension with
that stem, scored 4 in the same directory, 3 in the mirrored one, 2 in the paired project, else 0; it is
accepted with a score of 2, or if an exact stem has no rival. Imports and name prefixes are tried last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.classify import test_kind
from quarrylens.functions.paths import dir_of, ext_of, stem_of

_AFFIXES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {}
for _exts, _suffixes, _prefixes in (
    ("go zig", "_test", ""), ("js jsx mjs cjs ts tsx mts", ".test .spec -test _test .e2e .integration", ""), ("py pyw", "_test _tests", "test_"), ("rb", "_spec _test", "test_"), ("ex exs", "_test", ""),
    ("java kt kts scala groovy", "IntegrationTests IntegrationTest Tests Test Specs Spec Suite IT", "Test"), ("cs fs", "IntegrationTests Tests Test Specs Spec", ""), ("swift php", "Tests Test", ""), ("dart lua", "_test _spec", ""),
    ("rs erl clj", "_tests _test _SUITE", "test_"), ("c h cpp cc cxx hpp", "_unittest _test _tests Test", "test_"), ("jl r", "_test", "test_ test-"), ("sh bash zsh ps1 psm1", "_test .test .Tests", "test_"),
):
    for _e in _exts.split():
        _AFFIXES[_e] = (tuple(sorted(_suffixes.split(), key=len, reverse=True)), tuple(_prefixes.split()))
FAMILIES = [set("js jsx mjs cjs ts tsx mts vue svelte".split()), set("ex exs".split()), set("java kt kts scala groovy".split()), set("c h cpp cc cxx hpp".split()), set("sh bash zsh".split()), set("ps1 psm1".split()), set("py pyw".split()), set("cs fs razor".split())]
TEST_SEGMENTS = set("test tests spec specs __tests__ __test__ testing e2e it integration-tests".split())
DROPPED = set("unit integration functional feature features acceptance e2e smoke".split())
SOURCE_ROOTS = ["src", "lib", "app", "main", "internal", "pkg", "source", "sources"]
MAPPABLE = sorted(_AFFIXES)


def stems(name: str) -> list[tuple[int, str]]:
    """(tier, stem): 0 exact, 1 fuzzy, in the order in which they are tried."""
    stem, _, ext = name.rpartition(".")
    suffixes, prefixes = _AFFIXES.get(ext.lower(), ((), ()))
    exact = []
    for s in suffixes:
        if stem.endswith(s) and len(stem) > len(s):
            exact.append(stem[: -len(s)])
    for p in prefixes:
        if stem.startswith(p) and len(stem) > len(p):
            exact.append(stem[len(p) :])
    exact.append(stem)
    fuzzy = []
    for e in exact[:-1] or exact:
        parts = re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])|[_.\-]", e)
        for n in range(len(parts) - 1, 0, -1):
            cut = "".join(parts[:n]).rstrip("_.-")
            if cut and cut not in exact and cut not in fuzzy:
                fuzzy.append(cut)
    return [(0, e) for e in dict.fromkeys(exact)] + [(1, f) for f in fuzzy]


def mirrors(directory: str) -> list[str]:
    """Directories that mirror a test's: test segments dropped or exchanged for a source root."""
    parts = [p for p in directory.split("/") if p]
    at = [i for i, p in enumerate(parts) if p.lower() in TEST_SEGMENTS][:3]
    if not at:
        return []
    out = []
    for i in at:
        rest = [p for j, p in enumerate(parts) if j != i and p.lower() not in DROPPED]
        out.append("/".join(rest))
        for root in SOURCE_ROOTS:
            out.append("/".join([root if j == i else p for j, p in enumerate(parts) if j == i or p.lower() not in DROPPED]))
    every = [p for p in parts if p.lower() not in TEST_SEGMENTS | DROPPED]
    out += ["/".join(every), *("/".join([r, *every]) for r in SOURCE_ROOTS)]
    return list(dict.fromkeys(out))


def project(directory: str) -> str:
    """The project that a test project's directory is paired with, "" where it is none."""
    m = re.match(r"^(.*?)([^/]+?)[.\-_](?:Unit|Integration)?Tests?(?:/|$)", directory, re.I)
    return (m[1] + m[2]) if m else ""


def _family(ext: Column) -> Column:
    """The same for extensions that stand for each other."""
    out = None
    for i, f in enumerate(FAMILIES):
        out = F.when(ext.isin(*sorted(f)), f"/{i}") if out is None else out.when(ext.isin(*sorted(f)), f"/{i}")
    return out.otherwise(ext)


def tests(files: DataFrame, imports: DataFrame) -> DataFrame:
    """test_path, source_path ("" where nothing is accepted), kind of every test file.

    Tests and sources are each read once: both say under which keys they can meet, and one join brings them together.
    Keys begin with n (all that a name can mean), c (a name in one directory), p (a name, for paired projects) or l (how
    a name begins); s is the row that every test has.
    """
    c, nul = F.col, F.lit("\0")
    own = files.where("class = 'test'").select("rel_path", ext_of(c("rel_path")).alias("ext"))

    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, ext in zip(frame["rel_path"], frame["ext"], strict=True):
                d, _, name = path.rpartition("/")
                rows.append((path, d, ext[1:], None, "", -1, -1, None))
                for o, (tier, stem) in enumerate(stems(name) if ext[1:] in _AFFIXES else []):
                    rows.append((path, d, ext[1:], mirrors(d), project(d), tier, o, stem))
            yield pd.DataFrame(rows, columns=["test_path", "dir", "ext", "mirrors", "project", "tier", "ord", "stem"])

    forms = own.mapInPandas(asked, "test_path string, dir string, ext string, mirrors array<string>, project string, tier int, ord int, stem string")
    spelt = F.concat(_family(c("ext")), nul, F.lower("stem"))
    text, texts = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    probe = lambda key, score=0, d=text, m=texts, p=text: F.struct(F.concat(*key).alias("key"), F.lit(score).alias("score"), d.alias("dir"), m.alias("mirrors"), p.alias("project"))
    at = lambda d, score: probe([F.lit("c"), spelt, nul, d], score)
    paired = F.when(c("project") != "", probe([F.lit("p"), spelt], 2, p=c("project")))
    leading = F.when(c("tier") == 0, probe([F.lit("l"), _family(c("ext")), nul, c("stem")], 0, c("dir"), c("mirrors"), c("project")))
    probes = F.concat(F.array(probe([F.lit("n"), spelt]), at(c("dir"), 4), paired, leading), F.transform("mirrors", lambda m: at(m, 3)))
    probes = F.when(c("stem").isNull(), F.array(probe([F.lit("s"), c("test_path")]))).otherwise(probes)
    asks = forms.select("test_path", "ext", "tier", "ord", "stem", F.explode(probes).alias("at")).where("at is not null").select("test_path", "ext", "tier", "ord", "stem", "at.*")

    source = files.where(c("class").isin("source", "script")).select(c("rel_path").alias("source_path"))
    source = source.select("source_path", dir_of(c("source_path")).alias("sdir"), F.substring(ext_of(c("source_path")), 2, 20).alias("sext"), stem_of(c("source_path")).alias("sstem"))
    family, name = F.concat(_family(c("sext")), nul), F.concat(_family(c("sext")), nul, F.lower("sstem"))
    # a stem of two parts or more that begins the source's
    begins = F.transform(F.sequence(F.lit(2), F.greatest(F.length("sstem") - 1, F.lit(2))), lambda n: F.substring(c("sstem"), F.lit(1), n))
    begins = F.filter(begins, lambda x: x.rlike("[a-z0-9][A-Z_.-]") & (x != c("sstem")))
    keys = F.concat(F.array(F.concat(F.lit("n"), name), F.concat(F.lit("c"), name, nul, "sdir"), F.concat(F.lit("p"), name)), F.transform(begins, lambda x: F.concat(F.lit("l"), family, x)))
    # of what a name can mean there is one row for each spelling and extension, so a name that thousands of files share stays one row
    meant = source.withColumn("key", F.explode(keys)).groupBy("key", "sstem", "sext", F.when(c("key").startswith("n"), "").otherwise(c("source_path")).alias("of"))
    meant = meant.agg(F.count("*").alias("n"), F.min("source_path").alias("source_path"), F.min("sdir").alias("sdir"))

    met = asks.join(meant, "key", "left").withColumn("kind", F.substring("key", 1, 1)).withColumn("fold", (c("stem") != c("sstem")).cast("int"))
    inside = c("sdir").startswith(c("project")) | F.lower("sdir").contains(F.concat(F.lit("/"), F.lower("project")))
    near = F.when(c("sdir") == c("dir"), 4).when(F.array_contains("mirrors", c("sdir")), 3).when((c("project") != "") & inside, 2).otherwise(0)
    met = met.withColumn("score", F.when(c("kind") == "l", near).otherwise(c("score")))
    met = met.where((c("kind") == "s") | (c("source_path").isNotNull() & (c("kind").isin("n", "c") | ((c("kind") == "l") & (c("score") >= 2)) | ((c("kind") == "p") & inside))))
    # for each stem: exact case before any case; what is near, and the only one if there is no rival
    of = lambda *kinds: c("kind").isin(*kinds)
    place = F.struct((-c("score")).alias("s"), (c("sext") != c("ext")).alias("other"), "source_path")
    least = lambda cond: F.min(F.when(cond, place))
    per = met.groupBy("test_path", "tier", "ord").agg(
        F.min(F.when(of("n"), c("fold"))).alias("fold"), F.sum(F.when(of("n") & (c("fold") == 0), c("n"))).alias("n0"), F.sum(F.when(of("n"), c("n"))).alias("n1"),
        *[least(of("c", "p") & (c("fold") == f)).alias(f"near{f}") for f in (0, 1)], *[least(of("n") & (c("fold") == f)).alias(f"only{f}") for f in (0, 1)],
        F.min(F.when(of("l"), F.struct((-c("score")).alias("s"), "source_path"))).alias("first"), F.max(F.when(of("l"), F.struct("score", "source_path"))).alias("last"),
    )
    alone = F.when((c("tier") == 0) & (F.coalesce("n0", "n1") == 1), F.when(c("fold") == 0, c("only0")).otherwise(c("only1")))
    per = per.withColumn("b", F.least(F.when(c("fold") == 0, c("near0")).when(c("fold") == 1, c("near1")), alone))
    one = per.groupBy("test_path").agg(F.min(F.when(c("b").isNotNull(), F.struct("tier", "ord", "fold", "b"))).alias("named"), F.min("first").alias("first"), F.max("last").alias("last"))
    # a name's beginning counts if the nearest source that has it has no equal rival
    begin = F.when(c("first.source_path") == c("last.source_path"), c("first.source_path"))
    # a test that imports the one source of its name
    by_import = forms.where("tier = 0").join(imports.withColumnRenamed("source_path", "test_path"), "test_path").where(F.lower(stem_of(c("target_path"))) == F.lower("stem"))
    by_import = by_import.groupBy("test_path").agg(F.min("target_path").alias("imported"), F.max("target_path").alias("other")).where("imported = other").select("test_path", "imported")
    found = F.coalesce(c("named.b.source_path"), c("imported"), begin, F.lit(""))
    return one.join(by_import, "test_path", "left").select("test_path", found.alias("source_path"), test_kind(c("test_path")).alias("kind"))
