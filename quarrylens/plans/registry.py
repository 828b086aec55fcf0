"""Every query by name, with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions import classify, paths
from quarrylens.operators import extract, grep, history, lookup, maintain, metrics, nearest, related, search
from quarrylens.plans import bind, tree_queries
from quarrylens.plans.bind import sql, t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLE_SQL[name] = oracle
        return fn

    return add


def line_metrics(s: SparkSession, d: str) -> DataFrame:
    return metrics.file_metrics(bind.imports(s, d), history.churn(bind.commit_files(s, d)))


def doc_metrics(s: SparkSession, d: str) -> DataFrame:
    return metrics.file_metrics(bind.doc_imports(s, d), bind.doc_churn(s, d))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in cols})


HEAD, COMMIT = ("imports", "commit_files", "churn", "metrics", "scored"), ("commit_files", "churn")
SMALL_COMMIT = 6


@query("hotspots", sql(*HEAD, select="select rel_path, fan_in, fan_out, churn, round(hotspot_score, 9) as hotspot_score from scored where hotspot_score > 0 order by hotspot_score desc, rel_path limit 20"))
def hotspots(s, d):
    return rounded(metrics.hotspots(line_metrics(s, d), 20), "hotspot_score")


@query("file_metrics", sql(*HEAD, select="select rel_path, fan_in, fan_out, churn, round(hotspot_score, 9) as hotspot_score from scored"))
def file_metrics(s, d):
    return rounded(line_metrics(s, d), "hotspot_score")


@query("fan_in", sql("imports", select="select target_path as rel_path, count(*) as fan_in from imports group by 1"))
def fan_in(s, d):
    return metrics.fan_in(bind.imports(s, d))


@query("fan_out", sql("imports", select="select source_path as rel_path, count(*) as fan_out from imports group by 1"))
def fan_out(s, d):
    return metrics.fan_out(bind.imports(s, d))


@query("churn", sql(*COMMIT, select="select * from churn"))
def churn(s, d):
    return history.churn(bind.commit_files(s, d))


@query("churn_top", sql(*COMMIT, select="select * from churn order by commits desc, file_path limit 25"))
def churn_top(s, d):
    return history.top_churn(churn(s, d), 25)


@query("cochange_pairs", sql("commit_files", "cochange", select="select * from cochange"))
def cochange_pairs(s, d):
    return history.cochange(bind.commit_files(s, d))


@query("cochange_neighbours", sql("commit_files", "cochange", select="select file, count from (select file_b as file, count from cochange where file_a = 'p/12' union all select file_a, count from cochange where file_b = 'p/12') where count >= 1"))
def cochange_neighbours(s, d):
    return history.neighbours(cochange_pairs(s, d), "p/12", 1)


@query("coverage_counts", sql("commits", select="select count(*) as scanned, count(*) filter (len(files) > 0) as with_files, count(*) filter (len(files) > 6) as oversized, count(*) filter (is_root) as root, max(len(files))::bigint as largest from commits"))
def coverage_counts(s, d):
    return history.coverage(bind.commits(s, d), SMALL_COMMIT)


@query("trust_verdict", sql("commits", select="select count(*) as scanned, count(*) filter (len(files) > 0) as with_files, case when count(*) filter (is_root) >= count(*) filter (len(files) > 0) then 'only root commits' else '' end as reason from commits"))
def trust_verdict(s, d):
    return history.trust(history.coverage(bind.commits(s, d), SMALL_COMMIT)).select("scanned", "with_files", "reason")


@query("areas_by_commit", sql("commits", select="select hash, array_to_string(list_sort(list_distinct(list_transform(files, lambda f: string_split(f, '/')[1]))), ',') as areas from commits"))
def areas_by_commit(s, d):
    return bind.commits(s, d).select("hash", F.array_join(F.array_sort(history.areas(F.col("files"))), ",").alias("areas"))


@query("recent_changes", "select event_id as hash, event_type as area from events where ts >= (select max(ts) from events) - interval 7 day")
def recent_changes(s, d):
    events = t(s, d, "events")
    commits = events.select(F.col("event_id").alias("hash"), F.col("ts").alias("date"), F.array(F.concat("event_type", F.lit("/"), "user_id")).alias("files"))
    newest = events.agg(F.max("ts").alias("now"))
    windowed = commits.crossJoin(F.broadcast(newest))  # one row
    return history.recent(windowed, F.col("now") - F.expr("interval 7 days")).select("hash", F.col("areas")[0].alias("area"))


def found(s: SparkSession, d: str, pattern: str, case: str = "smart") -> DataFrame:
    return grep.grep(bind.files(s, d), bind.contents(s, d), bind.symbols(s, d), doc_metrics(s, d), pattern, case)


GREP = ("docs", "files", "lines", "symbols", "doc_imports", "doc_churn", "doc_metrics", "doc_scored")


def grep_sql(cond: str, select: str) -> str:
    hits = f"""hits as (select l.rel_path, l.line, regexp_replace(l.text, '^\\s+|\\s+$', '', 'g')[1:200] as text, coalesce(s.symbol, '') as symbol, coalesce(m.hotspot_score, 0) as hotspot_score,
case when s.symbol is not null then 'definition' when regexp_matches(regexp_replace(l.text, '^\\s+|\\s+$', '', 'g'), '^(//|/\\*|#|\\* |@doc|@moduledoc|@spec)') then 'comment' when f.class = 'test' then 'test' else 'reference' end as type
from lines l join files f using (rel_path) left join (select file_path, line, min(name) as symbol from symbols group by 1, 2) s on s.file_path = l.rel_path and s.line = l.line left join doc_scored m on m.rel_path = l.rel_path
where f.class in ('source', 'test', 'config') and f.size between 1 and 1048576 and {cond})"""
    return "with " + ",\n".join([*(bind.CTES[n] for n in GREP), hits]) + "\n" + select


ROWS = "select rel_path, line, text, type, symbol, round(hotspot_score, 9) as hotspot_score from hits"


@query("grep_literal", grep_sql("contains(l.text, 'Licensed under')", ROWS))
def grep_literal(s, d):
    return rounded(found(s, d, "Licensed under"), "hotspot_score")


@query("grep_regex", grep_sql(r"regexp_matches(l.text, '(?i)\bth[a-z]+ing\b')", ROWS))
def grep_regex(s, d):
    return rounded(found(s, d, r"\bth[a-z]+ing\b", "insensitive"), "hotspot_score")


@query("grep_smart_case", grep_sql(r"regexp_matches(l.text, '^The\b.*[0-9]')", ROWS))
def grep_smart_case(s, d):
    return rounded(found(s, d, r"^The\b.*[0-9]"), "hotspot_score")


@query("grep_summary", grep_sql("contains(lower(l.text), 'tion')", "select count(*) as total, count(*) filter (type = 'definition') as definitions, count(*) filter (type = 'reference') as \"references\", count(*) filter (type = 'comment') as comments, count(*) filter (type = 'test') as tests, count(distinct rel_path) as files from hits"))
def grep_summary(s, d):
    return grep.summary(found(s, d, "tion"))


@query("grep_collapse", grep_sql("contains(l.text, 'License')", "select rel_path, text, type, round(hotspot_score, 9) as hotspot_score, min(line) as line, count(*) - 1 as similar from hits group by all"))
def grep_collapse(s, d):
    return rounded(grep.collapsed(found(s, d, "License")), "hotspot_score")


@query("grep_by_file", grep_sql("contains(l.text, 'Licensed')", "select row_number() over (order by later, cold, rel_path) as rank, rel_path, n, greatest(total - 20, 0) as truncated from (select rel_path, min((type <> 'definition', -hotspot_score, line)) as o, o[1] as later, o[2] as cold, count(distinct (text, type)) as n, (select count(distinct rel_path) from hits) as total from hits group by 1) order by 1 limit 20"))
def grep_by_file(s, d):
    return grep.by_file(found(s, d, "Licensed"), 20).select(F.col("rank").cast("long").alias("rank"), "rel_path", F.size("matches").cast("long").alias("n"), F.col("truncated").cast("long").alias("truncated"))


@query("symbols_exact", sql("docs", "lines", "symbols", select="select file_path, name, kind, line, signature from symbols where name = 'The'"))
def symbols_exact(s, d):
    return lookup.definitions(bind.symbols(s, d), "The")


@query("symbols_search", sql("docs", "lines", "symbols", select="select file_path, name, kind, line, signature from symbols where contains(lower(name), 'ing')"))
def symbols_search(s, d):
    return lookup.symbols(bind.symbols(s, d), "ING", -1)


@query("callers_resolved", sql("docs", "lines", "symbols", "references", "doc_imports", select="""select name, file_path, line,
file_path in (select file_path from symbols where name = 'the' or name = 'The') or regexp_replace(file_path, '/[^/]*$', '') in (select regexp_replace(file_path, '/[^/]*$', '') from symbols where name = 'The')
or file_path in (select source_path from doc_imports where target_path in (select file_path from symbols where name = 'The')) as resolved from refs where name = 'The'""".replace("name = 'the' or ", "")))
def callers_resolved(s, d):
    return lookup.callers(bind.references(s, d), bind.symbols(s, d), bind.doc_imports(s, d), "The")


@query("callers_common", sql("docs", "lines", "symbols", "references", "doc_imports", select="""select name, file_path, line, file_path in (select file_path from symbols where name = 'the')
or regexp_replace(file_path, '/[^/]*$', '') in (select regexp_replace(file_path, '/[^/]*$', '') from symbols where name = 'the') or file_path in (select source_path from doc_imports where target_path in (select file_path from symbols where name = 'the')) as resolved from refs where name = 'the'"""))
def callers_common(s, d):
    return lookup.callers(bind.references(s, d), bind.symbols(s, d), bind.doc_imports(s, d), "the")


@query("imports_of", sql("imports", select="select target_path from imports where source_path = 's/7'"))
def imports_of(s, d):
    return lookup.imports_of(bind.imports(s, d), "s/7")


@query("imported_by", sql("imports", select="select source_path from imports where target_path = 'p/12'"))
def imported_by(s, d):
    return lookup.imported_by(bind.imports(s, d), "p/12")


@query("import_coverage", sql("docs", "stats", select="select lang, count(*) as files, sum(extracted)::bigint as extracted, sum(resolved)::bigint as resolved, sum(external)::bigint as external, sum(unresolved)::bigint as unresolved from stats group by 1"))
def import_coverage(s, d):
    return metrics.import_coverage(bind.doc_stats(s, d))


@query("import_stats_for", sql("docs", "stats", select=f"select rel_path, lang, extracted, external, resolved, unresolved from stats where rel_path = (select {bind.PATH_SQL} from documents where doc_id = 17)"))
def import_stats_for(s, d):
    path = t(s, d, "documents").where("doc_id = 17").select(bind.doc_path().alias("rel_path"))
    return bind.doc_stats(s, d).join(F.broadcast(path), "rel_path", "left_semi").select("rel_path", "lang", "extracted", "external", "resolved", "unresolved")


@query("languages", sql("docs", "files", select="select lang, count(*) as files, round(count(*) * 100.0 / sum(count(*)) over (), 9)::double as percent from files where class in ('source', 'test') and lang <> '' group by 1"))
def languages(s, d):
    return rounded(metrics.languages(bind.files(s, d)).drop("extensions"), "percent")


@query("top_dirs", sql("docs", "files", select="select string_split(rel_path, '/')[1] as dir, count(*) as files, array_to_string(list_sort(list(distinct lang)), ',') as languages from files group by 1"))
def top_dirs(s, d):
    return metrics.top_dirs(bind.files(s, d)).withColumn("languages", F.array_join("languages", ","))


@query("overview_counts", sql("docs", "files", select="select count(*) as files, count(*) filter (class = 'test') as tests, count(distinct dir) as dirs from files"))
def overview_counts(s, d):
    return metrics.file_counts(bind.files(s, d))


@query("classify", sql("docs", "files", select="select rel_path, lang, class from files"))
def classified(s, d):
    return bind.files(s, d).select("rel_path", "lang", "class")


@query("dir_purpose", "select p_name, case when n in ('tests') then 'test' when n in ('docs') then 'docs' when n = 'cmd' then 'entrypoint' when n = 'api' then 'backend' else 'source' end as purpose from (select p_name, ['tests','docs','cmd','api','core'][p_size % 5 + 1] as n from part)")
def dir_purpose(s, d):
    names = F.element_at(F.array(*map(F.lit, ("tests", "docs", "cmd", "api", "core"))), (F.col("p_size") % 5 + 1).cast("int"))
    return t(s, d, "part").select("p_name", classify.dir_purpose(F.concat(F.lit("x/"), names)).alias("purpose"))


@query("test_kind", "select o_orderkey, case when o_orderpriority like '1%' then 'e2e' when o_orderpriority like '2%' then 'integration' else 'unit' end as kind from orders")
def test_kind(s, d):
    name = F.when(F.col("o_orderpriority").startswith("1"), "tests/e2e/a").when(F.col("o_orderpriority").startswith("2"), "tests/Integration/b").otherwise("tests/c")
    return t(s, d, "orders").select("o_orderkey", classify.test_kind(name).alias("kind"))


@query("high_fan_in", sql(*HEAD, select="select rel_path, fan_in from metrics where fan_in >= (select list_sort(list(fan_in))[(floor(0.9 * (count(*) - 1)))::int + 1] from metrics where fan_in > 0)"))
def high_fan_in(s, d):
    return metrics.high_fan_in(line_metrics(s, d), 0.9).select("rel_path", "fan_in")


PLAIN = r"""^\s*($|import\b|from\b.*\bimport\b|using\b|#include|package\b|require\b|use\b|//|/\*|\*|#|--|[{}()\[\];]+\s*$)"""
SHOWN = "shown as (select rel_path, array_to_string(list_filter(string_split(text[1:131072], chr(10))[1:200], lambda x: not regexp_matches(x, '" + PLAIN + "'))[1:5], chr(10)) as preview from docs join files using (rel_path) where class = 'source')"
SEARCH = """named as (select file_path as rel_path, case when lower(name) = 'ing' then 1.0 when starts_with(lower(name), 'ing') then 0.9 else 0.7 end as w, 0 as tier, lower(name) = 'ing' as exact from symbols where contains(lower(name), 'ing')
union all select rel_path, case when contains(lower(string_split(rel_path, '/')[-1]), 'ing') then 0.6 else 0.4 end, 1, false from files where class in ('source', 'test', 'config') and contains(lower(rel_path), 'ing')
union all select rel_path, 0.3, 2, false from shown where contains(lower(preview), 'ing')),
texts as (select rel_path, 0.2 as w, 3 as tier, false as exact from docs join files using (rel_path) where class in ('source', 'test', 'config') and contains(lower(text), 'ing') and rel_path not in (select rel_path from named)),
summed as (select rel_path, least(1.0, sum(w))::double as s, arg_min(tier, (-w, tier)) as tier, bool_or(exact) as exact from (from named union all from texts) group by 1)
select rel_path, round((case when class = 'test' and not exact and (select bool_or(class <> 'test') from summed join files using (rel_path)) then s * 0.85 else s end)::double, 9) as score, ['symbol', 'file_path', 'preview', 'content'][tier + 1] as tier
from summed join files using (rel_path) order by score desc, rel_path limit 30"""


@query("search_ranked", sql("docs", "files", "lines", "symbols", select=SEARCH).replace("\nnamed as", ",\n" + SHOWN + ",\nnamed as", 1))
def search_ranked(s, d):
    previews = extract.extras(bind.files(s, d), bind.contents(s, d))
    return search.search(bind.files(s, d), bind.symbols(s, d), previews, bind.contents(s, d), "ING", 30).drop("context")


def target(s: SparkSession, d: str) -> str:
    return t(s, d, "documents").where("doc_id = 6").select(bind.doc_path()).first()[0]


def doc_commits(s: SparkSession, d: str) -> DataFrame:
    """Commits of neighbouring documents: blocks of 4, 6 and 12."""
    docs = t(s, d, "documents").select("doc_id", bind.doc_path().alias("file"))
    return docs.select(F.explode(F.array(*[F.concat(F.lit(f"{n}/"), F.expr(f"doc_id div {n}")) for n in (4, 6, 12)])).alias("hash"), "file").distinct()


def busy_imports(s: SparkSession, d: str) -> DataFrame:
    """Each document imports the one of half its number, and all German ones import the one that is asked for."""
    docs = t(s, d, "documents").select("lang", bind.doc_path().alias("source_path"))
    busy = docs.where("lang = 'de'").select("source_path", F.lit(target(s, d)).alias("target_path")).where("source_path <> target_path")
    return bind.doc_imports(s, d).unionByName(busy).distinct()


def doc_owners(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").select(bind.doc_path().alias("rel_path"), F.array(F.concat(F.lit("@"), "lang"), F.concat(F.lit("@"), F.col("doc_id") % 3)).alias("owners"))


BUSY = """asked as (select rel_path as p, regexp_replace(rel_path, '/[^/]*$', '') as d, regexp_replace(string_split(rel_path, '/')[-1], '\\.[^.]*$', '') as st, lang as l, doc_id % 3 as o from docs where doc_id = 6),
busy as (select source_path, target_path from doc_imports union select rel_path, p from docs, asked where lang = 'de' and rel_path <> p),
busy_metrics as (select rel_path, sum(i)::bigint as fan_in, sum(c)::bigint as churn from (select target_path as rel_path, 1 as i, 0 as c from busy union all select source_path, 0, 0 from busy union all select file_path, 0, commits from doc_churn) group by 1),
busy_scored as (select *, coalesce(fan_in * churn / nullif((select max(fan_in * churn) from busy_metrics), 0), 0)::double as hotspot_score from busy_metrics),
blocks as (select distinct n || '/' || (doc_id // n) as hash, rel_path as file from docs, (values (4), (6), (12)) v(n)),
co as (select b.file as rel_path, count(*) as count from blocks a join blocks b on a.hash = b.hash and a.file <> b.file, asked where a.file = p group by 1),
linked as (select target_path as rel_path, 'imports' as signal from busy, asked where source_path = p union all select source_path, 'imported-by' from busy, asked where target_path = p)"""
RELATED = """sig as (select rel_path, 0.3 as w, 'same-directory' as signal from files, asked where dir = d
union all select test_path, 0.9, 'test-pair' from doc_tests, asked where source_path = p union all select source_path, 0.9, 'test-pair' from doc_tests, asked where test_path = p
union all select rel_path, 0.7, signal from linked union all select rel_path, 0.3, 'hotspot-dep' from linked join busy_scored using (rel_path) where hotspot_score > 0.1
union all select rel_path, case when count >= 10 then 0.8 when count >= 5 then 0.7 else 0.5 end, 'co-change' from co where count >= 2 union all select rel_path, 0.2, 'hotspot-cochange' from co where (select fan_in from busy_scored, asked where rel_path = p) > 10
union all select rel_path, 0.6, 'same-name' from files, asked where dir <> d and regexp_replace(string_split(rel_path, '/')[-1], '\\.[^.]*$', '') = st
union all select rel_path, 0.2, 'adjacent-package' from files, asked where regexp_replace(dir, '/[^/]*$', '') = regexp_replace(d, '/[^/]*$', '') and dir <> d and contains(dir, '/')),
owned as (select rel_path, lang = l or doc_id % 3 = o as same from docs, asked),
summed as (select rel_path, round(sum(w) + case when any_value(same) then 0.15 else 0 end, 9)::double as w, count(distinct signal) + any_value(same)::int as n from sig join owned using (rel_path), asked where rel_path <> p group by 1)
select rel_path, round(case when w <= 0.8 then w else 0.8 + 0.2 * (1 - exp(-(w - 0.8) / 1.5)) end, 9) as score, n as signals from summed order by score desc, rel_path limit 20"""


@query("related_ranked", sql("docs", "files", "doc_tests", "doc_imports", "doc_churn", select="@").replace("\n@", ",\n" + BUSY + ",\n" + RELATED))
def related_ranked(s, d):
    imports = busy_imports(s, d)
    rated = metrics.file_metrics(imports, bind.doc_churn(s, d))
    pairs = history.cochange(doc_commits(s, d))
    return related.related(target(s, d), bind.files(s, d), imports, bind.doc_tests(s, d), pairs, rated, doc_owners(s, d), 20).select("rel_path", "score", F.size("signals").cast("long").alias("signals"))


@query("soft_cap", "select l_orderkey, l_linenumber, round(case when x <= 0.8 then x else 0.8 + 0.2 * (1 - exp(-(x - 0.8) / 1.5)) end, 9) as score from (select l_orderkey, l_linenumber, l_quantity / 20.0 as x from lineitem)")
def soft_cap(s, d):
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(paths.soft_cap(F.col("l_quantity") / 20.0), 9).alias("score"))


@query("owners_last_match", sql("page_paths", select="select rel_path, case when regexp_matches(rel_path, '(?:^|/)7[^/]*$') then '@sevens' when regexp_matches(rel_path, '^(?:.+/)?de/[^/]*$') then '@de,@eu' when starts_with(rel_path, 'en/') then '@nobody' else '@all' end as owners from page_paths"))
def owners_last_match(s, d):
    rules = s.createDataFrame(bind.OWNER_RULES, "priority int, pattern string, owners array<string>")
    return nearest.owners(bind.pages(s, d), rules).select("rel_path", F.array_join("owners", ",").alias("owners"))


@query("nearest_config", sql("page_paths", select="""select dir, case when regexp_extract(dir, '^([^/]+/(en|de))(/|$)', 1) in (select regexp_replace(rel_path, '/?[^/]*$', '') from page_paths) then regexp_extract(dir, '^[^/]+/(en|de)', 1) || '/Makefile' else 'Makefile' end as config_path
from (select distinct regexp_replace(rel_path, '/?[^/]*$', '') as dir from page_paths)"""))
def nearest_config(s, d):
    dirs = bind.pages(s, d).select(paths.dir_of(F.col("rel_path")).alias("dir")).distinct()
    own = dirs.where(F.col("dir").rlike("/(en|de)$")).select(F.col("dir").alias("config_dir"), F.lit("makefile").alias("config_type"), F.concat(F.substring_index("dir", "/", -1), F.lit("/Makefile")).alias("config_path"))
    root = s.createDataFrame([("", "makefile", "Makefile")], own.schema)
    return nearest.nearest_configs(dirs, own.unionByName(root)).select("dir", "config_path")


@query("longest_prefix", sql("page_paths", select="select rel_path as spec, case when regexp_matches(rel_path, '^[^/]+/(en|fr)/') then regexp_extract(rel_path, '^([^/]+/(en|fr))/', 1) else string_split(rel_path, '/')[1] end as prefix from page_paths"))
def longest_prefix(s, d):
    own = bind.pages(s, d)
    two = own.where(F.col("rel_path").rlike("^[^/]+/(en|fr)/")).select(F.substring_index("rel_path", "/", 2).alias("prefix"))
    return nearest.longest_prefix(own.withColumnRenamed("rel_path", "spec"), two.union(own.select(F.substring_index("rel_path", "/", 1))))


@query("docs_attach", sql("docs", "lines", "symbols", select="""select n.file_path, n.end_line, coalesce(min((s.line, s.name))[2], '') as symbol, coalesce(min((s.line, s.name))[1], 0) as line
from (select rel_path as file_path, line as end_line from lines where contains(text, ',')) n left join symbols s on s.file_path = n.file_path and s.line between n.end_line + 1 and n.end_line + 10 group by 1, 2"""))
def docs_attach(s, d):
    notes = grep.lines(bind.contents(s, d)).where(F.col("text").contains(",")).select(F.col("rel_path").alias("file_path"), F.col("line").alias("end_line"), F.col("text").alias("body"))
    return nearest.following(notes, bind.symbols(s, d)).select("file_path", "end_line", "symbol", F.col("line").cast("long").alias("line"))


@query("parse_coverage", sql("docs", "files", select="""select rel_path, case when q is null then 'unknown' else 'partial' end as status from (select docs.rel_path, max(quality) as q from docs left join labels using (doc_id) group by 1) join files using (rel_path) where (q = 0) or (q is null and class in ('source', 'test', 'script'))"""))
def parse_coverage(s, d):
    return lookup.parse_coverage(bind.parses(s, d), bind.files(s, d)).select("rel_path", "status")


@query("tests_for", sql("docs", "files", "doc_tests", select="select distinct test_path as rel_path, kind, 'test' as relation from doc_tests where source_path in (select rel_path from files where starts_with(rel_path, 'src3/') and class = 'source') or source_path = 'src3'"))
def tests_for(s, d):
    return lookup.tests_for(bind.doc_tests(s, d), bind.files(s, d), "src3", -1)


@query("unmapped_tests", sql("docs", "files", "doc_tests", select="select rel_path from files where class = 'test' and rel_path not in (select test_path from doc_tests)"))
def unmapped_tests(s, d):
    return lookup.unmapped_tests(bind.doc_tests(s, d), bind.files(s, d))


@query("file_context", sql("docs", "files", "lines", "symbols", "doc_imports", "doc_churn", "doc_metrics", "doc_scored", "stats", select="""select f.rel_path, f.class, f.size, 'indexed' as status, sha256(d.text) as content_hash, coalesce(m.fan_in, 0) as fan_in, coalesce(m.churn, 0) as churn, s.extracted, s.unresolved,
'@' || d.lang || ',@' || (d.doc_id % 3) as owners, 2 as configs, d.source || '/Makefile' as readme, (select count(*) from symbols where file_path = f.rel_path) as docs from files f join docs d using (rel_path) left join doc_scored m using (rel_path) join stats s using (rel_path) where d.doc_id = 6"""))
def file_context(s, d):
    path = target(s, d)
    extras = bind.contents(s, d).select("rel_path", F.col("content").alias("preview"), F.sha2("content", 256).alias("content_hash"))
    near = t(s, d, "documents").select(bind.doc_path().alias("rel_path"), F.explode(F.array(F.lit("makefile"), F.lit("readme"))).alias("config_type"), F.concat("source", F.lit("/Makefile")).alias("config_path"))
    notes = bind.symbols(s, d).select("file_path", F.col("name").alias("symbol"), "line", F.col("signature").alias("body"))
    row = lookup.file_context(path, bind.files(s, d), extras, doc_metrics(s, d), doc_owners(s, d), near, notes, bind.doc_stats(s, d))
    return row.select("rel_path", "class", "size", "status", "content_hash", "fan_in", "churn", "extracted", "unresolved", F.array_join("owners", ",").alias("owners"), F.size("configs").cast("long").alias("configs"), F.col("configs")["readme"].alias("readme"), F.size("docs").cast("long").alias("docs"))


@query("content_hash", sql("docs", select="select rel_path, sha256(text) as content_hash from docs"))
def content_hash(s, d):
    return bind.contents(s, d).select("rel_path", F.sha2("content", 256).alias("content_hash"))


def stored_files(s: SparkSession, d: str) -> DataFrame:
    """What an older snapshot might have held: one language elsewhere, one source with other sizes."""
    f = bind.files(s, d)
    return f.withColumn("rel_path", F.when(F.col("rel_path").contains("/de/"), F.concat(F.lit("old/"), "rel_path")).otherwise(F.col("rel_path"))).withColumn("size", F.when(F.col("rel_path").startswith("src5/"), F.col("size") + 1).otherwise(F.col("size")))


DIFF = "select rel_path, 'added' as change from files where contains(rel_path, '/de/') union all select 'old/' || rel_path, 'removed' from files where contains(rel_path, '/de/') union all select rel_path, 'changed' from files where starts_with(rel_path, 'src5/') and not contains(rel_path, '/de/')"


@query("snapshot_diff", sql("docs", "files", select=DIFF))
def snapshot_diff(s, d):
    return maintain.snapshot_diff(stored_files(s, d), bind.files(s, d))


@query("per_key_replace", sql("docs", "files", select="select rel_path, class, size from files where class <> 'source' union all select 'new/' || rel_path, class, 0 from files where class = 'source'"))
def per_key_replace(s, d):
    base = bind.files(s, d).select("rel_path", "class", "size")
    gone = base.where("class = 'source'")
    return maintain.replace_keys(base, gone, gone.select(F.concat(F.lit("new/"), "rel_path").alias("rel_path"), "class", F.lit(0).cast("long").alias("size")), "rel_path")


@query("upsert", "select c_custkey, case when c_acctbal < 0 then 'owing' else c_mktsegment end as state from customer")
def upsert(s, d):
    own = t(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("state"), F.lit(0).alias("at"))
    new = t(s, d, "customer").where("c_acctbal < 0").select("c_custkey", F.lit("owing").alias("state"), F.lit(1).alias("at"))
    return maintain.upsert(own, new, ["c_custkey"], "at").drop("at")


@query("refresh_equals_rebuild", sql("docs", "files", select="select rel_path, size * 2 as value from files"))
def refresh_equals_rebuild(s, d):
    return maintain.refreshed(stored_files(s, d), bind.files(s, d), lambda f: f.select("rel_path", (F.col("size") * 2).alias("value")))


@query("line_counts", sql("docs", "lines", select="select rel_path, count(*) as lines, max(length(text))::bigint as longest from lines group by 1"))
def line_counts(s, d):
    return grep.lines(bind.contents(s, d)).groupBy("rel_path").agg(F.count("*").alias("lines"), F.max(F.length("text")).cast("long").alias("longest"))


@query("glob_match", sql("docs", "files", select=r"select rel_path from files where regexp_matches(rel_path, '^src1[^/]*/(?:.+/)?[^/]*\.[^x]y$')"))
def glob_match(s, d):
    return bind.files(s, d).where(F.col("rel_path").rlike(paths.glob_regex("src1*/**/*.[!x]y"))).select("rel_path")


@query("subtree", sql("docs", "files", select="select rel_path from files where starts_with(rel_path, 'src3/en/')"))
def subtree(s, d):
    return bind.files(s, d).where(paths.under(F.col("rel_path"), "src3/en/")).select("rel_path")


@query("all_tokens", sql("docs", select="select rel_path from docs where contains(lower(text), 'tion') and contains(lower(text), 'the ')  and contains(lower(text), 'ing')"))
def all_tokens(s, d):
    c = bind.contents(s, d)
    return c.where(paths.all_tokens_in(F.col("content"), "TION ing") & F.lower("content").contains("the ")).select("rel_path")


@query("path_parts", sql("page_paths", select=r"""select rel_path, regexp_replace(rel_path, '/?[^/]*$', '') as dir, string_split(rel_path, '/')[-1] as base, lower(regexp_extract(string_split(rel_path, '/')[-1], '(\.[^.]*)$', 1)) as ext,
regexp_replace(string_split(rel_path, '/')[-1], '\.[^.]*$', '') as stem, case when contains(rel_path, '/') then string_split(rel_path, '/')[1] else '.' end as top from page_paths"""))
def path_parts(s, d):
    p = F.col("rel_path")
    return bind.pages(s, d).select("rel_path", paths.dir_of(p).alias("dir"), paths.base_of(p).alias("base"), paths.ext_of(p).alias("ext"), paths.stem_of(p).alias("stem"), paths.top_segment(p).alias("top"))


@query("import_stats", """with s as (select l_suppkey as k, l_orderkey as o, l_linenumber as n, 'p' || (l_partkey % 50) as spec, case l_returnflag when 'A' then 'resolved' when 'N' then 'external' else 'unresolved' end as bucket from lineitem),
f as (select k, spec, min((o, n)) as pos from s where bucket = 'unresolved' group by 1, 2),
u as (select k, array_to_string(list(spec order by pos, spec)[1:20], ',') as specs from f group by 1)
select 's/' || k as rel_path, 'x' as lang, count(*) as extracted, count(*) filter (bucket = 'resolved') as resolved, count(*) filter (bucket = 'external') as external, count(*) filter (bucket = 'unresolved') as unresolved, coalesce(max(specs), '') as unresolved_specs from s left join u using (k) group by k""")
def import_stats(s, d):
    bucket = F.when(F.col("l_returnflag") == "A", "resolved").when(F.col("l_returnflag") == "N", "external").otherwise("unresolved")
    specs = t(s, d, "lineitem").select(F.concat(F.lit("s/"), "l_suppkey").alias("rel_path"), F.lit("x").alias("lang"), F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("spec"), F.struct("l_orderkey", "l_linenumber").alias("ord"), bucket.alias("bucket"))
    return metrics.import_stats(specs).withColumn("unresolved_specs", F.array_join("unresolved_specs", ","))


@query("test_status", sql("docs", "files", "doc_tests", select="select rel_path as test_path, case when rel_path in (select test_path from doc_tests) then 'mapped' when rel_path like '%.py' then 'no_match' else 'unsupported' end as status from files where class = 'test'"))
def test_status(s, d):
    return lookup.test_status(bind.doc_tests(s, d), bind.files(s, d), s.createDataFrame([("py",)], "ext string"))


QUERIES |= tree_queries.QUERIES
ORACLE_SQL |= tree_queries.ORACLE_SQL
