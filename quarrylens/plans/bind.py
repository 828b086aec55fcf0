"""The driver's tables projected to the engine's relations, in Spark and as the same DuckDB text.

Orders are commits, the parts on their lines the files they touch; suppliers import the parts they sell;
documents are files whose lines are searched; web pages are paths with owners and configuration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTS = ("py", "go", "ts", "java", "md", "yml", "sh", "css")


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def commit_files(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("hash"), F.concat(F.lit("p/"), "l_partkey").alias("file")).distinct()


def commits(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the parts on their lines; a quarter of the parts of each size class names the area."""
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    files = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("s"), F.col("l_suppkey") % 10, F.lit("/p"), "l_partkey"))).alias("files"))
    orders = t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("date"), (F.col("o_orderpriority") == "1-URGENT").alias("is_root"))
    return orders.join(files, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("hash"), "date", "is_root", F.coalesce("files", F.expr("cast(array() as array<string>)")).alias("files"))


def imports(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select(F.concat(F.lit("s/"), "l_suppkey").alias("source_path"), F.concat(F.lit("p/"), "l_partkey").alias("target_path")).distinct()


def doc_path() -> Column:
    ext = F.element_at(F.array(*map(F.lit, EXTS)), (F.col("doc_id") % 8 + 1).cast("int"))
    name = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("test_d"), (F.col("doc_id") / 5).cast("long"), F.lit("."))).otherwise(F.concat(F.lit("d"), F.col("doc_id"), F.lit(".")))
    return F.concat("source", F.lit("/"), "lang", F.lit("/"), name, ext)


def files(spark: SparkSession, d: str) -> DataFrame:
    from quarrylens.functions.classify import file_class, language

    own = t(spark, d, "documents").select(doc_path().alias("rel_path"), F.col("n_chars").alias("size"))
    path = F.col("rel_path")
    return own.select("rel_path", F.regexp_replace("rel_path", "/[^/]*$", "").alias("dir"), language(path).alias("lang"), file_class(path).alias("class"), "size", F.lit(0).cast("long").alias("mtime"))


def contents(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select(doc_path().alias("rel_path"), F.col("text").alias("content"))


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """The first word of each line is defined there."""
    from quarrylens.operators.grep import lines

    word = F.regexp_extract("text", "^([A-Za-z]+)", 1)
    rows = lines(contents(spark, d)).select(F.col("rel_path").alias("file_path"), word.alias("name"), F.when(F.col("line") == 1, "module").otherwise("function").alias("kind"), "line", F.substring("text", 1, 40).alias("signature"))
    return rows.where("name <> ''")


def references(spark: SparkSession, d: str) -> DataFrame:
    """The second word of each line is used there."""
    from quarrylens.operators.grep import lines

    word = F.regexp_extract("text", "^[A-Za-z]+ ([A-Za-z]+)", 1)
    return lines(contents(spark, d)).select(word.alias("name"), F.col("rel_path").alias("file_path"), "line").where("name <> ''")


def doc_imports(spark: SparkSession, d: str) -> DataFrame:
    """Each document imports the one of half its number."""
    docs = t(spark, d, "documents").select("doc_id", doc_path().alias("rel_path"))
    to = docs.select(F.col("doc_id").alias("to_id"), F.col("rel_path").alias("target_path"))
    return docs.join(to, F.expr("to_id = doc_id div 2 and doc_id > 0")).select(F.col("rel_path").alias("source_path"), "target_path")


def doc_tests(spark: SparkSession, d: str) -> DataFrame:
    """test_dN stands for document N where that is no test itself."""
    docs = t(spark, d, "documents").select("doc_id", doc_path().alias("rel_path"))
    test = docs.where("doc_id % 5 = 0").select(F.expr("doc_id div 5").alias("n"), F.col("rel_path").alias("test_path"))
    source = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("n"), F.col("rel_path").alias("source_path"))
    from quarrylens.functions.classify import test_kind

    return test.join(source, "n").select("test_path", "source_path", test_kind(F.col("test_path")).alias("kind"))


def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    """Specifiers of a document: labelled words stand for resolved, digits for external ones."""
    words = F.size(F.split("text", " "))
    marks = F.regexp_count("text", F.lit("[0-9]"))
    rows = t(spark, d, "documents").select(doc_path().alias("rel_path"), "lang", words.cast("long").alias("extracted"), F.least(marks, words).cast("long").alias("external"))
    return rows.withColumn("resolved", F.expr("(extracted - external) div 2")).withColumn("unresolved", F.expr("extracted - external - resolved"))


def doc_churn(spark: SparkSession, d: str) -> DataFrame:
    """Labels and conversations touch the document of their number."""
    ids = t(spark, d, "labels").select("doc_id").unionByName(t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")))
    docs = t(spark, d, "documents").select("doc_id", doc_path().alias("file_path"))
    return ids.join(docs, "doc_id").groupBy("file_path").agg(F.count("*").alias("commits"))


def parses(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", "lang", doc_path().alias("rel_path"))
    status = F.when(F.col("quality") == 1, "ok").otherwise("partial")
    return t(spark, d, "labels").join(docs, "doc_id").select("rel_path", "lang", F.lit("regex").alias("extractor"), status.alias("status"), F.col("toxic").cast("int").alias("symbol_count"), F.lit("").alias("detail"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Page addresses as paths: host/first/second."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"\?.*$", "")
    return t(spark, d, "pages").select(path.alias("rel_path")).distinct()


OWNER_RULES = [(1, "*", ["@all"]), (2, "en/", ["@nobody"]), (3, "**/de/*", ["@de", "@eu"]), (4, "/*.org/", ["@org"]), (5, "7*", ["@sevens"])]

#: DuckDB: the same projections. `path` takes the columns of documents.
PATH_SQL = "source || '/' || lang || '/' || case when doc_id % 5 = 0 then 'test_d' || (doc_id // 5) || '.' else 'd' || doc_id || '.' end || ['py','go','ts','java','md','yml','sh','css'][doc_id % 8 + 1]"
CTES = {
    "docs": f"docs as (select *, {PATH_SQL} as rel_path from documents)",
    "commit_files": "commit_files as (select distinct l_orderkey as hash, 'p/' || l_partkey as file from lineitem)",
    "imports": "imports as (select distinct 's/' || l_suppkey as source_path, 'p/' || l_partkey as target_path from lineitem)",
    "churn": "churn as (select file as file_path, count(*) as commits from commit_files group by 1)",
    "metrics": "metrics as (select rel_path, sum(i)::bigint as fan_in, sum(o)::bigint as fan_out, sum(c)::bigint as churn from (select target_path as rel_path, 1 as i, 0 as o, 0 as c from imports union all select source_path, 0, 1, 0 from imports union all select file_path, 0, 0, commits from churn) group by 1)",
    "scored": "scored as (select *, coalesce(fan_in * churn / nullif((select max(fan_in * churn) from metrics), 0), 0)::double as hotspot_score from metrics)",
    "cochange": "cochange as (select a.file as file_a, b.file as file_b, count(*) as count from commit_files a join commit_files b on a.hash = b.hash and a.file < b.file where a.hash in (select hash from commit_files group by 1 having count(*) <= 50) group by 1, 2)",
    "commits": "commits as (select o_orderkey as hash, o_orderdate as date, o_orderpriority = '1-URGENT' as is_root, coalesce(fs, []) as files from orders left join (select l_orderkey, list_sort(list(distinct 's' || (l_suppkey % 10) || '/p' || l_partkey)) as fs from lineitem group by 1) on o_orderkey = l_orderkey)",
    "files": "files as (select rel_path, regexp_replace(rel_path, '/[^/]*$', '') as dir, ['python','go','typescript','java','markdown','yaml','shell','css'][doc_id % 8 + 1] as lang, "
    "case when doc_id % 5 = 0 and doc_id % 8 in (0, 6) then 'test' else ['source','source','source','source','doc','other','script','source'][doc_id % 8 + 1] end as class, n_chars as size, 0::bigint as mtime from docs)",
    "lines": "lines as (select rel_path, unnest(range(1, len(ls) + 1)) as line, unnest(ls) as text from (select rel_path, case when text like '%' || chr(10) then list_slice(string_split(text, chr(10)), 1, -2) else string_split(text, chr(10)) end as ls from docs where text <> ''))",
    "symbols": "symbols as (select rel_path as file_path, regexp_extract(text, '^([A-Za-z]+)', 1) as name, case when line = 1 then 'module' else 'function' end as kind, line, text[1:40] as signature from lines where regexp_extract(text, '^([A-Za-z]+)', 1) <> '')",
    "references": "refs as (select regexp_extract(text, '^[A-Za-z]+ ([A-Za-z]+)', 1) as name, rel_path as file_path, line from lines where regexp_extract(text, '^[A-Za-z]+ ([A-Za-z]+)', 1) <> '')",
    "doc_imports": "doc_imports as (select a.rel_path as source_path, b.rel_path as target_path from docs a join docs b on b.doc_id = a.doc_id // 2 and a.doc_id > 0)",
    "doc_tests": "doc_tests as (select a.rel_path as test_path, b.rel_path as source_path, 'unit' as kind from docs a join docs b on b.doc_id = a.doc_id // 5 where a.doc_id % 5 = 0 and b.doc_id % 5 <> 0)",
    "doc_churn": "doc_churn as (select rel_path as file_path, count(*) as commits from (select doc_id from labels union all select conv_id from conversations) join docs using (doc_id) group by 1)",
    "doc_metrics": "doc_metrics as (select rel_path, sum(i)::bigint as fan_in, sum(o)::bigint as fan_out, sum(c)::bigint as churn from (select target_path as rel_path, 1 as i, 0 as o, 0 as c from doc_imports union all select source_path, 0, 1, 0 from doc_imports union all select file_path, 0, 0, commits from doc_churn) group by 1)",
    "doc_scored": "doc_scored as (select *, coalesce(fan_in * churn / nullif((select max(fan_in * churn) from doc_metrics), 0), 0)::double as hotspot_score from doc_metrics)",
    "stats": "stats as (select rel_path, lang, w as extracted, least(m, w) as external, (w - least(m, w)) // 2 as resolved, w - least(m, w) - (w - least(m, w)) // 2 as unresolved from (select rel_path, lang, len(string_split(text, ' '))::bigint as w, len(regexp_extract_all(text, '[0-9]'))::bigint as m from docs))",
    "page_paths": r"page_paths as (select distinct regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '\?.*$', '') as rel_path from pages)",
}


def sql(*names: str, select: str) -> str:
    return "with " + ",\n".join(CTES[n] for n in names) + "\n" + select
