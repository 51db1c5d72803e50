"""Queries that write a table in a format of the readers and read it again, in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexilathe.operators import matching as M
from lexilathe.session import shared_folder, table
from lexilathe.sources import files as S

SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("select s_suppkey, s_name, s_nationkey, '' as n_name from supplier union all select null, null, n_nationkey, n_name from nation")
def csv_round_trip(spark, d):
    """Two tables under the union of their columns as CSV, read again."""
    path = shared_folder(spark, "csv")
    a = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    b = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    S.write_csv([a, b], path)
    r = S.csv_rows(spark, path, "s_suppkey bigint, s_name string, s_nationkey bigint, n_name string")
    return r.withColumn("n_name", F.when(F.col("s_suppkey").isNotNull(), F.coalesce("n_name", F.lit(""))).otherwise(F.col("n_name")))


@query("select c_custkey, c_name, c_acctbal, row_number() over (order by c_custkey) - 1 as line_no, 0::bigint as faulty from customer")
def json_round_trip(spark, d):
    """A table as JSON lines with blank and broken lines between, read tolerantly, numbered in file order."""
    path = shared_folder(spark, "json")
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    c.orderBy("c_custkey").select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    rows, faulty = S.json_lines(spark, path, "c_custkey bigint, c_name string, c_acctbal double")
    return rows.select("line_no", "c_custkey", "c_name", "c_acctbal").join(F.broadcast(faulty.agg(F.count("*").alias("faulty"))))


@query("select c_custkey, c_name from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0")
def appended_rows(spark, d):
    """Rows appended twice, the second time only those whose key isn't there."""
    path = shared_folder(spark, "append")
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    S.append_json(c.filter("c_custkey % 2 = 0"), path, "c_custkey")
    S.append_json(c.filter("c_custkey % 2 = 0 or c_custkey % 3 = 0"), path, "c_custkey")
    return spark.read.schema("c_custkey bigint, c_name string").json(path)


@query("select vec_id, label, round(embedding[1]::double, 6) as head from embeddings")
def split_table(spark, d):
    """Metadata and vectors written apart, joined again."""
    a, b = S.split_columns(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), "vec_id", "embedding", shared_folder(spark, "split"))
    return a.join(b, "vec_id").select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("head"))


@query("select 'r' || (l_partkey % 3) as relation, 'p' || l_partkey as start, 's' || l_suppkey as \"end\", round(sum(case when l_linenumber % 2 = 0 then l_quantity else 1 end), 4) as weight from lineitem group by 1, 2, 3")
def edge_dump_sums(spark, d):
    """A dump of edges with weights in JSON, some of them missing, and short lines that don't count."""
    path = shared_folder(spark, "edges")
    e = table(spark, d, "lineitem").select(F.concat(F.lit("r"), F.col("l_partkey") % 3), F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey"), F.when(F.col("l_linenumber") % 2 == 0, F.to_json(F.struct(F.col("l_quantity").alias("weight")))).otherwise("{}")).toDF("r", "s", "e", "j")
    e.select(F.concat_ws("\t", F.lit("x"), "r", "s", "e", "j").alias("value")).union(spark.createDataFrame([("a\tb\tc",)], "value string")).write.option("compression", "gzip").text(path)
    return S.edge_dump(spark, path).groupBy("relation", "start", "end").agg(F.round(F.sum("weight"), 4).alias("weight"))


@query("select 'k' || p_partkey as id, case when p_partkey % 2 = 0 then 'book' else 'other' end as type, p_name as title, case when p_partkey % 3 = 0 then 'Doe, J. (ed.)' else p_brand end as authors, cast(1950 + p_size as varchar) as year from part")
def bib_round_trip(spark, d):
    """Entries with authors or editors and nested braces, read as records."""
    path = shared_folder(spark, "bib")
    p = table(spark, d, "part")
    who = F.when(F.col("p_partkey") % 3 == 0, F.lit("editor = {Doe, J.}")).otherwise(F.concat(F.lit('author = "'), "p_brand", F.lit('"')))
    entry = F.concat(F.when(F.col("p_partkey") % 2 == 0, "@book{k").otherwise("@misc{k"), "p_partkey", F.lit(",\n title = {{"), F.substring_index("p_name", " ", 1), F.lit("}"), F.substr("p_name", F.length(F.substring_index("p_name", " ", 1)) + 1), F.lit("},\n "), who, F.lit(",\n date = "), (F.lit(1950) + F.col("p_size")).cast("string"), F.lit("-01\n}\n"))
    p.select(entry.alias("value")).write.text(path)
    return S.bib_records(S.bib_entries(spark, path))


@query("select 'g' || (n_regionkey) as block, n_name as term from nation")
def term_list_round_trip(spark, d):
    """Lists of terms under headers, numbered and with remarks, in one file."""
    path = shared_folder(spark, "terms")
    n = table(spark, d, "nation").select(F.concat(F.lit("g"), "n_regionkey").alias("block"), "n_nationkey", "n_name")
    heads = n.select("block", F.lit(-1).cast("long").alias("k"), F.concat("block", F.lit(":")).alias("value")).distinct()
    lines = n.select("block", F.col("n_nationkey").cast("long").alias("k"), F.concat(F.lit("3. "), "n_name", F.lit(" (a remark)")).alias("value"))
    heads.union(lines).coalesce(1).sortWithinPartitions("block", "k").select("value").write.text(path)
    return S.term_list(S.numbered_lines(spark, path)).select("block", "term")


@query("with p as (select distinct document_id, page_number, text from page_record where document_id is not null and page_number is not null), l as (select document_id, max(page_number) as last from p group by 1), e as (select document_id, unnest(range(1, last + 1)) as page_number from l) select e.document_id, e.page_number, p.text is null as missing, length(coalesce(p.text, '')) as n from e left join p using (document_id, page_number)")
def backfilled_pages(spark, d):
    """An empty page for every number missing up to a document's last."""
    p = table(spark, d, "page_record").filter("document_id is not null and page_number is not null").select(F.col("document_id").alias("document"), "page_number", "text").distinct()
    return S.backfill(p).select(F.col("document").alias("document_id"), "page_number", "missing", F.length("text").cast("long").alias("n"))


@query("select document_id, sum(length(coalesce(text, '')))::double / count(*) >= 900 as plausible from (select distinct document_id, page_number, text from page_record) group by document_id")
def plausible_documents(spark, d):
    p = table(spark, d, "page_record").select(F.col("document_id").alias("document"), "page_number", "text").distinct()
    return S.plausible(p, 900).select(F.col("document").alias("document_id"), "plausible")


@query("select document_id, md5(string_agg('--- page ' || page_number || ' ---' || chr(10) || coalesce(text, ''), chr(10) order by page_number)) as digest from (select distinct on (document_id, page_number) document_id, page_number, text from page_record where page_number is not null order by document_id, page_number, written_at) group by document_id")
def marked_documents(spark, d):
    """Each document's pages under lines with their numbers."""
    p = M.first_of(table(spark, d, "page_record").filter("page_number is not null"), ["document_id", "page_number"], [F.col("written_at")])
    return S.marked_text(p.select(F.col("document_id").alias("document"), "page_number", F.coalesce("text", F.lit("")).alias("text"))).select(F.col("document").alias("document_id"), F.md5("text").alias("digest"))


@query("select case when c_custkey % 5 = 0 then 'missing' when c_custkey % 5 = 1 then 'mismatched' else 'same' end as state, count(*) as n from customer group by 1 union all select 'extra', 1")
def copy_states(spark, d):
    """A copy compared with its original by digests."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.col("c_name").cast("binary").alias("content"), "c_custkey")
    copy = c.filter("c_custkey % 5 <> 0").select("path", F.when(F.col("c_custkey") % 5 == 1, F.lit("x").cast("binary")).otherwise(F.col("content")).alias("content")).unionByName(spark.createDataFrame([("new", bytearray(b"1"))], "path string, content binary"))
    return S.verify_copy(c.drop("c_custkey"), copy).groupBy("state").agg(F.count("*").alias("n"))
