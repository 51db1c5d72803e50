"""Queries over texts, keys, edges and content tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexilathe.functions import text as X
from lexilathe.operators import chunking as C
from lexilathe.operators import graph as E
from lexilathe.operators import matching as M
from lexilathe.operators import statistics as T
from lexilathe.session import table

SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_WORDS = "len(list_filter(regexp_split_to_array(coalesce({t}, ''), '[ \\t\\n\\r]+'), lambda w: w <> ''))"
_PAGES = "with p as (select distinct document_id, page_number, text from page_record)"


def pages(spark, d):
    return table(spark, d, "page_record").select("document_id", "page_number", "text").distinct()


# --- text ----------------------------------------------------------------------------------------------------------


@query(r"""select doc_id, md5(t) as digest, length(t) as n_chars from (select doc_id,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+', ''), '[ \n]+$', '') || chr(10) as t from documents where text is not null)""")
def whitespace_collapse(spark, d):
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", X.collapse_whitespace(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n_chars"))


@query("select doc_id, nfc_normalize(text) <> text as changed, md5(nfc_normalize(text)) as digest from documents where text is not null")
def nfc_change(spark, d):
    t = table(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", (X.nfc_changes("text") > 0).alias("changed"), F.md5(X.nfc("text")).alias("digest"))


@query(_PAGES + " select document_id, count(*) as pages, " + ", ".join(f"cast(sum(len(regexp_extract_all(coalesce(text, ''), '{p}'))) as bigint) as {n}" for n, p in X.CLASSES.items()) + f", cast(sum({_WORDS.format(t='text')}) as bigint) as words from p group by document_id")
def char_class_counts(spark, d):
    """Character classes summed by document."""
    return pages(spark, d).groupBy("document_id").agg(F.count("*").alias("pages"), *[F.sum(X.count_class(F.col("text"), n)).alias(n) for n in X.CLASSES], F.sum(F.size(X.words(F.col("text")))).alias("words"))


_MIXED = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda w: regexp_matches(w, '[A-Za-z]') and regexp_matches(w, '" + X.SUSPICIOUS + "')))"


@query(_PAGES + f" select document_id, cast(sum({_MIXED}) as bigint) as mixed, round(1000.0::double * sum({_MIXED}) / greatest(sum({_WORDS.format(t='text')}), 1), 6) as per_1k_words, max(coalesce(list_max(list_transform(regexp_extract_all(coalesce(text, ''), '[\\x{{E000}}-\\x{{F8FF}}]+'), lambda r: length(r))), 0)) as longest_private_run from p group by document_id".replace("{{", "{").replace("}}", "}"))
def mixed_script_tokens(spark, d):
    t = F.col("text")
    return pages(spark, d).groupBy("document_id").agg(F.sum(X.mixed_script_tokens(t)).alias("mixed"), F.round(1000.0 * F.sum(X.mixed_script_tokens(t)) / F.greatest(F.sum(F.size(X.words(t))), F.lit(1)), 6).alias("per_1k_words"), F.max(X.longest_private_run(t)).cast("long").alias("longest_private_run"))


_HARD = "case " + " ".join(f"when regexp_matches(text, '{X.CLASSES[n]}') then 'integrity_{n.replace('_seq', '')}'" for n in ("replacement_char", "private_use", "control_char", "mojibake_seq")) + " end"


@query(_PAGES + f" select coalesce({_HARD}, 'none') as code, count(*) as pages, count(distinct document_id) as documents from p group by 1")
def hard_corruption(spark, d):
    return pages(spark, d).groupBy(F.coalesce(X.hard_corruption(F.col("text")), F.lit("none")).alias("code")).agg(F.count("*").alias("pages"), F.countDistinct("document_id").alias("documents"))


@query(_PAGES + """, l as (select document_id, page_number, unnest(string_split(text, chr(10))) as line from p),
c as (select *, len(regexp_extract_all(line, '\\p{L}|[\\x{E000}-\\x{F8FF}]')) as letters, len(regexp_extract_all(line, '""" + X.SUSPICIOUS + """')) as odd, """ + _MIXED.replace("text", "line") + """ as mixed from l)
select document_id, count(*) as lines, cast(sum(odd) as bigint) as odd_letters from c where letters >= 10 and (odd >= 0.05 * letters or mixed >= 2) group by document_id""")
def cipher_lines(spark, d):
    """Lines of at least 10 letters of which 5 % or more are of suspicious blocks, or with two words that mix scripts."""
    lines = pages(spark, d).select("document_id", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("document_id", X.cipher_line(F.col("line")).alias("cipher"), F.regexp_count("line", F.lit(X.SUSPICIOUS)).alias("odd"))
    return lines.filter("cipher").groupBy("document_id").agg(F.count("*").alias("lines"), F.sum("odd").alias("odd_letters"))


@query("""select id, slug, case when n = 1 then slug else slug || '-' || n end as unique_slug from (select id, slug, row_number() over (partition by slug order by id) as n from
 (select distinct id, left(regexp_replace(regexp_replace(lower(source_file), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 12) as slug from interview_database))""")
def slug_ids(spark, d):
    """Slugs made unique by a number, first come in order of id."""
    s = table(spark, d, "interview_database").select("id", X.slug(F.col("source_file"), 12).alias("slug")).distinct()
    n = M.occurrence(s, ["slug"], ["id"], "n")
    return n.select("id", "slug", F.when(F.col("n") == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("n") + 1)).alias("unique_slug"))


@query(r"""select label, count(*) as n, regexp_matches(label, '\p{L}') and not (regexp_matches(label, '\p{Ll}') and not regexp_matches(label, '[\p{Lu}\p{Lt}]')) as name_like, regexp_replace(lower(trim(label)), '[ \t\n]+', ' ', 'g') as normal from shared_space where label is not null group by label""")
def entity_shape(spark, d):
    s = table(spark, d, "shared_space").filter("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    return s.select("label", "n", X.looks_like_name(F.col("label")).alias("name_like"), X.normal_entity(F.col("label")).alias("normal"))


@query("""with t as (select corpus, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z'']{3,}'))) as token from documents where text is not null)
select token, count(*) as documents, count(*) filter (where corpus = 'literature') as literature, count(*) filter (where corpus = 'report') as report, count(*) filter (where corpus = 'interviews') as interviews, count(*) filter (where corpus = 'dictionary') as dictionary, count(distinct corpus) as n_corpora from t group by token""")
def token_df(spark, d):
    """Document frequency of each token, in all and by corpus."""
    t = table(spark, d, "documents").filter("text is not null").select("corpus", F.explode(F.array_distinct(F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[a-z']{3,}"), F.lit(0)))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("documents"), *[F.count_if(F.col("corpus") == c).alias(c) for c in ("literature", "report", "interviews", "dictionary")], F.countDistinct("corpus").alias("n_corpora"))


_PARTS = r"list_filter(regexp_split_to_array(text, '\n[ \t]*\n'), lambda p: regexp_matches(p, '[^ \t\n]'))"


@query(f"with x as (select doc_id, unnest({_PARTS}) as p from documents where text is not null) select doc_id, count(*) as paragraphs, cast(sum({_WORDS.format(t='p')}) as bigint) as words from x group by doc_id")
def paragraphs(spark, d):
    return C.paragraphs(table(spark, d, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum("n_words").alias("words"))


@query(r"""select doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\n]+', '\1' || chr(10), 'g'), '\n+'), lambda s: regexp_matches(s, '[^ \t\n]'))) as sentences from documents where text is not null""")
def sentences(spark, d):
    s = F.filter(F.split("text", r"(?<=[.!?])[ \t\n]+|\n+"), lambda x: x.rlike(r"[^ \t\n]"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(s).cast("long").alias("sentences"))


@query()
def greedy_chunks(spark, d):
    """Paragraphs gathered into chunks of at most 700 words (a fold; tested against a loop)."""
    return C.greedy_chunks(table(spark, d, "documents").filter("text is not null"), "doc_id", "text")


@query(f"""with i as (select distinct id, text from interview_database where text is not null), x as (select id, unnest({_PARTS}) as p, generate_subscripts({_PARTS}, 1) - 1 as no from i),
w as (select id, no, {_WORDS.format(t='p')} as n, starts_with(p, 'Interviewer:') as b from x),
r as (select id, no, b, coalesce(sum(n) over (partition by id order by no rows between unbounded preceding and 1 preceding), 0) as before, sum(n) over (partition by id) as total from w)
select id, cast(max(total) as bigint) as total, (arg_min(no, struct_pack(a := abs(before - total / 2.0::double), n := no)) filter (where b and before > 0))::int as cut from r group by id""")
def transcript_halves(spark, d):
    """The interviewer's turn before which each transcript is best cut in two."""
    i = table(spark, d, "interview_database").filter("text is not null").select("id", "text").distinct()
    p = C.paragraphs(i, "id", "text")
    return C.nearest_midpoint(p, ["id"], "paragraph_no", "n_words", F.col("paragraph").startswith("Interviewer:")).select("id", "total", "cut")


@query(r"""select distinct document_id, cast(nullif(regexp_extract(document_id, '(?:^|-)((?:19|20)[0-9]{2})(?:-|$)', 1), '') as int) as year from page_record""")
def years_of_documents(spark, d):
    return table(spark, d, "page_record").select("document_id", X.year_of(F.col("document_id")).alias("year")).distinct()


# --- keys and joins --------------------------------------------------------------------------------------------------


_POINTS = "with s as (select distinct point_id, key, label, source_dataset, point_role, attribution, claim_mode, epistemic_status from shared_space)"


def _points(spark, d):
    return table(spark, d, "shared_space").select("point_id", "key", "label", "source_dataset", "point_role", "attribution", "claim_mode", "epistemic_status").distinct()


@query(_POINTS + " select point_id, key, row_number() over (partition by key order by point_id) - 1 as occurrence from s where point_role = 'expression' and key is not null")
def occurrence_keys(spark, d):
    p = _points(spark, d).filter("point_role = 'expression' and key is not null")
    return M.occurrence(p, ["key"], ["point_id"]).select("point_id", "key", F.col("occurrence").cast("long").alias("occurrence"))


@query(_POINTS + """, a as (select key, row_number() over (partition by key order by point_id) - 1 as occurrence from s where point_role = 'expression' and key is not null),
e as (select distinct archive_line, document_id || ':' || chunk_index as key from expression_translations_embedded where document_id is not null and chunk_index is not null),
b as (select key, row_number() over (partition by key order by archive_line) - 1 as occurrence from e)
select count_if(a.key is not null and b.key is not null) as matched, count_if(b.key is null) as unmatched, count_if(a.key is null) as unused from a full join b on a.key = b.key and a.occurrence = b.occurrence""")
def context_resolution_stats(spark, d):
    a = M.occurrence(_points(spark, d).filter("point_role = 'expression' and key is not null"), ["key"], ["point_id"])
    e = table(spark, d, "expression_translations_embedded").filter("document_id is not null and chunk_index is not null").select("archive_line", F.concat_ws(":", "document_id", "chunk_index").alias("key")).distinct()
    return M.match_statistics(a.select("key", "occurrence"), M.occurrence(e, ["key"], ["archive_line"]).select("key", "occurrence"), ["key", "occurrence"])


@query(f"""with e as (select distinct archive_line, document_id, text_fr from expression_translations_embedded where text_fr is not null),
f as (select *, row_number() over (partition by document_id, text_fr order by archive_line) as r from e) select document_id, count(*) as kept from f where r = 1 and {_WORDS.format(t='text_fr')} >= 6 group by document_id""")
def first_occurrence_dedup(spark, d):
    """Each document's expressions, the first of equal texts, then those of six words or more (in this order: a short
    text still takes its place as the first)."""
    e = table(spark, d, "expression_translations_embedded").filter("text_fr is not null").select("archive_line", "document_id", "text_fr").distinct()
    f = M.first_of(e, ["document_id", "text_fr"], [F.col("archive_line")])
    return f.filter(F.size(X.words(F.col("text_fr"))) >= 6).groupBy("document_id").agg(F.count("*").alias("kept"))


@query(_POINTS + ", k as (select point_id, attribution, regexp_replace(key, ':[^:]*$', '') as document_id from s where source_dataset = 'interviews' and key is not null) select * from (select point_id, document_id, attribution, row_number() over (partition by document_id order by point_id) as response_rank from k) where attribution is null or attribution = 'participant'")
def response_rank(spark, d):
    """Running number within the document, counted before the rows are filtered; rows without an attribution pass."""
    p = _points(spark, d).filter("source_dataset = 'interviews' and key is not null").select("point_id", "attribution", F.regexp_replace("key", ":[^:]*$", "").alias("document_id"))
    r = M.occurrence(p, ["document_id"], ["point_id"], "n").withColumn("response_rank", (F.col("n") + 1).cast("long")).drop("n")
    return r.filter(F.col("attribution").isNull() | (F.col("attribution") == "participant")).select("point_id", "document_id", "attribution", "response_rank")


@query("""with a as (select document_id, count(distinct page_number) as pages from page_record group by document_id), b as (select document_id, count(distinct chunk_index) as chunks from chunk group by document_id), c as (select distinct document_id, true as audited from stage1_text_integrity)
select coalesce(a.document_id, b.document_id, c.document_id) as document_id, coalesce(pages, 0) as pages, coalesce(chunks, 0) as chunks, case when pages is null then 'no pages' when chunks is null then 'not chunked' when audited is null then 'not audited' else 'complete' end as status
from a full join b using (document_id) full join c on c.document_id = coalesce(a.document_id, b.document_id)""")
def registry_full_outer(spark, d):
    a = table(spark, d, "page_record").groupBy("document_id").agg(F.countDistinct("page_number").alias("pages"))
    b = table(spark, d, "chunk").groupBy("document_id").agg(F.countDistinct("chunk_index").alias("chunks"))
    c = table(spark, d, "stage1_text_integrity").select("document_id", F.lit(True).alias("audited")).distinct()
    r = a.join(b, "document_id", "full").join(c, "document_id", "full")
    status = F.when(F.col("pages").isNull(), "no pages").when(F.col("chunks").isNull(), "not chunked").when(F.col("audited").isNull(), "not audited").otherwise("complete")
    return r.select("document_id", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("chunks", F.lit(0)).alias("chunks"), status.alias("status"))


@query("""with a as (select distinct document_id, 'pages' as origin from page_record), b as (select distinct document_id, 'chunks' as origin from chunk) select * from a union all select * from b where document_id not in (select document_id from a where document_id is not null)""")
def precedence_union(spark, d):
    a = table(spark, d, "page_record").select("document_id").distinct().withColumn("origin", F.lit("pages"))
    return M.prefer(a, table(spark, d, "chunk").select("document_id").distinct().withColumn("origin", F.lit("chunks")), "document_id")


_ORG = "trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[&.,''-]', ' ', 'g'), '\\b(the|of|and)\\b', ' ', 'g'), ' +', ' ', 'g'))"


@query(_POINTS + f""", e as (select label, lower(label) as l, {_ORG.format(c='label')} as o from s where point_role <> 'expression' and label is not null group by label), c as (select distinct nearest_entity as n from cluster_summary where nearest_entity is not null)
select n as name, coalesce(x.label, y.label) as matched, case when x.label is not null then 'exact' when y.label is not null then 'normalised' else 'none' end as how
from c left join (select l, min(label) as label from e group by l) x on x.l = lower(n) left join (select o, min(label) as label from e group by o) y on y.o = {_ORG.format(c='n')}""")
def membership_tags(spark, d):
    """Names found among the entities by their lower-case form, else by a normalised one."""
    org = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), "[&.,'-]", " "), r"\b(the|of|and)\b", " "), " +", " "))
    e = _points(spark, d).filter("point_role <> 'expression' and label is not null").select("label").distinct()
    c = table(spark, d, "cluster_summary").filter("nearest_entity is not null").select(F.col("nearest_entity").alias("name")).distinct()
    x = e.groupBy(F.lower("label").alias("l")).agg(F.min("label").alias("a"))
    y = e.groupBy(org(F.col("label")).alias("o")).agg(F.min("label").alias("b"))
    m = c.join(x, F.lower("name") == F.col("l"), "left").join(y, org(F.col("name")) == F.col("o"), "left")
    return m.select("name", F.coalesce("a", "b").alias("matched"), F.when(F.col("a").isNotNull(), "exact").when(F.col("b").isNotNull(), "normalised").otherwise("none").alias("how"))


@query("select distinct document_id, page_number from page_record p where not exists (select 1 from integrity_regions r where r.document_id = p.document_id and r.page_number = p.page_number)")
def resume_todo(spark, d):
    """Pages that the integrity audit has no line of."""
    return M.todo(table(spark, d, "page_record").select("document_id", "page_number").distinct(), table(spark, d, "integrity_regions"), ["document_id", "page_number"])


@query("""select coalesce(t.c_custkey, s.c_custkey) as c_custkey, coalesce(s.c_name, t.c_name) as c_name, coalesce(s.c_acctbal, t.c_acctbal) as c_acctbal, case when t.c_custkey is null then 'created' when s.c_custkey is not null then 'updated' else 'kept' end as status
from (select c_custkey, c_name, c_acctbal from customer where c_nationkey < 18) t full join (select c_custkey, c_name, round(c_acctbal * 2, 2) as c_acctbal from customer where c_nationkey >= 12) s on s.c_custkey = t.c_custkey""")
def upsert_by_key(spark, d):
    c = table(spark, d, "customer")
    return M.upsert(c.filter("c_nationkey < 18").select("c_custkey", "c_name", "c_acctbal"), c.filter("c_nationkey >= 12").select("c_custkey", "c_name", F.round(F.col("c_acctbal") * 2, 2).alias("c_acctbal")), "c_custkey")


@query("""with a as (select md5(text) as k, min_by(doc_id, (-coalesce(year, 0))::bigint * 1000000000 + doc_id) as doc_id, list_sort(list(distinct source)) as sources, count(*) as copies from documents where text is not null and text <> '' group by md5(text)) select doc_id, array_to_string(sources, ';') as sources, copies from a""")
def merge_duplicates(spark, d):
    """One document per text, the latest, with the sources of all copies."""
    docs = table(spark, d, "documents").filter("text is not null and text <> ''").select("doc_id", F.coalesce("year", F.lit(0)).alias("year"), F.array("source").alias("sources"), F.md5("text").alias("k"))
    n = docs.groupBy("k").agg(F.count("*").alias("copies"))
    best = M.merge_best(docs, F.col("k"), [F.desc("year"), F.col("doc_id")], "sources")
    return best.join(n, "k").select("doc_id", F.array_join("sources", ";").alias("sources"), "copies")


_REASON = """case when text is null then 'null text' when not regexp_matches(text, '[^ \\t\\n]') then 'blank' when length(text) < 200 then 'short' when coalesce(trim(lang), '') in ('', 'und', 'n/a', 'unknown') then 'no language' when year is null then 'no year' end"""


@query(f"select coalesce({_REASON}, 'kept') as reason, count(*) as n from documents group by 1")
def screen_reasons(spark, d):
    """A cascade: the first reason that holds is counted."""
    t = F.col("text")
    reason = M.first_reason([
        ("null text", t.isNull()), ("blank", ~t.rlike(r"[^ \t\n]")), ("short", F.length(t) < 200),
        ("no language", F.coalesce(F.trim("lang"), F.lit("")).isin("", "und", "n/a", "unknown")), ("no year", F.col("year").isNull()),
    ])
    return table(spark, d, "documents").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("""with x as (select *, bool_or(p_size >= 45) over (partition by p_brand) as any_big from part), r as (select p_brand, p_partkey, p_size, row_number() over (partition by p_brand order by p_size desc, p_partkey) as rank from x where not any_big or p_size >= 45) select * from r where rank <= 3""")
def topn_with_fallback(spark, d):
    """The first rows of each group among those with evidence, or among all where none has it."""
    x = table(spark, d, "part").withColumn("any_big", F.max(F.col("p_size") >= 45).over(Window.partitionBy("p_brand"))).filter(~F.col("any_big") | (F.col("p_size") >= 45))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")).cast("long")).filter("rank <= 3").select("p_brand", "p_partkey", "p_size", "rank")


@query("""with m as (select p_brand, min(p_size) as lo, max(p_size) as hi from part group by p_brand) select p_partkey, round(case when hi > lo then (p_size - lo)::double / (hi - lo) else 0 end, 6) as score from part join m using (p_brand)""")
def minmax_score(spark, d):
    return T.min_max(table(spark, d, "part"), "p_size", ["p_brand"], "score").select("p_partkey", F.round("score", 6).alias("score"))


# --- entities and edges ----------------------------------------------------------------------------------------------


_MENTIONS = "with e as (select distinct on (point_id) point_id, label, coalesce(map_extract(mention_distribution, 'literature')[1], 0) as literature, coalesce(map_extract(mention_distribution, 'miviludes')[1], 0) as miviludes, coalesce(map_extract(mention_distribution, 'interviews')[1], 0) as interviews from shared_space where mention_distribution is not null)"


def _mentions(spark, d):
    s = table(spark, d, "shared_space").filter("mention_distribution is not null").dropDuplicates(["point_id"])
    return s.select("point_id", "label", *[F.coalesce(F.col("mention_distribution")[c], F.lit(0)).alias(c) for c in ("literature", "miviludes", "interviews")])


@query(_MENTIONS + " select point_id, label, literature, miviludes, interviews, literature + miviludes + interviews as total from e where literature >= 3 or miviludes >= 2 or interviews >= 2")
def mention_aggregation(spark, d):
    """Entities with enough mentions in any corpus, by each corpus's own threshold."""
    m = _mentions(spark, d).filter("literature >= 3 or miviludes >= 2 or interviews >= 2")
    return m.withColumn("total", F.col("literature") + F.col("miviludes") + F.col("interviews"))


@query(_MENTIONS + " select case (literature > 0)::int + (miviludes > 0)::int + (interviews > 0)::int when 3 then 'all' when 2 then 'two' when 1 then case when literature > 0 then 'literature' when miviludes > 0 then 'miviludes' else 'interviews' end else 'none' end as category, count(*) as n from e group by 1")
def provenance_categories(spark, d):
    some = sum(((F.col(c) > 0).cast("int") for c in ("literature", "miviludes", "interviews")), F.lit(0))
    only = F.when(F.col("literature") > 0, "literature").when(F.col("miviludes") > 0, "miviludes").otherwise("interviews")
    return _mentions(spark, d).groupBy(F.when(some == 3, "all").when(some == 2, "two").when(some == 1, only).otherwise("none").alias("category")).agg(F.count("*").alias("n"))


@query(_MENTIONS + ", r as (select literature + miviludes + interviews as total, row_number() over (order by literature + miviludes + interviews desc, point_id) as r from e) select round(sum(case when r <= 20 then total else 0 end)::double / sum(total), 6) as share from r")
def top_share(spark, d):
    """What share of all mentions the 20 most mentioned entities have."""
    m = _mentions(spark, d).withColumn("total", F.col("literature") + F.col("miviludes") + F.col("interviews"))
    top = m.orderBy(F.desc("total"), "point_id").limit(20).agg(F.sum("total").alias("a"))
    return top.join(F.broadcast(m.agg(F.sum("total").alias("b")))).select(F.round(F.col("a") / F.col("b"), 6).alias("share"))


@query(_POINTS + " select source_dataset, coalesce(epistemic_status, 'none') as status, count(*) as n, count(distinct key) as keys from s group by 1, 2")
def corpus_coverage(spark, d):
    return _points(spark, d).groupBy("source_dataset", F.coalesce("epistemic_status", F.lit("none")).alias("status")).agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


@query("select node, count(*) as degree from (select 'p' || l_partkey as node from lineitem union all select 's' || l_suppkey from lineitem) group by node")
def edge_degree(spark, d):
    e = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"))
    return E.degrees(e, "a", "b")


@query("""with recursive p as (select distinct p_partkey as node, p_partkey // 3 as parent from part where p_partkey > 0), a(node, ancestor) as (select node, parent from p union select a.node, p.parent from a join p on p.node = a.ancestor) select node, count(*) as n_ancestors, min(ancestor) as root from a group by node""")
def ancestor_closure(spark, d):
    """All ancestors of each node of a tree over the parts."""
    p = table(spark, d, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("node"), F.floor(F.col("p_partkey") / 3).alias("parent")).distinct()
    return E.ancestors(p).groupBy("node").agg(F.count("*").alias("n_ancestors"), F.min("ancestor").alias("root"))


# --- content ---------------------------------------------------------------------------------------------------------


_TALKS = "with i as (select distinct on (id) * from interview_database order by id, loaded_at)"


def _talks(spark, d):
    return M.first_of(table(spark, d, "interview_database"), ["id"], [F.col("loaded_at")])


@query("select (select count(distinct id) from interview_database) as interviews, (select count(*) from documents) as documents, (select count(distinct document_id) from page_record) as paged, (select count(*) from cluster_summary) as clusters")
def overview_counts(spark, d):
    one = lambda n, c: table(spark, d, n).agg(c)
    a = one("interview_database", F.countDistinct("id").alias("interviews")).join(one("documents", F.count("*").alias("documents")))
    return a.join(one("page_record", F.countDistinct("document_id").alias("paged"))).join(one("cluster_summary", F.count("*").alias("clusters")))


@query(_TALKS + " select id, date_time, method, row_number() over (order by date_time nulls first, id) as place from i")
def interview_list(spark, d):
    t = _talks(spark, d).select("id", "date_time", "method")
    return t.withColumn("place", F.row_number().over(Window.orderBy("date_time", "id")).cast("long"))


@query(_TALKS + " select id, date_time, method, language, n_questions from i where id = (select min(id) from i)")
def interview_detail(spark, d):
    t = _talks(spark, d)
    first = t.agg(F.min("id").alias("id"))
    return t.join(F.broadcast(first), "id").select("id", "date_time", "method", "language", "n_questions")


@query(_TALKS + " select 'method' as field, coalesce(method, 'Unknown') as value, count(*) as n from i group by 2 union all select 'gender', coalesce(gender, 'Unknown'), count(*) from i group by 2 union all select 'language', coalesce(language, 'Unknown'), count(*) from i group by 2 union all select 'mean_words', 'all', cast(coalesce(floor(avg(total_word_count) + 0.5::double), 0) as bigint) from i")
def interview_stats(spark, d):
    """Counts by three fields with a bucket for what isn't known, and the mean length rounded half up (0 if none)."""
    t = _talks(spark, d)
    parts = [t.groupBy(F.coalesce(f, F.lit("Unknown")).alias("value")).agg(F.count("*").alias("n")).select(F.lit(f).alias("field"), "value", "n") for f in ("method", "gender", "language")]
    mean = t.agg(F.coalesce(F.floor(F.avg("total_word_count") + 0.5), F.lit(0)).cast("long").alias("n")).select(F.lit("mean_words").alias("field"), F.lit("all").alias("value"), "n")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(mean)


@query("select corpus, source, count(*) as n, grouping(corpus) as no_corpus, grouping(source) as no_source from documents group by grouping sets ((corpus), (corpus, source), ())")
def registry_summary(spark, d):
    t = table(spark, d, "documents")
    return t.groupingSets([["corpus"], ["corpus", "source"], []], "corpus", "source").agg(F.count("*").alias("n"), F.grouping("corpus").cast("long").alias("no_corpus"), F.grouping("source").cast("long").alias("no_source"))


@query(_POINTS + " select point_id, source_dataset, label, contains(lower(label), 'circle') as hit from s where source_dataset in ('emergent_entities', 'conceptnet_concepts') and label is not null")
def facet_search(spark, d):
    """Points of the chosen sources, with a mark for those whose label holds the text."""
    p = _points(spark, d).filter(F.col("source_dataset").isin("emergent_entities", "conceptnet_concepts") & F.col("label").isNotNull())
    return p.select("point_id", "source_dataset", "label", F.lower("label").contains("circle").alias("hit"))


@query(_POINTS + " select attribution, claim_mode, count(*) as n from s where attribution = 'participant' and claim_mode is distinct from 'quotation' group by 1, 2")
def exemplar_candidates(spark, d):
    """Rows of one attribution whose claim isn't a quotation; those without a claim pass."""
    p = _points(spark, d).filter((F.col("attribution") == "participant") & ~F.col("claim_mode").eqNullSafe("quotation"))
    return p.groupBy("attribution", "claim_mode").agg(F.count("*").alias("n"))


@query("select user_id, time_bucket(interval '1 hour', ts) as start, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_hourly(spark, d):
    from lexilathe.streaming.events import hourly

    return hourly(table(spark, d, "events"))


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as f from events where user_id is not null and ts is not null), s as (select user_id, ts, sum(f) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")
def events_sessions(spark, d):
    from lexilathe.streaming.events import sessions

    return sessions(table(spark, d, "events"))
