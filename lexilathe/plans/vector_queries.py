"""Queries over vectors: centroids, dispersion, neighbours, rankings, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexilathe.functions import vectors as V
from lexilathe.operators import geometry as G
from lexilathe.operators import sampling as S
from lexilathe.operators import statistics as T
from lexilathe.session import table

DIM = 64


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), V.doubles(F.col("embedding")).alias("vec"))


def space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid points of shared_space, repeated rows once."""
    s = table(spark, sf_dir, "shared_space").filter(V.is_valid(F.col("vectors"), DIM)).dropDuplicates(["point_id"])
    return s.select(F.col("point_id").alias("id"), F.col("source_dataset").alias("grp"), "epistemic_status", "attribution", "claim_mode", "point_role", "key", "label", V.doubles(F.col("vectors")).alias("vec"))


_V = "with v as (select vec_id as id, label as grp, embedding::double[] as e from embeddings)"
_SPACE = """with s as (select distinct on (point_id) * from shared_space where vectors is not null and len(vectors) = 64
    and len(list_filter(vectors, lambda x: x is not null and not isnan(x) and not isinf(x))) = 64 and len(list_filter(vectors, lambda x: x <> 0)) > 0),
 v as (select point_id as id, source_dataset as grp, epistemic_status, vectors::double[] as e from s)"""
_C = ", m as (select grp, i, avg(e[i]) as m, count(*) as n from v, range(1, 65) t(i) group by grp, i), c as (select grp, list(m order by i) as c, max(n) as n from m group by grp)"

SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(_V + _C + """, d as (select v.grp, list_distance(e, c) as d from v join c using (grp))
select grp, count(*) as n, round(avg(d), 6) as mean_distance, round(median(d), 6) as median_distance, round(quantile_cont(d, 0.1::double), 6) as p10_distance, round(quantile_cont(d, 0.9::double), 6) as p90_distance from d group by grp""")
def centroid_dispersion(spark, d):
    r = G.dispersion(points(spark, d), DIM)
    return r.select("grp", "n", *[F.round(c, 6).alias(c) for c in r.columns[2:]])


@query(_SPACE + _C + """, d as (select v.grp, list_distance(e, c) as d from v join c using (grp))
select grp, count(*) as n, round(avg(d), 6) as mean_distance, round(median(d), 6) as median_distance, round(quantile_cont(d, 0.1::double), 6) as p10_distance, round(quantile_cont(d, 0.9::double), 6) as p90_distance from d group by grp""")
def source_dispersion(spark, d):
    r = G.dispersion(space(spark, d), DIM)
    return r.select("grp", "n", *[F.round(c, 6).alias(c) for c in r.columns[2:]])


@query(_SPACE.replace("vectors::double[] as e from s)", "vectors::double[] as e from s where epistemic_status is null or epistemic_status in ('asserted', 'qualified'))") + _C + """, d as (select v.grp, list_distance(e, c) as d from v join c using (grp))
select grp, count(*) as n, round(avg(d), 6) as mean_distance from d group by grp""")
def status_slice_dispersion(spark, d):
    """Dispersion with a status filter that lets rows without a status pass."""
    s = space(spark, d).filter(F.col("epistemic_status").isNull() | F.col("epistemic_status").isin("asserted", "qualified"))
    return G.dispersion(s, DIM).select("grp", "n", F.round("mean_distance", 6).alias("mean_distance"))


@query(_V + _C + " select i as dim, round(avg(m), 6) as value from m group by i")
def equal_weight_centroid(spark, d):
    c = G.centroids(points(spark, d), DIM).agg(V.mean_vector(F.col("centroid"), DIM).alias("c"))
    return c.select(F.posexplode("c").alias("dim", "value")).select((F.col("dim") + 1).cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query(_V + " select i as dim, round(avg(e[i]), 6) as value from v, range(1, 65) t(i) group by i")
def pooled_centroid(spark, d):
    c = points(spark, d).agg(V.mean_vector(F.col("vec"), DIM).alias("c"))
    return c.select(F.posexplode("c").alias("dim", "value")).select((F.col("dim") + 1).cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query(_V + _C + " select a.grp as a, b.grp as b, round(list_distance(a.c, b.c), 6) as distance, round(list_cosine_similarity(a.c, b.c), 6) as cosine from c a join c b on a.grp <> b.grp")
def centroid_pairwise(spark, d):
    p = G.group_pairs(G.centroids(points(spark, d), DIM), ordered=True)
    return p.select("a", "b", F.round(V.euclidean("a_centroid", "b_centroid"), 6).alias("distance"), F.round(V.cosine("a_centroid", "b_centroid"), 6).alias("cosine"))


@query(_SPACE + _C + """, d as (select v.grp, avg(list_distance(e, c)) as d from v join c using (grp) group by v.grp)
select a.grp as a, b.grp as b, round(list_distance(a.c, b.c), 6) as distance, round(list_distance(a.c, b.c) / ((x.d + y.d) / 2), 6) as separation
from c a join c b on a.grp < b.grp join d x on x.grp = a.grp join d y on y.grp = b.grp""")
def normalized_separation(spark, d):
    """Distance of two centroids over the groups' mean dispersion."""
    s = space(spark, d)
    c = G.centroids(s, DIM)
    spread = G.with_distance(s, c).groupBy("grp").agg(F.avg("distance").alias("spread"))
    p = G.group_pairs(c.join(spread, "grp"), ordered=False)
    dist = V.euclidean("a_centroid", "b_centroid")
    return p.select("a", "b", F.round(dist, 6).alias("distance"), F.round(dist / ((F.col("a_spread") + F.col("b_spread")) / 2), 6).alias("separation"))


@query(_SPACE + " select grp, count(*) as n, round(avg(sqrt(list_dot_product(e, e))), 6) as mean_norm from v group by grp")
def vector_norms(spark, d):
    return space(spark, d).groupBy("grp").agg(F.count("*").alias("n"), F.round(F.avg(V.norm("vec")), 6).alias("mean_norm"))


@query(_V + """, u as (select grp, i, sum(e[i] / sqrt(list_dot_product(e, e))) as s, count(*) as n from v, range(1, 65) t(i) group by grp, i)
select grp, max(n) as n, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 6) as mean_cosine from u group by grp""")
def mean_pairwise_cosine(spark, d):
    return G.mean_pairwise_cosine(points(spark, d), DIM).select("grp", "n", F.round("mean_cosine", 6).alias("mean_cosine"))


@query(_V + _C + """, d as (select v.grp, id, round(list_distance(e, c), 9) as d from v join c using (grp))
select * from (select grp, id, row_number() over (partition by grp order by d, id) as rank, round(d, 6) as distance from d) where rank <= 5""")
def knn_members(spark, d):
    p = points(spark, d)
    r = G.with_distance(p, G.centroids(p, DIM)).withColumn("distance", F.round("distance", 9))
    return G.top_k(r, ["grp"], [F.col("distance"), F.col("id")], 5).select("grp", "id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


@query(_V + _C + """, d as (select v.grp, id, round(list_distance(e, c), 9) as d from v join c using (grp)),
r as (select grp, id, d, row_number() over (partition by grp order by d, id) as a, row_number() over (partition by grp order by d desc, id desc) as z from d)
select grp, 'typical' as side, a as rank, id, round(d, 6) as distance from r where a <= 5 union all select grp, 'atypical', z, id, round(d, 6) from r where z <= 5""")
def typical_atypical(spark, d):
    return G.typical_and_atypical(points(spark, d), DIM, 5).select("grp", "side", F.col("rank").cast("long").alias("rank"), "id", F.round("distance", 6).alias("distance"))


@query(_V + _C + """, d as (select id, v.grp, list_distance(e, a.c) as da, list_distance(e, b.c) as db from v, c a, c b where a.grp = 0 and b.grp = 1 and v.grp in (0, 1))
select id, grp, case when da <= db then 0 else 1 end as side, round(round(abs(da - db) / ((da + db) / 2), 9), 6) as ambiguity, round(least(da, db), 6) as least_distance
from d order by round(abs(da - db) / ((da + db) / 2), 9), id limit 20""")
def borderline_pairs(spark, d):
    r = G.borderline(points(spark, d), DIM, 0, 1, 20)
    return r.select("id", "grp", "side", F.round("ambiguity", 6).alias("ambiguity"), F.round("least_distance", 6).alias("least_distance"))


def _queries_of(p: DataFrame) -> DataFrame:
    return p.filter("id % 100 = 0").select(F.col("id").alias("q_id"), F.col("grp").alias("q_grp"), F.col("vec").alias("q_vec"))


_Q = _V + ", q as (select * from v where id % 100 = 0), p as (select q.id as q_id, q.grp as q_grp, v.id, v.grp, round(list_distance(q.e, v.e), 9) as d, round(list_cosine_similarity(q.e, v.e), 9) as s from q join v on q.id <> v.id)"


def _pairs(spark, d):
    p = points(spark, d)
    return G.query_pairs(p, _queries_of(p)).withColumn("d", F.round(V.euclidean("q_vec", "vec"), 9)).withColumn("s", F.round(V.cosine("q_vec", "vec"), 9))


@query(_Q + " select q_id, grp, rank, id, round(d, 6) as distance from (select *, row_number() over (partition by q_id, grp order by d, id) as rank from p) where rank <= 5")
def query_retrieval_euclidean(spark, d):
    """For each vector whose id is divisible by 100, the 5 nearest of each group."""
    return G.top_k(_pairs(spark, d), ["q_id", "grp"], [F.col("d"), F.col("id")], 5).select("q_id", "grp", F.col("rank").cast("long").alias("rank"), "id", F.round("d", 6).alias("distance"))


@query(_Q + " select q_id, grp, rank, id, round(s, 6) as cosine from (select *, row_number() over (partition by q_id, grp order by s desc, id) as rank from p) where rank <= 5")
def query_retrieval_cosine(spark, d):
    return G.top_k(_pairs(spark, d), ["q_id", "grp"], [F.desc("s"), F.col("id")], 5).select("q_id", "grp", F.col("rank").cast("long").alias("rank"), "id", F.round("s", 6).alias("cosine"))


@query(_Q + " select q_grp, grp, count(*) as n from (select *, row_number() over (partition by q_id order by d, id) as rank from p) where rank <= 10 group by q_grp, grp")
def knn_composition(spark, d):
    """How many of the 10 nearest of each query belong to which group, by the query's group."""
    return G.top_k(_pairs(spark, d), ["q_id"], [F.col("d"), F.col("id")], 10).groupBy("q_grp", "grp").agg(F.count("*").alias("n"))


@query(_Q + " select q_id, round(max(d), 6) as density from (select *, row_number() over (partition by q_id order by d, id) as rank from p) where rank <= 10 group by q_id")
def local_density(spark, d):
    """Distance to the tenth nearest other point."""
    return G.top_k(_pairs(spark, d), ["q_id"], [F.col("d"), F.col("id")], 10).groupBy("q_id").agg(F.round(F.max("d"), 6).alias("density"))


@query(_Q + " select id, round(max(s), 6) as best, arg_max(q_id, s) as best_query, count_if(s >= 0.2) as above from p group by id")
def max_pool_similarity(spark, d):
    return _pairs(spark, d).groupBy("id").agg(F.round(F.max("s"), 6).alias("best"), F.max_by("q_id", "s").alias("best_query"), F.count_if(F.col("s") >= 0.2).alias("above"))


@query(_V + _C + " select id, v.grp, arg_min(c.grp, list_distance(e, c)) as cell, round(min(list_distance(e, c)), 6) as distance from v, c group by id, v.grp")
def voronoi_cells(spark, d):
    """The nearest centroid of each point; the centroids are few, which is checked."""
    p = points(spark, d)
    c = G.centroids(p, DIM).select(F.col("grp").alias("cell"), F.col("centroid"))
    if c.count() > G.MOST_GROUPS:
        raise ValueError("too many cells")
    cells = c.agg(F.collect_list(F.struct("cell", "centroid")).alias("cells"))
    near = F.array_min(F.transform("cells", lambda x: F.struct(V.euclidean(F.col("vec"), x["centroid"]).alias("d"), x["cell"].alias("cell"))))
    return p.join(F.broadcast(cells)).withColumn("near", near).select("id", "grp", F.col("near.cell").alias("cell"), F.round("near.d", 6).alias("distance"))


@query(_V + _C + """, n as (select id, v.grp, arg_min(c.grp, list_distance(e, c)) as cell from v, c group by id, v.grp)
select grp, cell, count(*) as n from n group by grp, cell""")
def nearest_label(spark, d):
    return voronoi_cells(spark, d).groupBy("grp", "cell").agg(F.count("*").alias("n"))


@query("select vec_id as id, label as grp from embeddings order by md5('42:' || vec_id), vec_id limit 50")
def simple_sample(spark, d):
    return S.simple(points(spark, d).select("id", "grp"), "id", 50, 42)


_ALLOC = """with s as (select source, count(*) as size from documents group by source), t as (select sum(size) as total from s),
b as (select source, size, cast(floor(size * 300 / total) as bigint) as base from s, t), m as (select 300 - sum(base) as missing from b),
a as (select source, size, least(size, base + case when row_number() over (order by size desc, source) <= missing then 1 else 0 end) as take from b, m)"""


@query(_ALLOC + " select source, size, cast(take as bigint) as take from a")
def stratified_allocation(spark, d):
    counts = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("size"))
    return S.allocate_floor(counts, "source", 300)


@query(_ALLOC + " select source, doc_id from (select d.source, doc_id, take, row_number() over (partition by d.source order by md5('42:' || doc_id), doc_id) as r from documents d join a using (source)) where r <= take")
def stratified_sample(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id")
    counts = docs.groupBy("source").agg(F.count("*").alias("size"))
    return S.stratified(docs, "source", "doc_id", S.allocate_floor(counts, "source", 300), 42)


@query("""with s as (select source, count(*) as size from documents group by source), t as (select sum(size) as total from s),
b as (select source, size, cast(floor(size * 300.0::double / total) as bigint) as base, round(size * 300.0::double / total - floor(size * 300.0::double / total), 9) as part from s, t), m as (select 300 - sum(base) as missing from b)
select source, size, cast(least(size, base + case when row_number() over (order by part desc, size desc, source) <= missing then 1 else 0 end) as bigint) as take from b, m""")
def largest_remainder_allocation(spark, d):
    counts = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("size"))
    return S.allocate_largest_remainder(counts, "source", 300)


@query("""with n as (select min(c) as n from (select count(*) as c from embeddings group by label))
select label as grp, vec_id as id from (select label, vec_id, n, row_number() over (partition by label order by md5('7:' || vec_id), vec_id) as r from embeddings, n) where r <= n""")
def equal_n_draw(spark, d):
    """As many of each group as the smallest has."""
    p = points(spark, d).select("grp", "id")
    least = p.groupBy("grp").count().agg(F.min("count").alias("take"))
    sizes = p.select("grp").distinct().join(F.broadcast(least))
    return S.stratified(p, "grp", "id", sizes, 7)


_REPS = 20


@query(f"""with r as (select rep, vec_id as id, embedding::double[] as e, label % 3 as grp from embeddings, range(0, {_REPS}) t(rep)),
n as (select min(c) as n from (select count(*) as c from embeddings group by label % 3)),
x as (select * from (select r.*, row_number() over (partition by rep, grp order by md5((42 + rep) || ':' || id), id) as k, n from r, n) where k <= n),
m as (select rep, grp, i, avg(e[i]) as m from x, range(1, 65) t(i) group by rep, grp, i), c as (select rep, grp, list(m order by i) as c from m group by rep, grp),
v as (select x.rep, x.grp, avg(list_distance(e, c)) as d from x join c using (rep, grp) group by x.rep, x.grp)
select grp, count(*) as reps, round(avg(d), 6) as mean, round(stddev_samp(d), 6) as std, round(quantile_cont(d, 0.025::double), 6) as lo, round(quantile_cont(d, 0.975::double), 6) as hi from v group by grp""")
def equal_n_dispersion(spark, d):
    """Dispersion over repeated equal-size draws, one plan keyed by the repetition."""
    p = points(spark, d).withColumn("grp", F.col("grp") % 3)
    least = p.groupBy("grp").count().agg(F.min("count").alias("take"))
    r = S.replicate(p, _REPS).withColumn("o", F.md5(F.concat((F.col("rep") + 42).cast("string"), F.lit(":"), F.col("id").cast("string"))))
    r = r.withColumn("k", F.row_number().over(Window.partitionBy("rep", "grp").orderBy("o", "id"))).join(F.broadcast(least)).filter("k <= take")
    r = r.withColumn("part", F.struct("rep", "grp")).drop("rep", "grp")
    out = G.with_distance(r, G.centroids(r, DIM, "part"), "part").groupBy("part").agg(F.avg("distance").alias("v")).select(F.col("part.grp").alias("grp"), "v")
    s = S.bootstrap_summary(out, ["grp"], "v")
    return s.select("grp", "reps", *[F.round(c, 6).alias(c) for c in ("mean", "std", "lo", "hi")])


@query(_V + """, r as (select grp, id, sqrt(list_dot_product(e, e)) as x, e[1] as y from v),
k as (select *, rank() over (partition by grp order by x) + (count(*) over (partition by grp, x) - 1) / 2.0::double as rx, rank() over (partition by grp order by y) + (count(*) over (partition by grp, y) - 1) / 2.0::double as ry from r)
select grp, count(*) as n, round(corr(rx, ry), 6) as rho from k group by grp""")
def spearman_groups(spark, d):
    p = points(spark, d).withColumn("x", V.norm("vec")).withColumn("y", F.col("vec")[0])
    return T.spearman(p, "x", "y", ["grp"]).select("grp", "n", F.round("rho", 6).alias("rho"))


@query("""with k as (select l_returnflag as grp, l_quantity as x, l_discount > 0.05 as f, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0::double as r from lineitem),
s as (select grp, sum(case when f then r end) as r1, count_if(f) as n1, count_if(not f) as n0 from k group by grp)
select grp, n1, n0, round((r1 - n1 * (n1 + 1) / 2.0::double) / (n1::double * n0), 6) as auc from s""")
def mann_whitney_auc(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_quantity", (F.col("l_discount") > 0.05).alias("f"))
    return T.auc(li, "l_quantity", "f", ["grp"]).select("grp", "n1", "n0", F.round("auc", 6).alias("auc"))


@query("""with f as (select o_orderpriority, regr_slope(o_totalprice, o_custkey) as s, regr_intercept(o_totalprice, o_custkey) as i from orders group by o_orderpriority)
select o_orderkey, round(o_totalprice - s * o_custkey - i, 3) as residual from orders join f using (o_orderpriority)""")
def ols_residuals(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", F.col("o_custkey").cast("double").alias("x"))
    return T.residuals(o, "o_totalprice", "x", ["o_orderpriority"]).select("o_orderkey", F.round("residual", 3).alias("residual"))


@query("""with c as (select quantile_cont(year, 0.3333::double) as lo, quantile_cont(year, 0.6667::double) as hi from documents)
select tercile, count(*) as n, min(year) as first_year, max(year) as last_year from (select year, case when year <= lo then 1 when year <= hi then 2 else 3 end as tercile from documents, c where year is not null) group by tercile""")
def tercile_periods(spark, d):
    y = table(spark, d, "documents").select("year").filter("year is not null")
    return T.terciles(y, "year").groupBy("tercile").agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query("""select event_type, count(*) as n, round(min(value), 4) as least, round(quantile_cont(value, 0.25::double), 4) as q1, round(quantile_cont(value, 0.5::double), 4) as median, round(quantile_cont(value, 0.75::double), 4) as q3, round(max(value), 4) as most from events where value is not null group by event_type""")
def five_number_summary(spark, d):
    return T.five_numbers(table(spark, d, "events"), "value", ["event_type"])


@query(_Q + """ select q_id, round(avg(case when grp = q_grp then rank end), 6) as mean_rank, round(count_if(grp = q_grp and rank <= 10) / 10.0::double, 6) as precision_at_10
from (select *, row_number() over (partition by q_id order by s desc, id) as rank from p) group by q_id""")
def precision_at_k(spark, d):
    """How well each query finds the vectors of its own group."""
    r = _pairs(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("s"), "id")))
    own = F.col("grp") == F.col("q_grp")
    return r.groupBy("q_id").agg(F.round(F.avg(F.when(own, F.col("rank"))), 6).alias("mean_rank"), F.round(F.count_if(own & (F.col("rank") <= 10)) / 10, 6).alias("precision_at_10"))


@query("""with t as (select distinct on (archive_line) * from expression_translations_embedded where embedding_vector is not null and embedding_vector_fr is not null and len(embedding_vector) = 64 and len(embedding_vector_fr) = 64
  and len(list_filter(embedding_vector, lambda x: x is not null and not isnan(x) and not isinf(x))) = 64 and len(list_filter(embedding_vector, lambda x: x <> 0)) > 0
  and len(list_filter(embedding_vector_fr, lambda x: x is not null and not isnan(x) and not isinf(x))) = 64 and len(list_filter(embedding_vector_fr, lambda x: x <> 0)) > 0),
f as (select document_id, list_cosine_similarity(embedding_vector::double[], embedding_vector_fr::double[]) as s from t)
select count(*) as n, round(avg(s), 6) as mean, round(median(s), 6) as median, round(quantile_cont(s, 0.1::double), 6) as p10, round(min(s), 6) as least, count_if(s < 0.7) as flagged from f""")
def translation_fidelity(spark, d):
    """Similarity of each expression's two vectors, and how many are under 0.70."""
    t = table(spark, d, "expression_translations_embedded").filter(V.is_valid(F.col("embedding_vector"), DIM) & V.is_valid(F.col("embedding_vector_fr"), DIM)).dropDuplicates(["archive_line"])
    s = t.select(V.cosine(V.doubles(F.col("embedding_vector")), V.doubles(F.col("embedding_vector_fr"))).alias("s"))
    return s.agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.percentile("s", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("s", F.lit(0.1)), 6).alias("p10"), F.round(F.min("s"), 6).alias("least"), F.count_if(F.col("s") < 0.7).alias("flagged"))


@query("""with q as (select quantile_cont(nearest_entity_euclidean_distance, 0.75::double) as q from cluster_summary)
select cluster_id, nearest_entity, round(nearest_entity_euclidean_distance, 6) as distance, nearest_entity_euclidean_distance >= q as gap from cluster_summary, q where nearest_entity_euclidean_distance is not null""")
def gap_clusters(spark, d):
    """Clusters whose nearest entity is farther than for three quarters of them."""
    c = table(spark, d, "cluster_summary").filter("nearest_entity_euclidean_distance is not null")
    q = c.agg(F.percentile("nearest_entity_euclidean_distance", F.lit(0.75)).alias("q"))
    return c.join(F.broadcast(q)).select("cluster_id", "nearest_entity", F.round("nearest_entity_euclidean_distance", 6).alias("distance"), (F.col("nearest_entity_euclidean_distance") >= F.col("q")).alias("gap"))


@query(_V + _C + """, m2 as (select list(a order by i) as m from (select i, avg(m) as a from m group by i))
select c.grp, round(list_distance(c.c, m2.m), 6) as distance, row_number() over (order by round(list_distance(c.c, m2.m), 9), c.grp) as rank from c, m2""")
def centrality_ranking(spark, d):
    """Groups by the distance of their centroid to the mean of all centroids."""
    c = G.centroids(points(spark, d), DIM)
    mid = c.agg(V.mean_vector(F.col("centroid"), DIM).alias("mid"))
    r = c.join(F.broadcast(mid)).withColumn("x", F.round(V.euclidean("centroid", "mid"), 9))
    return r.select("grp", F.round("x", 6).alias("distance"), F.row_number().over(Window.orderBy("x", "grp")).cast("long").alias("rank"))


@query("""with p as (select embedding[1]::double as x, embedding[2]::double as y from embeddings), b as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from p),
g as (select least(cast(floor((x - x0) / ((x1 - x0) / 12)) as int), 11) as gx, least(cast(floor((y - y0) / ((y1 - y0) / 12)) as int), 11) as gy from p, b),
n as (select gx, gy, count(*) as n from g group by gx, gy)
select cast(i as int) as gx, cast(j as int) as gy, coalesce(n, 0) as n from range(0, 12) a(i), range(0, 12) b(j) left join n on n.gx = i and n.gy = j""")
def gap_grid(spark, d):
    """Histogram over a grid of 12 by 12 cells over the bounding box of two dimensions, the last cell closed; cells
    without points are gaps."""
    p = table(spark, d, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    b = p.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cell = lambda v, lo, hi: F.least(F.floor((F.col(v) - F.col(lo)) / ((F.col(hi) - F.col(lo)) / 12)).cast("int"), F.lit(11))
    n = p.join(F.broadcast(b)).groupBy(cell("x", "x0", "x1").alias("gx"), cell("y", "y0", "y1").alias("gy")).agg(F.count("*").alias("n"))
    steps = F.sequence(F.lit(0), F.lit(11))
    grid = spark.range(1).select(F.explode(steps).alias("gx")).select("gx", F.explode(steps).alias("gy"))
    return grid.join(n, ["gx", "gy"], "left").na.fill(0, ["n"])
