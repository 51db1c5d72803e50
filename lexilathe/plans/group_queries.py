"""Queries over groups of points: named groups, rankings, controlled comparisons, tables of nearest points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexilathe.functions import text as X
from lexilathe.functions import vectors as V
from lexilathe.operators import geometry as G
from lexilathe.operators import groups as R
from lexilathe.operators import nearest as N
from lexilathe.operators import sampling as S
from lexilathe.plans.vector_queries import _SPACE, _V, DIM, points
from lexilathe.session import table, written

SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CORPORA = ("literature", "miviludes", "interviews")
_IN = "('literature', 'miviludes', 'interviews')"
_P = _SPACE.replace("vectors::double[] as e from s)", "point_role, attribution, key, label, mention_distribution as said, regexp_replace(key, ':[^:]*$', '') as doc, vectors::double[] as e from s)")
_CENTER = ", m as (select {by}, i, avg(e[i]) as m from {of}, range(1, 65) t(i) group by {by}, i), c as (select {by}, list(m order by i) as c from m group by {by})"


def space(spark, d) -> DataFrame:
    """The valid points of shared_space, repeated rows once, with the document that the key names."""
    s = table(spark, d, "shared_space").filter(V.is_valid(F.col("vectors"), DIM)).dropDuplicates(["point_id"])
    return s.select(F.col("point_id").alias("id"), F.col("source_dataset").alias("grp"), "epistemic_status", "attribution", "point_role", "key", "label", F.col("mention_distribution").alias("said"), F.regexp_replace("key", ":[^:]*$", "").alias("doc"), V.doubles(F.col("vectors")).alias("vec"))


def _written(spark, d, groups: tuple[str, ...], *columns: str) -> DataFrame:
    """The points of space() that are in these groups, with packed vectors, read once and written: id, grp, these
    columns, vec."""
    s = table(spark, d, "shared_space").select(F.col("point_id").alias("id"), F.col("source_dataset").alias("grp"), *columns, F.col("vectors").alias("vec"))
    return written(N.packed(s, "vec", DIM).dropDuplicates(["id"]).filter(F.col("grp").isin(*groups)))


def _asked(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


# --- named groups -----------------------------------------------------------------------------------------------------


@query(_P + " select grp || '__' || epistemic_status as name, count(*) as n from v where epistemic_status is not null group by 1 having count(*) >= 3")
def status_subgroups(spark, d):
    """Groups by corpus and status with at least three points; points without a status are in none."""
    return R.subgroups(space(spark, d), "grp", "epistemic_status")


_NAMED = """, n as (select id, e, grp as name from v union all select id, e, grp || '__' || epistemic_status from v where grp || '__' || epistemic_status in (select grp || '__' || epistemic_status from v where epistemic_status is not null group by 1 having count(*) >= 3)
 union all select id, e, 'entities_' || k from (select id, e, unnest(map_keys(said)) as k, unnest(map_values(said)) as x from v where said is not null) where x > 0)"""


@query(_P + _NAMED + " select name, count(*) as n, count(distinct id) as points, round(avg(sqrt(list_dot_product(e, e))), 6) as mean_norm from n group by name")
def named_groups(spark, d):
    """Corpora, corpora by status, and entities that a corpus mentions, as groups by name."""
    t = R.tagged(space(spark, d), "grp", "epistemic_status", "said")
    return t.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("id").alias("points"), F.round(F.avg(V.norm("vec")), 6).alias("mean_norm"))


@query(_P + " select grp, count(*) as n from v where grp in ('literature', 'miviludes') or (grp = 'interviews' and coalesce(epistemic_status = 'asserted', false)) group by grp")
def prototype_pool(spark, d):
    """Two corpora whole, of the third only the rows whose mark is true (a missing mark isn't)."""
    marked = F.coalesce(F.col("epistemic_status") == "asserted", F.lit(False))
    return space(spark, d).filter(F.col("grp").isin("literature", "miviludes") | ((F.col("grp") == "interviews") & marked)).groupBy("grp").agg(F.count("*").alias("n"))


@query(_P + """, x as (select case when grp = 'literature' then 'a' else 'b' end as pool, 0 as no_key, id from v where grp in ('literature', 'interviews') union all select 'c', (archive_line is null)::int, archive_line from (select distinct archive_line from expression_translations_embedded where text_en is not null))
select pool, count(*) as n, min(id) as least, max(id) as greatest from x group by pool""")
def pools_together(spark, d):
    """Rows of several loaders as one set, each with its label; columns that a loader lacks are null."""
    s = space(spark, d)
    a = s.filter("grp = 'literature'").select("id", "label", F.lit("a").alias("pool"))
    b = s.filter("grp = 'interviews'").select("id", "attribution", F.lit("b").alias("pool"))
    c = table(spark, d, "expression_translations_embedded").filter("text_en is not null").select(F.col("archive_line").alias("id"), F.lit("c").alias("pool")).distinct()
    every = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    return every.groupBy("pool").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("greatest"))


@query("with a as (select document_id as id from page_record), b as (select document_id from chunk), c as (select document_id from stage1_text_integrity) select id, (id in (select * from b)) as in_chunks, (id in (select * from c)) as in_audit from (select id from a union select document_id from b union select document_id from c) where id is not null")
def id_sets(spark, d):
    """The union of the ids of three tables, with what other sets hold each."""
    ids = lambda n: table(spark, d, n).select(F.col("document_id").alias("id")).filter("id is not null").distinct()
    b, c = ids("chunk"), ids("stage1_text_integrity")
    every = ids("page_record").union(b).union(c).distinct()
    every = every.join(b.withColumn("in_chunks", F.lit(True)), "id", "left").join(c.withColumn("in_audit", F.lit(True)), "id", "left")
    return every.na.fill(False, ["in_chunks", "in_audit"])


@query("with e as (select distinct on (point_id) point_id, label, mention_distribution as m from shared_space where mention_distribution is not null) select point_id, label from e where coalesce(map_extract(m, 'literature')[1], 0) > 0 and coalesce(map_extract(m, 'miviludes')[1], 0) > 0 and coalesce(map_extract(m, 'interviews')[1], 0) > 0")
def shared_by_all(spark, d):
    """Entities that all three corpora mention."""
    e = table(spark, d, "shared_space").filter("mention_distribution is not null").dropDuplicates(["point_id"])
    return e.filter(sum(((F.coalesce(F.col("mention_distribution")[c], F.lit(0)) > 0).cast("int") for c in CORPORA), F.lit(0)) == 3).select("point_id", "label")


# --- rankings ---------------------------------------------------------------------------------------------------------

_PAIRS = _V + ", q as (select * from v where id % 100 = 0), p as (select q.id as q_id, v.id, v.grp, round(list_distance(q.e, v.e), 9) as dist, round(list_cosine_similarity(q.e, v.e), 9) as cos from q, v), r as (select *, row_number() over (partition by q_id order by dist, id) as rank from p where dist >= 1e-9)"


def _ranked(spark, d) -> DataFrame:
    p = points(spark, d)
    q = p.filter("id % 100 = 0").select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))
    pairs = G.beside(p, q, F.lit(True), "id").select("q_id", "id", "grp", F.round(V.euclidean("q_vec", "vec"), 9).alias("dist"), F.round(V.cosine("q_vec", "vec"), 9).alias("cos"))
    return R.full_ranking(pairs, ["q_id"], "dist", [F.col("dist"), F.col("id")])


@query(_PAIRS + " select q_id, id, grp, rank, round(dist, 6) as distance from r")
def full_ranking(spark, d):
    """All points ranked by distance to each query point; the query itself is left out before numbering."""
    return _ranked(spark, d).select("q_id", "id", "grp", "rank", F.round("dist", 6).alias("distance"))


@query(_PAIRS + " select count(distinct q_id) as n_rankings, 0::bigint as gaps, 0::bigint as inversions from r")
def ranking_faults(spark, d):
    """What a check of these rankings finds: ranks that aren't contiguous, distances that fall."""
    return R.ranking_faults(_ranked(spark, d), ["q_id"], "dist")


@query(_PAIRS + ", t as (select *, row_number() over (partition by q_id order by cos desc, id) as by_cosine from r) select q_id, id, rank as by_distance, by_cosine from t where id % 50 = 0")
def focus_ranks(spark, d):
    """The places of chosen points among all others by each of two measures."""
    w = Window.partitionBy("q_id").orderBy(F.desc("cos"), "id")
    return _ranked(spark, d).withColumn("by_cosine", F.row_number().over(w).cast("long")).filter("id % 50 = 0").select("q_id", "id", F.col("rank").alias("by_distance"), "by_cosine")


@query(_V + _CENTER.format(by="grp", of="v") + ", x as (select v.grp, id, round(list_distance(e, c), 9) as dist from v join c using (grp)) select grp, id, row_number() over (partition by grp order by dist, id) as rank, rank() over (order by dist) as place, round(dist, 6) as distance from x")
def group_ranking(spark, d):
    """Every member ranked by the distance to its group's centroid, and its place among all members of all groups. The
    places come from counts of equal distances, so no task sorts all rows."""
    p = points(spark, d)
    x = G.with_distance(p, G.centroids(p, DIM)).select("grp", "id", F.round("distance", 9).alias("dist"))
    from lexilathe.operators.statistics import places

    ranked = x.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy("dist", "id")).cast("long"))
    return places(ranked, "dist", "place").select("grp", "id", "rank", "place", F.round("dist", 6).alias("distance"))


_LEVELS = ", n as (select id, e, grp as name from v where grp in " + _IN + " union all select id, e, grp || '__' || epistemic_status from v where grp in " + _IN + " and grp || '__' || epistemic_status in (select grp || '__' || epistemic_status from v where epistemic_status is not null group by 1 having count(*) >= 3))"


@query(_P + _LEVELS + _CENTER.format(by="name", of="n") + """, x as (select name, id, round(list_distance(e, c), 9) as dist from n join c using (name)), r as (select *, row_number() over (partition by name order by dist, id) as a, row_number() over (partition by name order by dist desc, id desc) as z from x)
select name as grp, 'typical' as side, a as rank, id, round(dist, 6) as distance from r where a <= 3 union all select name, 'atypical', z, id, round(dist, 6) from r where z <= 3""")
def typicality_product(spark, d):
    """The three most and least typical points of each corpus and of each corpus by status."""
    t = R.tagged(space(spark, d).filter(F.col("grp").isin(*CORPORA)).withColumn("none", F.lit(None).cast("map<string,int>")), "grp", "epistemic_status", "none")
    r = G.typical_and_atypical(t.select(F.col("name").alias("grp"), "id", "vec"), DIM, 3)
    return r.select("grp", "side", F.col("rank").cast("long").alias("rank"), "id", F.round("distance", 6).alias("distance"))


@query(_P + _CENTER.format(by="grp", of="v") + """, x as (select a.grp as a, b.grp as b, id, list_distance(e, a.c) as da, list_distance(e, b.c) as db from c a join c b on a.grp < b.grp join v on v.grp in (a.grp, b.grp) where a.grp in """ + _IN + " and b.grp in " + _IN + """),
r as (select *, round(abs(da - db) / ((da + db) / 2), 9) as amb from x), k as (select *, row_number() over (partition by a, b order by amb, id) as rank from r) select a, b, rank, id, case when da <= db then a else b end as side, round(amb, 6) as ambiguity, round(least(da, db), 6) as least_distance from k where rank <= 5""")
def borderline_product(spark, d):
    """For each pair of corpora the five points that are most nearly as far from one centroid as from the other. A
    point twice in a pool is an error."""
    s = space(spark, d).filter(F.col("grp").isin(*CORPORA)).select("grp", "id", "vec")
    once = F.when(F.count("*").over(Window.partitionBy("id")) == 1, True).otherwise(F.raise_error(F.lit("a point stands twice in the pool")).cast("boolean"))
    pairs = G.group_pairs(G.centroids(s, DIM).drop("n"), ordered=False)
    x = s.withColumn("once", once).filter("once").join(F.broadcast(pairs), F.col("grp").isin(F.col("a"), F.col("b"))).withColumn("da", V.euclidean("vec", "a_centroid")).withColumn("db", V.euclidean("vec", "b_centroid"))
    mean = (F.col("da") + F.col("db")) / 2
    x = x.withColumn("amb", F.round(F.when(mean > 0, F.abs(F.col("da") - F.col("db")) / mean).otherwise(0.0), 9))
    k = G.top_k(x, ["a", "b"], [F.col("amb"), F.col("id")], 5)
    return k.select("a", "b", F.col("rank").cast("long").alias("rank"), "id", F.when(F.col("da") <= F.col("db"), F.col("a")).otherwise(F.col("b")).alias("side"), F.round("amb", 6).alias("ambiguity"), F.round(F.least("da", "db"), 6).alias("least_distance"))


# --- references and controlled comparisons -----------------------------------------------------------------------------


_REDUCED = ", w as (select * from v where grp in " + _IN + "), k as (select id from (select id, row_number() over (order by md5('7:' || id), id) as r from w where grp = 'literature') where r <= 50)"


@query(_P + _REDUCED + """, full_ as (select i, avg(e[i]) as x from w, range(1, 65) t(i) group by i), eq as (select i, avg(m) as x from (select grp, i, avg(e[i]) as m from w, range(1, 65) t(i) group by grp, i) group by i),
red as (select i, avg(e[i]) as x from w, range(1, 65) t(i) where grp <> 'literature' or id in (select id from k) group by i) select 'full' as mode, i as dim, round(x, 6) as value from full_ union all select 'equal_weight', i, round(x, 6) from eq union all select 'reduced', i, round(x, 6) from red""")
def reference_modes(spark, d):
    """The combined reference by mode: all points, all corpora alike, or with one corpus reduced to a drawn sample."""
    w = space(spark, d).filter(F.col("grp").isin(*CORPORA))
    few = S.simple(w.filter("grp = 'literature'").select("id"), "id", 50, 7)
    center = lambda x: x.agg(V.mean_vector(F.col("vec"), DIM).alias("c"))
    equal = G.centroids(w, DIM).agg(V.mean_vector(F.col("centroid"), DIM).alias("c"))
    reduced = w.filter("grp <> 'literature'").select("id", "vec").unionByName(w.join(few, "id", "left_semi").filter("grp = 'literature'").select("id", "vec"))
    modes = [center(w).withColumn("mode", F.lit("full")), equal.withColumn("mode", F.lit("equal_weight")), center(reduced).withColumn("mode", F.lit("reduced"))]
    every = modes[0].unionByName(modes[1]).unionByName(modes[2]).select("mode", F.posexplode("c").alias("dim", "value"))
    return every.select("mode", (F.col("dim") + 1).cast("long").alias("dim"), F.round("value", 6).alias("value"))


_DRAWN = ", least_ as (select min(n) as n from (select count(*) as n from {of} group by grp)), drawn as (select * from (select rep, grp, id, e, row_number() over (partition by rep, grp order by md5(rep || ':' || id), id) as place from {of}, range(0, {reps}) r(rep)) where place <= (select {size} from least_))"
_OVER = "round(avg(x), 6) as mean, round(coalesce(stddev_samp(x), 0), 6) as std, round(quantile_cont(x, 0.025::double), 6) as low, round(quantile_cont(x, 0.975::double), 6) as high"


def _summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    s = S.bootstrap_summary(rows, by, value)
    return s.select(*by, "reps", *[F.round(a, 6).alias(b) for a, b in (("mean", "mean"), ("std", "std"), ("lo", "low"), ("hi", "high"))])


@query(_V + _DRAWN.format(of="v", reps=3, size="least(n, 20)") + ", q as (select id, e from v where id % 100 = 0), p as (select rep, grp, q.id as q_id, list_distance(q.e, x.e) as dist, row_number() over (partition by rep, grp, q.id order by round(list_distance(q.e, x.e), 9), x.id) as k from q join drawn x on x.id <> q.id), m as (select rep, grp, avg(dist) as x from p where k <= 10 group by rep, grp) select grp, count(*) as reps, " + _OVER + " from m group by grp")
def equal_size_nearest(spark, d):
    """The mean distance of query points to the ten nearest of each group, at equal group sizes, over repeated draws."""
    return _summary(_equal_nearest(spark, d, 3).groupBy("rep", "grp").agg(F.avg("dist").alias("x")), ["grp"], "x")


def _equal_nearest(spark, d, reps) -> DataFrame:
    p = points(spark, d)
    q = p.filter("id % 100 = 0").select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))
    x = G.query_pairs(R.equal_draws(p, "grp", "id", reps, 20), q).withColumn("dist", V.euclidean("q_vec", "vec")).withColumn("near", F.round("dist", 9))
    return G.top_k(x, ["rep", "grp", "q_id"], [F.col("near"), F.col("id")], 10, "k")


@query(_V + _DRAWN.format(of="v", reps=2, size="least(n, 20)") + ", q as (select id, e from v where id % 100 = 0), p as (select rep, grp, q.id as q_id, row_number() over (partition by rep, q.id order by round(list_distance(q.e, x.e), 9), x.id) as k from q join drawn x on x.id <> q.id) select rep, q_id, grp, count(*) as n, round(count(*) / 10.0::double, 6) as share from p where k <= 10 group by rep, q_id, grp")
def equal_n_composition(spark, d):
    """Of which groups the ten nearest of each query point are, at equal group sizes. It is an error if the shares of a
    query don't sum to one."""
    p = points(spark, d)
    q = p.filter("id % 100 = 0").select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))
    x = G.query_pairs(R.equal_draws(p, "grp", "id", 2, 20), q).withColumn("near", F.round(V.euclidean("q_vec", "vec"), 9))
    n = G.top_k(x, ["rep", "q_id"], [F.col("near"), F.col("id")], 10, "k").groupBy("rep", "q_id", "grp").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("rep", "q_id"))
    checked = n.withColumn("fine", F.when(whole == 10, True).otherwise(F.raise_error(F.lit("shares of a query don't sum to one")).cast("boolean"))).filter("fine")
    return checked.select(F.col("rep").cast("long").alias("rep"), "q_id", "grp", "n", F.round(F.col("n") / 10, 6).alias("share"))


@query(_P + """, a as (select grp, count(*) as n from v where grp in """ + _IN + """ group by grp), o as (select grp, row_number() over (order by grp) - 1 as i from a), r as (select v.grp, id, row_number() over (partition by v.grp order by md5((100 + 1000 * i) || ':' || id), id) as r from v join o using (grp)) select grp, id from r where r <= 15""")
def sub_seed_sample(spark, d):
    """Fifteen points of each corpus, drawn with a seed of its own; it is an error if a corpus has fewer."""
    s = space(spark, d).filter(F.col("grp").isin(*CORPORA)).select("grp", "id")
    n = s.groupBy("grp").count()
    seeds = n.withColumn("seed", F.lit(100) + 1000 * (F.row_number().over(Window.orderBy("grp")) - 1))
    seeds = seeds.withColumn("take", F.when(F.col("count") >= 15, F.lit(15)).otherwise(F.raise_error(F.lit("a corpus has fewer points than asked for")).cast("int")))
    return S.first_by_hash(s.join(F.broadcast(seeds), "grp"), ["grp"], F.md5(F.concat_ws(":", "seed", "id")), "id", "take").select("grp", "id")


@query(_P + """, g as (select grp, epistemic_status as status, count(*) as n from v where epistemic_status is not null and grp in """ + _IN + """ group by 1, 2), a as (select *, (row_number() over (order by n, grp, status) <= 60)::int as one from g),
b as (select *, 60 - sum(one) over () as rest, n - one as room from a), c as (select *, floor(rest * room::double / greatest(sum(room) over (), 1)) as part from b), e as (select *, rest - sum(part) over () as lack, row_number() over (order by n desc, grp, status) as place from c)
select grp, status, n, cast(least(one + part + (place <= lack)::int, n) as bigint) as take from e""")
def floor_first_allocation(spark, d):
    """Sixty rows over corpus and status: one each, the rest in proportion, what then lacks to the largest."""
    g = space(spark, d).filter(F.col("epistemic_status").isNotNull() & F.col("grp").isin(*CORPORA)).groupBy("grp", F.col("epistemic_status").alias("status")).agg(F.count("*").alias("n"))
    return R.floor_first(g, 60, [F.col("grp"), F.col("status")]).select("grp", "status", "n", F.col("take").cast("long").alias("take"))


@query(_P + """, f as (select id, grp from v where grp = 'miviludes_criteria'), o as (select id, grp from v where grp <> 'miviludes_criteria' order by md5('3:' || id), id limit 40) select id, grp, 'forced' as why from f union all select id, grp, 'drawn' from o""")
def forced_and_drawn(spark, d):
    """A set that is taken whole, and a draw from what isn't in it."""
    s = space(spark, d).select("id", "grp")
    forced = s.filter("grp = 'miviludes_criteria'").withColumn("why", F.lit("forced"))
    return forced.unionByName(S.simple(s.join(forced.select("id"), "id", "left_anti"), "id", 40, 3).withColumn("why", F.lit("drawn")))


@query(_P + " select grp, count(*) as n, min(id) as least from (select * from v order by md5('11:' || id), id limit 200) group by grp")
def pooled_sample(spark, d):
    """A uniform draw from the pool of all points, by corpus."""
    return S.simple(space(spark, d).select("id", "grp"), "id", 200, 11).groupBy("grp").agg(F.count("*").alias("n"), F.min("id").alias("least"))


# --- tables of nearest points ------------------------------------------------------------------------------------------


@query(_P + ", w as (select * from v where grp in " + _IN + ")" + _CENTER.format(by="grp", of="w") + " select v.id as q_id, c.grp, round(list_distance(v.e, c.c), 6) as distance, round(list_cosine_similarity(v.e, c.c), 6) as cosine from v, c where v.grp = 'miviludes_criteria'")
def centroid_distances(spark, d):
    """Each criterion beside each corpus' centroid."""
    s = space(spark, d)
    c = G.centroids(s.filter(F.col("grp").isin(*CORPORA)), DIM)
    q = s.filter("grp = 'miviludes_criteria'").select(F.col("id").alias("q_id"), "vec")
    return q.join(F.broadcast(c)).select("q_id", "grp", F.round(V.euclidean("vec", "centroid"), 6).alias("distance"), F.round(V.cosine("vec", "centroid"), 6).alias("cosine"))


_CRIT = _P + ", q as (select id as q_id, e as qe from v where grp = 'miviludes_criteria'), p as (select q_id, id, grp, doc, key, round(list_distance(qe, e), 9) as dist, round(list_cosine_similarity(qe, e), 9) as cos from q, v where grp <> 'miviludes_criteria')"


def _criteria(spark, d) -> DataFrame:
    s = space(spark, d)
    q = s.filter("grp = 'miviludes_criteria'").select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))
    p = G.query_pairs(s.filter("grp <> 'miviludes_criteria'"), q)
    return p.select("q_id", "id", "grp", "doc", "key", F.round(V.euclidean("q_vec", "vec"), 9).alias("dist"), F.round(V.cosine("q_vec", "vec"), 9).alias("cos"))


@query(_CRIT + ", r as (select *, row_number() over (partition by q_id, grp order by dist, id) as rank from p) select q_id, grp, rank, id, round(dist, 6) as distance from r where rank <= case grp when 'literature' then 5 when 'interviews' then 3 when 'emergent_entities' then 2 else 0 end")
def criterion_pools(spark, d):
    """The nearest points to each criterion, of three pools, with a number for each."""
    most = F.when(F.col("grp") == "literature", 5).when(F.col("grp") == "interviews", 3).when(F.col("grp") == "emergent_entities", 2).otherwise(0)
    r = G.top_k(_criteria(spark, d).filter(most > 0), ["q_id", "grp"], [F.col("dist"), F.col("id")], 5)
    return r.filter(F.col("rank") <= most).select("q_id", "grp", F.col("rank").cast("long").alias("rank"), "id", F.round("dist", 6).alias("distance"))


@query(_CRIT + ", n as (select distinct point_id, label from shared_space), r as (select *, row_number() over (partition by q_id, grp order by dist, id) as rank from p where grp in " + _IN + ") select q_id, grp, rank, id, doc, coalesce(nullif(trim(label), ''), key) as context from r join n on n.point_id = r.id where rank <= 5")
def anchor_retrieval(spark, d):
    """The five nearest of each corpus to each criterion with their text, which must not be blank."""
    s = _written(spark, d, (*CORPORA, "miviludes_criteria"), "key", "label")
    p = N.best(s.filter(F.col("grp").isin(*CORPORA)), _asked(s.filter("grp = 'miviludes_criteria'")), DIM, 5, "euclidean")
    r = G.top_k(p, ["q_id", "grp"], [F.round("value", 9), F.col("id")], 5)
    n = s.select("id", F.regexp_replace("key", ":[^:]*$", "").alias("doc"), "key", "label")
    said = F.coalesce(F.nullif(F.trim("label"), F.lit("")), "key")
    text = F.when(said.isNotNull(), said).otherwise(F.raise_error(F.lit("a point has no context")))
    return r.join(n, "id").select("q_id", "grp", F.col("rank").cast("long").alias("rank"), "id", "doc", text.alias("context"))


@query(_CRIT + ", g as (select q_id, grp, min(dist) as dist, max(cos) as cos from p where grp in " + _IN + " group by 1, 2) select q_id, arg_min(grp, struct_pack(a := dist, b := grp)) as nearest, arg_max(grp, struct_pack(a := cos, b := grp)) as most_similar, arg_min(grp, struct_pack(a := dist, b := grp)) <> arg_max(grp, struct_pack(a := cos, b := grp)) as differ from g group by q_id")
def best_corpus(spark, d):
    """The corpus nearest to each criterion by each of two measures, and whether they differ."""
    s = _written(spark, d, (*CORPORA, "miviludes_criteria"))
    p = N.best(s.filter(F.col("grp").isin(*CORPORA)), _asked(s.filter("grp = 'miviludes_criteria'")), DIM, 1, "euclidean", "cosine")
    of = lambda m: F.round(F.when(F.col("measure") == m, F.col("value")), 9)
    g = p.groupBy("q_id", "grp").agg(F.min(of("euclidean")).alias("dist"), F.max(of("cosine")).alias("cos"))
    b = g.groupBy("q_id").agg(F.min_by("grp", F.struct("dist", "grp")).alias("nearest"), F.max_by("grp", F.struct("cos", "grp")).alias("most_similar"))
    return b.withColumn("differ", F.col("nearest") != F.col("most_similar"))


@query(_P + ", q as (select id as q_id, doc as q_doc, e as qe from v where grp = 'interviews' and id % 10 = 0), p as (select q_id, q_doc, id, doc, round(list_distance(qe, e), 9) as dist from q, v where grp = 'interviews' and id <> q_id), r as (select *, row_number() over (partition by q_id order by dist, id) as rank from p) select q_id, id, rank, round(dist, 6) as distance, coalesce(rank = 1 and doc = q_doc, false) as same_document from r where rank <= 3")
def exemplar_neighbours(spark, d):
    """The three nearest expressions of the same corpus, with a mark where the first is of the same document."""
    s = _written(spark, d, ("interviews",), "key")
    p = N.best(s, _asked(s.filter("id % 10 = 0")), DIM, 3, "euclidean").withColumn("dist", F.round("value", 9))
    r = G.top_k(p, ["q_id"], [F.col("dist"), F.col("id")], 3)
    docs = s.select("id", F.regexp_replace("key", ":[^:]*$", "").alias("doc"))
    r = r.join(docs, "id").join(docs.select(F.col("id").alias("q_id"), F.col("doc").alias("q_doc")), "q_id")
    same = F.coalesce((F.col("rank") == 1) & (F.col("doc") == F.col("q_doc")), F.lit(False))
    return r.select("q_id", "id", F.col("rank").cast("long").alias("rank"), F.round("dist", 6).alias("distance"), same.alias("same_document"))


@query(_P + """, y as (select id, e, try_cast(nullif(regexp_extract(doc, '(?:^|-)((?:19|20)[0-9]{2})(?:-|$)', 1), '') as int) as year from v), t as (select quantile_cont(year, 1/3::double) as a, quantile_cont(year, 2/3::double) as b from y where year is not null),
p as (select id, e, year, case when year <= a then 'early' when year <= b then 'middle' else 'late' end as grp from y, t where year is not null)""" + _CENTER.format(by="grp", of="p") + ", o as (select grp, count(*) as n, min(year) as first_year, max(year) as last_year from p group by grp) select x.grp as a, y.grp as b, p.n as n_a, p.first_year, p.last_year, round(list_distance(x.c, y.c), 6) as distance from c x join c y on x.grp <> y.grp join o p on p.grp = x.grp")
def period_centroids(spark, d):
    """Points by the year in their document's id, in three periods of the years' terciles (rows without a year left
    out), with the distances of the periods' centroids."""
    y = space(spark, d).withColumn("year", X.year_of(F.col("doc"))).filter("year is not null").select("id", "vec", "year")
    t = y.agg(F.percentile("year", F.lit(1 / 3)).alias("t1"), F.percentile("year", F.lit(2 / 3)).alias("t2"))
    p = y.join(F.broadcast(t)).withColumn("grp", F.when(F.col("year") <= F.col("t1"), "early").when(F.col("year") <= F.col("t2"), "middle").otherwise("late"))
    c = G.centroids(p, DIM).drop("n").join(p.groupBy("grp").agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year")), "grp")
    r = G.group_pairs(c, ordered=True)
    return r.select("a", "b", F.col("a_n").alias("n_a"), F.col("a_first_year").alias("first_year"), F.col("a_last_year").alias("last_year"), F.round(V.euclidean("a_centroid", "b_centroid"), 6).alias("distance"))


# --- clusters and poles -------------------------------------------------------------------------------------------------

_CORE = _V + _CENTER.format(by="grp", of="v") + ", x as (select v.grp, id, e, round(list_distance(e, c), 9) as dist from v join c using (grp)), r as (select *, row_number() over (partition by grp order by dist, id) as rank from x)"


def _cores(spark, d, k: int) -> DataFrame:
    p = points(spark, d)
    x = G.with_distance(p, G.centroids(p, DIM)).withColumn("dist", F.round("distance", 9))
    return G.top_k(x, ["grp"], [F.col("dist"), F.col("id")], k)


@query(_CORE + ", k as (select * from r where rank <= 5), y as (select grp, i, avg(e[i]) as y from k, range(1, 65) t(i) group by grp, i), z as (select grp, list(y order by i) as z from y group by grp), n as (select grp, count(distinct e) as vectors from k group by grp) select grp, vectors as n_vectors, vectors = 1 as degenerate, round(list_distance(z, c), 6) as distance from z join c using (grp) join n using (grp)")
def core_proxies(spark, d):
    """A centroid of each group's five most typical members, how far it is from the whole group's, and whether it is
    degenerate, all members having one vector."""
    k = _cores(spark, d, 5)
    proxy = k.groupBy("grp").agg(V.mean_vector(F.col("vec"), DIM).alias("z"), F.countDistinct("vec").alias("n_vectors"), F.first("centroid").alias("c"))
    return proxy.select("grp", "n_vectors", (F.col("n_vectors") == 1).alias("degenerate"), F.round(V.euclidean("z", "c"), 6).alias("distance"))


@query(_CORE + ", s as (select grp, count(*) as n from v group by grp order by n desc, grp limit 5) select r.grp, s.n as size, r.rank, r.id from r join s using (grp) where rank <= 3")
def largest_clusters(spark, d):
    """The three members nearest to the centroid of each of the five largest groups."""
    s = points(spark, d).groupBy("grp").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "grp").limit(5)
    return _cores(spark, d, 3).join(F.broadcast(s), "grp").select("grp", "size", F.col("rank").cast("long").alias("rank"), "id")


@query(_P + ", w as (select * from v where grp in " + _IN + ")" + _CENTER.format(by="grp", of="w") + ", p as (select c.grp, w.id, w.grp as other, round(list_cosine_similarity(c.c, w.e), 9) as cos from c join w on w.grp <> c.grp), r as (select *, row_number() over (partition by grp, other order by cos desc, id) as rank from p) select grp, other, rank, id, round(cos, 6) as cosine from r where rank <= 5")
def across_corpora(spark, d):
    """The five points of each other corpus that are most similar to a corpus' centroid."""
    w = space(spark, d).filter(F.col("grp").isin(*CORPORA))
    c = G.centroids(w, DIM).select(F.col("grp").alias("own"), "centroid")
    p = w.join(F.broadcast(c), F.col("grp") != F.col("own")).withColumn("cos", F.round(V.cosine("centroid", "vec"), 9))
    r = G.top_k(p, ["own", "grp"], [F.desc("cos"), F.col("id")], 5)
    return r.select(F.col("own").alias("grp"), F.col("grp").alias("other"), F.col("rank").cast("long").alias("rank"), "id", F.round("cos", 6).alias("cosine"))


@query(_P + """, q as (select 'criterion' as kind, 'c' || id as pole, e from v where grp = 'miviludes_criteria' and id % 2 = 0 union all select 'entity', 'e' || id, e from v where grp = 'emergent_entities' and id % 20 = 0)
select kind, pole, grp, count(*) as n, round(avg(list_cosine_similarity(q.e, v.e)), 6) as mean_cosine from q, v where grp in """ + _IN + " group by kind, pole, grp")
def pole_means(spark, d):
    """Poles of two kinds put together, and the mean similarity of each corpus to each pole. Means of unit vectors are
    summed first, so no pair of pole and point is formed."""
    s = space(spark, d)
    kinds = [("criterion", "c", "miviludes_criteria", 2), ("entity", "e", "emergent_entities", 20)]
    parts = [s.filter((F.col("grp") == g) & (F.col("id") % m == 0)).select(F.lit(k).alias("kind"), F.concat(F.lit(a), "id").alias("pole"), V.unit(F.col("vec")).alias("u")) for k, a, g, m in kinds]
    poles = parts[0].unionByName(parts[1])
    m = s.filter(F.col("grp").isin(*CORPORA)).groupBy("grp").agg(F.count("*").alias("n"), V.mean_vector(V.unit(F.col("vec")), DIM).alias("mean"))
    return poles.join(F.broadcast(m)).select("kind", "pole", "grp", "n", F.round(V.dot("u", "mean"), 6).alias("mean_cosine"))


@query(_P + ", w as (select * from v where grp in " + _IN + "), q as (select id as q_id, e as qe from v where grp = 'miviludes_criteria'), x as (select q_id, grp, count(*) as available from q, w where list_cosine_similarity(qe, e) >= 0.2 group by 1, 2) select q.q_id, g.grp, 25::bigint as requested, coalesce(available, 0) as available, least(coalesce(available, 0), 25) as taken, greatest(25 - coalesce(available, 0), 0) as short from q cross join (select distinct grp from w) g left join x on x.q_id = q.q_id and x.grp = g.grp")
def focused_population(spark, d):
    """For each criterion and corpus how many similar points are asked for, there, taken, and lacking."""
    s = space(spark, d)
    w = s.filter(F.col("grp").isin(*CORPORA))
    q = s.filter("grp = 'miviludes_criteria'").select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))
    x = G.query_pairs(w, q).filter(V.cosine("q_vec", "vec") >= 0.2).groupBy("q_id", "grp").agg(F.count("*").alias("available"))
    every = q.select("q_id").join(F.broadcast(w.select("grp").distinct())).join(x, ["q_id", "grp"], "left").na.fill(0, ["available"])
    return every.select("q_id", "grp", F.lit(25).cast("long").alias("requested"), "available", F.least("available", F.lit(25)).alias("taken"), F.greatest(F.lit(25) - F.col("available"), F.lit(0)).alias("short"))


@query(_V + _CENTER.format(by="grp", of="v") + " select x.grp as a, y.grp as b, round(case when x.grp = y.grp then 0 else greatest(0, 1 - list_cosine_similarity(x.c, y.c)) end, 6) as distance from c x, c y")
def distance_matrix(spark, d):
    """Cosine distances of the groups' centroids, diagonal included, as an input of scaling."""
    m = R.distance_matrix(G.centroids(points(spark, d), DIM), "grp", "centroid")
    return rounded(m, distance=6)


@query(_P + """, m as (select id, label from v where grp = 'emergent_entities' and id % 3 = 0 and label is not null), q as (select * from v where grp = 'emergent_entities' and id % 3 <> 0), x as (select q.id, max(round(list_cosine_similarity(q.e, p.e), 9)) as cos from q, v p where p.grp = 'emergent_entities' and p.id % 3 = 0 group by q.id)
select x.id, round(cos, 6) as best, cos >= 0.5 and q.label not in (select label from m) as review from x join q using (id) where q.label is not null""")
def review_list(spark, d):
    """Each entity's greatest similarity to a pool, and whether it must be looked at: similar to the pool, not in it."""
    s = _written(spark, d, ("emergent_entities",), "label")
    pool, q = s.filter("id % 3 = 0"), s.filter("id % 3 <> 0 and label is not null")
    p = N.best(pool, _asked(q), DIM, 1, "cosine")
    best = p.groupBy(F.col("q_id").alias("id")).agg(F.max(F.round("value", 9)).alias("cos")).join(q.select("id", "label"), "id")
    known = pool.filter("label is not null").select("label").distinct().withColumn("known", F.lit(True))
    return best.join(known, "label", "left").select("id", F.round("cos", 6).alias("best"), ((F.col("cos") >= 0.5) & F.col("known").isNull()).alias("review"))


# --- masked vectors, cluster profiles, named sets -----------------------------------------------------------------------


@query(_V + """, k as (select id, grp, list_transform(e, lambda x, i: case when id % 2 = 0 and i <= 16 then 0.0 else x end) as m, e from v), q as (select * from k where id % 100 = 0), p as (select q.id as q_id, q.grp = k.grp as own, row_number() over (partition by q.id order by round(list_cosine_similarity(q.e, k.e), 9) desc, k.id) as a, row_number() over (partition by q.id order by round(list_cosine_similarity(q.e, k.m), 9) desc, k.id) as b from q join k on k.id <> q.id)
select q_id, round(count_if(own and a <= 10) / 10.0::double, 6) as precision_unmasked, round(count_if(own and b <= 10) / 10.0::double, 6) as precision_masked, round(avg(a) filter (where own), 6) as rank_unmasked, round(avg(b) filter (where own), 6) as rank_masked from p group by q_id""")
def masked_retrieval(spark, d):
    """Precision at ten and mean rank of the own group's points, as they are and with masked vectors put in where there
    are some."""
    p = points(spark, d)
    masked = p.filter("id % 2 = 0").select("id", F.transform("vec", lambda x, i: F.when(i < 16, 0.0).otherwise(x)).alias("masked"))
    pool = p.join(masked, "id", "left").withColumn("masked", F.coalesce("masked", "vec"))
    q = p.filter("id % 100 = 0").select(F.col("id").alias("q_id"), F.col("grp").alias("q_grp"), F.col("vec").alias("q_vec"))
    x = G.query_pairs(pool, q).select("q_id", "id", (F.col("grp") == F.col("q_grp")).alias("own"), F.round(V.cosine("q_vec", "vec"), 9).alias("s"), F.round(V.cosine("q_vec", "masked"), 9).alias("t"))
    rank = lambda c: F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc(c), "id"))
    x = x.withColumn("a", rank("s")).withColumn("b", rank("t"))
    of = lambda c: F.round(F.count_if(F.col("own") & (F.col(c) <= 10)) / 10, 6)
    mean = lambda c: F.round(F.avg(F.when(F.col("own"), F.col(c))), 6)
    return x.groupBy("q_id").agg(of("a").alias("precision_unmasked"), of("b").alias("precision_masked"), mean("a").alias("rank_unmasked"), mean("b").alias("rank_masked"))


@query(_V + _CENTER.format(by="grp", of="v") + ", g as (select list(x order by i) as g from (select i, avg(e[i]) as x from v, range(1, 65) t(i) group by i)), s as (select v.grp, count(*) as size, round(avg(list_distance(e, c)), 6) as dispersion, array_to_string(list_sort(list(id))[1:3], ';') as members from v join c using (grp) group by v.grp) select s.grp, size, dispersion, round(list_distance(c, g), 6) as to_grand_centroid, members from s join c using (grp), g")
def cluster_profiles(spark, d):
    """Each group's size, dispersion, distance to the grand centroid and first members."""
    p = points(spark, d)
    c = G.centroids(p, DIM)
    grand = p.agg(V.mean_vector(F.col("vec"), DIM).alias("g"))
    s = G.with_distance(p, c).groupBy("grp").agg(F.count("*").alias("size"), F.round(F.avg("distance"), 6).alias("dispersion"))
    first = G.top_k(p.select("grp", "id"), ["grp"], [F.col("id")], 3).groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ";").alias("members"))
    return s.join(c.select("grp", "centroid"), "grp").join(F.broadcast(grand)).join(first, "grp").select("grp", "size", "dispersion", F.round(V.euclidean("centroid", "g"), 6).alias("to_grand_centroid"), "members")


@query(_P + ", w as (select * from v where grp in " + _IN + ")" + _CENTER.format(by="grp", of="w") + ", x as (select v.grp as named, v.id, c.grp as cluster, round(list_cosine_similarity(v.e, c.c), 9) as cos from v, c where v.grp in ('miviludes_criteria', 'emergent_entities')), r as (select *, row_number() over (partition by named, id order by cos desc, cluster) as k from x) select named, id, cluster, round(cos, 6) as cosine, cos >= 0.3 as member, row_number() over (partition by named order by cos desc, id) as place from r where k = 1")
def nearest_clusters(spark, d):
    """The cluster nearest to each member of two named sets, whether it is near enough, and its place in its set."""
    s = space(spark, d)
    c = G.centroids(s.filter(F.col("grp").isin(*CORPORA)), DIM).select(F.col("grp").alias("cluster"), "centroid")
    x = s.filter(F.col("grp").isin("miviludes_criteria", "emergent_entities")).join(F.broadcast(c)).select(F.col("grp").alias("named"), "id", "cluster", F.round(V.cosine("vec", "centroid"), 9).alias("cos"))
    best = x.groupBy("named", "id").agg(F.max_by(F.struct("cluster", "cos"), F.struct("cos", F.negate(F.ascii("cluster")))).alias("b")).select("named", "id", "b.*")
    place = F.row_number().over(Window.partitionBy("named").orderBy(F.desc("cos"), "id"))
    return best.select("named", "id", "cluster", F.round("cos", 6).alias("cosine"), (F.col("cos") >= 0.3).alias("member"), place.cast("long").alias("place"))
