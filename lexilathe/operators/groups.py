"""Groups found in the data, rankings against their centroids, and comparisons at equal sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexilathe.functions import vectors as V
from lexilathe.operators.sampling import first_by_hash


def subgroups(points: DataFrame, group: str, status: str, least: int = 3) -> DataFrame:
    """(name, n) of the groups `group__status` that have `least` points; rows without a status belong to none. It is an
    error, raised when the result is read, if there is no such group."""
    g = points.filter(F.col(status).isNotNull()).groupBy(F.concat_ws("__", group, status).alias("name")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    some = g.agg(F.count("*").alias("groups")).select(F.when(F.col("groups") > 0, True).otherwise(F.raise_error(F.lit("no subgroup is large enough")).cast("boolean")).alias("some"))
    return g.join(F.broadcast(some), F.col("some")).select("name", "n")


def tagged(points: DataFrame, group: str, status: str, mentions: str, least: int = 3) -> DataFrame:
    """points once for each named group that they belong to: the group itself, group__status where that has `least`
    points, and entities_<corpus> for each corpus with a mention. The number of names is bounded by that of groups."""
    kept = subgroups(points, group, status, least).select(F.col("name").alias("kept"))
    own = points.select("*", F.col(group).alias("name"))
    sub = points.filter(F.col(status).isNotNull()).withColumn("name", F.concat_ws("__", group, status)).join(F.broadcast(kept), F.col("name") == F.col("kept")).drop("kept")
    some = F.filter(F.map_entries(mentions), lambda e: e["value"] > 0)
    said = points.filter(F.col(mentions).isNotNull()).select("*", F.explode(F.transform(some, lambda e: F.concat(F.lit("entities_"), e["key"]))).alias("name"))
    return own.unionByName(sub).unionByName(said)


def full_ranking(pairs: DataFrame, query: list[str], distance: str, order: list[Column], itself: float = 1e-9) -> DataFrame:
    """pairs with `rank` from 1 by distance for each query; a candidate nearer than `itself` is the query and is left
    out before numbering."""
    w = Window.partitionBy(*query).orderBy(*order)
    return pairs.filter(F.col(distance) >= itself).withColumn("rank", F.row_number().over(w).cast("long"))


def ranking_faults(ranked: DataFrame, query: list[str], distance: str) -> DataFrame:
    """(n_rankings, gaps, inversions): rankings, those whose ranks aren't 1 to n, and places where the distance falls."""
    w = Window.partitionBy(*query).orderBy("rank")
    back = ranked.withColumn("falls", (F.col(distance) < F.lag(distance).over(w)).cast("int"))
    per = back.groupBy(*query).agg((F.max("rank") != F.count("*")).alias("gap"), F.sum(F.coalesce("falls", F.lit(0))).alias("falls"))
    return per.agg(F.count("*").alias("n_rankings"), F.count_if("gap").alias("gaps"), F.coalesce(F.sum("falls"), F.lit(0)).alias("inversions"))


def equal_draws(points: DataFrame, group: str, ident: str, reps: int, most: int | None = None) -> DataFrame:
    """points drawn to the size of the smallest group (at most `most`) from every group, `reps` times over: with `rep`.

    A draw is the least md5 of rep and id, so it is the same for any partitioning. Ids alone are ranked, and the
    vectors are joined to what was drawn."""
    least = points.groupBy(group).count().agg(F.min("count").alias("least"))
    size = least.select((F.least("least", F.lit(most)) if most else F.col("least")).alias("take"))
    ids = points.select(group, ident).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).join(F.broadcast(size))
    drawn = first_by_hash(ids, ["rep", group], F.md5(F.concat_ws(":", "rep", ident)), ident, "take").select("rep", ident)
    return points.join(drawn, ident)


def floor_first(strata: DataFrame, total: int, order: list[Column]) -> DataFrame:
    """strata (…, n) with `take`: one each, as far as `total` goes (smallest first), the rest in proportion (floor of
    the share of what is left), what then lacks one each by size, the greatest first, never more than n. The number of
    strata is small, so their windows are too."""
    small = Window.orderBy("n", *order)
    everything = Window.partitionBy()
    s = strata.withColumn("one", (F.row_number().over(small) <= total).cast("long"))
    s = s.withColumn("left", F.lit(total) - F.sum("one").over(everything)).withColumn("room", F.col("n") - F.col("one"))
    s = s.withColumn("part", F.floor(F.col("left") * F.col("room") / F.greatest(F.sum("room").over(everything), F.lit(1))))
    s = s.withColumn("lack", F.col("left") - F.sum("part").over(everything))
    s = s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), *order)))
    s = s.withColumn("take", F.least(F.col("one") + F.col("part") + (F.col("place") <= F.col("lack")).cast("long"), "n"))
    return s.drop("one", "left", "room", "part", "lack", "place")


def distance_matrix(rows: DataFrame, ident: str, vec: str) -> DataFrame:
    """(a, b, distance): cosine distances of all ordered pairs with the diagonal, which is 0; none below 0. For sets of
    centroids."""
    a, b = rows.select(F.col(ident).alias("a"), F.col(vec).alias("x")), rows.select(F.col(ident).alias("b"), F.col(vec).alias("y"))
    d = F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - V.cosine("x", "y")))
    return a.join(F.broadcast(b)).select("a", "b", d.alias("distance"))
