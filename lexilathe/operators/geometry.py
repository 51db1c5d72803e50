"""Centroids, dispersion, neighbours and rankings over (id, group, vec) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexilathe.functions import vectors as V

#: A side of at most so many rows is sent to all tasks; a larger one is worked on in blocks of so many.
MOST_GROUPS = 10_000
#: Parts that rows are cut into beside each block.
PARTS = 64


def beside(rows: DataFrame, queries: DataFrame, condition: Column, ident: str) -> DataFrame:
    """Every row beside every one of a stated query set that meets the condition. Up to MOST_GROUPS queries are
    broadcast. More are cut into blocks of about so many, and each block meets each of PARTS parts of the rows in a join
    on both numbers, so no task holds more than a block and a part, and none of it is a nested loop over whole sides."""
    n = queries.count()
    if n <= MOST_GROUPS:
        return rows.join(F.broadcast(queries), condition)
    blocks = -(-n // MOST_GROUPS)
    left = rows.withColumn("_part", F.pmod(F.xxhash64(ident), F.lit(PARTS))).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("_block", F.pmod(F.xxhash64(*queries.columns[:1]), F.lit(blocks)).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    return left.join(right, ["_part", "_block"]).filter(condition).drop("_part", "_block")


def centroids(points: DataFrame, dim: int, by: str = "grp") -> DataFrame:
    """(by, n, centroid) of points (by, vec): one shuffle of partial sums. Rows with a null vec are left out; an empty
    table has no groups."""
    return points.filter("vec is not null").groupBy(by).agg(F.count("*").alias("n"), V.mean_vector(F.col("vec"), dim).alias("centroid"))


def with_distance(points: DataFrame, centers: DataFrame, by: str = "grp") -> DataFrame:
    """points with the distance to their group's centroid. Centers are one row a group, joined on the group."""
    return points.join(centers.select(by, "centroid"), by).withColumn("distance", V.euclidean("vec", "centroid"))


def dispersion(points: DataFrame, dim: int, by: str = "grp") -> DataFrame:
    """(by, n, mean, median, p10, p90) of the distances to the own centroid, percentiles interpolated."""
    d = with_distance(points.filter("vec is not null"), centroids(points, dim, by), by)
    return d.groupBy(by).agg(
        F.count("*").alias("n"), F.avg("distance").alias("mean_distance"), F.percentile("distance", F.lit(0.5)).alias("median_distance"),
        F.percentile("distance", F.lit(0.1)).alias("p10_distance"), F.percentile("distance", F.lit(0.9)).alias("p90_distance"),
    )


def group_pairs(centers: DataFrame, ordered: bool, by: str = "grp") -> DataFrame:
    """All pairs of groups with their centroids; the groups are the stated query set."""
    rest = [c for c in centers.columns if c != by]
    a = centers.select(F.col(by).alias("a"), *[F.col(c).alias(f"a_{c}") for c in rest])
    b = centers.select(F.col(by).alias("b"), *[F.col(c).alias(f"b_{c}") for c in rest])
    return beside(a, b, (F.col("a") != F.col("b")) if ordered else (F.col("a") < F.col("b")), "a")


def query_pairs(points: DataFrame, queries: DataFrame) -> DataFrame:
    """Every point beside every query of a stated query set (q_id, q_vec), itself left out."""
    return beside(points, queries, F.col("id") != F.col("q_id"), "id")


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each partition, ranked from 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def typical_and_atypical(points: DataFrame, dim: int, k: int) -> DataFrame:
    """(grp, side, rank, id, distance): the k members nearest to their centroid and the k farthest, which is the same
    ranking reversed. Ties go to the lower id among the nearest and the higher among the farthest."""
    d = with_distance(points.filter("vec is not null"), centroids(points, dim)).withColumn("distance", F.round("distance", 9))
    near = top_k(d, ["grp"], [F.col("distance"), F.col("id")], k).withColumn("side", F.lit("typical"))
    far = top_k(d, ["grp"], [F.desc("distance"), F.desc("id")], k).withColumn("side", F.lit("atypical"))
    return near.unionByName(far).select("grp", "side", "rank", "id", "distance")


def borderline(points: DataFrame, dim: int, a, b, k: int) -> DataFrame:
    """The k points of two groups whose distances to the two centroids differ least, relative to their mean."""
    c = centroids(points, dim)
    two = c.filter(F.col("grp") == F.lit(a)).select(F.col("centroid").alias("ca")).crossJoin(c.filter(F.col("grp") == F.lit(b)).select(F.col("centroid").alias("cb")))
    d = points.filter(F.col("grp").isin(a, b)).join(F.broadcast(two)).withColumn("da", V.euclidean("vec", "ca")).withColumn("db", V.euclidean("vec", "cb"))
    mean = (F.col("da") + F.col("db")) / 2
    d = d.withColumn("ambiguity", F.round(F.when(mean > 0, F.abs(F.col("da") - F.col("db")) / mean).otherwise(0.0), 9))
    d = d.withColumn("side", F.when(F.col("da") <= F.col("db"), F.lit(a)).otherwise(F.lit(b))).withColumn("least_distance", F.least("da", "db"))
    return d.orderBy("ambiguity", "id").limit(k).select("id", "grp", "side", "ambiguity", "least_distance")


def mean_pairwise_cosine(points: DataFrame, dim: int, by: str = "grp") -> DataFrame:
    """(by, n, mean_cosine) over all pairs of a group without forming them: from the length of the sum of unit vectors.
    Zero vectors are left out; groups of one have none."""
    s = points.withColumn("u", V.unit(F.col("vec"))).filter("u is not null").groupBy(by).agg(F.count("*").alias("n"), V.sum_vector(F.col("u"), dim).alias("s"))
    return s.filter("n > 1").select(by, "n", ((V.dot("s", "s") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cosine"))
