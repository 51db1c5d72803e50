"""Edges: degrees, weights, closures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilathe.session import settle


def degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, degree) over both ends of (a, b); a loop counts twice. Null ends are left out."""
    return edges.select(F.explode(F.array(a, b)).alias("node")).filter("node is not null").groupBy("node").agg(F.count("*").alias("degree"))


def related(edges: DataFrame, seed: str, node: str, relation: str, weight: str) -> DataFrame:
    """(node, total_weight, n_seeds, n_relations, n_edges); a null weight counts as 1."""
    return edges.groupBy(F.col(node).alias("node")).agg(F.sum(F.coalesce(weight, F.lit(1.0))).alias("total_weight"), F.countDistinct(seed).alias("n_seeds"), F.countDistinct(relation).alias("n_relations"), F.count("*").alias("n_edges"))


def ancestors(parents: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, ancestor) for all ancestors in an acyclic relation (node, parent). The depth covered doubles each round."""
    reached = settle(parents.select("node", F.col("parent").alias("ancestor")).distinct())
    count = reached.count()
    for _ in range(most_rounds):
        up = reached.select(F.col("node").alias("x"), F.col("ancestor").alias("y"))
        reached = settle(reached.join(up, F.col("ancestor") == F.col("x")).select("node", F.col("y").alias("ancestor")).union(reached).distinct())
        now = reached.count()
        if now == count:
            return reached
        count = now
    return reached
