"""Principal components, downsampling by clusters, silhouettes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexilathe.functions import vectors as V


class Transform:
    """Scaling to unit variance (population) and rotation to principal components, fitted once and cut anywhere."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, components: np.ndarray, ratio: np.ndarray):
        self.mean, self.scale, self.components, self.ratio = mean, scale, components, ratio

    def keep(self, share: float = 0.95) -> int:
        """The least number of components that hold the share of the variance."""
        return int(min(np.searchsorted(np.cumsum(self.ratio), share) + 1, len(self.ratio)))

    def apply(self, points: DataFrame, k: int) -> DataFrame:
        """points with vec projected to the first k components."""
        mean, scale, rotation = self.mean, self.scale, self.components[:k].T
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x = (np.array(pdf["vec"].tolist(), float) - mean) / scale
                    yield pdf.assign(vec=list(x @ rotation))

        return points.mapInPandas(run, fields)


def fit_transform(points: DataFrame, dim: int) -> Transform:
    """From sums of vectors and products, made by task and added up: dim * dim numbers a task, whatever the table's
    size. A constant dimension is left unscaled; fewer than two rows have no components."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, p = 0, np.zeros(dim), np.zeros((dim, dim))
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["vec"].tolist(), float)
                n, s, p = n + len(x), s + x.sum(axis=0), p + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s.tobytes()], "p": [p.tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        s, p = (sum(np.frombuffer(b) for b in pdf[c]) for c in ("s", "p"))
        return pd.DataFrame({"n": [int(pdf["n"].sum())], "s": [s.tobytes()], "p": [p.tobytes()]})

    schema = "n long, s binary, p binary"
    rows = points.select("vec").filter("vec is not null").mapInPandas(run, schema).groupBy((F.spark_partition_id() % 16).alias("g")).applyInPandas(lambda pdf: add(pdf), schema).collect()
    n = sum(r.n for r in rows)
    if n < 2:
        return Transform(np.zeros(dim), np.ones(dim), np.zeros((0, dim)), np.zeros(0))
    s, p = sum(np.frombuffer(r.s) for r in rows), sum(np.frombuffer(r.p) for r in rows).reshape(dim, dim)
    mean = s / n
    cov = p / n - np.outer(mean, mean)
    scale = np.sqrt(np.clip(np.diag(cov), 0, None))
    scale[scale < 1e-12] = 1.0
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    order = np.argsort(values)[::-1][: min(n, dim)]
    values = np.clip(values[order], 0, None)
    return Transform(mean, scale, vectors[:, order].T, values / values.sum() if values.sum() else values)


def downsample(points: DataFrame, k: int, per_cluster: int, seed: int = 42) -> DataFrame:
    """At most per_cluster points of each of k clusters, those first by hash."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = points.withColumn("features", array_to_vector("vec"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster", maxIter=20).fit(ready)
    w = Window.partitionBy("cluster").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id")
    return model.transform(ready).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_cluster).drop("features", "r")


def silhouettes(pairs: DataFrame) -> DataFrame:
    """(q_id, q_grp, silhouette) from pairs (q_id, q_grp, grp, d) of queries with all other points: how much nearer a
    query is to its own group than to the next one. A query alone in its group has 0."""
    mean = pairs.groupBy("q_id", "q_grp", "grp").agg(F.avg("d").alias("m"))
    own = F.max(F.when(F.col("grp") == F.col("q_grp"), F.col("m")))
    other = F.min(F.when(F.col("grp") != F.col("q_grp"), F.col("m")))
    s = mean.groupBy("q_id", "q_grp").agg(own.alias("a"), other.alias("b"))
    return s.select("q_id", "q_grp", F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))
