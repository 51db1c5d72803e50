"""Queries over fitted models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lexilathe.operators import models as O
from lexilathe.plans.vector_queries import _Q, _pairs, points

SQL: dict[str, str] = {}
QUERIES: dict = {}


def pca_variance_curve(spark, d):
    """Share of the variance of each component, and whether it is among those that hold 95 %."""
    t = O.fit_transform(points(spark, d), 64)
    keep, total = t.keep(), np.cumsum(t.ratio)
    return spark.createDataFrame([(i + 1, round(float(r), 6), round(float(c), 6), i < keep) for i, (r, c) in enumerate(zip(t.ratio, total))], "component int, ratio double, cumulative double, kept boolean")


def projected_norms(spark, d):
    """Length of each point under the fitted transform, cut to the components that hold 95 %."""
    p = points(spark, d)
    t = O.fit_transform(p, 64)
    q = t.apply(p, t.keep())
    return q.select("id", "grp", F.round(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("length"))


def kmeans_downsample(spark, d):
    return O.downsample(points(spark, d), 20, 5).select("id", "grp", "cluster")


def silhouette(spark, d):
    """Silhouette of each vector whose id is divisible by 100, against all vectors."""
    return O.silhouettes(_pairs(spark, d).select("q_id", "q_grp", "grp", "d")).select("q_id", "q_grp", F.round("silhouette", 6).alias("silhouette"))


SQL["silhouette"] = _Q + ", m as (select q_id, q_grp, grp, avg(d) as m from p group by q_id, q_grp, grp), s as (select q_id, q_grp, max(case when grp = q_grp then m end) as a, min(case when grp <> q_grp then m end) as b from m group by q_id, q_grp) select q_id, q_grp, round(case when a is null or b is null then 0 else (b - a) / greatest(a, b) end, 6) as silhouette from s"
QUERIES |= {f.__name__: f for f in (pca_variance_curve, projected_norms, kmeans_downsample, silhouette)}
