"""All queries of the core library."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from lexilathe.session import shipped

MODULES = ["vector_queries", "group_queries", "text_queries", "record_queries", "source_queries", "model_queries"]


def queries() -> dict:
    found: dict = {}
    for m in MODULES:
        found |= import_module(f"lexilathe.plans.{m}").QUERIES
    return {name: shipped(f) for name, f in found.items()}


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for m in MODULES:
        found |= import_module(f"lexilathe.plans.{m}").SQL
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's dispersion beside its nearest members."""
    q = queries()
    return q["centroid_dispersion"](spark, sf_dir).join(q["knn_members"](spark, sf_dir), "grp")
