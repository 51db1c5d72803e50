"""Rank statistics, regression residuals and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def average_rank(df: DataFrame, value: str, name: str, by: list[str]) -> DataFrame:
    """Rank from 1, ties sharing the mean of their ranks, within each partition."""
    w = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return df.withColumn(name, F.rank().over(w) + (F.count("*").over(ties) - 1) / 2)


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, n, rho) over rows where both are set."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(rows, x, "rx", by), y, "ry", by)
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))


def auc(df: DataFrame, score: str, flag: str, by: list[str]) -> DataFrame:
    """(by, n1, n0, auc): the share of (true, false) pairs in which the true one scores higher, ties counting half, from
    rank sums."""
    ranked = average_rank(df.filter(F.col(score).isNotNull() & F.col(flag).isNotNull()), score, "r", by)
    s = ranked.groupBy(*by).agg(F.sum(F.when(F.col(flag), F.col("r"))).alias("r1"), F.count_if(F.col(flag)).alias("n1"), F.count_if(~F.col(flag)).alias("n0"))
    return s.filter("n1 > 0 and n0 > 0").select(*by, "n1", "n0", ((F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))).alias("auc"))


def residuals(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """df with the residual of the least squares line of y on x, fitted by partition; joined back on the partition."""
    fit = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return df.join(fit, by).withColumn("residual", F.col(y) - F.col("slope") * F.col(x) - F.col("intercept"))


def five_numbers(df: DataFrame, value: str, by: list[str], digits: int = 4) -> DataFrame:
    """(by, n, least, q1, median, q3, most), rounded."""
    q = lambda p: F.round(F.percentile(value, F.lit(p)), digits)
    return df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.round(F.min(value), digits).alias("least"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.round(F.max(value), digits).alias("most"))


def terciles(df: DataFrame, value: str) -> DataFrame:
    """df with tercile 1, 2 or 3 by the 33.33 and 66.67 percentiles of all rows, upper bounds included."""
    cut = df.agg(F.percentile(value, F.lit(0.3333)).alias("lo"), F.percentile(value, F.lit(0.6667)).alias("hi"))
    return df.join(F.broadcast(cut)).withColumn("tercile", F.when(F.col(value) <= F.col("lo"), 1).when(F.col(value) <= F.col("hi"), 2).otherwise(3)).drop("lo", "hi")


def min_max(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """df with value scaled to 0..1 within each partition; 0 where all are equal."""
    span = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return df.join(span, by).withColumn(name, F.when(F.col("hi") > F.col("lo"), (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)).drop("lo", "hi")


def places(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows with `name`: one more than the number of rows of a lesser value (null values last). Equal values are counted
    first, and the counts are summed up by ranges of the value, so no task holds all rows."""
    counts = rows.groupBy(value).agg(F.count("*").alias("_n")).repartitionByRange(value).withColumn("_part", F.spark_partition_id())
    from lexilathe.session import settle

    counts = settle(counts)
    parts = counts.groupBy("_part").agg(F.sum("_n").alias("_sum"))  # a row a partition
    before = parts.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy(F.asc_nulls_last(value)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("_inside", inside).join(F.broadcast(before), "_part").select(F.col(value).alias("_v"), (F.col("_before") + F.col("_inside") + 1).alias(name))
    return rows.join(placed, rows[value].eqNullSafe(placed["_v"])).drop("_v")
