"""Reproducible samples: rows are drawn in the order of a hash of seed and key, so a draw depends on neither partitions
nor engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_order(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def simple(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows, or all if there are no more. A top-n by hash, so only n rows a task are moved."""
    return df.orderBy(draw_order(seed, key), key).limit(n)


def allocate_floor(counts: DataFrame, stratum: str, n: int) -> DataFrame:
    """counts (stratum, size) with take: the floor of the proportional share, one more for the largest strata until n is
    reached, never more than the stratum holds (so the total may fall short)."""
    total = counts.agg(F.sum("size").alias("total"))
    base = counts.crossJoin(F.broadcast(total)).withColumn("base", F.floor(F.col("size") * n / F.col("total")).cast("long"))
    missing = base.agg((F.lit(n) - F.sum("base")).alias("missing"))
    ranked = base.withColumn("r", F.row_number().over(Window.orderBy(F.desc("size"), stratum)))  # one row a stratum
    return ranked.crossJoin(F.broadcast(missing)).withColumn("take", F.least("size", F.col("base") + F.when(F.col("r") <= F.col("missing"), 1).otherwise(0))).select(stratum, "size", "take")


def allocate_largest_remainder(counts: DataFrame, stratum: str, n: int) -> DataFrame:
    """As allocate_floor(), the rest going to the largest fractions."""
    total = counts.agg(F.sum("size").alias("total"))
    share = F.col("size") * F.lit(float(n)) / F.col("total")
    base = counts.crossJoin(F.broadcast(total)).withColumn("base", F.floor(share).cast("long")).withColumn("part", F.round(share - F.floor(share), 9))
    missing = base.agg((F.lit(n) - F.sum("base")).alias("missing"))
    ranked = base.withColumn("r", F.row_number().over(Window.orderBy(F.desc("part"), F.desc("size"), stratum)))
    return ranked.crossJoin(F.broadcast(missing)).withColumn("take", F.least("size", F.col("base") + F.when(F.col("r") <= F.col("missing"), 1).otherwise(0))).select(stratum, "size", "take")


def first_by_hash(df: DataFrame, by: list[str], h: Column, key: str, take: str) -> DataFrame:
    """The `take` (a column) rows of each group that come first by the hex digest h, ties by key.

    Rows are counted by group and the first three digits of the digest; only those up to the bucket in which the group
    reaches its number are ranked. So a group of any size is neither gathered nor sorted whole, and none is lost."""
    bucket = F.substring("_h", 1, 3)
    rows = df.withColumn("_h", h)
    counts = rows.groupBy(*by, bucket.alias("_b")).agg(F.count("*").alias("_n"), F.first(take).alias("_take"))
    run = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_n"))
    last = run.filter(F.col("_before") < F.col("_take")).groupBy(*by).agg(F.max("_b").alias("_last"))
    near = rows.join(last, by).filter(bucket <= F.col("_last"))
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h", key)))
    return ranked.filter(F.col("_r") <= F.col(take)).drop("_h", "_last", "_r")


def stratified(df: DataFrame, stratum: str, key: str, allocation: DataFrame, seed: int) -> DataFrame:
    """The rows of each stratum that come first by hash, as many as the allocation takes."""
    return first_by_hash(df.join(allocation.select(stratum, "take"), stratum), [stratum], draw_order(seed, key), key, "take").drop("take")


def replicate(df: DataFrame, reps: int) -> DataFrame:
    """df once for each repetition, as column rep."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))


def bootstrap_summary(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, reps, mean, std, lo, hi): mean, sample deviation (0 for one repetition) and 2.5 and 97.5 percentiles."""
    return values.groupBy(*by).agg(
        F.count("*").alias("reps"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.percentile(value, F.lit(0.025)).alias("lo"), F.percentile(value, F.lit(0.975)).alias("hi"),
    )
