"""Joins by derived keys, precedence, de-duplication and accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrence(df: DataFrame, key: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    """df with the running number, from 0, of each row among those of its key, in a stated order. The order must be
    total, else equal rows are numbered either way."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def match_statistics(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """One row: how many left rows matched and didn't, and how many right rows weren't used. Keys must be unique on
    each side (see occurrence()); null keys match nothing."""
    both = left.select(*key, F.lit(1).alias("l")).join(right.select(*key, F.lit(1).alias("r")), key, "full")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("matched"), F.count_if(F.col("r").isNull()).alias("unmatched"), F.count_if(F.col("l").isNull()).alias("unused"))


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__r = 1").drop("__r")


def prefer(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of first, and of second what first lacks. Null keys of second never match and are kept."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """target with the rows of source put in by key; set values win over null ones. status tells what became of each."""
    rest = [c for c in target.columns if c != key]
    s = source.select(key, *[F.col(c).alias(f"__{c}") for c in rest], F.lit(True).alias("__s"))
    t = target.withColumn("__t", F.lit(True)).join(s, key, "full")
    status = F.when(F.col("__t").isNull(), "created").when(F.col("__s").isNotNull(), "updated").otherwise("kept")
    return t.select(key, *[F.coalesce(f"__{c}", c).alias(c) for c in rest], status.alias("status"))


def todo(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """The rows of work that aren't done yet."""
    return work.join(done.select(*key).distinct(), key, "left_anti")


def merge_best(df: DataFrame, key: Column, better: list[Column], collect: str) -> DataFrame:
    """One row per key: the one that `better` puts first, with all distinct values of `collect` as a sorted array. Rows
    without a key stay as they are."""
    keyed, rest = df.withColumn("__k", key).filter("__k is not null"), df.withColumn("__k", key).filter("__k is null").drop("__k")
    all_of = keyed.groupBy("__k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(collect)))).alias("__all"))
    best = first_of(keyed, ["__k"], better).drop(collect).join(all_of, "__k").withColumnRenamed("__all", collect).drop("__k")
    return best.unionByName(rest)


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that holds, or null; null conditions don't hold."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(reasons):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def kept_in_order(rows: DataFrame, by: list[str], part: str, order: str, text: str, most: int = 4) -> DataFrame:
    """(by, part, order, text, state) of rows gone through in order of part and order within each group: `repeated` if
    the text was kept before, else `over` if its part has kept `most` already, else `kept`. A text that was over its
    part's number isn't remembered, so a later part may keep it. A group's rows meet in one fold in the JVM: groups are
    documents. A null text is a text of its own."""
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(None).cast(rows.schema[part].dataType).alias("part"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        key = F.coalesce(F.concat(F.lit("="), x["t"]), F.lit(""))
        n = F.when(acc["part"].eqNullSafe(x["p"]), acc["n"]).otherwise(0)
        state = F.when(F.array_contains(acc["seen"], key), "repeated").when(n >= most, "over").otherwise("kept")
        kept = state == "kept"
        return F.struct(F.when(kept, F.concat(acc["seen"], F.array(key))).otherwise(acc["seen"]).alias("seen"), x["p"].alias("part"), (n + kept.cast("int")).alias("n"), F.concat(acc["out"], F.array(state)).alias("out"))

    grouped = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(part).alias("p"), F.col(order).alias("o"), F.col(text).alias("t")))).alias("x"))
    states = grouped.withColumn("s", F.aggregate("x", start, step, lambda acc: acc["out"]))
    z = states.select(*by, F.explode(F.arrays_zip("x", "s")).alias("z"))
    return z.select(*by, F.col("z.x.p").alias(part), F.col("z.x.o").alias(order), F.col("z.x.t").alias(text), F.col("z.s").alias("state"))
