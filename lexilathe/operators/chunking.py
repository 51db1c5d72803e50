"""Paragraphs, greedy chunks and segments of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexilathe.functions import text as X


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, paragraph_no, paragraph, n_words) for the pieces between blank lines, numbered from 0 without the blank
    ones. Null and blank texts have none."""
    parts = F.filter(F.split(text, r"\n[ \t]*\n"), lambda p: p.rlike(r"[^ \t\n]"))
    return docs.select(key, F.posexplode(parts).alias("paragraph_no", "paragraph")).withColumn("n_words", F.size(X.words(F.col("paragraph"))))


def greedy_groups(sizes: Column, most: int = 700, enough: int = 300, least_parts: int = 2, many_parts: int = 5) -> Column:
    """Chunk number of each part, from an array of their sizes, as a fold in the JVM.

    A chunk ends before a part that would take it over `most`, and after a part if it has at least least_parts and
    either `enough` words or many_parts."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("chunk"), F.lit(0).alias("words"), F.lit(0).alias("parts"))

    def step(acc, n):
        over = (acc["parts"] > 0) & (acc["words"] + n > most)
        chunk = acc["chunk"] + over.cast("int")
        words = F.when(over, 0).otherwise(acc["words"]) + n
        parts = F.when(over, 0).otherwise(acc["parts"]) + 1
        full = (parts >= least_parts) & ((words >= enough) | (parts >= many_parts))
        return F.struct(F.concat(acc["out"], F.array(chunk)).alias("out"), (chunk + full.cast("int")).alias("chunk"), F.when(full, 0).otherwise(words).alias("words"), F.when(full, 0).otherwise(parts).alias("parts"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def greedy_chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk_index, first_paragraph, last_paragraph, n_words) of each document's chunks; no shuffle but of the
    short rows that are summed up."""
    parts = F.filter(F.split(text, r"\n[ \t]*\n"), lambda p: p.rlike(r"[^ \t\n]"))
    sizes = docs.select(key, F.transform(parts, lambda p: F.size(X.words(p))).alias("sizes")).filter("size(sizes) > 0")
    placed = sizes.select(key, F.posexplode(F.arrays_zip(greedy_groups(F.col("sizes")).alias("chunk"), F.col("sizes").alias("n"))).alias("no", "x"))
    return placed.groupBy(key, F.col("x.chunk").alias("chunk_index")).agg(F.min("no").alias("first_paragraph"), F.max("no").alias("last_paragraph"), F.sum("x.n").alias("n_words"))


def nearest_midpoint(turns: DataFrame, key: list[str], order: str, words: str, boundary: Column) -> DataFrame:
    """(key, cut, total): the turn of each unit before which it is best cut in two, the one among the boundaries whose
    words before come nearest to half; null where there is no boundary."""
    w = Window.partitionBy(*key).orderBy(order)
    run = turns.withColumn("before", F.coalesce(F.sum(words).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum(words).over(Window.partitionBy(*key)))
    away = F.abs(F.col("before") - F.col("total") / 2)
    return run.groupBy(*key).agg(F.min_by(F.when(boundary & (F.col("before") > 0), F.col(order)), F.when(boundary & (F.col("before") > 0), F.struct(away, F.col(order)))).alias("cut"), F.max("total").alias("total"))


def forward_fill(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """value carried on to the rows after it that have none."""
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
