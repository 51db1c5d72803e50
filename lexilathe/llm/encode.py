"""Problem 8: ids of every text. Problem 9: one mixture of several sources at target shares of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilathe.llm import tokenizer
from lexilathe.session import settle, table


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = tokenizer.DEFAULT_PATH) -> DataFrame:
    """(id, ids array<int>) of every row; no shuffle. Null and empty texts have an empty array; the id may be null or
    repeated, rows are kept as they are. Very long texts are encoded whole."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer.load(path)
        for batch in batches:
            ids, ends = t.encode_batch(batch.column(1).to_pylist())
            for lo in range(0, batch.num_rows, 2000):  # small batches to the JVM
                hi = min(lo + 2000, batch.num_rows)
                lists = pa.ListArray.from_arrays(pa.array(ends[lo : hi + 1] - ends[lo], pa.int32()), pa.array(ids[ends[lo] : ends[hi]]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["id", "ids"])

    return docs.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(ids: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = tokenizer.DEFAULT_PATH) -> DataFrame:
    """(id, text) from (id, ids), by the streaming decoder. A null array gives a null text."""
    ids = ids.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = ids.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer.load(path)
        for batch in batches:
            texts = [None if x is None else t.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return ids.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def token_counts(docs: DataFrame, keep: list[str], text_col: str = "text", path: str = tokenizer.DEFAULT_PATH) -> DataFrame:
    """The columns `keep` and n_tokens long; null and empty texts have 0."""
    docs = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer.load(path)
        for batch in batches:
            n = t.count_batch(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    return docs.mapInArrow(run, schema)


# --- mixture -----------------------------------------------------------------------------------------------------

#: Bits of the hash that one histogram level resolves, and the bits in all.
LEVEL_BITS, HASH_BITS = 12, 60


def _budgets(targets: list, tokens: dict[str, int], total: int | None) -> dict[str, float]:
    """Tokens wanted of each source. A source without tokens can give none and doesn't bound the others; the mixture
    is as large as the most limited other source allows, or `total`."""
    able = {t.source: t.target_share for t in targets if t.target_share and t.target_share > 0 and tokens.get(t.source)}
    if not able:
        return {}
    most = min(tokens[t.source] * max(t.max_repeats or 0, 0) / able[t.source] for t in targets if t.source in able)
    size = most if total is None else min(total / sum(able.values()), most)
    return {s: share * size for s, share in able.items()}


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, path: str = tokenizer.DEFAULT_PATH) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares): mixture has doc_id, source, n_tokens and uses (how many times the document is used); shares
    has each target source with what it reached.

    Each source gives its target share of the tokens; the mixture is as large as max_repeats allows. A source's budget
    is met by floor(budget / tokens) uses of all its documents and one use more of those whose hash lies under a
    threshold. The threshold comes from histograms of tokens by source and hash bucket: first over the highest 12 bits,
    then over the next 12 bits of the one bucket in which the budget ends, and so on; rows are never sorted, and a hot
    source is summed by its buckets. Histograms have at most 4096 rows a source and are read by the driver; `targets`
    is a small fixed table and is collected.

    Null, empty and repeated texts: documents without tokens and documents of no target source aren't used; repeated
    rows of one doc_id are separate documents. A target source that has no documents, or max_repeats of 0, is
    reported with share 0 (max_repeats of 0 for a source that has documents makes the whole mixture empty, as its share
    can't be reached)."""
    rows = [r for r in targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).collect() if r.source is not None]
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(r.source,) for r in rows], "source string")
    counted = token_counts(docs.join(F.broadcast(wanted), "source", "left_semi"), ["doc_id", "source"], path=path)
    hashed = counted.filter("n_tokens > 0").withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 64 - HASH_BITS))
    hashed = settle(hashed)

    tokens: dict[str, int] = {}
    budgets: dict[str, float] = {}
    repeats: dict[str, int] = {}
    prefix: dict[str, int] = {}  # the boundary bucket so far, and the tokens still wanted inside it
    rest: dict[str, float] = {}
    threshold: dict[str, int] = {}
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - LEVEL_BITS * level
        here = hashed
        if level > 1:
            if not prefix:
                break
            edge = spark.createDataFrame(list(prefix.items()), "source string, prefix long")
            here = hashed.join(F.broadcast(edge), "source").filter(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        hist = here.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"))
        by: dict[str, list] = {}
        for r in hist.collect():
            by.setdefault(r.source, []).append((r.bucket, r.n, r.docs))
        if level == 1:
            tokens = {s: sum(n for _, n, _ in b) for s, b in by.items()}
            budgets = _budgets(rows, tokens, total_tokens)
            for s, budget in budgets.items():
                repeats[s] = min(int((budget + 1e-6) // tokens[s]), next(r.max_repeats for r in rows if r.source == s))
                rest[s] = max(0.0, budget - repeats[s] * tokens[s])
                prefix[s] = 0
        for s in list(prefix):
            for bucket, n, docs in sorted(by.get(s, [])):
                if n > rest[s]:
                    # One document (or rows that share a hash): used if that comes nearer to the budget.
                    if docs == 1 or shift == 0:
                        threshold[s] = (bucket + (1 if rest[s] * 2 > n else 0)) << shift
                        del prefix[s]
                    else:
                        prefix[s] = bucket
                    break
                rest[s] -= n
            else:
                threshold[s] = (max((b for b, _, _ in by.get(s, [])), default=-1) + 1) << shift
                del prefix[s]
    plan = spark.createDataFrame([(s, repeats[s], threshold[s], r) for s in budgets for r in [next(t.max_repeats for t in rows if t.source == s)]], "source string, whole int, below long, most int")
    mixed = (
        hashed.join(F.broadcast(plan), "source")
        .withColumn("uses", F.least(F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0), F.col("most")))
        .filter("uses > 0")
        .select("doc_id", "source", "n_tokens", "uses")
    )
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens_used"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    have = spark.createDataFrame([(r.source, r.target_share, r.max_repeats, tokens.get(r.source, 0)) for r in rows], "source string, target_share double, max_repeats int, tokens_available long")
    shares = have.join(used, "source", "left").na.fill(0, ["tokens_used", "documents", "most_uses"])
    all_used = shares.agg(F.sum("tokens_used").alias("all_used"))
    shares = shares.crossJoin(F.broadcast(all_used)).select("source", "target_share", F.when(F.col("all_used") > 0, F.col("tokens_used") / F.col("all_used")).otherwise(0.0).alias("reached_share"), "max_repeats", "most_uses", "tokens_available", "tokens_used", "documents")
    return mixed, shares


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether decoding the ids gives each text back; null counts as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs)).select("doc_id", F.col("text").alias("decoded"))
    digest = lambda c: F.xxhash64(F.coalesce(c, F.lit("")))
    return (
        docs.select("doc_id", digest(F.col("text")).alias("a"), F.lit(1).alias("k"))
        .union(both.select("doc_id", digest(F.col("decoded")).alias("a"), F.lit(-1).alias("k")))
        .groupBy("doc_id", "a").agg(F.sum("k").alias("k"))
        .groupBy("doc_id").agg((F.max(F.abs("k")) == 0).alias("same"))
    )


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


QUERIES = {"p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip, "p9_mixture": p9_mixture, "p9_shares": p9_shares}
