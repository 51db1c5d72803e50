"""Problem 10: stretches of text that stand word for word in several records.

Every window of `span` code points has a key: the least hash of the half-length windows inside it. Records that share
a window share its key, and neighbouring windows mostly have the same one, so a record is a short list of runs of
windows with one key. Keys are sent to shards, each of about as many at any size of the corpus, and a shard's count-min
sketch counts them and never undercounts; those that it estimates to stand in two records or more go back to their
records. A second pass over the texts makes the exact hashes of the windows of these keys alone, and these few rows are
grouped exactly. Nothing is lost, as a sketch only overestimates, and the share that is kept in vain doesn't grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilathe.session import table
from lexilathe.session import written as settle

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_ODD = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]  # one per row of the sketch

#: Texts are worked on in blocks of so many code points; longer ones in pieces that overlap by a window.
BLOCK = 1 << 18
#: Rows of a sketch, log2 of the one-byte cells in a row, and the keys of a shard, about.
DEPTH, BITS, SHARD = 4, 21, 1 << 19


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, U(_BASE)), np.full(n, U(_INVERSE))
        up[0] = down[0] = U(1)
        return np.cumprod(up), np.cumprod(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    return x


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by running minima from both ends of blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, U(2**64 - 1))
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def window_keys(codes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, hash) of each window of `span` code points. Both depend on the window's content alone."""
    half = span // 2
    up, down = _powers(max(len(codes) + 1, BLOCK * 2))
    sums = np.concatenate([np.zeros(1, U), np.cumsum((codes.astype(U) + U(1)) * up[: len(codes)])])
    hash_of = lambda k: _mix((sums[k:] - sums[:-k]) * down[: len(codes) - k + 1])
    return _sliding_min(hash_of(half), span - half + 1), hash_of(span)


def _pieces(texts: list[str | None], span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (codes, owner of each code, its position in the text). A text longer than a block comes in pieces that
    share span code points, so that each window and the one before it are whole in some piece."""
    parts: list[np.ndarray] = []
    owners: list[int] = []
    starts: list[int] = []
    held = 0

    def block():
        sizes = [len(p) for p in parts]
        own = np.repeat(np.array(owners), sizes)
        first = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
        return np.concatenate(parts), own, np.arange(len(own)) - first + np.repeat(np.array(starts), sizes)

    for i, text in enumerate(texts):
        if text is None or len(text) < span:
            continue
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        for lo in range(0, len(codes) - span + 1, BLOCK):
            parts.append(codes[lo : lo + BLOCK + span])
            owners.append(i)
            starts.append(lo)
            held += len(parts[-1])
            if held >= BLOCK:
                yield block()
                parts, owners, starts, held = [], [], [], 0
    if parts:
        yield block()


def _runs(texts: list[str | None], span: int):
    """Per block: keys, hashes, owner and position of each window that lies in one text, and where runs of one key in
    one text begin."""
    for codes, own, pos in _pieces(texts, span):
        keys, hashes = window_keys(codes, span)
        n = len(keys)
        inside = (own[:n] == own[span - 1 :]) & (pos[span - 1 :] - pos[:n] == span - 1)
        keys, hashes, o, p = keys[inside], hashes[inside], own[:n][inside], pos[:n][inside]
        if len(keys):
            begin = np.concatenate([[True], (keys[1:] != keys[:-1]) | (o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1)])
            yield keys, hashes, o, p, begin


def _cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((keys * U(_ODD[row])) >> U(64 - bits)).astype(np.int64)


def shards_for(size_in_bytes: int, span: int) -> int:
    """Shards for input of this size, if text is stored in a third of its size: a key for a quarter of a span each."""
    return max(1, -(-int(3 * size_in_bytes / (span / 4)) // SHARD))


def estimated(keys: np.ndarray, bits: int) -> np.ndarray:
    """Counts of keys by a count-min sketch of their own, 2 standing for two or more: the least of a key's cells."""
    least = np.full(len(keys), 2, np.uint8)
    for row in range(DEPTH):
        at = _cells(keys, row, bits)
        least = np.minimum(least, np.minimum(np.bincount(at, minlength=1 << bits), 2).astype(np.uint8)[at])
    return least


#: A key to be counted; one that its own batch holds in two records, so that it needn't be; and that, once, for the count.
ASKED, SURE, COUNTED = 0, 1, 2


def repeated_keys(docs: DataFrame, span: int, bits: int, shards: int) -> DataFrame:
    """(id, keys) of docs (id, text): the keys of each record that are estimated to stand in another one too.

    A key that a batch of records holds twice is known to be repeated: its records are spread over the shards and the
    key is sent to its own shard once for the batch, so a key of any number of records makes no shard large."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            got = [(keys[begin], ids[o[begin]]) for keys, _, o, _, begin in _runs(batch.column(1).to_pylist(), span)]
            if not got:
                continue
            keys, of = (np.concatenate(x) for x in zip(*got))
            order = np.lexsort((of, keys))
            keys, of = keys[order], of[order]
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])])
            keys, of = keys[new], of[new]
            names, count = np.unique(keys, return_counts=True)
            sure = np.repeat(count, count) > 1
            twice = names[count > 1]
            what = np.concatenate([np.where(sure, SURE, ASKED), np.full(len(twice), COUNTED)]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([of, np.zeros(len(twice), np.int64)])), pa.array(np.concatenate([keys, twice]).view(np.int64)), pa.array(what)], ["id", "key", "what"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            what = batch.column(2).to_numpy()
            sure = np.flatnonzero(what == SURE)
            if len(sure):
                yield batch.select([0, 1]).take(pa.array(sure))
            held.append([batch.column(c).to_numpy()[what != SURE] for c in range(3)])
        if held:
            ids, keys, what = (np.concatenate(x) for x in zip(*held))
            # A key that is sure somewhere counts as two there.
            counted = keys.view(np.uint64)
            least = estimated(np.concatenate([counted, counted[what == COUNTED]]), bits)[: len(keys)]
            keep = (least > 1) & (what == ASKED)
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(keys[keep])], ["id", "key"])

    marks = docs.select("id", "text").mapInArrow(find, "id long, key long, what tinyint")
    place = F.when(F.col("what") == SURE, F.xxhash64("key", "id")).otherwise(F.xxhash64("key"))
    kept = marks.repartitionById(shards, F.pmod(place, F.lit(shards)).cast("int")).mapInArrow(test, "id long, key long")
    return kept.groupBy("id").agg(F.collect_list("key").alias("keys"))


def shared_runs(docs: DataFrame, id_col: str, text_col: str, span: int = 250, bits: int = BITS, shards: int | None = None) -> DataFrame:
    """Runs of windows whose key is estimated to occur in two texts: key long, id, start int (position of the first
    window), prev long (hash of the window before, or of the id at the start of a text), hashes array<long>.

    Null texts, empty ones and those shorter than span have no windows. Ids must be distinct and not null; rows with a
    null id are left out. Texts of any length are read whole."""
    docs = docs.filter(F.col(id_col).isNotNull() & (F.length(text_col) >= span)).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if shards is None:
        shards = shards_for(int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), span)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = batch.column(0).to_numpy(), np.unique(batch.column(2).flatten().to_numpy()).view(np.uint64)
            wanted.sort()
            for keys, hashes, o, p, begin in _runs(batch.column(1).to_pylist(), span):
                first = np.flatnonzero(begin)
                run_keys = keys[first]
                twice = np.isin(run_keys, wanted)
                if not twice.any():
                    continue
                ends = np.concatenate([first[1:], [len(keys)]])
                # The window before lies in this block unless the run starts the text or a piece of it.
                before = np.where((first > 0) & (o[first] == o[first - 1]) & (p[first] == p[first - 1] + 1), hashes[first - 1], _mix(ids[o[first]].astype(U) * U(_ODD[3]) + p[first].astype(U)))
                sizes = (ends - first)[twice]
                at = np.repeat(first[twice] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(hashes[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(run_keys[twice].view(np.int64)), pa.array(ids[o[first[twice]]]), pa.array(p[first[twice]].astype(np.int32)), pa.array(before[twice].view(np.int64)), lists],
                    ["key", "id", "start", "prev", "hashes"],
                )

    wanted = settle(repeated_keys(docs, span, bits, shards))
    return docs.join(wanted, "id").select("id", "text", "keys").mapInArrow(keep, "key long, id long, start int, prev long, hashes array<long>")


def shared_pairs(runs: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the pairs of ids that share a window.

    A group of equal windows yields only the pairs whose windows before differ: the others have been found at the
    window before, and so back to where their common stretch begins. So a stretch yields each pair once, not once per
    window, and a group that merely continues yields nothing."""
    mark = F.xxhash64("prev", "hashes")
    # Groups of runs: those in one text only, and those that are alike in all texts and continue alike, are done.
    heads = (
        runs.groupBy("key")
        .agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min(mark).alias("c"), F.max(mark).alias("d"))
        .filter("a < b and c < d").select("key")
    )
    windows = (
        runs.join(heads, "key", "left_semi")
        .select("id", "prev", "hashes", F.posexplode("hashes").alias("i", "hash"))
        .select("hash", "id", F.when(F.col("i") == 0, F.col("prev")).otherwise(F.element_at("hashes", F.greatest("i", F.lit(1)))).alias("prev"))
    )
    starts = (
        windows.groupBy("hash").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min("prev").alias("c"), F.max("prev").alias("d"))
        .filter("a < b and c < d").select("hash")
    )
    some = windows.join(starts, "hash", "left_semi").distinct()
    left, right = some.alias("l"), some.alias("r")
    return (
        left.join(right, (F.col("l.hash") == F.col("r.hash")) & (F.col("l.id") < F.col("r.id")) & (F.col("l.prev") != F.col("r.prev")))
        .select(F.col("l.id").alias("id_a"), F.col("r.id").alias("id_b"))
        .distinct()
    )


def shared_lengths(runs: DataFrame, span: int = 250) -> DataFrame:
    """(id, shared_chars): code points of each text that lie in a stretch of at least span that another text holds.
    Only ids with such a stretch."""
    from pyspark.sql import Window

    several = runs.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("key")
    windows = runs.join(several, "key", "left_semi").select("id", "start", F.posexplode("hashes").alias("i", "hash"))
    windows = windows.select("id", "hash", (F.col("start") + F.col("i")).alias("at"))
    equal = windows.groupBy("hash").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("hash")
    hits = windows.join(equal, "hash", "left_semi").select("id", "at").distinct()
    step = F.lead("at").over(Window.partitionBy("id").orderBy("at")) - F.col("at")
    return hits.withColumn("new", F.least(F.coalesce(step, F.lit(span)), F.lit(span))).groupBy("id").agg(F.sum("new").alias("shared_chars"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = settle(shared_runs(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return shared_pairs(runs).select(F.col("id_a").alias("doc_a"), F.col("id_b").alias("doc_b"))


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its length and how much of it stands in other documents. Null texts have length 0."""
    docs = table(spark, sf_dir, "documents")
    runs = settle(shared_runs(docs, "doc_id", "text"))
    lengths = shared_lengths(runs)
    out = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("text_chars")).join(lengths.withColumnRenamed("id", "doc_id"), "doc_id", "left").na.fill(0, ["shared_chars"])
    return out.withColumn("shared_share", F.when(F.col("text_chars") > 0, F.col("shared_chars") / F.col("text_chars")).otherwise(0.0))


QUERIES = {"p10_found": p10_found, "p10_shared": p10_shared}
