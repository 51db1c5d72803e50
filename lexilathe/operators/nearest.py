"""The best rows of a table for each of a stated query set, exactly, without forming their pairs.

Rows and queries are multiplied tile by tile; only what may be among a query's k best is looked at again, its measure
computed in the order of the columns' own expressions, and returned. What comes out is a few rows a query for each part
of the rows, however many the pairs are. Neither side is gathered: a task holds CHUNK rows and a file's batch of
queries at a time. The work is one product for each pair, so it grows with rows times queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from lexilathe.session import open_folder, shared_folder

#: Rows that a task holds at a time, queries that it reads at a time, and the sides of a tile.
CHUNK, BATCH, ROWS, QUERIES = 65_536, 10_000, 2_048, 256
#: What the measures' own rounding (nine places) may hide, and the relative error of a product of doubles.
HIDDEN, ERROR = 2e-9, 1e-12


def measured(measure: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The measure of each row of a and of b, with the sums in the order that V.euclidean() and V.cosine() add them up."""
    if measure == "euclidean":
        return np.sqrt(_summed(lambda i: (a[:, i] - b[:, i]) * (a[:, i] - b[:, i]), a))
    size = np.sqrt(_summed(lambda i: a[:, i] * a[:, i], a)) * np.sqrt(_summed(lambda i: b[:, i] * b[:, i], b))
    return _summed(lambda i: a[:, i] * b[:, i], a) / size


def _summed(part, a: np.ndarray) -> np.ndarray:
    s = np.zeros(len(a))
    for i in range(a.shape[1]):
        s += part(i)
    return s


class Side:
    """Rows in which the k best are sought. Of equal ones only the k + 1 least ids can count (one may be the query's), and
    they stand by length, so that the error of a tile is that of rows alike."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, k: int):
        h = (np.ascontiguousarray(x).view(np.int64) * (2 * np.arange(x.shape[1]) + 12_345_679)).sum(axis=1)
        order = np.lexsort((ids, h))
        same = np.zeros(len(x), bool)
        same[1:] = (h[order[1:]] == h[order[:-1]]) & (x[order[1:]] == x[order[:-1]]).all(axis=1)
        keep = order[np.arange(len(x)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(x)))) <= k]
        size = np.linalg.norm(x[keep], axis=1)
        by = np.argsort(size, kind="stable")
        self.x, self.ids, self.size, self.k = x[keep[by]], ids[keep[by]], size[by], k


def best_of(measure: str, rows: Side, q: np.ndarray, q_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, value): for each query the rows, itself left out, that may be among its k best once the measure is
    rounded to nine places and equal ones are taken by id."""
    far, x, ids, k = measure == "euclidean", rows.x, rows.ids, rows.k
    q_size = np.linalg.norm(q, axis=1)
    # Scores rise as the measure gets better: q x - x x / 2, or the cosine.
    left, right = (x, q) if far else (x / rows.size[:, None], q / q_size[:, None])
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for lo in range(0, len(q), QUERIES):
        of, at, value = out[0]
        block, square = right[lo : lo + QUERIES], q_size[lo : lo + QUERIES] ** 2
        n = len(block)
        bound = np.full(n, np.inf if far else -np.inf)  # the k-th best value so far
        for start in range(0, len(x), ROWS):
            score = block @ left[start : start + ROWS].T
            width = score.shape[1]
            if far:
                score -= rows.size[start : start + ROWS] ** 2 / 2
            error = ERROR * (square + rows.size[start + width - 1] ** 2) if far else np.full(n, ERROR)
            reach = bound
            if start == 0 and width > k + 1:  # nothing is known yet but the k + 1 best scores of this tile
                some = np.partition(score, -k - 1, axis=1)[:, -k - 1] - error
                reach = np.sqrt(np.maximum(square - 2 * some, 0)) if far else some
            limit = ((square - (reach + HIDDEN) ** 2) / 2 if far else reach - HIDDEN) - error
            hit = np.flatnonzero(score >= limit[:, None])
            row = hit // width
            place = start + hit - row * width
            other = ids[place] != q_ids[lo + row]
            row, place = row[other], place[other]
            if not len(row):
                continue
            of, at, value = np.concatenate([of, row]), np.concatenate([at, place]), np.concatenate([value, measured(measure, q[lo + row], x[place])])
            order = np.lexsort((ids[at], value if far else -value, of))
            of, at, value = of[order], at[order], value[order]
            edge = np.searchsorted(of, np.arange(n + 1))
            full = np.flatnonzero(np.diff(edge) >= k)
            bound[full] = value[edge[full] + k - 1]
            new = np.concatenate([[True], (of[1:] != of[:-1]) | (value[1:] != value[:-1])])
            equal = np.arange(len(of)) - np.maximum.accumulate(np.where(new, np.arange(len(of)), 0))
            kept = (value <= bound[of] + HIDDEN if far else value >= bound[of] - HIDDEN) & (equal < k)
            of, at, value = of[kept], at[kept], value[kept]
        out.append((of + lo, ids[at], value))
    of, found, value = (np.concatenate(c) for c in zip(*out))
    return of, found, value


def best(rows: DataFrame, queries: DataFrame, dim: int, k: int, *measures: str) -> DataFrame:
    """(measure, q_id, grp, id, value): for each query (q_id, q_vec) and each group of rows (id, grp, vec), itself left
    out, the rows among which are its k best by each measure ("euclidean" the least, "cosine" the greatest), with all
    that rounding to nine places might put before them. Ids are long and not null, vectors as packed() gives them. The caller ranks what
    comes out: about k rows a query for each group and each part of the rows. `rows` is counted, so it should be a
    written table."""
    path = shared_folder(rows.sparkSession, "queries")
    queries.select("q_id", "q_vec").write.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= CHUNK:
                yield from chunk(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from chunk(pa.Table.from_batches(held))

    def chunk(t: pa.Table) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        names, x, ids = np.array(t["grp"].to_pylist(), object), _matrix(t["vec"], dim), t["id"].to_numpy()
        sides = {}
        for g in set(names):
            own = np.flatnonzero(names == g) if g is not None else np.flatnonzero([n is None for n in names])
            sides[g] = Side(x[own], ids[own], k)
        del x, ids
        files, inside = open_folder(path)
        for b in ds.dataset(inside, filesystem=files, format="parquet").to_batches(batch_size=BATCH, use_threads=False):
            if not b.num_rows:
                continue
            q, q_ids = _matrix(b["q_vec"], dim), b["q_id"].to_numpy()
            for g, side in sides.items():
                for m in measures:
                    of, found, value = best_of(m, side, q, q_ids)
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(m), len(of)), pa.array(q_ids[of], pa.int64()), pa.repeat(pa.scalar(g, pa.string()), len(of)), pa.array(found, pa.int64()), pa.array(value, pa.float64())], ["measure", "q_id", "grp", "id", "value"])

    few = rows.select("id", "grp", "vec").filter("id is not null")
    return few.coalesce(max(-(-rows.count() // CHUNK), 2 * rows.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, "measure string, q_id long, grp string, id long, value double")


def packed(rows: DataFrame, vec: str, dim: int) -> DataFrame:
    """rows whose vector is valid (as V.is_valid() says), with it as the bytes of its numbers: an array costs a writer
    many times what its bytes do."""
    wide = rows.schema[vec].dataType.simpleString() == "array<double>"
    names, at = rows.columns, rows.columns.index(vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = np.flatnonzero(np.asarray(b.column(at).value_lengths().fill_null(-1)) == dim)
            x = b.column(at).take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x, size = np.ascontiguousarray(x[fine], np.float64 if wide else np.float32), dim * (8 if wide else 4)
            kept = b.take(pa.array(places[fine]))
            ends = pa.py_buffer(np.arange(0, (len(x) + 1) * size, size, dtype=np.int32))
            columns = [pa.Array.from_buffers(pa.binary(), len(x), [None, ends, pa.py_buffer(x)]) if i == at else c for i, c in enumerate(kept.columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, StructType([StructField(f.name, BinaryType()) if f.name == vec else f for f in rows.schema]))


def _matrix(column, dim: int) -> np.ndarray:
    """The vectors that packed() gave, in double precision."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [np.frombuffer(b"".join(c.to_pylist()), np.float64 if len(c[0].as_py()) == dim * 8 else np.float32).astype(np.float64).reshape(-1, dim) for c in chunks if len(c)]
    return np.concatenate(parts or [np.zeros((0, dim))])
