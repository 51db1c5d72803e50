"""Problem 5: the k most similar vectors of every vector, by an inverted multi-index.

The coordinates of unit vectors are cut into two halves, and each half is quantised by its own codebook, whose size
grows with the square root of the collection, so a vector lies in the cell (i, j) and a cell holds about sixty. A query
takes the cells in ascending order of the summed distances of its halves to the two centroids, a number of cells that
grows with the fourth root of the collection, and ranks what they hold by cosine.

The entries are a table in the shared folder, in units of bounded size of lists (one i each) that lie close together.
A task takes the queries of one unit, finds the cells of each, and reads the units that these lie in, one at a time;
all queries that take a cell are multiplied with its entries at once. So vectors are shuffled once, when the table is
written, and neither they nor candidates after it, and no task holds more than two units.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilathe.session import drop_folder, open_folder, shared_folder, table
from lexilathe.session import written as settle

#: Entries of a cell on average, and vectors a centroid that codebooks are fitted on (chosen by hash).
CELL, SAMPLE_EACH = 64, 256
#: Entries of a unit, about, and of its own unit that each query starts with.
UNIT, START = 15_000, 1_000
#: Ids of equal vectors that an entry keeps; enough for the neighbours of all of them.
KEPT = 6
#: Entries keep coordinates as 16-bit numbers; cosines are right to about 2e-5.
STEP = 32767


def is_valid(v: Column, dim: int) -> Column:
    """dim numbers, all finite and not all zero."""
    low = F.array_min(F.transform(v, lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))))
    high = F.array_max(F.transform(v, lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))))
    # NaN sorts above all numbers, so it shows in the greatest; the least is NaN only if all are.
    fine = ~F.isnan(high) & (high < float("inf")) & (low > float("-inf")) & ((low != 0) | (high != 0))
    return v.isNotNull() & (F.size(v) == dim) & F.coalesce(fine, F.lit(False))


def valid_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the valid ones among an array of lists: what is_valid() says, for a batch."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(sizes == dim)
    v = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    fine = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
    v = v[fine]
    v /= np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return at[fine], v / np.linalg.norm(v, axis=1, keepdims=True)


def fit_codebook(sample: np.ndarray, k: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """k centroids by Lloyd's algorithm; fewer if there are fewer distinct vectors."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    centroids = distinct[rng.permutation(len(distinct))[:k]].astype(np.float32)
    for _ in range(rounds):
        own = nearest(sample, centroids)
        order = np.argsort(own, kind="stable")
        edge = np.searchsorted(own[order], np.arange(len(centroids) + 1))
        full = np.flatnonzero(edge[1:] > edge[:-1])
        sums = np.add.reduceat(sample[order], edge[full], axis=0)
        centroids[full] = sums / (edge[full + 1] - edge[full])[:, None]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centroids.T - 0.5 * (centroids**2).sum(axis=1), axis=1)


def multi_sequence(d1: np.ndarray, d2: np.ndarray, count: int) -> list[tuple[int, int]]:
    """The first `count` cells (i, j) in ascending order of d1[i] + d2[j], by a heap. This defines what a query takes;
    first_cells() gives the same for many queries at once."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, seen, out = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < count:
        _, a, b = heapq.heappop(heap)
        out.append((int(o1[a]), int(o2[b])))
        for x, y in ((a + 1, b), (a, b + 1)):
            if x < len(o1) and y < len(o2) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (d1[o1[x]] + d2[o2[y]], x, y))
    return out


def staircase(k1: int, k2: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The places (a, b) in two ascending lists that the heap can come to within `count` steps: a pair has
    (a + 1) (b + 1) - 1 others before it."""
    widths = np.minimum(k2, count // np.arange(1, min(k1, count) + 1))
    return np.repeat(np.arange(len(widths)), widths), np.arange(widths.sum()) - np.repeat(np.cumsum(widths) - widths, widths)


def first_cells(d1: np.ndarray, d2: np.ndarray, stairs: tuple[np.ndarray, np.ndarray], count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, i, j) of the first `count` cells of each query (row of d1 and d2), with all that are as near as the last:
    every query's own heap order up to there, found by partial sorting of the pairs the heap can come to."""
    a, b = stairs
    o1, o2 = np.argsort(d1, axis=1), np.argsort(d2, axis=1)
    sums = np.take_along_axis(d1, o1, 1).take(a, axis=1) + np.take_along_axis(d2, o2, 1).take(b, axis=1)
    if sums.shape[1] > count:
        at = np.flatnonzero(sums <= np.partition(sums, count - 1, axis=1)[:, count - 1 : count])
    else:
        at = np.arange(sums.size)
    q = at // len(a)
    p = at - q * len(a)
    return q, o1.ravel()[q * d1.shape[1] + a[p]], o2.ravel()[q * d2.shape[1] + b[p]]


def along(centroids: np.ndarray) -> np.ndarray:
    """An order of centroids in which close ones mostly stand together: halves along the widest direction, again and
    again."""
    out, todo = [], [np.arange(len(centroids))]
    while todo:
        at = todo.pop()
        if len(at) <= 2:
            out.extend(at)
            continue
        x = centroids[at] - centroids[at].mean(axis=0)
        way = x[np.argmax((x * x).sum(axis=1))]
        for _ in range(3):
            way = x.T @ (x @ way)
            way = way / max(float(np.linalg.norm(way)), 1e-30)
        order = at[np.argsort(x @ way, kind="stable")]
        todo += [order[len(at) // 2 :], order[: len(at) // 2]]
    return np.array(out, np.int64)


class Unit:
    """Entries of one unit, sorted by cell: the cell's number, ids (the least KEPT of equal vectors) and unit vectors."""

    def __init__(self, cell: np.ndarray, ids: pa.ListArray, vecs: np.ndarray):
        self.cell, self.ids, self.vecs = cell, ids, vecs
        self.first = ids.values.to_numpy()[ids.offsets.to_numpy()[:-1]]


class Index:
    """The two codebooks (their size grows with the square root of the collection) and the units; sent to the tasks.
    List i lies in units first[i] to first[i] + parts[i] - 1, by the hash of the vector; `sizes` has the entries of each
    unit, and `crowds` is the number of entries with KEPT ids or more."""

    def __init__(self, path: str, books: list[np.ndarray], first: np.ndarray, parts: np.ndarray, dim: int):
        self.path, self.books, self.first, self.parts, self.dim = path, books, first, parts, dim
        self.units = int((first + parts).max())
        self.sizes, self.crowds, self.n = {}, 0, 0

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.dim // 2
        part = lambda a, c: (a * a).sum(axis=1)[:, None] - 2 * a @ c.T + (c * c).sum(axis=1)
        return part(x[:, :half], self.books[0]), part(x[:, half:], self.books[1])

    def read(self, u: int) -> Unit:
        import pyarrow.dataset as ds

        files, inside = open_folder(f"{self.path}/u={u}")
        t = ds.dataset(inside, filesystem=files, format="parquet").to_table(columns=["cell", "ids", "vec"]).combine_chunks()
        cell = t["cell"].to_numpy()
        if (np.diff(cell) < 0).any():
            t = t.take(pa.array(np.argsort(cell, kind="stable")))
            cell = t["cell"].to_numpy()
        ids, packed = _one(t["ids"]), _one(t["vec"])
        vecs = np.frombuffer(packed.buffers()[2], np.int16, len(packed) * self.dim, packed.offset * self.dim * 2).reshape(-1, self.dim).astype(np.float32)
        vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
        return Unit(cell, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths()))]), pa.int32()), ids.flatten()), vecs)

    def drop(self, spark: SparkSession) -> None:
        drop_folder(spark, self.path)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _units(lists: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, parts): units of about UNIT entries from the estimated number of entries of each list, in the order
    given. A list of more than two units' entries has units of its own."""
    first, parts, u, held = np.zeros(len(lists), np.int64), np.ones(len(lists), np.int64), 0, 0.0
    for i in order:
        if lists[i] > 2 * UNIT:
            u += held > 0
            first[i], parts[i], held = u, math.ceil(lists[i] / UNIT), 0.0
            u += int(parts[i])
        else:
            if held and held + lists[i] > UNIT:
                u, held = u + 1, 0.0
            first[i], held = u, held + max(float(lists[i]), 1e-9)
    return first, parts


def build_index(vectors: DataFrame, dim: int, n: int | None = None) -> Index:
    """Writes the index of (id long, vec array<float>). Rows with a null id or an invalid vector are left out. Repeated
    rows and equal vectors become one entry: they are merged within each batch before the shuffle and again before
    writing, so a group of copies of any size costs no more than its rows' reading. `n` is the number of rows, where it
    is known; it sets the number of centroids alone."""
    spark = vectors.sparkSession
    n = vectors.count() if n is None else n
    k = max(1, math.ceil(math.sqrt(n / CELL)))
    want = SAMPLE_EACH * k
    share = F.lit(int((1 << 30) * min(1.0, want / max(n, 1))))
    rows = vectors.filter(F.col("id").isNotNull()).select("id", "vec")
    taken = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= share).select("vec").limit(2 * want).toArrow()["vec"]
    x = np.concatenate([valid_rows(c, dim)[1] for c in taken.chunks] + [np.zeros((0, dim))]).astype(np.float32)
    half = dim // 2
    books = [fit_codebook(p, k) if len(p) else np.zeros((1, p.shape[1]), np.float32) for p in (x[:, :half], x[:, half:])]
    lists = np.bincount(nearest(x[:, :half], books[0]), minlength=len(books[0])) * (n / max(len(x), 1))
    index = Index(shared_folder(spark, "index"), books, *_units(lists, along(books[0])), dim)

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, unit = valid_rows(batch.column(1), dim)
            if not len(at):
                continue
            ids, h, unit = batch.column(0).to_numpy()[at], batch.column(2).to_numpy()[at], unit.astype(np.float32)
            one, offsets, values = _merge_copies(h, np.arange(len(h) + 1), ids)
            h, unit = h[one], unit[one]
            i, j = nearest(unit[:, :half], books[0]), nearest(unit[:, half:], books[1])
            yield _batch(index.first[i] + h % index.parts[i], i * len(books[1]) + j, h, offsets, values, np.rint(unit * STEP).astype(np.int16))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches, schema=schema)  # the entries of one unit
        for u in np.unique(t["u"].to_numpy()):
            part = t.filter(pa.array(t["u"].to_numpy() == u)).combine_chunks()
            ids = _one(part["ids"])
            one, offsets, values = _merge_copies(part["h"].to_numpy(), np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths()))]), ids.flatten().to_numpy())
            order = np.argsort(part["cell"].to_numpy()[one], kind="stable")
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)).take(pa.array(order))
            rest = part.take(pa.array(one[order]))
            yield pa.RecordBatch.from_arrays([lists if c == "ids" else _one(rest[c]) for c in ("u", "cell", "ids", "vec")], ["u", "cell", "ids", "vec"])

    schema = pa.schema([("u", pa.int32()), ("cell", pa.int64()), ("h", pa.int64()), ("ids", pa.list_(pa.int64())), ("vec", pa.binary())])
    entries = rows.withColumn("h", F.xxhash64("vec")).mapInArrow(quantise, "u int, cell bigint, h bigint, ids array<bigint>, vec binary").repartitionById(index.units, F.col("u"))
    entries.mapInArrow(merge, "u int, cell bigint, ids array<bigint>, vec binary").write.partitionBy("u").parquet(index.path)
    stored = spark.read.schema("ids array<bigint>, u int").parquet(index.path)
    for r in stored.groupBy("u").agg(F.count("*").alias("n"), F.count_if(F.size("ids") >= KEPT).alias("crowds")).collect():  # a row a unit
        index.sizes[r.u] = r.n
        index.crowds, index.n = index.crowds + r.crowds, index.n + r.n
    return index


def _merge_copies(h: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, offsets, ids): of each hash the first place, and the least KEPT of its distinct ids."""
    of = np.repeat(h, np.diff(offsets))
    order = np.lexsort((values, of))
    of, values = of[order], values[order]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (values[1:] != values[:-1])]) if len(of) else np.zeros(0, bool)
    of, values = of[new], values[new]
    names, start, count = np.unique(of, return_index=True, return_counts=True)
    keep = np.arange(len(of)) - np.repeat(start, count) < KEPT
    distinct, place = np.unique(h, return_index=True)  # the same names in the same order
    return place, np.concatenate([[0], np.cumsum(np.minimum(count, KEPT))]), values[keep]


def _batch(u, cell, h, offsets, values, packed) -> pa.RecordBatch:
    n, width = len(u), packed.shape[1] * 2
    vec = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(packed))])
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int32()), pa.array(cell, pa.int64()), pa.array(h, pa.int64()), lists, vec], ["u", "cell", "h", "ids", "vec"])


def cells_of_query(n: int, scale: float) -> int:
    """Cells that a query takes in a collection of n entries: grows with the fourth root of n, as recall else falls."""
    return max(1, math.ceil(scale * max(n, 1) ** 0.25))


FOUND = "home int, key bigint, ids array<bigint>, near array<bigint>, cos array<float>"


def search(spark: SparkSession, index: Index, k: int, scale: float, floor: float = -2.0, copies: bool = True, then: Callable | None = None, ddl: str = FOUND) -> DataFrame:
    """(home, key, ids, near, cos) of every entry of the index: its unit, its least id, its kept ids, and the ids and
    cosines of the k + KEPT most similar ids (its own copies included, the entry itself not), most similar first, equal
    ones by id, none less similar than floor. Entries with neither near ids nor copies may be missing.

    `scale` times the fourth root of the number of entries is the number of cells that a query takes. Without `copies`
    each entry found is named by its least id alone, and its own copies are left out. `then` is a function of the Arrow
    table of all entries of one unit, giving record batches of `ddl` instead."""
    work = [u for u in range(index.units) if index.sizes.get(u)]
    cells = cells_of_query(index.n, scale)
    shared = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                found = search_unit(shared.value, work[x], k, cells, floor, copies)
                yield from then(found) if then else found.to_batches()

    return spark.range(0, len(work), 1, max(1, len(work))).mapInArrow(run, ddl)


_SCHEMA = pa.schema([("home", pa.int32()), ("key", pa.int64()), ("ids", pa.list_(pa.int64())), ("near", pa.list_(pa.int64())), ("cos", pa.list_(pa.float32()))])
#: Queries of a unit that are worked on at a time, and hits after which only the best of each query are kept.
BLOCK, HITS = 50_000, 4_000_000


def search_unit(index: Index, u: int, k: int, cells: int, floor: float, copies: bool) -> pa.Table:
    """The rows of search() for one unit, sorted by key."""
    own = index.read(u)
    parts = [_search_block(index, u, own, lo, min(lo + BLOCK, len(own.cell)), k, cells, floor, copies) for lo in range(0, len(own.cell), BLOCK)]
    t = pa.concat_tables(parts).combine_chunks()
    return t.take(pa.array(np.argsort(t["key"].to_numpy(), kind="stable")))


class _Best:
    """The best hits (query, entry, cosine) of each query. A hit is kept if it is as good as the query's bound, which
    rises to its top-th best hit so far."""

    def __init__(self, n: int, top: int, floor: float):
        self.n, self.top, self.bound, self.new = n, top, np.full(n, floor, np.float32), 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, q: np.ndarray, entry: np.ndarray, cos: np.ndarray) -> None:
        self.parts.append((q, entry, cos))
        self.new += len(q)
        if self.new >= HITS:
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, entry, cos = (np.concatenate([p[c] for p in self.parts] or [np.zeros(0, t)]) for c, t in enumerate((np.int64, np.int64, np.float32)))
        # One sort of query, distance (20 bits) and place.
        far = np.clip((1.0 - cos.astype(np.float64)) * (1 << 18), 0, (1 << 20) - 1).astype(np.uint64)
        keys = (q.astype(np.uint64) << np.uint64(48)) | (far << np.uint64(28)) | np.arange(len(q), dtype=np.uint64)
        keys.sort()
        at, of = (keys & np.uint64((1 << 28) - 1)).astype(np.int64), (keys >> np.uint64(48)).astype(np.int64)
        edge = np.searchsorted(of, np.arange(self.n + 1))
        # All that are as far as the last of the best, so that the order within the 20 bits loses none.
        rank = np.arange(len(of)) - edge[of]
        last = np.minimum(edge[:-1] + self.top, edge[1:]) - 1
        limit = np.where(last >= edge[:-1], far[at[np.maximum(last, 0)]] if len(at) else 0, 0)
        keep = (rank < self.top) | (far[at] <= limit[of])
        at = at[keep]
        q, entry, cos = q[at], entry[at], cos[at]
        full = np.flatnonzero(np.diff(edge) >= self.top)
        self.bound[full] = np.maximum(self.bound[full], 1.0 - (limit[full] + 1.0) / (1 << 18) - 1e-6)
        self.parts, self.new = [(q, entry, cos)], 0
        return q, entry, cos


def _search_block(index: Index, u: int, own: Unit, lo: int, hi: int, k: int, cells: int, floor: float, copies: bool) -> pa.Table:
    x, n, width = own.vecs[lo:hi], hi - lo, len(index.books[1])
    stairs = staircase(*map(len, index.books), cells)
    visits = []
    step = max(16, (1 << 21) // max(1, len(stairs[0])))
    for at in range(0, n, step):
        q, i, j = first_cells(*index.distances(x[at : at + step]), stairs, cells)
        visits.append(((q + at).astype(np.int32), (i * width + j).astype(np.int32 if index.units * width < 1 << 31 else np.int64)))
    q, cell = (np.concatenate(v) for v in zip(*visits))
    order = np.argsort(cell if len(index.books[0]) * width > 1 << 16 else cell.astype(np.uint16), kind="stable")
    q, cell = q[order], cell[order]
    del visits, order
    best = _Best(n, k + 1, floor)  # the entry itself is one of them
    started = np.zeros(len(own.cell), bool)
    if floor < -1:
        # A start with entries of the own unit gives each query a bound; they aren't looked at again.
        some = np.unique(np.linspace(0, len(own.cell) - 1, START).astype(np.int64))
        started[some] = True
        for at in range(0, n, 4096):
            sim = x[at : at + 4096] @ own.vecs[some].T
            top = np.argpartition(sim, max(0, len(some) - k - 1), axis=1)[:, -k - 1 :]
            best.add(np.repeat(np.arange(at, at + len(sim)), top.shape[1]), (u << 40) + some[top].ravel(), np.take_along_axis(sim, top, 1).ravel())
        best.shrink()
    taken, edge = np.unique(cell, return_index=True)
    edge = np.append(edge, len(cell))
    lists = np.unique(taken // width)
    need = [v for v in sorted({int(index.first[i]) + p for i in lists for p in range(int(index.parts[i]))}, key=lambda v: (v != u, v)) if index.sizes.get(v)]
    names = {}
    for v in need:
        unit = own if v == u else index.read(v)
        held, start = np.unique(unit.cell, return_index=True)
        start = np.append(start, len(unit.cell))
        for c, t in zip(*np.intersect1d(held, taken, assume_unique=True, return_indices=True)[1:]):
            some = q[edge[t] : edge[t + 1]]
            for s in range(start[c], start[c + 1], 4096):  # a hot cell in blocks
                e = min(s + 4096, start[c + 1])
                for z in range(0, len(some), max(1, (1 << 22) // (e - s))):
                    part = some[z : z + max(1, (1 << 22) // (e - s))]
                    sim = x.take(part, axis=0) @ unit.vecs[s:e].T
                    if v == u and started[s:e].any():
                        sim[:, started[s:e]] = -9
                    hit = np.flatnonzero(sim >= best.bound.take(part)[:, None])
                    if len(hit):
                        row = hit // (e - s)
                        best.add(part[row].astype(np.int64), (v << 40) + s + hit - row * (e - s), sim.ravel()[hit])
        entries = best.shrink()[1]
        mine = np.unique(entries[(entries >> 40) == v])
        names[v] = (mine, unit.ids.take(pa.array(mine & (1 << 40) - 1)))
    of, entry, cos = best.shrink()
    return _named(own, lo, hi, u, of, entry, cos, names, k, floor, copies)


def _named(own: Unit, lo: int, hi: int, u: int, of: np.ndarray, entry: np.ndarray, cos: np.ndarray, names: dict, k: int, floor: float, copies: bool) -> pa.Table:
    """The hits as lists of ids; `names` has the ids of the entries of each unit."""
    cos = np.minimum(cos, np.float32(1))
    itself = entry == (u << 40) + lo + of
    if not copies:
        of, entry, cos, itself = of[~itself], entry[~itself], cos[~itself], itself[~itself]
    known = np.concatenate([n[0] for n in names.values()] or [np.zeros(0, np.int64)])
    lists = pa.concat_arrays([n[1] for n in names.values()]) if names else pa.array([], pa.list_(pa.int64()))
    order = np.argsort(known)
    at = order[np.searchsorted(known[order], entry)] if len(entry) else np.zeros(0, np.int64)
    size, flat = np.asarray(lists.value_lengths()), lists.flatten().to_numpy()
    first = np.cumsum(size) - size
    if copies:
        many = size[at]
        ids = flat[np.repeat(first[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        of, cos = np.repeat(of, many), np.repeat(cos, many)
        other = ids != own.first[lo + of]
        ids, of, cos = ids[other], of[other], cos[other]
    else:
        ids = flat[first[at]]
    order = np.lexsort((ids, -cos, of))
    ids, of, cos = ids[order], of[order], cos[order]
    start = np.searchsorted(of, np.arange(hi - lo + 1))
    fit = np.arange(len(of)) - start[of] < k + KEPT
    ids, of, cos = ids[fit], of[fit], cos[fit]
    edge = np.searchsorted(of, np.arange(hi - lo + 1))
    rows = np.flatnonzero(np.diff(edge) > 0) if floor > -1 and copies else np.arange(hi - lo)
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.diff(edge)[rows])]), pa.int32())
    return pa.table(
        [pa.array(np.full(len(rows), u), pa.int32()), pa.array(own.first[lo:hi][rows]), own.ids.slice(lo, hi - lo).take(pa.array(rows)), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(cos, pa.float32()))],
        schema=_SCHEMA,
    )


def all_neighbours(vectors: DataFrame, found: DataFrame, k: int, crowds: int) -> DataFrame:
    """(id, near_id, cos, rank): the k most similar others of each id, from the result of search(). Copies beyond the
    KEPT that an entry names take the neighbours of the entry; `crowds` tells whether there are such."""
    near = F.concat(F.array(F.struct(F.col("key").alias("id"), F.lit(1.0).cast("float").alias("cos"))), F.arrays_zip(F.col("near").alias("id"), F.col("cos").alias("cos")))
    rows = found.select("ids", near.alias("near"))
    every = rows.filter(F.size("ids") < KEPT).select(F.explode("ids").alias("id"), "near")
    if crowds:
        many = rows.filter(F.size("ids") >= KEPT).select(F.element_at("ids", 1).alias("id"), "near")
        # Entries with at least KEPT copies: all rows that have a vector equal to that of the entry's first id.
        keyed = vectors.filter(F.col("id").isNotNull()).select("id", F.xxhash64("vec").alias("h"))
        groups = keyed.join(many, "id").select("h", "near").dropDuplicates(["h"])
        every = every.unionByName(keyed.join(groups, "h").select("id", "near").dropDuplicates(["id"]))
    best = F.array_sort("near", lambda a, b: F.when(a["cos"] > b["cos"], -1).when(a["cos"] < b["cos"], 1).otherwise(F.when(a["id"] < b["id"], -1).otherwise(1)))
    others = F.slice(F.filter(best, lambda n: n["id"] != F.col("id")), 1, k)
    return every.select("id", F.posexplode(others).alias("p", "n")).select("id", F.col("n.id").alias("near_id"), F.col("n.cos").cast("double").alias("cos"), (F.col("p") + 1).alias("rank"))


#: Cells that a query takes, as a multiple of the fourth root of the number of entries.
CELLS = 18.5


def collection(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The vectors of both tables as (id, vec), invalid ones too, and the number of rows; rows may be repeated."""
    a, b = table(spark, sf_dir, "shared_space"), table(spark, sf_dir, "expression_translations_embedded")
    n = a.count() + b.count()
    return a.select(F.col("point_id").alias("id"), F.col("vectors").alias("vec")).union(b.select(F.col("archive_line").alias("id"), F.col("embedding_vector").alias("vec"))), n


def neighbours(spark: SparkSession, sf_dir: str, k: int = 5, scale: float = CELLS, floor: float = -2.0) -> DataFrame:
    """The k most similar others of each valid vector, if their cosine is floor or more."""
    vectors, n = collection(spark, sf_dir)
    index = build_index(vectors, 64, n)
    found = settle(search(spark, index, k, scale, floor))
    index.drop(spark)
    return all_neighbours(vectors, found, k, index.crowds)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours(spark, sf_dir, floor=0.899).filter("cos >= 0.9")
    return near.select(F.least("id", "near_id").alias("vec_a"), F.greatest("id", "near_id").alias("vec_b")).distinct()


def p5_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every valid vector's five most similar others."""
    return neighbours(spark, sf_dir)


QUERIES = {"p5_found": p5_found, "p5_knn": p5_knn}
