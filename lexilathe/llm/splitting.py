"""Problem 2: oversized texts cut into pieces at natural boundaries, worked on by ranges.

A text is a run of bytes, and workers look at ranges of it: each range is a row of its own, read with a halo on both
sides, so that what lies across its edge is judged as if the whole were at hand, and gives a table of its words and the
boundaries before them. The tables of a text are stitched by streaming them in order of the ranges: word numbers are
running sums, and a piece is chosen as soon as the words that it may hold are known, so what is held at a time is a
piece and a range, however long the text. Pieces are written as offsets. Columns and files are cut by the same code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilathe.session import open_folder, table
from lexilathe.session import written as settle

#: Bytes of a range and of the halo on each side of it.
RANGE, HALO = 1 << 16, 1 << 12
#: Kinds of boundaries before a word, best last.
WORD, SENTENCE, LINE, PARAGRAPH = 0, 1, 2, 3

_WORD = re.compile(rb"[^ \t\n]+")
_BLANK = re.compile(rb"\n[ \t]*\n")
_ENDS = tuple(x.encode() for x in (".", "!", "?", "…", ".”", ".\"", ".»", "!”", "?”", "?\"", "!\"", ".)", "?)"))


def scan(data: bytes, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, kind) of each word of data that starts in [lo, hi); offsets are into data. A word is a run of bytes
    other than space, tab and newline, and its kind tells what lies before it. This defines what range_words() finds."""
    starts, ends, kinds = [], [], []
    before = 0
    last = b""
    for m in _WORD.finditer(data):
        s = m.start()
        if s >= hi:
            break
        if s >= lo:
            gap = data[before:s]
            kind = PARAGRAPH if _BLANK.search(gap) else LINE if b"\n" in gap else SENTENCE if last.endswith(_ENDS) else WORD
            starts.append(s)
            ends.append(m.end())
            kinds.append(kind)
        before, last = m.end(), m.group()
    return np.array(starts, np.int64), np.array(ends, np.int64), np.array(kinds, np.int8)


def choose(kinds: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces (first word, first new word, end) of a text of so many words: each of at most `limit` words, each but the
    first repeating the last `overlap` words before it. A piece ends before the best boundary in the last half of its
    room (a paragraph, else a line, a sentence, or any word), the last such."""
    n, pieces, at = len(kinds), [], 0
    while True:
        first = max(0, at - overlap) if at else 0
        if n - first <= limit:
            pieces.append((first, at, n))
            return pieces
        top = first + limit
        low = at + max(1, (top - at) // 2)
        room = kinds[low : top + 1]
        best = room.max()
        end = low + int(np.flatnonzero(room == best)[-1])
        pieces.append((first, at, end))
        at = end


def range_words(data: bytes, base: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, kind) of the words of a text that start in [lo, hi), by offset in the text; data holds the text from
    base on, with the halos. A word that began before lo belongs to the range before; the end of a word that reaches
    over the halo is -1, and of a gap longer than the halo what lies in the halo counts."""
    x = np.frombuffer(data, np.uint8)
    line = x == 10
    word = ~(line | (x == 32) | (x == 9))
    edge = np.diff(word.astype(np.int8), prepend=np.int8(base > 0 and len(x) and word[0]), append=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if base > 0 and len(x) and word[0]:
        first = np.concatenate([[-1], first])  # a word that began before
    lines = np.concatenate([[0], np.cumsum(line)])
    gap = lines[first[1:]] - lines[last[: len(first) - 1]]
    before = lambda k: x[np.maximum(last[: len(first) - 1] - k, 0)]
    a, b, c, d = (before(k) for k in (1, 2, 3, 4))
    stop = lambda y: (y == 46) | (y == 33) | (y == 63)
    wide = (c == 0xE2) & (b == 0x80)
    ends = stop(a) | (wide & (a == 0xA6)) | ((a == 34) & stop(b)) | ((a == 41) & ((b == 46) | (b == 63))) | (wide & (a == 0x9D) & stop(d)) | ((a == 0xBB) & (b == 0xC2) & (c == 46))
    kind = np.where(gap > 1, PARAGRAPH, np.where(gap == 1, LINE, np.where(ends, SENTENCE, WORD)))
    ahead = lines[max(first[0], 0)] if len(first) else 0
    kind = np.concatenate([[PARAGRAPH if ahead > 1 else LINE if ahead else WORD], kind])[: len(first)]
    end = np.where(last == len(x), np.where(base + len(x) < hi + HALO, base + last, -1), base + last)
    keep = (base + first >= lo) & (base + first < hi) & (first >= 0)
    return base + first[keep], end[keep], kind[keep].astype(np.int8)


_ROW = "uid long, no int, size long, most int, words binary"


def _packed(data: bytes, base: int, lo: int, hi: int) -> bytes:
    """The words of a range in five bytes each: offset in the range, length (0 if it reaches over the halo), kind."""
    s, e, k = range_words(data, base, lo, hi)
    length = np.where((e < 0) | (e - s > 65_535), 0, e - s).astype(np.uint16)
    return (s - lo).astype(np.uint16).tobytes() + length.tobytes() + k.tobytes()


def boundary_tables(texts: DataFrame) -> DataFrame:
    """(uid, no, size, most, words): the table of each range of texts (uid, text, most). Ranges with their halos are cut
    out by the JVM, a row each, and spread over the cluster."""
    data = F.encode("text", "utf-8")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.length("data") - 1, F.lit(0)), F.lit(RANGE)), lambda lo: F.struct(lo.alias("lo"), F.substring(F.col("data"), F.greatest(lo - HALO, F.lit(0)) + 1, F.least(lo, F.lit(HALO)) + RANGE + HALO).alias("part")))
    ranges = texts.select("uid", "most", data.alias("data")).select("uid", "most", F.length("data").alias("size"), F.explode(cut).alias("r"))
    ranges = ranges.select("uid", "most", "size", "r.lo", "r.part").repartition("uid", "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            los, sizes = batch.column(3).to_pylist(), batch.column(2).to_pylist()
            words = [_packed(p, max(lo - HALO, 0), lo, min(lo + RANGE, n)) for lo, n, p in zip(los, sizes, batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lo // RANGE for lo in los], pa.int32()), pa.array(sizes, pa.int64()), batch.column(1), pa.array(words, pa.binary())], ["uid", "no", "size", "most", "words"])

    return ranges.mapInArrow(run, _ROW)


class _Chooser:
    """choose() for a text whose words come range by range; holds those from the start of the piece on."""

    def __init__(self, uid: int, size: int, most: int, overlap: int):
        self.uid, self.size, self.most, self.overlap = uid, size, most, overlap
        self.first = self.at = self.held = self.no = 0  # word numbers: of the piece's start, its first new word, the first held
        self.start, self.end, self.kind = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)

    def add(self, no: int, packed: bytes) -> Iterator[tuple]:
        n = len(packed) // 5
        s = np.frombuffer(packed, np.uint16, n).astype(np.int64) + no * RANGE
        length = np.frombuffer(packed, np.uint16, n, 2 * n).astype(np.int64)
        self.start, self.kind = np.concatenate([self.start, s]), np.concatenate([self.kind, np.frombuffer(packed, np.int8, n, 4 * n)])
        self.end = np.concatenate([self.end, np.where(length > 0, s + length, -1)])
        while self.held + len(self.start) > self.first + self.most:
            top = self.first + self.most
            low = self.at + max(1, (top - self.at) // 2)
            room = self.kind[low - self.held : top + 1 - self.held]
            yield self.piece(low + int(np.flatnonzero(room == room.max())[-1]))

    def piece(self, end: int) -> tuple:
        h = self.held
        stop = self.end[end - 1 - h]
        if stop < 0:  # a word longer than the halo ends before the next begins
            stop = self.start[end - h] if end - h < len(self.start) else self.size
        out = (self.uid, self.no, end - self.first, int(self.start[self.first - h]), int(self.start[self.at - h]), int(stop))
        self.no, self.at, self.first = self.no + 1, end, max(0, end - self.overlap)
        self.start, self.end, self.kind, self.held = self.start[self.first - h :], self.end[self.first - h :], self.kind[self.first - h :], self.first
        return out

    def rest(self) -> Iterator[tuple]:
        if self.no:  # texts within their limit give no piece
            yield self.piece(self.held + len(self.start))


def piece_offsets(tables: DataFrame, overlap: int) -> DataFrame:
    """(uid, piece_no, n_words, start_byte, new_byte, end_byte) of the texts above their limit, from their tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = None
        for batch in batches:
            rows = []
            for uid, no, size, most, words in zip(*(c.to_pylist() for c in batch.columns)):
                if text is None or text.uid != uid:
                    rows += text.rest() if text else []
                    text = _Chooser(uid, size, most, overlap)
                rows += text.add(no, words)
            yield out(rows)
        if text:
            yield out(list(text.rest()))

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k in (1, 2) else pa.int64()) for k in range(6)], ["uid", "piece_no", "n_words", "start_byte", "new_byte", "end_byte"])

    ordered = tables.select("uid", "no", "size", "most", "words").repartition("uid").sortWithinPartitions("uid", "no")
    return ordered.mapInArrow(run, "uid long, piece_no int, n_words int, start_byte long, new_byte long, end_byte long")


def _oversized(units: DataFrame, key: list[str], text_col: str, limit_col: str) -> DataFrame:
    rows = units.select(*key, F.col(text_col).alias("text"), F.col(limit_col).cast("int").alias("most")).filter("text is not null").withColumn("uid", F.xxhash64(*key, "text"))
    # So many words need so many characters. A repeated row has the same uid, and of those one counts.
    return rows.filter(F.length("text") > 2 * F.col("most")).dropDuplicates(["uid"])


def split_units(units: DataFrame, key: list[str], text_col: str, limit_col: str, overlap: int = 40) -> DataFrame:
    """Units above their limit, as pieces: the key columns, piece_no, n_pieces, n_words and text of each piece.

    Rows repeated with the same key and text are one unit. Null and empty texts have no words and are never above a
    limit; a word of any length stays whole. A word is a run of characters other than space, tab and newline; the
    boundaries of a piece are those of words, and its text is that of the unit between them, so joining the pieces
    without what they repeat gives the unit's words back. Limits must be greater than twice the overlap."""
    rows = settle(_oversized(units, key, text_col, limit_col))
    pieces = settle(piece_offsets(boundary_tables(rows), overlap))
    # A text meets the offsets of all its pieces once and is cut in one pass.
    cuts = pieces.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("piece_no", "n_words", "start_byte", "end_byte"))).alias("cuts"))
    data = rows.join(cuts, "uid").select(*key, "cuts", F.encode("text", "utf-8").alias("data"))
    body = lambda c: F.rtrim(F.decode(F.substring(F.col("data"), (c["start_byte"] + 1).cast("int"), (c["end_byte"] - c["start_byte"]).cast("int")), "utf-8"), F.lit(" \t\n"))
    made = F.transform("cuts", lambda c: F.struct(c["piece_no"].alias("piece_no"), F.size("cuts").alias("n_pieces"), c["n_words"].alias("n_words"), body(c).alias("text")))
    return data.select(*key, F.explode(made).alias("p")).select(*key, "p.*")


def split_files(spark: SparkSession, paths: list[str], limit_words: int, overlap: int = 40) -> DataFrame:
    """(path, piece_no, n_words, start_byte, new_byte, end_byte) for text files of any size in a folder all workers see.

    Each task seeks to ranges of a file and reads them with a halo; nothing reads a whole file. A file of at most
    limit_words words gives no row."""
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    files = []
    for u, p in enumerate(paths):
        where = jvm.org.apache.hadoop.fs.Path(p)
        fs = where.getFileSystem(conf)
        files.append((u, fs.makeQualified(where).toString(), fs.getFileStatus(where).getLen(), p))
    table_of = spark.createDataFrame(files, "uid long, at string, size long, path string")
    parts = max(1, min(10_000, sum(1 + f[2] // (RANGE * 64) for f in files)))
    ranges = table_of.select("uid", "at", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(RANGE))).alias("lo")).repartition(parts, "uid", F.floor(F.col("lo") / (RANGE * 64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, ats, sizes, los = (c.to_pylist() for c in batch.columns)
            words = []
            for at, size, lo in zip(ats, sizes, los):
                fs, inside = open_folder(at)
                base = max(lo - HALO, 0)
                with fs.open_input_file(inside) as f:
                    words.append(_packed(f.read_at(min(lo + RANGE + HALO, size) - base, base), base, lo, min(lo + RANGE, size)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lo // RANGE for lo in los], pa.int32()), batch.column(2), pa.array([limit_words] * len(los), pa.int32()), pa.array(words, pa.binary())], ["uid", "no", "size", "most", "words"])

    return piece_offsets(ranges.mapInArrow(run, _ROW), overlap).join(F.broadcast(table_of.select("uid", "path")), "uid").drop("uid")


#: Limits in words, and the words that a piece repeats.
CHUNK_WORDS, UNIT_WORDS, OVERLAP = 700, 1_800, 40
KEY = ["unit_kind", "document_id", "chunk_index"]


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = table(spark, sf_dir, "chunk").select(F.lit("chunk").alias("unit_kind"), "document_id", "chunk_index", "text", F.lit(CHUNK_WORDS).alias("most"))
    unit = table(spark, sf_dir, "transcript_unit").select(F.lit("transcript_unit").alias("unit_kind"), "document_id", "chunk_index", "text", F.lit(UNIT_WORDS).alias("most"))
    return chunk.union(unit)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units that come out in pieces."""
    rows = settle(_oversized(_units(spark, sf_dir), KEY, "text", "most"))
    cut = piece_offsets(boundary_tables(rows), OVERLAP).select("uid").distinct()
    return rows.select("uid", *KEY).join(cut, "uid", "left_semi").select(*KEY).distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all units above their limit; page_range is that of the whole unit (null where it has none)."""
    pages = table(spark, sf_dir, "chunk").select(F.lit("chunk").alias("unit_kind"), "document_id", "chunk_index", "page_range")
    pages = pages.union(table(spark, sf_dir, "transcript_unit").select(F.lit("transcript_unit"), "document_id", "chunk_index", "page_range")).groupBy(*KEY).agg(F.max("page_range").alias("page_range"))
    return split_units(_units(spark, sf_dir), KEY, "text", "most", OVERLAP).join(pages, KEY, "left")


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces}
_words = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n]+'), lambda x: x <> ''))"
SQL = {
    "p2_found": f"""
        select distinct unit_kind, document_id, chunk_index from (
            select 'chunk' as unit_kind, document_id, chunk_index, {_words} as n, 700 as most from chunk
            union all select 'transcript_unit', document_id, chunk_index, {_words}, 1800 from transcript_unit)
        where n > most"""
}
