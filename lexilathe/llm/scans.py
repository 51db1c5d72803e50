"""Problem 6: noise in the text of scanned pages, found and repaired.

Headers are lines that come again, nearly alike, at the edges of a document's pages; page numbers are lines of a number
that follow the pages; both are taken out. Words split over lines are joined, by what the corpus vocabulary says where
the line end alone doesn't tell, and words the scan misread are those that a usual confusion of letters turns into a
far more frequent word of the corpus. A long document is never one task: its pages meet in aggregates and in windows
over blocks of pages.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexilathe.session import table
from lexilathe.session import written as settle

# What scans make of letters (read, meant).
CONFUSIONS = [
    ("c", "e"), ("e", "c"), ("@", "a"), ("@", "o"), ("0", "o"), ("1", "i"), ("1", "l"), ("5", "s"), ("6", "b"), ("6", "é"), ("6", "ó"), ("8", "b"), ("9", "g"),
    ("f", "t"), ("t", "f"), ("q", "g"), ("ri", "n"), ("r1", "n"), ("ii", "u"), ("cl", "d"), ("c1", "d"), ("li", "h"), ("1i", "h"), ("rn", "m"), ("vv", "w"), ("h", "b"), ("!", "l"), ("|", "l"),
]
# Words that join two halves of a shortened compound ("first- and second-hand").
JOINERS = "and or und oder bzw beziehungsweise sowie et ou y e o u ed od".split()
# Words that number a part of a text.
PARTS = "chapter chapitre kapitel capítulo capitulo capitolo part partie teil parte section abschnitt sección sezione secção".split()

HYPHENS = "-‐\xad¬‑"
#: Those that a compound may have as its own.
OWN = "-‐‑"
#: A word must be so many times rarer than what it is taken for, which must occur so often.
RARER, OFTEN = 20, 5
#: Pages of a block in the windows over a document's pages.
BLOCK = 64

_NUMBER = re.compile(r"(?:[\[(–—\-−·|~*]\s*)?(page|seite|página|pagina|pág|pag|p|s)?\b\.?\s*((?:[\dlioIO]\s?){1,5})(?:\s*[\])–—\-−·|~*])?", re.IGNORECASE)
_ROMAN = re.compile(r"[\[(–—\-]?\s*(?=[ivxlc])(c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))\s*[\])–—\-]?", re.IGNORECASE)
_NUMBERED = re.compile(r"(\d{1,4})\s+(?=[^\W\d_])|(?<=[^\W\d_)])\s+(\d{1,4})$")
_TOKEN = re.compile(r"[^\s.,;:()«»“”„\"‘’'?¿¡…–—/]+")
DDL_KEY = "document_id string, page_number int"


def title_key(line: str) -> str:
    """A line without numbers, signs and case."""
    return " ".join(re.sub(r"[\d\W_]+", " ", line).lower().split())


def number_of(line: str) -> int | None:
    """The number that a line consists of, if it is one: arabic, with signs or a word for page around, or roman."""
    line = line.strip()
    m = _ROMAN.fullmatch(line)
    if m and m.group(1):
        total = 0
        values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in m.group(1).lower()]
        for v, after in zip(values, [*values[1:], 0]):
            total += -v if v < after else v
        return total
    m = _NUMBER.fullmatch(line)
    if not m:
        return None
    digits = re.sub(r"\s", "", m.group(2)).translate(str.maketrans("lLiIoO", "111100"))
    return int(digits) if (m.group(1) or any(c.isdigit() for c in m.group(2))) and digits.isdigit() and len(digits) < 5 else None


def number_in(line: str) -> int | None:
    """The number at the start or the end of a line of words."""
    m = _NUMBERED.match(line) or _NUMBERED.search(line)
    return int(m.group(1) or m.group(2)) if m else None


def edge_lines(pages: DataFrame) -> DataFrame:
    """Lines at page edges, and lines that may be headings: key columns, line_no, edge (0 none, 1 and 2 from the top, 3
    and 4 from the bottom), title (their key), number, inner (a number at the start or end of a line of words), gap
    (whether a blank line follows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, page, text in zip(*(c.to_pylist() for c in batch.columns)):
                lines = (text or "").split("\n")
                full = [i for i, x in enumerate(lines) if x.strip()]
                edges = {}
                for e, i in zip((4, 3), full[:-3:-1]):
                    edges[i] = e
                for e, i in zip((1, 2), full[:2]):
                    edges[i] = e
                for i in full:
                    e = edges.get(i, 0)
                    gap = i + 1 < len(lines) and not lines[i + 1].strip()
                    x = lines[i].strip()
                    if e or (gap and len(x) < 90 and x[-1] not in ".!?,;:…)”»\"" + HYPHENS):
                        rows.append((doc, page, i, e, title_key(x), number_of(x) if e else None, number_in(x) if e else None, gap))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_()])],
                ["document_id", "page_number", "line_no", "edge", "title", "number", "inner", "gap"],
            )

    return pages.select("document_id", "page_number", "text").mapInArrow(run, DDL_KEY + ", line_no int, edge int, title string, number long, inner long, gap boolean")


def furniture(pages: DataFrame) -> DataFrame:
    """(key columns, line_no, noise_kind) of headers and page numbers."""
    lines = settle(edge_lines(pages))
    # Page numbers: the number runs with the pages, as for most of the document's, or stands next to the edge.
    offset = F.coalesce("number", "inner") - F.col("page_number")
    numbers = lines.filter("coalesce(number, inner) is not null").withColumn("off", offset)
    usual = numbers.groupBy("document_id", "off").agg(F.count("*").alias("n")).groupBy("document_id").agg(F.max_by("off", F.struct("n", F.negate(F.abs("off")))).alias("usual"))
    page_numbers = numbers.filter("number is not null").join(usual, "document_id").filter((F.col("off") == F.col("usual")) | ((F.abs(F.col("off") - F.col("usual")) <= 2) & F.col("edge").isin(1, 4))).select("document_id", "page_number", "line_no", F.lit("page_number").alias("noise_kind"))

    # Only the line at the very edge, or the one next to it if that holds a page number, can be a running title.
    sides = numbers.join(page_numbers.select("document_id", "page_number", "line_no"), ["document_id", "page_number", "line_no"], "left_semi")
    outer = sides.groupBy("document_id", "page_number").agg(F.max(F.col("edge") == 1).alias("top"), F.max(F.col("edge") == 4).alias("bottom"))
    edge = lines.filter((F.col("edge") > 0) & F.col("number").isNull() & (F.length("title") >= 3)).join(outer, ["document_id", "page_number"], "left")
    edge = edge.filter(F.col("edge").isin(1, 4) | (F.col("edge") == 2) & F.col("top") | (F.col("edge") == 3) & F.col("bottom"))
    part = F.split("title", " ")[0].isin(PARTS) & (F.size(F.split("title", " ")) <= 2)
    # A line of words with the page's number in it is a running title, however often it comes.
    paged = F.coalesce(F.col("inner") - F.col("page_number") == F.col("usual"), F.lit(False)).alias("paged")
    edge = settle(edge.filter(~part).join(usual, "document_id", "left").select("document_id", "page_number", "line_no", "title", "gap", paged))
    inner = lines.filter("edge = 0 and length(title) >= 3").groupBy("document_id", "title").agg(F.min(F.struct("page_number", "line_no")).alias("heading"))
    slug = F.regexp_replace(F.regexp_replace("document_id", r"^\d{4}-", ""), r"-\d+$", "")
    plain = F.translate("title", "áàâäãåéèêëíìîïóòôöõúùûüçñßœæ", "aaaaaaeeeeiiiiooooouuuucnsoa")
    own = (F.length(slug) >= 5) & F.regexp_replace(plain, r"\s+", "-").startswith(slug)
    seen = edge.groupBy("document_id", "title").agg(
        F.countDistinct("page_number").alias("pages"),
        F.sum(F.col("page_number") % 2).alias("odd"),
        F.min(F.struct("page_number", "line_no", "gap")).alias("first"),
        F.max("paged").alias("paged"),
        F.max(own.cast("int")).alias("own"),
    )
    seen = settle(seen.join(inner, ["document_id", "title"], "left"))
    known = seen.filter((F.col("pages") >= 2) | F.col("paged") | (F.col("own") == 1) | (F.col("heading.page_number") <= F.col("first.page_number")))
    # Lines seen once, nearly like a known running title of the document, are misread ones of it.
    ends = lambda c: F.array_distinct(F.array(F.concat(F.lit("<"), F.substring(c, 1, 4)), F.concat(F.lit(">"), F.substring(c, -4, 4)), F.substring(c, 5, 4)))
    odd_ones = seen.join(known.select("document_id", "title"), ["document_id", "title"], "left_anti").select("document_id", "title", F.explode(ends(F.col("title"))).alias("end"))
    close = (
        odd_ones.join(known.select("document_id", F.col("title").alias("like"), F.explode(ends(F.col("title"))).alias("end")), ["document_id", "end"])
        .filter(F.levenshtein("title", "like") <= F.greatest(F.lit(1), F.length("like") * 0.2))
        .select("document_id", "title").distinct()
    )
    # A chapter's title stands once in its own place, followed by a blank line; if that isn't elsewhere on an earlier
    # page, it is the first at an edge. The document's title (on even pages only) has no such place.
    place = F.when((F.col("odd") == 0) | (F.col("own") == 1) & (F.col("first.page_number") > 1) | ~F.col("first.gap") | (F.col("heading.page_number") <= F.col("first.page_number")), F.lit(None)).otherwise(F.col("first.page_number"))
    titles = known.select("document_id", "title", place.alias("place")).unionByName(close.withColumn("place", F.lit(None).cast("int")))
    headers = edge.join(titles, ["document_id", "title"]).filter("place is null or page_number <> place or paged").select("document_id", "page_number", "line_no", F.lit("header").alias("noise_kind"))
    return headers.unionByName(page_numbers).distinct()


def _page_words(lines: list[str], skip: set[int]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, str]], tuple | None]:
    """((line, line of its end, word) of all words; (line, next line, first half, second half) of words that a hyphen at a line end may
    split; the first half that ends the page, with its line). Halves are left out of the words."""
    words, splits = [], []
    text = [i for i, x in enumerate(lines) if x.strip() and i not in skip]
    halves: dict[int, str] = {}
    carried = None
    for k, i in enumerate(text):
        tokens = _TOKEN.findall(lines[i])
        raw = lines[i].rstrip()
        if carried and tokens:
            # The second half is the line's first token.
            j, first = carried
            second = tokens[0].strip(HYPHENS)
            splits.append((j, i, first, second))
            if not (second.lower() in JOINERS):
                tokens = tokens[1:]
        carried = None
        if tokens and raw[-1:] in HYPHENS and len(raw) > 1 and raw[-2].isalpha():
            first = tokens[-1].rstrip(HYPHENS)
            if first:
                carried = (i, first)
                tokens = tokens[:-1]
        words += [(i, i, w.strip(HYPHENS)) for w in tokens]
    return words, splits, carried


def _noise_lists(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """pages with skip: their numbers of header and page number lines."""
    taken = lines.groupBy("document_id", "page_number").agg(F.collect_set("line_no").alias("skip"))
    return pages.join(taken, ["document_id", "page_number"], "left").select("document_id", "page_number", "text", "skip")


def vocabulary(bodies: DataFrame) -> DataFrame:
    """(word, n, own) over pages (with skip): lower-case words, those split over two lines of a page joined; own leaves
    out the joined ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            joined: Counter = Counter()
            for text, skip in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words, splits, _ = _page_words((text or "").split("\n"), set(skip or ()))
                counts.update(w for _, _, w in words)
                joined.update(a + b for _, _, a, b in splits)
            low: dict[str, list[int]] = {}
            for own, of in ((1, counts), (0, joined)):
                for w, n in of.items():
                    both = low.setdefault(w.lower(), [0, 0])
                    both[0] += n
                    both[1] += own * n
            yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.string()), *(pa.array([x[k] for x in low.values()], pa.int64()) for k in (0, 1))], ["word", "n", "own"])

    return bodies.mapInArrow(run, "word string, n long, own long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))


def keeps_hyphen(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(x, y, keep) of halves (x, y) in lower case: whether the corpus writes x-y rather than xy; if neither more than the
    other, whether both halves are words by themselves."""
    asked = [(0, F.concat("x", F.lit(h), "y")) for h in OWN] + [(1, F.concat("x", "y")), (2, F.col("x")), (3, F.col("y"))]
    words = pairs.distinct().select("x", "y", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), w.alias("word")) for k, w in asked])).alias("q")).select("x", "y", "q.k", "q.word")
    with_, without, x, y = (F.sum(F.when(F.col("k") == k, F.coalesce("own", F.lit(0))).otherwise(0)) for k in range(4))
    keep = (with_ > without) | ((with_ == without) & (x >= OFTEN) & (y >= OFTEN))
    return words.join(counts.select("word", "own"), "word", "left").groupBy("x", "y").agg((keep & ~F.col("y").isin(JOINERS)).alias("keep"))


def variants(word: str) -> list[str]:
    """What a word may have been before the scan: one kind of confusion undone at one place, or a digit everywhere."""
    out = set()
    for read, meant in CONFUSIONS:
        at = word.find(read)
        while at >= 0:
            out.add(word[:at] + meant + word[at + len(read) :])
            at = word.find(read, at + 1)
        if word.count(read) > 1 and not read.isalpha():
            out.add(word.replace(read, meant))
    return sorted(out)


def misread_words(counts: DataFrame) -> DataFrame:
    """(word, meant) of the words of a vocabulary that the scan misread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, n, v) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if len(w) >= 3 and any(c.isalpha() for c in w) for v in variants(w)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.string(), pa.int64(), pa.string()])], ["word", "n", "meant"])

    tried = counts.mapInArrow(run, "word string, n long, meant string")
    known = counts.select(F.col("word").alias("meant"), F.col("n").alias("m"))
    return tried.join(known, "meant").filter((F.col("m") >= OFTEN) & (F.col("m") >= RARER * F.col("n"))).groupBy("word").agg(F.max_by("meant", F.struct("m", "meant")).alias("meant"))


#: Bits of the map of misread words' hashes that is sent to the tasks.
MAP_BITS = 20


def line_noise(bodies: DataFrame, counts: DataFrame, wrong: DataFrame) -> DataFrame:
    """(key columns, line_no, noise_kind, word, meant) of hyphens and misread words on pages (with skip)."""
    spark = bodies.sparkSession
    bits = np.zeros(1 << MAP_BITS, bool)  # at most 2^20 rows come to the driver, whatever the corpus
    bits[[r[0] for r in wrong.select((F.crc32(F.encode("word", "utf-8")) % (1 << MAP_BITS)).alias("b")).distinct().collect()]] = True
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # kind 0: a word that may be misread; 1: a split within the page; 2: the half word that ends the page; 3: the
        # first word of the page.
        for batch in batches:
            rows = []
            for doc, page, text, skip in zip(*(c.to_pylist() for c in batch.columns)):
                lines = (text or "").split("\n")
                words, splits, last = _page_words(lines, set(skip or ()))
                may = [(i, w.lower()) for i, _, w in words]
                for i, j, a, b in splits:
                    rows.append((doc, page, i, 1, a, b))
                    may.append((-1, (a + b).lower()))
                    if shared.value[zlib.crc32((a + b).lower().encode()) & (1 << MAP_BITS) - 1]:
                        rows += [(doc, page, i, 4, a, b), (doc, page, j, 5, a, b)]
                rows += [(doc, page, i, 0, w, "") for i, w in may if i >= 0 and shared.value[zlib.crc32(w.encode()) & (1 << MAP_BITS) - 1]]
                if last:
                    rows.append((doc, page, last[0], 2, last[1], ""))
                first = next((t for i, x in enumerate(lines) if x.strip() and i not in (skip or ()) for t in [_TOKEN.findall(x)] if t), None)
                if first:
                    rows.append((doc, page, -1, 3, first[0].strip(HYPHENS), ""))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()])],
                ["document_id", "page_number", "line_no", "what", "a", "b"],
            )

    marks = settle(bodies.mapInArrow(run, DDL_KEY + ", line_no int, what int, a string, b string"))
    # The word after a page's end is the first of the next page that has one: looked for within a block of pages, and
    # for the last of a block among the first words of the blocks.
    firsts = marks.filter("what = 3").select("document_id", "page_number", F.col("a").alias("word"), F.floor(F.col("page_number") / BLOCK).alias("block"))
    heads = firsts.groupBy("document_id", "block").agg(F.min_by("word", "page_number").alias("head"))
    after = heads.select("document_id", "block", F.lead("head").over(Window.partitionBy("document_id").orderBy("block")).alias("next_head"))
    inside = firsts.withColumn("next", F.lead("word").over(Window.partitionBy("document_id", "block").orderBy("page_number")))
    following = inside.join(after, ["document_id", "block"]).select("document_id", "page_number", F.coalesce("next", "next_head").alias("next"))
    across = marks.filter("what = 2").join(following, ["document_id", "page_number"]).filter("next is not null").select("document_id", "page_number", "line_no", "a", F.col("next").alias("b"))
    splits = marks.filter("what = 1").select("document_id", "page_number", "line_no", "a", "b").unionByName(across)
    letters = splits.filter(F.col("b").rlike(r"^\p{L}"))
    joined = letters.withColumn("word", F.lower(F.concat("a", "b"))).join(counts.filter(F.col("n") >= OFTEN), "word", "left")
    hyphens = joined.filter(~F.lower("b").isin(JOINERS) | F.col("n").isNotNull())
    hyphens = hyphens.withColumns({"x": F.lower("a"), "y": F.lower("b")})
    hyphens = hyphens.join(keeps_hyphen(hyphens.select("x", "y"), counts), ["x", "y"])
    compound = F.concat("a", F.lit("-"), "b")
    hyphens = hyphens.select("document_id", "page_number", "line_no", F.lit("hyphen").alias("noise_kind"), compound.alias("word"), F.when(F.col("keep"), compound).otherwise(F.concat("a", "b")).alias("meant"))
    # In a split word the half that the correction changes is the misread one.
    whole = marks.filter("what = 0").select("document_id", "page_number", "line_no", F.col("a").alias("word")).join(wrong, "word")
    halves = marks.filter("what in (4, 5)").withColumn("word", F.lower(F.concat("a", "b"))).join(wrong, "word")
    in_second = F.col("meant").startswith(F.lower(F.substring(F.col("a"), 1, 1000)))
    halves = halves.filter((F.col("what") == 5) == in_second)
    misread = whole.unionByName(halves.select("document_id", "page_number", "line_no", "word", "meant")).select("document_id", "page_number", "line_no", F.lit("misread").alias("noise_kind"), "word", "meant")
    return hyphens.unionByName(misread)


def scan_noise(pages: DataFrame, suspect: DataFrame) -> DataFrame:
    """(document_id, page_number, line_no, noise_kind, word, meant) of pages (document_id, page_number, text), without
    the lines of suspect (key columns, line_no) as misread ones.

    Rows repeated with one key are one page (one of the texts, if they differ). Null and empty texts have no lines;
    pages without a document or number are left out. Texts of any length are read whole."""
    pages = settle(pages.filter("document_id is not null and page_number is not null").groupBy("document_id", "page_number").agg(F.max("text").alias("text")))
    outer = settle(furniture(pages.filter("text is not null")))
    bodies = settle(_noise_lists(pages.filter("text is not null"), outer))
    counts = settle(vocabulary(bodies))
    inner = line_noise(bodies, counts, settle(misread_words(counts)))
    kept = inner.filter("noise_kind = 'hyphen'").unionByName(inner.filter("noise_kind = 'misread'").join(suspect.distinct(), ["document_id", "page_number", "line_no"], "left_anti"))
    none = F.lit(None).cast("string")
    return outer.withColumns({"word": none, "meant": none}).unionByName(kept)


def paragraphs(pages: DataFrame, noise: DataFrame) -> DataFrame:
    """(document_id, page_number, paragraph_no, text, open_end, glued) of repaired pages: without headers and page numbers,
    with lines joined, split words joined and misread words replaced. A paragraph that goes on on the next page has
    open_end, and glued if its last word goes on there, so that no space comes between; the parts follow each other in
    the order of pages and numbers."""
    skip = noise.filter("noise_kind in ('header', 'page_number')").groupBy("document_id", "page_number").agg(F.collect_set("line_no").alias("skip"))
    fixes = noise.filter("word is not null").groupBy("document_id", "page_number").agg(F.collect_set(F.struct("line_no", "noise_kind", "word", "meant")).alias("fixes"))
    one = pages.filter("document_id is not null and page_number is not null and text is not null").groupBy("document_id", "page_number").agg(F.max("text").alias("text"))
    rows = one.join(skip, ["document_id", "page_number"], "left").join(fixes, ["document_id", "page_number"], "left").select("document_id", "page_number", "text", "skip", "fixes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, page, text, skip_, fixes_ in zip(*(c.to_pylist() for c in batch.columns)):
                for no, (paragraph, is_open, is_glued) in enumerate(_repair(text.split("\n"), set(skip_ or ()), fixes_ or [])):
                    out.append((doc, page, no, paragraph, is_open, is_glued))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()])], ["document_id", "page_number", "paragraph_no", "text", "open_end", "glued"])

    return rows.mapInArrow(run, DDL_KEY + ", paragraph_no int, text string, open_end boolean, glued boolean")


def _cased(seen: str, meant: str) -> str:
    """meant in the case of what was seen: capitals, a capital at the start, or as it is."""
    letters = [c for c in seen if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return meant.upper()
    return meant[:1].upper() + meant[1:] if seen[:1].isupper() else meant


def continuous(parts: DataFrame) -> DataFrame:
    """(document_id, page_number, paragraph_no, last_page, text): the rows of paragraphs() with those put together that
    go on over page ends, under the page and number where they begin.

    Where one begins is told by short rows, one a page; only texts that go on are brought together, so a group is one
    paragraph, however long the document."""
    page = parts.groupBy("document_id", "page_number").agg(F.max("paragraph_no").alias("last"), F.max_by("open_end", "paragraph_no").alias("open"))
    order = Window.partitionBy("document_id").orderBy("page_number")
    # A page whose first paragraph goes on from the page before; the run of such pages with one paragraph is passed through.
    page = page.withColumn("from_before", F.coalesce(F.lag("open").over(order), F.lit(False))).withColumn("prior", F.lag(F.struct("page_number", "last")).over(order))
    begins = F.when(~F.col("from_before"), F.struct("page_number", F.lit(0).alias("last"))).when(F.col("prior.last") > 0, F.col("prior"))
    page = page.withColumn("head", F.last(begins, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    keyed = parts.join(page.select("document_id", "page_number", "last", "from_before", "head"), ["document_id", "page_number"])
    first = (F.col("paragraph_no") == 0) & F.col("from_before")
    keyed = keyed.select("document_id", F.when(first, F.col("head.page_number")).otherwise(F.col("page_number")).alias("page"), F.when(first, F.col("head.last")).otherwise(F.col("paragraph_no")).alias("no"), "page_number", "text", "glued", ((F.col("paragraph_no") == F.col("last")) & F.col("open_end") | first).alias("more"))
    whole = keyed.filter("not more").select("document_id", F.col("page").alias("page_number"), F.col("no").alias("paragraph_no"), F.col("page_number").alias("last_page"), "text")
    piece = F.transform(F.array_sort(F.collect_list(F.struct("page_number", F.concat("text", F.when(F.col("glued"), "").otherwise(" ")).alias("t")))), lambda x: x["t"])
    many = keyed.filter("more").groupBy("document_id", F.col("page").alias("page_number"), F.col("no").alias("paragraph_no")).agg(F.max("page_number").alias("last_page"), F.rtrim(F.array_join(piece, "")).alias("text"))
    return whole.unionByName(many)


def _repair(lines: list[str], skip: set[int], fixes: list[dict]) -> list[tuple[str, bool, bool]]:
    split_at = {f["line_no"]: f for f in fixes if f["noise_kind"] == "hyphen"}
    words: dict[int, list[tuple[str, str]]] = {}
    for f in fixes:
        if f["noise_kind"] == "misread":
            words.setdefault(f["line_no"], []).append((f["word"], f["meant"]))
    parts: list[list[str]] = [[]]
    wrong: list[tuple[str, str]] = []  # of the lines that the last entry of parts was joined from
    glue = False
    for i, line in enumerate(lines):
        if i in skip:
            continue
        if not line.strip():
            if parts[-1] and not glue:
                parts.append([])
            continue
        text = line.strip()
        if glue and parts[-1]:
            parts[-1][-1] += text
            wrong = wrong + words.get(i, [])
        else:
            parts[-1].append(text)
            wrong = words.get(i, [])
        glue = i in split_at
        if glue:
            body = parts[-1][-1].rstrip()
            # A compound keeps its own hyphen, which is what the split's meaning has; soft and printed marks go.
            own = body[-1:] in OWN and split_at[i]["meant"] == split_at[i]["word"]
            parts[-1][-1] = body if own else body[:-1]
        # After joining, so that words whose halves stand on two lines are found whole.
        for word, meant in wrong:
            parts[-1][-1] = re.sub(r"(?<!\w)" + re.escape(word) + r"(?!\w)", lambda m: _cased(m.group(), meant), parts[-1][-1], flags=re.IGNORECASE)  # noqa: B023
    done = [" ".join(p) for p in parts if p]
    last = len(done) - 1
    return [(p, k == last and (glue or p.rstrip()[-1:] not in ".!?…”»\")"), k == last and glue) for k, p in enumerate(done)]


def _noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    suspect = table(spark, sf_dir, "integrity_regions").select("document_id", "page_number", F.col("line_index_in_page").alias("line_no"))
    return scan_noise(table(spark, sf_dir, "page_record"), suspect)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noise(spark, sf_dir).select("document_id", "page_number", "line_no", "noise_kind").distinct()


def p6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as continuous paragraphs, by the page and number where they begin."""
    return continuous(settle(paragraphs(table(spark, sf_dir, "page_record"), settle(_noise(spark, sf_dir)))))


QUERIES = {"p6_found": p6_found, "p6_paragraphs": p6_paragraphs}
