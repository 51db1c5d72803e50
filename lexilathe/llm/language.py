"""Problem 4: language of texts and of their paragraphs by rank-order profiles of n-grams."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexilathe.session import table

LANGUAGES = ["en", "fr", "de", "es", "it", "pt"]

# How labels name the six languages, beside codes with a region such as en-GB.
NAMES = {
    "en": "en eng english anglais englisch inglés ingles inglese inglês",
    "fr": "fr fra fre french français francais französisch franzosisch francés frances francese francês",
    "de": "de deu ger german allemand deutsch alemán aleman tedesco alemão alemao",
    "es": "es spa spanish espagnol spanisch español espanol castellano spagnolo espanhol",
    "it": "it ita italian italien italienisch italiano",
    "pt": "pt por portuguese portugais portugiesisch portugués portugues portoghese português",
}

#: Labelled rows per language that profiles are fitted on, n-grams in a profile, and n-grams of a text that are ranked.
SAMPLE_ROWS, PROFILE, RANKED = 400, 2000, 400
#: Paragraphs with fewer letters are too short to be found.
LEAST_LETTERS = 40

_A = 28  # symbols: 0 for what is no letter, 1-26, 27 for letters outside a-z
_BLANK = re.compile(r"\n[ \t]*\n(?:[ \t]*\n)*")
_SPEAKER = re.compile(r"[^\W\d_][\w .]{0,24}:\s")


def label_column(label) -> F.Column:
    """The language code that a label names, or an empty string."""
    plain = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    plain = F.trim(F.regexp_replace(plain, r"\(.*\)$", ""))
    plain = F.when(plain.rlike(r"^[a-z]{2,3}[-_]"), F.regexp_extract(plain, r"^([a-z]{2,3})", 1)).otherwise(plain)
    code = F.lit("")
    for lang, names in NAMES.items():
        code = F.when(plain.isin(names.split()), lang).otherwise(code)
    return code


@lru_cache(1)
def _symbols() -> np.ndarray:
    """Symbol of each code point of the basic plane: letters without case and accents."""
    out = np.zeros(65536, np.uint8)
    for c in range(65536):
        ch = chr(c)
        if ch.isalpha():
            base = unicodedata.normalize("NFD", ch.lower())[:1]
            out[c] = ord(base) - 96 if "a" <= base <= "z" else 27
    return out


def segments(text: str) -> list[str]:
    """The non-blank pieces between blank lines; a blank line holds only spaces or tabs."""
    return [p for p in _BLANK.split(text) if p.strip(" \t\n")]


def _ngrams(pieces: list[str], bare: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters of each piece, piece of each n-gram, n-gram, count): the n-grams of two and three symbols of each bare
    piece; none reaches over a word."""
    sym = _symbols()

    def coded(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = " ".join(strings) + " "
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        s = sym[np.minimum(codes, 65535)]
        if codes.max() > 65535:
            s[[i for i in np.flatnonzero(codes > 65535) if chr(codes[i]).isalpha()]] = 27
        return s, np.repeat(np.arange(len(strings)), np.fromiter(map(len, strings), np.int64, len(strings)) + 1)

    s, own = coded(pieces)
    letters = np.bincount(own[s > 0], minlength=len(pieces))
    if any(a is not b for a, b in zip(pieces, bare)):
        s, own = coded(bare)
    s = np.concatenate([[0], s]).astype(np.int64)
    own = np.concatenate([[0], own])
    a, b, c = s[:-2], s[1:-1], s[2:]
    three = np.flatnonzero(b > 0)
    two = np.flatnonzero((a > 0) & (b > 0))
    keys = np.concatenate([own[1:-1][three] << 16 | (a[three] * _A + b[three]) * _A + c[three], own[1:-1][two] << 16 | _A**3 + a[two] * _A + b[two]])
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(keys)]]))
    keys = keys[first]
    return letters, keys >> 16, keys & 0xFFFF, count


GRAMS = _A**3 + _A**2


def fit(pieces: list[str], labels: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Ranks (language, n-gram) from pieces with uncertain labels (numbers; -1 for none). After each round the pieces
    take the language found for them, so wrong labels and mixed texts fade out."""
    bare = [_SPEAKER.sub("", p, count=1) if _SPEAKER.match(p) else p for p in pieces]
    letters, own, gram, count = _ngrams(pieces, bare)
    ranks = None
    for _ in range(rounds):
        ranks = np.full((len(LANGUAGES), GRAMS), PROFILE, np.int32)
        for k in range(len(LANGUAGES)):
            of = labels[own] == k
            total = np.bincount(gram[of], weights=count[of], minlength=GRAMS)
            best = np.argsort(-total, kind="stable")[:PROFILE]
            best = best[total[best] > 0]
            ranks[k, best] = np.arange(len(best))
        found, confidence = _nearest(len(pieces), own, gram, count, ranks)
        labels = np.where((letters >= LEAST_LETTERS) & (confidence > 0.02), found, -1)
    return ranks


def _nearest(n: int, own: np.ndarray, gram: np.ndarray, count: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language of least out-of-place distance and the lead over the next, as a share, for each of n pieces."""
    common = ranks.min(axis=0)  # ties of equal counts are ranked alike in all languages
    order = np.lexsort((common[gram], -count, own))
    own, gram = own[order], gram[order]
    first = np.searchsorted(own, np.arange(n))
    place = np.arange(len(own)) - first[own]
    top = place < RANKED
    own, gram, place = own[top], gram[top], place[top]
    distance = np.empty((len(ranks), n))
    for k in range(len(ranks)):
        r = ranks[k][gram]
        away = np.where(r >= PROFILE, PROFILE, np.abs(r - place))
        distance[k] = np.bincount(own, weights=away, minlength=n)
    total = np.sort(distance, axis=0)
    lead = np.where(total[1] > 0, 1 - total[0] / np.maximum(total[1], 1), 0.0)
    return np.argmin(distance, axis=0), lead


def classify(pieces: list[str], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, language number or -1 without letters, confidence) of each piece."""
    bare = [_SPEAKER.sub("", p, count=1) if _SPEAKER.match(p) else p for p in pieces]
    letters, own, gram, count = _ngrams(pieces, bare)
    found, lead = _nearest(len(pieces), own, gram, count, ranks)
    return letters, np.where(letters > 0, found, -1), np.round(lead, 4)


def fit_on(records: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Profiles from a bounded sample: at most `rows` records of each label (those of least hash), taken to the driver."""
    labelled = records.filter("label <> '' and text is not null").select("record_id", "label", F.xxhash64("record_id").alias("h"))
    ranked = labelled.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("h", "record_id"))).filter(F.col("k") <= rows)
    sample = records.join(F.broadcast(ranked.select("record_id", "label")), ["record_id", "label"], "left_semi").select("label", "text", "record_id").orderBy("record_id").collect()
    pieces, labels = [], []
    for r in sample:
        own = segments(r.text)
        pieces += own
        labels += [LANGUAGES.index(r.label)] * len(own)
    if not pieces:
        return np.full((len(LANGUAGES), GRAMS), PROFILE, np.int32)
    return fit(pieces, np.array(labels))


def language_segments(records: DataFrame, ranks: np.ndarray) -> DataFrame:
    """record_kind, record_id, label, segment_no, n_letters, lang, confidence of each segment of records (record_kind,
    record_id, label, text). Null, empty and blank texts have no segments; a segment without letters has a null lang.
    Ties go to the first of LANGUAGES. Repeated records give repeated rows."""
    shared = records.sparkSession.sparkContext.broadcast(ranks)
    names = pa.array([*LANGUAGES, None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            rows, numbers, pieces, held = [], [], [], 0

            def out():
                letters, lang, lead = classify(pieces, shared.value)
                heads = pa.RecordBatch.from_arrays(batch.columns[:3], ["record_kind", "record_id", "label"]).take(pa.array(rows))
                return pa.RecordBatch.from_arrays([*heads.columns, pa.array(numbers, pa.int32()), pa.array(letters, pa.int32()), names.take(pa.array(lang % len(names))), pa.array(lead)], ["record_kind", "record_id", "label", "segment_no", "n_letters", "lang", "confidence"])

            for i, text in enumerate(texts):
                if not text:
                    continue
                own = segments(text)
                rows += [i] * len(own)
                numbers += range(len(own))
                pieces += own
                held += len(text)
                if held > 500_000 or len(pieces) > 20_000:
                    if pieces:
                        yield out()
                    rows, numbers, pieces, held = [], [], [], 0
            if pieces:
                yield out()

    return records.select("record_kind", "record_id", "label", "text").mapInArrow(run, "record_kind string, record_id string, label string, segment_no int, n_letters int, lang string, confidence double")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("record_kind"), F.col("doc_id").cast("string").alias("record_id"), label_column(F.col("lang")).alias("label"), "text")
    talks = table(spark, sf_dir, "interview_database").select(F.lit("interview").alias("record_kind"), F.col("id").alias("record_id"), label_column(F.col("language")).alias("label"), "text")
    return docs.union(talks)


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    return language_segments(records.filter("text is not null"), fit_on(records.filter("record_kind = 'document'")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = _found(spark, sf_dir).filter((F.col("n_letters") >= LEAST_LETTERS) & F.col("lang").isNotNull() & (F.col("lang") != F.col("label")))
    return wrong.select("record_kind", "record_id", "segment_no", "lang").distinct()


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every text with its language and confidence."""
    return _found(spark, sf_dir).distinct()


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with text: the language of most of its letters, its confidence (the letters' mean), and whether it
    is mixed (a tenth of the letters or more in another language)."""
    by = _found(spark, sf_dir).filter("lang is not null").distinct().groupBy("record_kind", "record_id", "label", "lang")
    by = by.agg(F.sum("n_letters").alias("n"), F.sum(F.col("n_letters") * F.col("confidence")).alias("c"))
    out = by.groupBy("record_kind", "record_id", "label").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"), F.max("n").alias("top"), F.sum("n").alias("n_letters"), F.max_by("c", F.struct("n", "lang")).alias("c"))
    return out.select("record_kind", "record_id", "label", "lang", F.round(F.col("c") / F.col("top"), 4).alias("confidence"), (F.col("top") < 0.9 * F.col("n_letters")).alias("mixed"))


QUERIES = {"p4_found": p4_found, "p4_segments": p4_segments, "p4_records": p4_records}
