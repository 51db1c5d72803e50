"""Problem 1: text that went through a wrong character decoding, found and restored by noisy-channel decoding.

A channel is a pair of encodings: the text was written in one and read in the other. A garbled token is encoded back
with the encoding it was read in, which gives bytes; its lattice has, for each channel, the ways to read these bytes,
with wildcards where bytes were lost (U+FFFD). Word frequencies of the whole corpus, joined to the words of all
readings, are the language model; a Viterbi search over each line picks the reading of each token, a change of channel
inside a line costing extra.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilathe.session import table
from lexilathe.session import written as settle

# Encodings that UTF-8 or Windows-1252 text is read in by mistake, and the reverse.
MULTI = ["cp1252", "latin-1", "iso8859-15", "cp1250", "cp1251", "mac_roman", "cp437", "cp850"]
SINGLE = [("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252")]

LOST = "�"
_ACCENTS = set("´¨¸ˆ˜¯˙`^")
_WORD = re.compile(r"[^\W\d_]+|[^\w\s]|_")
#: Costs: a reading by a channel, a change of channel within a line, a word that the corpus lacks, per letter of it.
CHANNEL, CHANGE, UNSEEN, PER_LETTER = 3.0, 2.0, 6.0, 0.3


def plausible(ch: str) -> bool:
    """Characters that text in the six languages, and names in Greek or Cyrillic, are written with."""
    o = ord(ch)
    return (
        0x20 <= o < 0x7F or 0xA0 <= o <= 0x17F or 0x386 <= o <= 0x3CE or 0x400 <= o <= 0x45F
        or ch in "‐‑–—‘’‚“”„†‡•…‰‹›€™−№"
    )


def regular(word: str) -> bool:
    """Letters of one script, in lower case, upper case or with one leading capital."""
    if not (word.islower() or word.isupper() or (word[:1].isupper() and (word[1:].islower() or len(word) == 1))):
        return False
    return len({"g" if 0x370 <= ord(c) < 0x400 else "c" if 0x400 <= ord(c) < 0x530 else "l" for c in word}) == 1


def word_keys(token: str) -> list[str]:
    """What is looked up: words in lower case, and single signs."""
    return [w.lower() for w in _WORD.findall(token)]


@lru_cache(32)
def _bytes_of(encoding: str) -> dict[str, int]:
    """Byte of each character; bytes that the encoding leaves open stand for the control characters they are."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


def _as_utf8(token: str, read_in: str) -> str | None:
    """token with every sequence of characters that are the bytes of a plausible UTF-8 character replaced by it; None
    if there is none. Characters that don't belong to such a sequence stay: a token may be garbled in part."""
    table_ = _bytes_of(read_in)
    codes = [table_.get(c, -1) for c in token]
    out, i, changed, n = [], 0, False, len(token)
    while i < n:
        b = codes[i]
        size = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
        if size and i + size <= n and all(0x80 <= c <= 0xBF for c in codes[i + 1 : i + size]):
            try:
                ch = bytes(codes[i : i + size]).decode("utf-8")
            except UnicodeDecodeError:
                ch = ""
            if ch and (plausible(ch) or 0x80 <= ord(ch) < 0xA0):
                out.append(ch)
                i += size
                changed = True
                continue
        out.append(token[i])
        i += 1
    return "".join(out) if changed else None


#: A sign between letters that no right word has there.
_INSIDE = re.compile("[^\\W\\d_](?:(?!['’´¨¸ˆ˜¯˙`^\xa0\xad])[^\\w\\s\\x00-\\x7f\\ue000-\\uf8ff�‐‑–—])+[^\\W\\d_]")


def _as_single(token: str, written_in: str, read_in: str) -> str | None:
    table_ = _bytes_of(read_in)
    out, changed, telling = [], False, False
    if any(not plausible(c) and c not in table_ for c in token):
        return None  # letters of a broken font
    for c in token:
        b = table_.get(c, -1)
        if b >= 0x80:
            try:
                d = bytes([b]).decode(written_in)
            except UnicodeDecodeError:
                return None
            if d != c:
                if not plausible(d) or (c in _ACCENTS and not d.isalpha()):
                    return None
                telling |= c.isalpha() or d.isalpha()  # a sign for a sign tells nothing
                changed, c = True, d
        out.append(c)
    if not changed or not telling:
        return None
    return None if _INSIDE.search("".join(out)) and not _INSIDE.search(token) else "".join(out)


def _as_stripped(token: str) -> str | None:
    """UTF-8 read as Latin-1 from which the control characters were dropped: of a dash, a quotation mark or an ellipsis
    only its first byte is left, and so of some capitals."""
    if not any(c in "âÃÂ" for c in token):
        return None
    out = re.sub("(?<=[^\\W\\d_])â(?=[^\\W\\d_])", "’", token)
    out = re.sub("(?<=\\S)â", "”", re.sub("â(?=\\S)", "“", out)) if out != "â" else "–"
    # What begins with Â and would lose its second byte is a control character itself, so no letter follows.
    return re.sub("Â(?![^\\W\\d_])", "", out.replace("Ã", LOST))


def readings(token: str) -> list[tuple[str, str, bool]]:
    """(channel, reading, strong) of a token, the token itself first under the channel ''. strong: the reading comes
    from multi-byte sequences, which hardly arise by chance. Text that was garbled twice is read twice."""
    out = [("", token, False)]
    seen = {token}
    for enc in MULTI:
        first = _as_utf8(token, enc)
        if first is None:
            continue
        ways = [first]
        for _ in range(2):  # garbled again
            again = next((x for e in MULTI if (x := _as_utf8(ways[-1], e)) is not None), None)
            if again is None:
                break
            ways.append(again)
        for r in reversed(ways):
            if r not in seen and all(plausible(c) or ord(c) > 0x2FFF for c in r if c not in token):
                seen.add(r)
                out.append((f"utf-8>{enc}", r, True))
    stripped = _as_stripped(token)
    if stripped is not None and stripped not in seen:
        seen.add(stripped)
        out.append(("utf-8>latin-1, controls dropped", stripped, False))
    for written, read in SINGLE:
        r = _as_single(token, written, read)
        if r is not None and r not in seen:
            seen.add(r)
            out.append((f"{written}>{read}", r, False))
    return out


def _odd(text: str) -> int:
    """Words that no right text has: wrongly cased, or with a sign inside."""
    return sum(w.isalpha() and not regular(w) and not w.isascii() for w in re.findall(r"[^\W\d_]+", text)) + len(_INSIDE.findall(text))


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, n) over all texts: words in lower case, those of irregular case as they are, and single signs. Null texts
    have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            counts: Counter = Counter()
            words: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    words.update(_WORD.findall(text))
            for w, n in words.items():
                counts[w.lower() if regular(w) else w] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["key", "n"])

    return texts.select(text_col).mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


LINE = ["document_id", "page_number", "line_index_in_page"]


def restore_lines(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """(key columns, line_text, found, lossy, restored, channels array<string>) of lines (key columns, line_text).

    Rows repeated with the same key and text are one. found: some token's best reading isn't the token itself, or
    bytes were lost. restored holds the best readings; a lost byte whose word no corpus word fits stays U+FFFD (lossy).
    Null and empty lines are not found. Lines of any length are read whole."""
    lines = lines.select(*LINE, "line_text").dropDuplicates()
    suspect = settle(lines.filter(F.col("line_text").rlike("[^\\x00-\\x7f]")).withColumn("line", F.xxhash64(*LINE, "line_text")))

    def lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for line, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at, token in enumerate(text.split(" ")):
                    if token.isascii():
                        continue
                    for channel, reading, strong in readings(token):
                        keys = [k.replace(LOST, "") if set(k) == {LOST} else k for k in word_keys_lossy(reading)]
                        rows.append((line, at, token, channel, reading, strong, [k for k in keys if k]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string())])],
                ["line", "at", "token", "channel", "reading", "strong", "keys"],
            )

    nodes = settle(suspect.select("line", "line_text").mapInArrow(lattice, "line long, at int, token string, channel string, reading string, strong boolean, keys array<string>"))
    wanted = nodes.select(F.explode("keys").alias("key")).distinct()
    plain = wanted.filter(~F.col("key").contains(LOST)).join(counts, "key").select("key", "n", F.col("key").alias("word"))
    # A word with lost bytes is looked up by what is left of it: corpus words with one letter, or two beyond ASCII (or all
    # of those), left out have the same rest, and must fit with a letter or two for each run of lost bytes.
    run = F.regexp_replace(F.regexp_replace(F.regexp_replace("key", f"{LOST}{{3,}}", ".{1,3}"), f"{LOST}{{2}}", ".{1,2}"), LOST, ".")
    asked = wanted.filter(F.col("key").contains(LOST)).select("key", F.regexp_replace("key", LOST, "").alias("rest"), F.concat(F.lit("^"), run, F.lit("$")).alias("fits"))
    vocabulary = counts.filter((F.col("key") == F.lower("key")) & ~F.col("key").contains(LOST) & F.col("key").rlike("^.*\\p{L}.*$")).select("key", "n").mapInArrow(_rests, "word string, n long, rest string")
    lossy = asked.join(vocabulary, "rest").filter("rlike(word, fits)").groupBy("key").agg(F.max("n").alias("n"), F.max_by("word", F.struct("n", "word")).alias("word"))
    known = plain.unionByName(lossy)
    scored = (
        nodes.withColumn("key", F.explode_outer("keys"))
        .join(known, "key", "left")
        .groupBy("line", "at", "token", "channel", "reading", "strong")
        .agg(F.collect_list(F.struct("key", "n", "word")).alias("words"))
        .groupBy("line").agg(F.collect_list(F.struct("at", "token", "channel", "reading", "strong", "words")).alias("nodes"))
    )

    all_words = float(counts.agg(F.sum("n")).first()[0] or 1) + 1.0

    def viterbi(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(a, *_decode(b, all_words)) for a, b in zip(pdf["line"], pdf["nodes"])], columns=["line", "changes", "channels"])

    best = scored.mapInPandas(viterbi, "line long, changes map<int, string>, channels array<string>")
    joined = lines.withColumn("line", F.xxhash64(*LINE, "line_text")).join(best, "line", "left")
    tokens = F.split("line_text", " ", -1)
    restored = F.array_join(F.transform(tokens, lambda t, i: F.coalesce(F.element_at("changes", i), t)), " ")
    lost = F.coalesce(F.col("line_text").contains(LOST), F.lit(False))
    return joined.select(
        *LINE, "line_text", (lost | F.coalesce(F.size("channels") > 0, F.lit(False))).alias("found"),
        F.coalesce(restored.contains(LOST), F.lit(False)).alias("lossy"), F.coalesce(restored, "line_text").alias("restored"), F.coalesce("channels", F.array().cast("array<string>")).alias("channels"),
    )


def word_keys_lossy(token: str) -> list[str]:
    """word_keys() with a lost byte taken for a letter."""
    if LOST not in token:
        return word_keys(token)
    out = []
    for w in re.findall(r"(?:[^\W\d_]|�)+|[^\w\s]|_", token):
        out.append(w.lower())
    return out


def _cost(x, all_words: float) -> float:
    """Negative log likelihood of a reading: its words' share of the corpus, and what its channel costs."""
    total, known = 0.0, True
    for w in x["words"]:
        key, n = w["key"], w["n"]
        if key is None:
            continue
        if not key[0].isalpha() and key[0] != LOST:
            sign = -math.log(max(n or 0, 0.5) / all_words)
            total += min(sign, 7.5) if key in "“”‘’«»„‚–—…" else sign
        elif n:
            total -= math.log(n / all_words)
            known &= n >= 5
        else:
            total += UNSEEN - math.log(0.5 / all_words) + PER_LETTER * len(key)
            known = False
    total += 10.0 * _odd(x["reading"])
    if x["channel"]:
        total += CHANNEL
        if x["strong"]:
            total -= 12.0
        elif any(c in _ACCENTS for c in x["token"]) and not known:
            total += 30.0  # an accent beside its letter is no wrong decoding
    return total


def _decode(nodes: list, all_words: float) -> tuple[dict[int, str], list[str]]:
    """Viterbi over the tokens of a line; the state is the channel last used."""
    by: dict[int, list] = {}
    for x in nodes:
        by.setdefault(x["at"], []).append(x)
    paths: dict[str, tuple[float, list]] = {"": (0.0, [])}
    for at in sorted(by):
        new: dict[str, tuple[float, list]] = {}
        for x in sorted(by[at], key=lambda x: (x["channel"], x["reading"])):
            cost = _cost(x, all_words)
            for state, (sum_, path) in paths.items():
                step = cost + (CHANGE if x["channel"] and state and state != x["channel"] else 0) - (2.0 if x["channel"] and state == x["channel"] else 0)
                to = x["channel"] or state
                if to not in new or sum_ + step < new[to][0]:
                    new[to] = (sum_ + step, [*path, (at, x)])
        paths = new
    _, path = min(paths.values(), key=lambda p: p[0])
    changes, channels = {}, set()
    for at, x in path:
        reading = x["reading"]
        for w in x["words"]:
            if w["key"] and LOST in w["key"] and w["word"]:
                reading = _fill(reading, w["key"], w["word"])
        if x["channel"]:
            channels.add(x["channel"])
        if reading != x["token"]:
            changes[at] = reading
            if LOST in x["token"]:
                channels.add("lost")
    return changes, sorted(channels)


def rests(word: str) -> set[str]:
    """What is left of a word that lost a letter, two letters beyond ASCII, or all of those."""
    beyond = [i for i, c in enumerate(word) if not c.isascii()]
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + word[i + 1 : j] + word[j + 1 :] for k, i in enumerate(beyond) for j in beyond[k + 1 :]}
    out.add("".join(c for c in word if c.isascii()))
    return out - {word}


def _rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(w, n, r) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in rests(w)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.string(), pa.int64(), pa.string()])], ["word", "n", "rest"])


def _fill(reading: str, key: str, word: str) -> str:
    """reading with the lost letters of key taken from word, in the case of the letters around."""
    at = reading.lower().find(key.lower())
    if at < 0:
        return reading
    old = reading[at : at + len(key)]
    parts = re.split(f"({LOST}+)", old)
    m = re.fullmatch("".join(f"(.{{1,{len(p)}}})" if LOST in p else re.escape(p.lower()) for p in parts), word)
    if not m:
        return reading
    found = iter(m.groups())
    upper = old.isupper() and len(old) > 2
    new = "".join((next(found).upper() if upper else next(found)) if LOST in p else p for p in parts)
    return reading[:at] + new + reading[at + len(key) :]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all tables that hold texts of the corpus, as (text); originals, not translations."""
    one = lambda name, column="text": table(spark, sf_dir, name).select(F.col(column).alias("text"))
    names = ("chunk", "documents", "transcript_unit", "interview_database")
    every = one("page_record")
    for name in names:
        every = every.union(one(name))
    return every.filter("text is not null")


def _restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore_lines(table(spark, sf_dir, "integrity_regions"), settle(word_counts(corpus(spark, sf_dir))))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _restored(spark, sf_dir).filter("found").select(*LINE).distinct()


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of integrity_regions with its mark and, where possible, the original text."""
    return _restored(spark, sf_dir)


QUERIES = {"p1_found": p1_found, "p1_restored": p1_restored}
