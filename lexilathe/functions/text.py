"""Text functions as column expressions (evaluated by the JVM), and the few that need Unicode tables, in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

# Character classes that a text-integrity audit counts, as patterns of both Java and RE2.
CLASSES = {
    "replacement_char": r"\x{FFFD}",
    "private_use": r"[\x{E000}-\x{F8FF}]",
    "control_char": r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]",
    "mojibake_seq": r"\x{C3}[\x{80}-\x{BF}]|\x{E2}\x{20AC}.|\x{C2}[\x{A0} ]",
    "latin_ext_b_letters": r"[\x{0180}-\x{024F}]",
    "greek_letters": r"[\x{0370}-\x{0374}\x{0376}\x{0377}\x{037A}-\x{037D}\x{037F}\x{0386}\x{0388}-\x{03F5}\x{03F7}-\x{03FF}]",
    "cyrillic_letters": r"[\x{0400}-\x{0481}\x{048A}-\x{04FF}]",
    "nbsp": r"\x{A0}",
    "soft_hyphen": r"\x{AD}",
    "hyphen_linebreak": r"[\p{L}\p{N}_]-\n[\p{L}\p{N}_]",
    "spaced_accent": r"[\x{B4}\x{2C6}\x{2DC}\x{A8}\x{B8}] ?\p{L}",
}
# The same for two classes that look around the match, which Java alone can say.
AROUND = {
    "isolated_capital": r"(?<![A-Za-z])[a-z]+ [B-HJ-Z] [a-z]+(?![A-Za-z])",
    "ligature_pattern": r"(?<![A-Za-z])[a-z]+ [WVY] [a-z]+(?![A-Za-z])",
}
SUSPICIOUS = r"[\x{0180}-\x{024F}\x{0370}-\x{03FF}\x{E000}-\x{F8FF}]"


def collapse_whitespace(t: Column) -> Column:
    """Runs of blanks as one, lines stripped, at most one blank line, one newline at the end; null stays null."""
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(F.regexp_replace(t, r"^[ \n]+", ""), r"[ \n]+$", ""), F.lit("\n"))


def slug(t: Column, most: int = 80) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as a hyphen, none at the ends, at most `most` long."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), F.lit(most))


def normal_entity(t: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(t)), r"[ \t\n]+", " ")


def looks_like_name(t: Column) -> Column:
    """Some letter, and not all of them in lower case; letters without case count as a name's."""
    return t.rlike(r"\p{L}") & ~(t.rlike(r"\p{Ll}") & ~t.rlike(r"[\p{Lu}\p{Lt}]"))


def surname(author: Column) -> Column:
    """What stands before the first comma, else the last word; the mark of an editor is dropped."""
    a = F.trim(F.regexp_replace(author, r"\(ed\.\)", ""))
    return F.when(a.contains(","), F.trim(F.substring_index(a, ",", 1))).otherwise(F.element_at(F.split(a, " +"), -1))


def year_of(ident: Column) -> Column:
    """The first 19xx or 20xx of an id that stands between hyphens or at an end, or null."""
    y = F.regexp_extract(ident, r"(?:^|-)((?:19|20)[0-9]{2})(?:-|$)", 1)
    return F.when(y != "", y.cast("int"))


def words(t: Column) -> Column:
    """The runs of characters other than white space; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(t, F.lit("")), r"[ \t\n\r]+"), lambda w: w != "")


def count_class(t: Column, name: str) -> Column:
    return F.regexp_count(F.coalesce(t, F.lit("")), F.lit(AROUND.get(name) or CLASSES[name]))


def cipher_line(line: Column) -> Column:
    """Whether a line shows a broken letter map: ten letters or more, and either a twentieth of them are of suspicious
    blocks or two words mix them with ASCII letters."""
    letters, odd = F.regexp_count(line, F.lit(r"\p{L}|[\x{E000}-\x{F8FF}]")), F.regexp_count(line, F.lit(SUSPICIOUS))
    return (letters >= 10) & ((odd >= 0.05 * letters) | (mixed_script_tokens(line) >= 2))


def soft_flags(t: Column) -> Column:
    """Marks that don't condemn a text: detached accents, unusual scripts, lone capitals, odd blanks and hyphens."""
    unusual = t.rlike(CLASSES["latin_ext_b_letters"]) | t.rlike(CLASSES["greek_letters"]) | t.rlike(CLASSES["cyrillic_letters"])
    tests = {"spaced_accent": t.rlike(CLASSES["spaced_accent"]), "unusual_script": unusual, "isolated_capital": t.rlike(AROUND["isolated_capital"]), "contains_nbsp": t.rlike(CLASSES["nbsp"]), "contains_soft_hyphen": t.rlike(CLASSES["soft_hyphen"]), "contains_hyphen_linebreak": t.rlike(CLASSES["hyphen_linebreak"])}
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))


def document_flags(counts: dict[str, Column], words: Column, cipher_lines: Column) -> tuple[Column, Column]:
    """(flags, notes) of a document from its counts: arrays in a fixed order, by the rates per thousand words."""
    rate = lambda n: counts[n] * 1000.0 / F.greatest(words, F.lit(1))
    cmap = (counts["mixed_script_tokens"] >= 10) | (cipher_lines >= 3)
    ligature = rate("ligature_pattern") >= 2.0
    hard = {"replacement_chars": counts["replacement_char"] > 0, "control_chars": counts["control_char"] > 0, "mojibake": counts["mojibake_seq"] > 0, "private_use_cipher": counts["private_use"] >= 10, "cmap_cipher": cmap, "ligature_substitution": ligature, "detached_accents": rate("spaced_accent") >= 0.5}
    other = counts["greek_letters"] + counts["cyrillic_letters"] + counts["latin_ext_b_letters"] > 0
    soft = {"spaced_capital_splits": ~ligature & (F.greatest(rate("ligature_pattern"), rate("isolated_capital")) >= 0.5), "hyphen_linebreaks_present": counts["hyphen_linebreak"] > 0, "nbsp_present": counts["nbsp"] > 0, "soft_hyphens_present": counts["soft_hyphen"] > 0, "non_latin_letters_present": other & ~cmap}
    made = lambda tests: F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))
    return made(hard), made(soft)


def fold_newlines(t: Column) -> Column:
    """Line ends with the blanks around them as one blank."""
    return F.regexp_replace(t, r"[ \t]*\n+[ \t]*", " ")


def surnames(authors: Column) -> Column:
    """The distinct surnames of a list of authors split at semicolons or "and"."""
    each = F.filter(F.split(authors, r" *; *| and "), lambda a: F.trim(a) != "")
    return F.array_distinct(F.transform(each, surname))


def title_key(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^a-z0-9 ]", ""), " +", " "))


# Cyrillic and Greek letters that look like Latin ones, and those.
LOOKALIKE, LATIN = "АВЕКМНОРСТХаеорсухіΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTXaeopcyxiABEZHIKMNOPTYXo"


def fold_lookalikes(t: Column) -> Column:
    """Letters that look like Latin ones as those; braces are dropped."""
    return F.translate(F.regexp_replace(t, r"[{}]", ""), LOOKALIKE, LATIN)


def shortened(t: Column, most: int) -> Column:
    """At most so many characters, the last an ellipsis if something was cut off."""
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.left(t, F.lit(most - 1))), F.lit("…"))).otherwise(t)


def concept_term(uri: Column, lang: str = "en") -> Column:
    """The term of a concept's path /c/<lang>/<term>/…, with blanks for underscores; null for other paths."""
    term = F.regexp_extract(uri, f"^/c/{lang}/([^/]+)", 1)
    return F.when(term != "", F.translate(term, "_", " "))


def without_bracket(t: Column) -> Column:
    """t without a bracket at its end."""
    return F.regexp_replace(t, r" *\([^()]*\) *$", "")


def rebuilt(positions: Column) -> Column:
    """The text of an inverted index (map of word to its places): words in order of their places."""
    entries = F.flatten(F.transform(F.map_entries(positions), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(entries), lambda x: x["w"]), " ")


def unfenced(t: Column) -> Column:
    """What stands between the fences of a code block, or t itself."""
    inner = F.regexp_extract(t, r"(?s)```(?:json)?[ \t]*\n?(.*?)```", 1)
    return F.regexp_replace(F.when(inner != "", inner).otherwise(t), r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def all_words_in(t: Column, stop: list[str]) -> Column:
    """Whether no word stands outside the list; true for a text without words."""
    return F.forall(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)), lambda w: w.isin(stop))


def lexicon_hit(t: Column, lexicon: list[str]) -> Column:
    """Whether a word of the lexicon occurs, between blanks, hyphens or slashes, without signs at its ends."""
    parts = F.split(F.lower(F.coalesce(t, F.lit(""))), r"[ \t\n/-]+")
    return F.exists(parts, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").isin(lexicon))


def masked(t: Column, pattern: str, mask: str = "[MASK]") -> Column:
    """t with each word that holds a match of the pattern as the mask, masks side by side as one."""
    import re

    m = re.escape(mask)
    return F.regexp_replace(F.regexp_replace(t, rf"[^ \t\n]*(?:{pattern})[^ \t\n]*", mask.replace("$", r"\$")), rf"{m}(?:[ \t\n]+{m})+", mask)


def all_caps(t: Column) -> Column:
    return (F.regexp_count(t, F.lit(r"\p{L}")) >= 2) & ~t.rlike(r"[\p{Ll}\p{Lo}\p{Lm}]")


def unbalanced(t: Column) -> Column:
    """Whether quotes or brackets don't come in pairs."""
    n = lambda p: F.regexp_count(t, F.lit(p))
    return (n('"') % 2 == 1) | (n("“") != n("”")) | (n("«") != n("»")) | (n(r"\(") != n(r"\)"))


def title_case(t: Column, small: list[str], most: int = 12) -> Column:
    """Whether all words but the small ones begin with a capital, the first too, in at most so many words."""
    bare = F.filter(F.transform(words(t), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: w != "")
    content = F.filter(bare, lambda w: ~F.lower(w).isin(small))
    capital = lambda w: w.rlike(r"^\p{Lu}")
    return (F.size(bare).between(1, most)) & (F.size(content) > 0) & F.forall(content, capital) & F.coalesce(capital(F.get(bare, F.lit(0))), F.lit(False))


def mixed_script_tokens(t: Column) -> Column:
    """How many words have ASCII letters beside letters of a suspicious block."""
    return F.size(F.filter(words(t), lambda w: w.rlike("[A-Za-z]") & w.rlike(SUSPICIOUS)))


def longest_private_run(t: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"[\x{E000}-\x{F8FF}]+"), F.lit(0)), F.length)), F.lit(0))


def hard_corruption(t: Column) -> Column:
    """The first class of certain corruption that a text shows, or null."""
    out = F.lit(None).cast("string")
    for name in ("mojibake_seq", "control_char", "private_use", "replacement_char"):
        out = F.when(t.rlike(CLASSES[name]), F.lit(f"integrity_{name}".replace("_seq", ""))).otherwise(out)
    return out


@F.pandas_udf(StringType())
def nfc(t: pd.Series) -> pd.Series:
    """Composed form; null stays null."""
    return t.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(IntegerType())
def nfc_changes(t: pd.Series) -> pd.Series:
    """Code points that composing changes: those that differ by position, and the difference in length."""

    def one(x):
        if x is None:
            return 0
        y = unicodedata.normalize("NFC", x)
        return 0 if x == y else sum(a != b for a, b in zip(x, y)) + abs(len(x) - len(y))

    return t.map(one).astype("int32")
