"""Queries over texts and records: audits, spans, turns and segments, names, keyed joins, edges, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexilathe.functions import text as X
from lexilathe.operators import chunking as C
from lexilathe.operators import graph as E
from lexilathe.operators import matching as M
from lexilathe.operators import spans as P
from lexilathe.operators import statistics as T
from lexilathe.plans.text_queries import _MIXED, _PAGES, _PARTS, _TALKS, _WORDS, _talks, pages
from lexilathe.session import table, written

SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- audits of texts ---------------------------------------------------------------------------------------------------

#: In SQL, which can't look around a match: each sign but a letter doubled, so that neighbours never share one.
_DOUBLED = "regexp_replace(' ' || coalesce({t}, '') || ' ', '([^A-Za-z])', '\\1\\1', 'g')"
_LONE = "len(regexp_extract_all(" + _DOUBLED + ", '[^A-Za-z][a-z]+  {c}  [a-z]+[^A-Za-z]'))"
_COUNTS = {n: f"len(regexp_extract_all(coalesce(text, ''), '{p}'))" for n, p in X.CLASSES.items()} | {"isolated_capital": _LONE.format(t="text", c="[B-HJ-Z]"), "ligature_pattern": _LONE.format(t="text", c="[WVY]"), "mixed_script_tokens": _MIXED}
_SUMS = ", ".join(f"cast(sum({c}) as bigint) as {n}" for n, c in _COUNTS.items())
_CIPHERS = "(select document_id, cast(sum((letters >= 10 and (odd >= 0.05 * letters or mixed >= 2))::int) as bigint) as cipher_lines from (select document_id, len(regexp_extract_all(line, '\\p{L}|[\\x{E000}-\\x{F8FF}]')) as letters, len(regexp_extract_all(line, '" + X.SUSPICIOUS + "')) as odd, " + _MIXED.replace("text", "line") + " as mixed from (select document_id, unnest(string_split(text, chr(10))) as line from p)) group by document_id)"
_AUDIT = _PAGES + ", a as (select document_id, count(*) as pages, cast(sum((coalesce(trim(text), '') = '')::int) as bigint) as empty_pages, cast(coalesce(sum(length(text)), 0) as bigint) as chars, cast(sum(" + _WORDS.format(t="text") + ") as bigint) as words, " + _SUMS + ", max(coalesce(list_max(list_transform(regexp_extract_all(coalesce(text, ''), '[\\x{E000}-\\x{F8FF}]+'), lambda r: length(r))), 0))::bigint as private_use_max_run from p group by document_id), b as (select a.*, coalesce(c.cipher_lines, 0) as cipher_lines from a left join " + _CIPHERS + " c using (document_id))"


def _audit(spark, d) -> DataFrame:
    p, t = pages(spark, d), F.col("text")
    lines = p.select("document_id", F.explode(F.split("text", "\n")).alias("line")).filter(X.cipher_line(F.col("line"))).groupBy("document_id").agg(F.count("*").alias("cipher_lines"))
    names = [*X.CLASSES, *X.AROUND]
    counts = p.groupBy("document_id").agg(
        F.count("*").alias("pages"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("empty_pages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.sum(F.size(X.words(t))).alias("words"),
        *[F.sum(X.count_class(t, n)).alias(n) for n in names], F.sum(X.mixed_script_tokens(t)).alias("mixed_script_tokens"), F.max(X.longest_private_run(t)).cast("long").alias("private_use_max_run"),
    )
    return counts.join(lines, "document_id", "left").na.fill(0, ["cipher_lines"])


@query(_AUDIT + " select * from b")
def integrity_counts(spark, d):
    """All fifteen character classes summed by document (the longest run as a maximum), with sizes and cipher lines."""
    return _audit(spark, d)


_RATE = "({n} * 1000.0::double / greatest(words, 1))"
_CMAP = "(mixed_script_tokens >= 10 or cipher_lines >= 3)"


def _listed(tests: list[tuple[str, str]]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"case when {c} then '{n}' end" for n, c in tests) + "], lambda x: x is not null), ';')"


_HARD_TESTS = [("replacement_chars", "replacement_char > 0"), ("control_chars", "control_char > 0"), ("mojibake", "mojibake_seq > 0"), ("private_use_cipher", "private_use >= 10"), ("cmap_cipher", _CMAP), ("ligature_substitution", _RATE.format(n="ligature_pattern") + " >= 2"), ("detached_accents", _RATE.format(n="spaced_accent") + " >= 0.5")]
_NOTE_TESTS = [("spaced_capital_splits", _RATE.format(n="ligature_pattern") + " < 2 and " + _RATE.format(n="greatest(ligature_pattern, isolated_capital)") + " >= 0.5"), ("hyphen_linebreaks_present", "hyphen_linebreak > 0"), ("nbsp_present", "nbsp > 0"), ("soft_hyphens_present", "soft_hyphen > 0"), ("non_latin_letters_present", "greek_letters + cyrillic_letters + latin_ext_b_letters > 0 and not " + _CMAP)]


@query(_AUDIT + f" select document_id, words, {_listed(_HARD_TESTS)} as flags, {_listed(_NOTE_TESTS)} as notes, round({_RATE.format(n='isolated_capital')}, 3) as isolated_capital_per_1k_words, round({_RATE.format(n='ligature_pattern')}, 3) as ligature_pattern_per_1k_words, round({_RATE.format(n='spaced_accent')}, 3) as spaced_accent_per_1k_words, round({_RATE.format(n='mixed_script_tokens')}, 3) as mixed_script_tokens_per_1k_words from b")
def integrity_flags(spark, d):
    """The flags and notes of each document, and four rates per thousand words."""
    a = _audit(spark, d)
    flags, notes = X.document_flags({c: F.col(c) for c in a.columns}, F.col("words"), F.col("cipher_lines"))
    rates = [F.round(F.col(n) * 1000.0 / F.greatest("words", F.lit(1)), 3).alias(f"{n}_per_1k_words") for n in ("isolated_capital", "ligature_pattern", "spaced_accent", "mixed_script_tokens")]
    return a.select("document_id", "words", F.array_join(flags, ";").alias("flags"), F.array_join(notes, ";").alias("notes"), *rates)


_HAS = {n: f"regexp_matches(text, '{p}')" for n, p in X.CLASSES.items()}
_SOFT_TESTS = [("spaced_accent", _HAS["spaced_accent"]), ("unusual_script", f"({_HAS['latin_ext_b_letters']} or {_HAS['greek_letters']} or {_HAS['cyrillic_letters']})"), ("isolated_capital", _LONE.format(t="text", c="[B-HJ-Z]") + " > 0"), ("contains_nbsp", _HAS["nbsp"]), ("contains_soft_hyphen", _HAS["soft_hyphen"]), ("contains_hyphen_linebreak", _HAS["hyphen_linebreak"])]


@query(_PAGES + f" select flags, count(*) as n from (select {_listed(_SOFT_TESTS)} as flags from p where text is not null) group by flags")
def soft_flags(spark, d):
    """Pages by the marks that their texts show."""
    return pages(spark, d).filter("text is not null").groupBy(F.array_join(X.soft_flags(F.col("text")), ";").alias("flags")).agg(F.count("*").alias("n"))


@query("""with x as (select doc_id, string_split(text, '') as a, string_split(nfc_normalize(text), '') as b, text, nfc_normalize(text) as n from documents where text is not null and nfc_normalize(text) <> text) select doc_id, cast(length(text) - length(n) as bigint) as shorter from x""")
def nfc_lengths(spark, d):
    """By how much composing shortens the texts that it changes."""
    t = table(spark, d, "documents").filter("text is not null")
    n = t.select("doc_id", F.col("text"), X.nfc("text").alias("n")).filter("text <> n")
    return n.select("doc_id", (F.length("text") - F.length("n")).cast("long").alias("shorter"))


@query(_PAGES + f", h as (select document_id, page_number, {' + '.join(_COUNTS[n] for n in ('replacement_char', 'private_use', 'control_char', 'mojibake_seq', 'spaced_accent'))} as hits, {_WORDS.format(t='text')} as words from p) select document_id, page_number, round(100.0::double * hits / greatest(words, 1), 3) as score from h")
def integrity_scores(spark, d):
    """Hits of the certain and detached classes per hundred words of each page."""
    t = F.col("text")
    hits = sum((X.count_class(t, n) for n in ("replacement_char", "private_use", "control_char", "mojibake_seq", "spaced_accent")), F.lit(0))
    return pages(spark, d).select("document_id", "page_number", F.round(100.0 * hits / F.greatest(F.size(X.words(t)), F.lit(1)), 3).alias("score"))


@query("select document_id, chunk_index, md5(f) as digest, f <> text as changed from (select distinct document_id, chunk_index, text, regexp_replace(text, '[ \\t]*\\n+[ \\t]*', ' ', 'g') as f from chunk where text is not null)")
def folded_chunks(spark, d):
    """Chunks on one line, with a mark where that changed them."""
    c = table(spark, d, "chunk").filter("text is not null").select("document_id", "chunk_index", "text").distinct()
    return c.select("document_id", "chunk_index", F.md5(X.fold_newlines(F.col("text"))).alias("digest"), (X.fold_newlines(F.col("text")) != F.col("text")).alias("changed"))


@query("select document_id, page_number, all_caps, unbalanced, count(*) as n from (select document_id, page_number, len(regexp_extract_all(line, '\\p{L}')) >= 2 and not regexp_matches(line, '[\\p{Ll}\\p{Lo}\\p{Lm}]') as all_caps, len(regexp_extract_all(line, '\"')) % 2 = 1 or len(regexp_extract_all(line, '“')) <> len(regexp_extract_all(line, '”')) or len(regexp_extract_all(line, '«')) <> len(regexp_extract_all(line, '»')) or len(regexp_extract_all(line, '\\(')) <> len(regexp_extract_all(line, '\\)')) as unbalanced from (select document_id, page_number, unnest(string_split(text, chr(10))) as line from (select distinct document_id, page_number, text from page_record))) where all_caps or unbalanced group by all")
def line_shapes(spark, d):
    """Lines in capitals, and lines whose quotes or brackets don't come in pairs."""
    l = pages(spark, d).select("document_id", "page_number", F.explode(F.split("text", "\n")).alias("line"))  # noqa: E741
    return l.select("document_id", "page_number", X.all_caps(F.col("line")).alias("all_caps"), X.unbalanced(F.col("line")).alias("unbalanced")).filter("all_caps or unbalanced").groupBy("document_id", "page_number", "all_caps", "unbalanced").agg(F.count("*").alias("n"))


# Small words that a title may leave without a capital.
SMALL = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with"]
_BARE = "list_filter(list_transform(list_filter(regexp_split_to_array(label, '[ \\t\\n\\r]+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')), lambda w: w <> '')"


@query(f"with l as (select distinct label, {_BARE} as b from shared_space where label is not null), c as (select *, list_filter(b, lambda w: not list_contains({SMALL!r}, lower(w))) as k from l) select label, len(b) between 1 and 12 and len(k) > 0 and len(list_filter(k, lambda w: not regexp_matches(w, '^\\p{{Lu}}'))) = 0 and coalesce(regexp_matches(b[1], '^\\p{{Lu}}'), false) as titled, len(list_filter(regexp_split_to_array(lower(label), '[ \\t\\n/-]+'), lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') in ('doctrine', 'oath', 'prophecy', 'movement'))) > 0 as hit, len(list_filter(regexp_extract_all(lower(label), '\\p{{L}}+'), lambda w: not list_contains({[*SMALL, 'that', 'this']!r}, w))) = 0 as filler from c")
def label_shapes(spark, d):
    """Labels written as titles, those with a word of a lexicon, and those with none but small words."""
    l = table(spark, d, "shared_space").filter("label is not null").select("label").distinct()  # noqa: E741
    t = F.col("label")
    return l.select("label", X.title_case(t, SMALL).alias("titled"), X.lexicon_hit(t, ["doctrine", "oath", "prophecy", "movement"]).alias("hit"), X.all_words_in(t, [*SMALL, "that", "this"]).alias("filler"))


# --- spans, turns and segments -----------------------------------------------------------------------------------------


@query("with c as (select distinct document_id, chunk_index, text from chunk where text is not null), l as (select document_id, chunk_index, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from c) select document_id, chunk_index, no - 1 as line_no, cast(coalesce(sum(length(line) + 1) over (partition by document_id, chunk_index order by no rows between unbounded preceding and 1 preceding), 0) as bigint) as s, cast(length(line) + coalesce(sum(length(line) + 1) over (partition by document_id, chunk_index order by no rows between unbounded preceding and 1 preceding), 0) as bigint) as e from l")
def line_spans(spark, d):
    """The offsets of each line of each chunk."""
    c = table(spark, d, "chunk").filter("text is not null").select("document_id", "chunk_index", "text").distinct()
    r = c.select("document_id", "chunk_index", F.posexplode(P.line_spans(F.col("text"))).alias("line_no", "x"))
    return r.select("document_id", "chunk_index", F.col("line_no").cast("long").alias("line_no"), F.col("x.s").cast("long").alias("s"), F.col("x.e").cast("long").alias("e"))


_WORDLIST = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '')"


@query(f"with c as (select distinct document_id, chunk_index, text, array_to_string({_WORDLIST}[4:12], ' ') as q from chunk where text is not null), f as (select *, instr(text, q) as pos, regexp_extract(text, array_to_string(list_transform(string_split(q, ' '), lambda w: regexp_escape(w)), '[ \\t\\n\\r]+')) as loose from c where q <> '') select document_id, chunk_index, case when pos > 0 then pos - 1 else instr(text, loose) - 1 end as s, case when pos > 0 then pos - 1 + length(q) else instr(text, loose) - 1 + length(loose) end as e, pos = 0 as folded from f where pos > 0 or loose <> ''")
def resolved_quotes(spark, d):
    """Where a quotation (here the fourth to twelfth word of each chunk) stands, also over line ends."""
    c = table(spark, d, "chunk").filter("text is not null").select("document_id", "chunk_index", "text").distinct()
    q = c.withColumn("q", F.array_join(F.slice(X.words(F.col("text")), 4, 9), " ")).withColumn("r", P.resolve(F.col("text"), F.col("q"))).filter("r is not null")
    return q.select("document_id", "chunk_index", F.col("r.s").cast("long").alias("s"), F.col("r.e").cast("long").alias("e"), (F.instr("text", F.col("q")) == 0).alias("folded"))


@query(_PAGES + """, l as (select document_id, page_number, generate_subscripts(string_split(text, chr(10)), 1) - 1 as no, unnest(string_split(text, chr(10))) as line from p),
o as (select *, coalesce(sum(length(line) + 1) over (partition by document_id, page_number order by no rows between unbounded preceding and 1 preceding), 0) as s from l), r as (select distinct o.document_id, o.page_number, s, s + length(line) as e from o join integrity_regions g on g.document_id = o.document_id and g.page_number = o.page_number and g.line_index_in_page = o.no),
w as (select document_id, page_number, least(100, length(text)) as a, least(400, length(text)) as b from p where text is not null) select document_id, page_number, exists (select 1 from r where r.document_id = w.document_id and r.page_number = w.page_number and w.a < r.e and w.b > r.s) as touches from w""")
def spans_in_regions(spark, d):
    """Whether a span of each page (its 100th to 400th character) meets a suspect line."""
    p = pages(spark, d).filter("text is not null")
    l = p.select("document_id", "page_number", F.posexplode(P.line_spans(F.col("text"))).alias("line_index_in_page", "x"))  # noqa: E741
    g = table(spark, d, "integrity_regions").select("document_id", "page_number", "line_index_in_page").distinct()
    regions = l.join(g, ["document_id", "page_number", "line_index_in_page"]).groupBy("document_id", "page_number").agg(F.collect_list("x").alias("regions"))
    n = F.length("text")
    return p.join(regions, ["document_id", "page_number"], "left").select("document_id", "page_number", P.overlaps(F.least(F.lit(100), n), F.least(F.lit(400), n), F.col("regions")).alias("touches"))


@query()
def spans_without_overlap(spark, d):
    """Of spans of events by user, the longest first, those that meet none taken before (a fold; tested by a loop)."""
    e = table(spark, d, "events").filter("user_id is not null and value is not null").select("user_id", "event_id", (F.col("event_id") % 1000).cast("int").alias("s"), F.floor(F.abs("value") % 40 + 1).cast("int").alias("n"))
    spans = e.groupBy("user_id").agg(F.collect_list(F.struct((-F.col("n")).alias("rank"), "event_id", "s", (F.col("s") + F.col("n")).alias("e"))).alias("spans"))
    return spans.select("user_id", F.explode(P.without_overlap(F.col("spans"))).alias("x")).select("user_id", "x.event_id", "x.s", "x.e")


_TURNS = _TALKS + r""", m as (select id, string_split(regexp_replace(text, '(?i)(?:^|\n)[ \t]*(interviewer|interviewee|participant|interview notes)[ \t]*:', chr(1) || '\1' || chr(2), 'g'), chr(1)) as parts from i where text is not null),
t as (select id, generate_subscripts(parts, 1) as no, unnest(parts) as part from m), u as (select id, no, lower(string_split(part, chr(2))[1]) as label, trim(regexp_replace(regexp_replace(list_last(string_split(part, chr(2))), '[ \t\n]*-{2,}[ \t\n]*$', ''), '^[ \t\n]+|[ \t\n]+$', '', 'g')) as content from t where no > 1),
f as (select id, min(no) as first_no from u where label = 'interviewer' group by id), s as (select id, row_number() over (partition by id order by no) - 1 as turn_no, case when label = 'interviewer' then 'interviewer' else 'participant' end as role, content from u join f using (id) where no >= first_no and label <> 'interview notes' and content <> '')"""


@query(_TURNS + " select id, turn_no, role, md5(content) as digest from s")
def interview_turns(spark, d):
    """The turns of labelled transcripts; header and notes are no speech."""
    return P.turns(_talks(spark, d).filter("text is not null"), ["id"], "text").select("id", F.col("turn_no").cast("long").alias("turn_no"), "role", F.md5("content").alias("digest"))


@query(_TURNS + f" select id, count(*) as turns, count_if(role = 'interviewer') as questions, count_if(role = 'participant') as answers, cast(sum({_WORDS.format(t='content')}) as bigint) as words, coalesce(count_if(role = 'interviewer') = max(i.n_questions), false) as agrees from s join i using (id) group by id")
def dialogue_counts(spark, d):
    """Turns and words of the dialogue alone, beside what the metadata says."""
    t = P.turns(_talks(spark, d).filter("text is not null"), ["id"], "text")
    c = t.groupBy("id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "interviewer").alias("questions"), F.count_if(F.col("role") == "participant").alias("answers"), F.sum(F.size(X.words(F.col("content")))).alias("words"))
    return c.join(_talks(spark, d).select("id", "n_questions"), "id").withColumn("agrees", F.coalesce(F.col("questions") == F.col("n_questions"), F.lit(False))).drop("n_questions")


@query(_TURNS + f""", n as (select id, turn_no, role, {_WORDS.format(t='content')} as n from s), r as (select *, coalesce(sum(n) over (partition by id order by turn_no rows between unbounded preceding and 1 preceding), 0) as before, sum(n) over (partition by id) as total from n),
c as (select id, max(total) as total, arg_min(turn_no, struct_pack(a := abs(before - total / 2.0::double), b := turn_no)) filter (where role = 'interviewer' and before > 0) as cut from r group by id)
select r.id, case when c.total > 120 and c.cut is not null and turn_no >= c.cut then 1 else 0 end as unit_no, min(turn_no) as first_turn, count(*) as turns, cast(sum(n) as bigint) as words from r join c using (id) group by 1, 2""")
def transcript_units(spark, d):
    """A transcript of at most 120 words as one unit, a longer one as two, cut before the interviewer's turn nearest to
    the middle; without such a turn it stays one unit."""
    t = P.turns(_talks(spark, d).filter("text is not null"), ["id"], "text").withColumn("n", F.size(X.words(F.col("content"))))
    return _units(t, 120)


def _units(turns: DataFrame, most: int) -> DataFrame:
    cut = C.nearest_midpoint(turns, ["id"], "turn_no", "n", F.col("role") == "interviewer")
    late = (F.col("total") > most) & F.col("cut").isNotNull() & (F.col("turn_no") >= F.col("cut"))
    u = turns.join(cut, "id").withColumn("unit_no", F.when(late, 1).otherwise(0))
    return u.groupBy("id", "unit_no").agg(F.min("turn_no").cast("long").alias("first_turn"), F.count("*").alias("turns"), F.sum("n").alias("words"))


@query(_TURNS + r", x as (select id, turn_no, role, unnest(list_filter(regexp_split_to_array(regexp_replace(content, '([.!?])[ \t\n]+', '\1' || chr(10), 'g'), '\n+'), lambda q: regexp_matches(q, '[^ \t\n]'))) as q from s) select id, turn_no, role, count(*) as sentences from x group by all")
def turn_sentences(spark, d):
    """The sentences of each turn."""
    t = P.turns(_talks(spark, d).filter("text is not null"), ["id"], "text")
    n = F.size(F.filter(F.split("content", r"(?<=[.!?])[ \t\n]+|\n+"), lambda x: x.rlike(r"[^ \t\n]")))
    return t.select("id", F.col("turn_no").cast("long").alias("turn_no"), "role", n.cast("long").alias("sentences")).filter("sentences > 0")


_UNIT = "with t as (select distinct on (document_id, chunk_index) document_id, chunk_index, text, turn_roles from transcript_unit where text is not null order by document_id, chunk_index, written_at)"


def _transcripts(spark, d) -> DataFrame:
    t = table(spark, d, "transcript_unit").filter("text is not null")
    return M.first_of(t, ["document_id", "chunk_index"], [F.col("written_at")]).select("document_id", "chunk_index", "text", "turn_roles")


@query(_UNIT + f", b as (select document_id, chunk_index, unnest({_PARTS}) as p, generate_subscripts({_PARTS}, 1) as no, turn_roles from t where turn_roles is not null) select document_id, chunk_index, no - 1 as segment_no, turn_roles[no] as role, md5(p) as digest from b where no <= len(turn_roles)")
def roles_by_position(spark, d):
    """Blocks of transcripts with the role at the same place; what has no counterpart is left out."""
    t = _transcripts(spark, d).filter("turn_roles is not null").withColumn("parts", F.filter(F.split("text", r"\n[ \t]*\n"), lambda p: p.rlike(r"[^ \t\n]")))
    n = F.least(F.size("parts"), F.size("turn_roles"))
    z = t.filter(n > 0).select("document_id", "chunk_index", F.posexplode(F.arrays_zip(F.slice("parts", F.lit(1), n).alias("p"), F.slice("turn_roles", F.lit(1), n).alias("role"))).alias("segment_no", "x"))
    return z.select("document_id", "chunk_index", F.col("segment_no").cast("long").alias("segment_no"), F.col("x.role").alias("role"), F.md5("x.p").alias("digest"))


_LABELS = ", s as (select document_id, chunk_index, generate_subscripts({p}, 1) - 1 as no from t), l as (select document_id, chunk_index, generate_subscripts(turn_roles, 1) - 1 as no, unnest(turn_roles) as role from t where turn_roles is not null)".format(p=_PARTS)


@query(_UNIT + _LABELS + " select s.document_id, s.chunk_index, cast(count(*) as bigint) as segments, count(l.no) as labelled, count(*) - count(l.no) as unlabelled, (select count(*) from l x where x.document_id = s.document_id and x.chunk_index = s.chunk_index and x.no not in (select no from s y where y.document_id = s.document_id and y.chunk_index = s.chunk_index)) as out_of_range from s left join l using (document_id, chunk_index, no) group by s.document_id, s.chunk_index")
def segment_labels(spark, d):
    """Segments with their labels by number: every segment stays, the first of several labels counts, and labels for
    segments that there aren't are issues."""
    t = _transcripts(spark, d)
    parts = F.filter(F.split("text", r"\n[ \t]*\n"), lambda p: p.rlike(r"[^ \t\n]"))
    keys = ["document_id", "chunk_index"]
    s = t.select(*keys, F.posexplode(parts).alias("no", "p")).select(*keys, "no")
    l = M.first_of(t.filter("turn_roles is not null").select(*keys, F.posexplode("turn_roles").alias("no", "role")), [*keys, "no"], [F.col("role")])  # noqa: E741
    out = l.join(s, [*keys, "no"], "left_anti").groupBy(*keys).agg(F.count("*").alias("out_of_range"))
    j = s.join(l.withColumn("has", F.lit(1)), [*keys, "no"], "left").groupBy(*keys).agg(F.count("*").alias("segments"), F.count("has").alias("labelled"))
    return j.join(out, keys, "left").na.fill(0, ["out_of_range"]).withColumn("unlabelled", F.col("segments") - F.col("labelled"))


# --- names, strings and payloads ---------------------------------------------------------------------------------------


@query("""with a as (select n_nationkey as k, n_name as n, r_name as r from nation join region on r_regionkey = n_regionkey) select k, array_to_string(list_sort(list_distinct([replace(n, '_', ' '), replace(r, '_', ' ')])), ';') as surnames from a""")
def author_surnames(spark, d):
    """Surnames of lists of authors: before the first comma, else the last word, without the editor's mark."""
    a = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    authors = F.concat(F.col("n_name"), F.lit(", A. B.; Jane van "), F.regexp_replace("r_name", " ", "_"), F.lit(" (ed.) and "), F.col("n_name"), F.lit(", C."))
    names = F.transform(X.surnames(authors), lambda s: F.translate(s, "_", " "))
    return a.select(F.col("n_nationkey").alias("k"), F.array_join(F.array_sort(F.array_distinct(names)), ";").alias("surnames"))


@query("""select p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) as title_key, case when length(p_name) > 12 then rtrim(left(p_name, 11)) || '…' else p_name end as shortened, p_name as bare, replace(p_name, ' ', ' ') as term, 'Ape' as folded from part""")
def string_forms(spark, d):
    """Keys of titles, shortened names, names without a bracket at the end, terms of concept paths, look-alikes."""
    t = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", X.title_key(t).alias("title_key"), X.shortened(t, 12).alias("shortened"), X.without_bracket(F.concat(t, F.lit(" (old form)"))).alias("bare"), X.concept_term(F.concat(F.lit("/c/en/"), F.translate(t, " ", "_"), F.lit("/n/x"))).alias("term"), X.fold_lookalikes(F.lit("{А}ре")).alias("folded"))


@query(f"select distinct document_id, chunk_index, md5(array_to_string({_WORDLIST}, ' ')) as digest from chunk where text is not null and regexp_matches(text, '[^ \\t\\n\\r]')")
def rebuilt_texts(spark, d):
    """Texts rebuilt from inverted indexes of their words' places."""
    c = table(spark, d, "chunk").filter("text is not null").select("document_id", "chunk_index", "text").distinct()
    w = c.select("document_id", "chunk_index", F.posexplode(X.words(F.col("text"))).alias("p", "w"))
    index = w.groupBy("document_id", "chunk_index", "w").agg(F.collect_list("p").alias("at")).groupBy("document_id", "chunk_index").agg(F.map_from_entries(F.collect_list(F.struct("w", "at"))).alias("places"))
    return index.select("document_id", "chunk_index", F.md5(X.rebuilt(F.col("places"))).alias("digest"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, props is not null and json_valid(props) and json_extract(props, '$.k') is not null as valid from events")
def json_payloads(spark, d):
    """Numbers from fenced JSON, with a mark for what can't be read."""
    t = X.unfenced(F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```")))
    r = F.from_json(t, "k bigint")
    return table(spark, d, "events").select("event_id", r["k"].alias("k"), F.coalesce(r["k"].isNotNull(), F.lit(False)).alias("valid"))


@query("select doc_id, sha256(text) as digest from documents where text is not null")
def text_digests(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))


_NAMES = "(select distinct nearest_entity as entity, lower(nearest_entity) as alias from cluster_summary where nearest_entity is not null)"


def _aliases(spark, d) -> list[tuple[str, str]]:
    """Names of an entity table that holds at most some hundreds."""
    names = table(spark, d, "cluster_summary").filter("nearest_entity is not null").select("nearest_entity").distinct().limit(100_000).collect()
    return [(r[0], r[0].lower()) for r in names]


@query(f"select doc_id, entity from documents, {_NAMES} a where contains(lower(text), alias) and regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(alias) || '($|[^\\p{{L}}\\p{{N}}_])')")
def alias_matches(spark, d):
    """Documents and the entities that they name; the text is searched once for all names."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    return P.alias_matches(docs, _aliases(spark, d), "text").select("doc_id", "entity").distinct()


@query(f"""with m as (select doc_id, corpus, source, entity from documents, {_NAMES} a where contains(lower(text), alias) and regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(alias) || '($|[^\\p{{L}}\\p{{N}}_])'))
select entity, count(*) as documents, count_if(corpus = 'literature') as literature, count_if(corpus = 'report') as report, count_if(corpus = 'interviews') as interviews, count_if(corpus = 'dictionary') as dictionary, min(doc_id) as first_document, array_to_string(list_sort(list(doc_id))[1:3], ';') as examples, count(distinct source) as sources from m group by entity having count_if(corpus = 'literature') >= 2 or count_if(corpus = 'report') >= 3 or count_if(corpus = 'interviews') >= 1""")
def entity_mentions(spark, d):
    """Mentions counted from the texts by corpus, the first document and three examples, for entities with enough of
    them in any corpus by its own threshold."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "corpus", "source", "text")
    names = table(spark, d, "cluster_summary").filter("nearest_entity is not null").select(F.col("nearest_entity").alias("entity"), F.lower("nearest_entity").alias("alias")).distinct()
    m = written(P.mentions(docs, "text", names))
    by = {c: F.count_if(F.col("corpus") == c).alias(c) for c in ("literature", "report", "interviews", "dictionary")}
    first = F.row_number().over(Window.partitionBy("entity").orderBy("doc_id"))
    few = m.withColumn("r", first).filter("r <= 3").groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ";").alias("examples"))
    g = m.groupBy("entity").agg(F.count("*").alias("documents"), *by.values(), F.min("doc_id").alias("first_document"), F.countDistinct("source").alias("sources"))
    return g.filter("literature >= 2 or report >= 3 or interviews >= 1").join(few, "entity")


@query("select doc_id, md5(regexp_replace(regexp_replace(text, '[^ \\t\\n]*(?:(?i)oath|prophec)[^ \\t\\n]*', '[MASK]', 'g'), '\\[MASK\\](?:[ \\t\\n]+\\[MASK\\])+', '[MASK]', 'g')) as digest from documents where text is not null")
def masked_texts(spark, d):
    """Texts with the words that hold a match as a mask, masks side by side as one."""
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.md5(X.masked(F.col("text"), "(?i)oath|prophec")).alias("digest"))


@query("with l as (select distinct label from shared_space where label is not null and label <> '') select lower(label) as folded, min(label) as kept, count(*) as spellings from l group by 1")
def folded_names(spark, d):
    """One spelling of each name, the first in order."""
    l = table(spark, d, "shared_space").filter("label is not null and label <> ''").select("label").distinct()  # noqa: E741
    return l.groupBy(F.lower("label").alias("folded")).agg(F.min("label").alias("kept"), F.count("*").alias("spellings"))


@query("with l as (select distinct label from shared_space where label is not null), n as (select label, len(list_filter(regexp_split_to_array(label, '[ \\t\\n\\r]+'), lambda w: w <> '')) as words from l) select label, words <= 4 and not starts_with(lower(label), 'the ') as kept, words from n")
def name_forms(spark, d):
    """Labels short enough for a name that don't begin with the article."""
    l = table(spark, d, "shared_space").filter("label is not null").select("label").distinct()  # noqa: E741
    n = F.size(X.words(F.col("label")))
    return l.select("label", ((n <= 4) & ~F.startswith(F.lower("label"), F.lit("the "))).alias("kept"), n.cast("long").alias("words"))


@query("with l as (select distinct label from shared_space where label is not null) select a.label as with_article, b.label as without_article from l a join l b on lower(a.label) = 'the ' || lower(b.label)")
def article_pairs(spark, d):
    """Labels that differ by their article alone."""
    l = table(spark, d, "shared_space").filter("label is not null").select("label").distinct()  # noqa: E741
    return l.select(F.col("label").alias("with_article")).join(l.select(F.col("label").alias("without_article")), F.lower("with_article") == F.concat(F.lit("the "), F.lower("without_article")))


# --- keyed joins --------------------------------------------------------------------------------------------------------


@query("""with e as (select distinct archive_line, document_id, chunk_index, text_fr, text_en from expression_translations_embedded), f as (select * from e where text_en is not null) select e.document_id || ':' || e.chunk_index as key, e.archive_line, f.text_en is not null as translated, coalesce(f.text_fr = e.text_fr, true) as agrees from e left join f on f.archive_line = e.archive_line where e.document_id is not null and e.chunk_index is not null""")
def translation_join(spark, d):
    """Expressions with their translations; a translation whose text isn't that of the expression is an error."""
    e = table(spark, d, "expression_translations_embedded").select("archive_line", "document_id", "chunk_index", "text_fr", "text_en").distinct()
    f = e.filter("text_en is not null").select("archive_line", F.col("text_fr").alias("was"), "text_en")
    j = e.filter("document_id is not null and chunk_index is not null").drop("text_en").join(f, "archive_line", "left")
    same = F.coalesce(F.col("was") == F.col("text_fr"), F.lit(True))
    agrees = F.when(same, True).otherwise(F.raise_error(F.lit("a translation belongs to another text")).cast("boolean"))
    return j.select(F.concat_ws(":", "document_id", "chunk_index").alias("key"), "archive_line", F.col("text_en").isNotNull().alias("translated"), agrees.alias("agrees"))


@query("""with e as (select document_id, chunk_index, text_fr, max_by(archive_line, archive_line) as line, count(distinct archive_line) as copies from expression_translations_embedded where text_fr is not null and document_id is not null and chunk_index is not null and embedding_vector is not null group by all),
k as (select distinct document_id, chunk_index from chunk) select e.*, k.document_id is not null as in_chunks from e left join k using (document_id, chunk_index)""")
def last_vector_lookup(spark, d):
    """The line whose vector a key of three parts leads to: of several the last; and whether its chunk is there."""
    e = table(spark, d, "expression_translations_embedded").filter("text_fr is not null and document_id is not null and chunk_index is not null and embedding_vector is not null")
    g = e.groupBy("document_id", "chunk_index", "text_fr").agg(F.max("archive_line").alias("line"), F.countDistinct("archive_line").alias("copies"))
    k = table(spark, d, "chunk").select("document_id", "chunk_index").distinct().withColumn("in_chunks", F.lit(True))
    return g.join(k, ["document_id", "chunk_index"], "left").na.fill(False, ["in_chunks"])


@query("""with r as (select distinct document_id, page_number, line_index_in_page as line_no from integrity_regions), p as (select distinct document_id, page_number, text is not null as has_text from page_record)
select p.document_id, p.page_number, count(r.line_no) as suspect_lines, bool_or(has_text) as has_text from p left join r using (document_id, page_number) group by 1, 2""")
def records_with_verdicts(spark, d):
    """Every page with the verdicts on its lines, none or several."""
    r = table(spark, d, "integrity_regions").select("document_id", "page_number", F.col("line_index_in_page").alias("line_no")).distinct()
    p = table(spark, d, "page_record").select("document_id", "page_number", F.col("text").isNotNull().alias("has_text")).distinct()
    n = r.groupBy("document_id", "page_number").agg(F.count("line_no").alias("suspect_lines"))
    return p.groupBy("document_id", "page_number").agg(F.bool_or("has_text").alias("has_text")).join(n, ["document_id", "page_number"], "left").na.fill(0, ["suspect_lines"])


@query("""with t as (select distinct label as l from shared_space where source_dataset = 'conceptnet_concepts' and label is not null), m as (select distinct label from shared_space where source_dataset = 'emergent_entities' and label is not null), s as (select distinct lower(nearest_entity) as n from cluster_summary where nearest_entity is not null)
select label, exists (select 1 from t where t.l = m.label) as embedded, lower(label) not in (select n from s) as free from m""")
def term_sets(spark, d):
    """Entities that are embedded terms, and those that aren't among the cited names."""
    of = lambda g: table(spark, d, "shared_space").filter((F.col("source_dataset") == g) & F.col("label").isNotNull()).select("label").distinct()
    cited = table(spark, d, "cluster_summary").filter("nearest_entity is not null").select(F.lower("nearest_entity").alias("low")).distinct().withColumn("cited", F.lit(True))
    m = of("emergent_entities").join(of("conceptnet_concepts").withColumn("embedded", F.lit(True)), "label", "left").withColumn("low", F.lower("label"))
    return m.join(cited, "low", "left").select("label", F.coalesce("embedded", F.lit(False)).alias("embedded"), F.col("cited").isNull().alias("free"))


@query("""with e as (select distinct l_partkey as a, l_suppkey as b from lineitem), s as (select s_suppkey as k from supplier where s_suppkey % 3 = 0) select a, b, case when a in (select k from s) then 'start' else 'end' end as side, case when a in (select k from s) then b else a end as other from e where a <> b and (a in (select k from s) or b in (select k from s))""")
def seed_edges(spark, d):
    """Edges at a seed; a match at the start beats one at the end, and loops are dropped."""
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct().filter("a <> b")
    s = table(spark, d, "supplier").filter("s_suppkey % 3 = 0").select("s_suppkey")
    j = e.join(s.select(F.col("s_suppkey").alias("a"), F.lit(True).alias("at_start")), "a", "left").join(s.select(F.col("s_suppkey").alias("b"), F.lit(True).alias("at_end")), "b", "left").filter("at_start or at_end")
    return j.select("a", "b", F.when(F.col("at_start"), "start").otherwise("end").alias("side"), F.when(F.col("at_start"), F.col("b")).otherwise(F.col("a")).alias("other"))


@query("""with p as (select distinct point_id, key, label from shared_space where point_role = 'expression'), c as (select document_id || ':' || chunk_index as key, min(text) as text from chunk where document_id is not null and chunk_index is not null group by 1), g as (select distinct document_id from page_record where document_id is not null)
select case when p.key is null then 'no key' when g.document_id is null then 'no pages' when c.key is null then 'no chunk' when c.text is null or not contains(regexp_replace(c.text, '[ \\t\\n]+', ' ', 'g'), coalesce(p.label, '')) then 'not found' else 'traced' end as outcome, count(*) as n from p left join g on g.document_id = regexp_replace(p.key, ':[^:]*$', '') left join c on c.key = p.key group by 1""")
def entity_trace(spark, d):
    """How far each expression can be traced: the first gate that it fails."""
    p = table(spark, d, "shared_space").filter("point_role = 'expression'").select("point_id", "key", "label").distinct().withColumn("document_id", F.regexp_replace("key", ":[^:]*$", ""))
    c = table(spark, d, "chunk").filter("document_id is not null and chunk_index is not null").groupBy(F.concat_ws(":", "document_id", "chunk_index").alias("key")).agg(F.min("text").alias("text"), F.lit(True).alias("has_chunk"))
    g = table(spark, d, "page_record").filter("document_id is not null").select("document_id").distinct().withColumn("has_pages", F.lit(True))
    j = p.join(g, "document_id", "left").join(c, "key", "left")
    found = F.regexp_replace("text", r"[ \t\n]+", " ").contains(F.coalesce("label", F.lit("")))
    gate = M.first_reason([("no key", F.col("key").isNull()), ("no pages", F.col("has_pages").isNull()), ("no chunk", F.col("has_chunk").isNull()), ("not found", ~F.coalesce(found, F.lit(False)))])
    return j.groupBy(F.coalesce(gate, F.lit("traced")).alias("outcome")).agg(F.count("*").alias("n"))


@query("""with a as (select document_id as doc, chunk_index as chunk, 'chunk' as kind, 0 as line from (select distinct document_id, chunk_index from chunk)), b as (select document_id, chunk_index, 'expression', archive_line from (select distinct document_id, chunk_index, archive_line from expression_translations_embedded where document_id is not null and chunk_index is not null)) select doc, chunk, kind, line, row_number() over (partition by doc order by chunk, kind, line) as place from (select * from a union all select * from b)""")
def interleaved_trace(spark, d):
    """Chunks and expressions of each document in one order."""
    a = table(spark, d, "chunk").select(F.col("document_id").alias("doc"), F.col("chunk_index").alias("chunk")).distinct().select("doc", "chunk", F.lit("chunk").alias("kind"), F.lit(0).cast("long").alias("line"))
    b = table(spark, d, "expression_translations_embedded").filter("document_id is not null and chunk_index is not null").select("document_id", "chunk_index", F.lit("expression").alias("kind"), "archive_line").distinct()
    return a.union(b).withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("chunk", "kind", "line")).cast("long"))


@query("""with c as (select distinct document_id, chunk_index from chunk), e as (select distinct document_id, chunk_index, archive_line from expression_translations_embedded), d as (select distinct document_id from page_record where document_id is not null), f as (select *, row_number() over (partition by document_id order by chunk_index, archive_line) as r from e where document_id is not null) select d.document_id, f.archive_line as first_line, case when f.archive_line is null then 'unavailable' else 'found' end as status from d left join f on f.document_id = d.document_id and f.r = 1""")
def first_candidates(spark, d):
    """The first expression of each document, or a row that says there is none."""
    docs = table(spark, d, "page_record").filter("document_id is not null").select("document_id").distinct()
    e = table(spark, d, "expression_translations_embedded").filter("document_id is not null").select("document_id", "chunk_index", "archive_line").distinct()
    f = M.first_of(e, ["document_id"], [F.col("chunk_index").asc_nulls_last(), F.col("archive_line")]).select("document_id", F.col("archive_line").alias("first_line"))
    return docs.join(f, "document_id", "left").withColumn("status", F.when(F.col("first_line").isNull(), "unavailable").otherwise("found"))


@query("""with e as (select distinct document_id, chunk_index, archive_line from expression_translations_embedded where document_id in (select document_id from page_record)), c as (select distinct document_id, chunk_index from chunk)
select c.document_id, count(distinct c.chunk_index) as chunks, count(distinct e.chunk_index) as yielding, count(e.archive_line) as yielded from c left join e using (document_id, chunk_index) group by c.document_id""")
def yields(spark, d):
    """How much each document's chunks yielded."""
    keys = ["document_id", "chunk_index"]
    e = table(spark, d, "expression_translations_embedded").select(*keys, "archive_line").distinct().join(table(spark, d, "page_record").select("document_id").distinct(), "document_id", "left_semi")
    n = e.groupBy(*keys).agg(F.count("archive_line").alias("n"))
    j = table(spark, d, "chunk").select(*keys).distinct().join(n, keys, "left")
    return j.groupBy("document_id").agg(F.count("chunk_index").alias("chunks"), F.count("n").alias("yielding"), F.coalesce(F.sum("n"), F.lit(0)).alias("yielded"))


# --- edges, merging and reports ------------------------------------------------------------------------------------------

_EDGES = "with e as (select l_suppkey as s, l_partkey as t, l_returnflag as rel, l_quantity as w from lineitem where l_returnflag <> 'N'), d as (select node, count(*) as degree from (select 'p' || l_partkey as node from lineitem union all select 's' || l_suppkey from lineitem) where node in (select 'p' || t from e) group by node)"


@query(_EDGES + ", g as (select t, sum(coalesce(w, 1)) as w, count(distinct s) as seeds, count(distinct rel) as relations, count(*) as n from e group by t having count(distinct s) >= 3) select t as node, seeds as n_seeds, relations as n_relations, n as n_edges, degree, round(w / degree, 6) as specificity, round(seeds * w / degree, 6) as score from g join d on d.node = 'p' || t where t not in (select p_partkey from part where p_size = 1) order by round(seeds * w / degree, 9) desc, t limit 50")
def node_scores(spark, d):
    """Nodes with three seeds or more by seeds times weight over degree, relations of one kind and excluded nodes left
    out; the degree counts all edges of the tracked nodes."""
    every = table(spark, d, "lineitem")
    e = every.filter("l_returnflag <> 'N'")
    r = E.related(e, "l_suppkey", "l_partkey", "l_returnflag", "l_quantity").filter("n_seeds >= 3")
    tracked = e.select(F.concat(F.lit("p"), "l_partkey").alias("node")).distinct()
    degree = E.degrees(every.select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")), "a", "b").join(tracked, "node", "left_semi")
    out = table(spark, d, "part").filter("p_size = 1").select(F.col("p_partkey").alias("node"))
    j = r.join(out, "node", "left_anti").join(degree.select(F.col("node").alias("name"), "degree"), F.concat(F.lit("p"), "node") == F.col("name"))
    j = j.withColumn("specificity", F.col("total_weight") / F.col("degree")).withColumn("score", F.col("n_seeds") * F.col("specificity"))
    return j.orderBy(F.desc(F.round(F.col("n_seeds") * F.col("total_weight") / F.col("degree"), 9)), "node").limit(50).select("node", "n_seeds", "n_relations", "n_edges", "degree", F.round("specificity", 6).alias("specificity"), F.round("score", 6).alias("score"))


_KEY = "regexp_replace(lower(left(text, 40)), '[^a-z0-9 ]', '', 'g')"


@query(f"""with a as (select doc_id, coalesce(n_chars, 0) as c, source, md5(text) as k, {_KEY} as t, lang from documents where text is not null and text <> ''), b as (select k, arg_max(doc_id, struct_pack(c := c, d := -doc_id)) as doc_id, max(c) as c, list(distinct source) as s, arg_max(t, struct_pack(c := c, d := -doc_id)) as t, arg_max(coalesce(lang, ''), struct_pack(c := c, d := -doc_id)) as l from a group by k),
u as (select t, l, unnest(s) as x from b) select arg_max(doc_id, struct_pack(c := c, d := -doc_id)) as doc_id, count(*) as merged, (select array_to_string(list_sort(list(distinct x)), ';') from u where u.t = b.t and u.l = b.l) as sources from b group by t, l""")
def merged_records(spark, d):
    """Records merged by one key, then by another, each time keeping the one of the greatest size (the first of equal
    ones) and the union of their sources."""
    docs = table(spark, d, "documents").filter("text is not null and text <> ''")
    a = docs.select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("c"), "source", F.md5("text").alias("k"), F.regexp_replace(F.lower(F.left("text", F.lit(40))), "[^a-z0-9 ]", "").alias("t"), F.coalesce("lang", F.lit("")).alias("l"))
    best = F.struct("c", -F.col("doc_id"))
    b = a.groupBy("k").agg(F.max_by("doc_id", best).alias("doc_id"), F.max("c").alias("c"), F.collect_set("source").alias("s"), F.max_by("t", best).alias("t"), F.max_by("l", best).alias("l"))
    g = b.groupBy("t", "l").agg(F.max_by("doc_id", best).alias("doc_id"), F.count("*").alias("merged"))
    s = b.select("t", "l", F.explode("s").alias("x")).groupBy("t", "l").agg(F.array_join(F.array_sort(F.collect_set("x")), ";").alias("sources"))  # a row a distinct source
    return g.join(s, ["t", "l"]).select("doc_id", "merged", "sources")


@query("""with m as (select p_brand, min(p_size) as lo, max(p_size) as hi, count(distinct p_type) as n from part group by p_brand) select p_partkey, round(case when hi > lo then (p_size - lo)::double / (hi - lo) else 0 end + least(n - 1, 5) * 0.05, 6) as score from part join m using (p_brand)""")
def score_with_bonus(spark, d):
    """Sizes scaled within the brand, with a bonus for further types, capped."""
    p = table(spark, d, "part")
    n = p.groupBy("p_brand").agg(F.countDistinct("p_type").alias("n"))
    s = T.min_max(p, "p_size", ["p_brand"], "score").join(F.broadcast(n), "p_brand")
    return s.select("p_partkey", F.round(F.col("score") + F.least(F.col("n") - 1, F.lit(5)) * 0.05, 6).alias("score"))


@query("""select count(distinct document_id) as documents, count(distinct text) as texts, count(distinct lower(regexp_replace(trim(text), '[ \\t\\n]+', ' ', 'g'))) as normal_texts, count(*) as n, count(*) > count(distinct lower(regexp_replace(trim(text), '[ \\t\\n]+', ' ', 'g'))) as has_duplicates from (select distinct document_id, chunk_index, text from chunk where text is not null)""")
def text_diversity(spark, d):
    """How many documents, texts and normalised texts there are among the chunks."""
    c = table(spark, d, "chunk").filter("text is not null").select("document_id", "chunk_index", "text").distinct()
    n = F.countDistinct(F.lower(F.regexp_replace(F.trim("text"), r"[ \t\n]+", " ")))
    return c.agg(F.countDistinct("document_id").alias("documents"), F.countDistinct("text").alias("texts"), n.alias("normal_texts"), F.count("*").alias("n")).withColumn("has_duplicates", F.col("n") > F.col("normal_texts"))


@query("""with p as (select distinct document_id, page_number, coalesce(text, '') as text from page_record), r as (select document_id, count(*) as emitted, count_if(trim(text) <> '' and length(text) >= 200) as retained, count_if(trim(text) = '') as empty_, count_if(trim(text) <> '' and length(text) < 200) as short_ from p group by document_id) select document_id, emitted, retained, empty_ as empty, short_ as short, round(retained::double / emitted, 6) as rate from r""")
def run_summary(spark, d):
    """Pages kept and rejected by reason; it is an error if they don't add up to all."""
    t = F.coalesce("text", F.lit(""))
    p = table(spark, d, "page_record").select("document_id", "page_number", t.alias("text")).distinct()
    blank, short = F.trim("text") == "", F.length("text") < 200
    r = p.groupBy("document_id").agg(F.count("*").alias("emitted"), F.count_if(~blank & ~short).alias("retained"), F.count_if(blank).alias("empty"), F.count_if(~blank & short).alias("short"))
    whole = F.when(F.col("emitted") == F.col("retained") + F.col("empty") + F.col("short"), F.col("emitted")).otherwise(F.raise_error(F.lit("rows are missing from the summary")).cast("long"))
    return r.select("document_id", whole.alias("emitted"), "retained", "empty", "short", F.round(F.col("retained") / F.col("emitted"), 6).alias("rate"))


@query("""with s as (select distinct point_id, label, regexp_replace(key, ':[^:]*$', '') as doc from shared_space where point_role = 'expression' and key is not null), f as (select *, row_number() over (partition by doc order by point_id) as r from s) select count(*) as documents, count_if(len(list_filter(regexp_split_to_array(coalesce(label, ''), '[ \\t\\n\\r]+'), lambda w: w <> '')) >= 5 and contains(label, 'the ')) as passing, round(avg((len(list_filter(regexp_split_to_array(coalesce(label, ''), '[ \\t\\n\\r]+'), lambda w: w <> '')) >= 5 and contains(coalesce(label, ''), 'the '))::int), 6) as rate from f where r = 1""")
def first_item_audit(spark, d):
    """The share of documents whose first item passes two tests."""
    s = table(spark, d, "shared_space").filter("point_role = 'expression' and key is not null").select("point_id", "label", F.regexp_replace("key", ":[^:]*$", "").alias("doc")).distinct()
    ok = (F.size(X.words(F.col("label"))) >= 5) & F.coalesce(F.col("label").contains("the "), F.lit(False))
    return M.first_of(s, ["doc"], [F.col("point_id")]).agg(F.count("*").alias("documents"), F.count_if(ok).alias("passing"), F.round(F.avg(ok.cast("int")), 6).alias("rate"))


@query("""with s as (select distinct point_id, source_dataset, point_role from shared_space where point_role is not null) select point_role as cluster, count(*) as size, count_if(source_dataset = 'literature') as literature, count_if(source_dataset = 'miviludes') as miviludes, count_if(source_dataset = 'interviews') as interviews, count_if(source_dataset = 'literature') = 0 as literature_absent, count_if(source_dataset = 'miviludes') = 0 as miviludes_absent, count_if(source_dataset = 'interviews') = 0 as interviews_absent from s where point_role <> 'expression' or source_dataset <> 'literature' group by point_role""")
def coverage_by_cluster(spark, d):
    """What corpora each cluster's points are of, and which have none there."""
    s = table(spark, d, "shared_space").filter("point_role is not null").select("point_id", "source_dataset", F.col("point_role").alias("cluster")).distinct().filter("cluster <> 'expression' or source_dataset <> 'literature'")
    names = ("literature", "miviludes", "interviews")
    g = s.groupBy("cluster").agg(F.count("*").alias("size"), *[F.count_if(F.col("source_dataset") == n).alias(n) for n in names])
    return g.withColumns({f"{n}_absent": F.col(n) == 0 for n in names})


@query("select c_nationkey, c_custkey, case when n = 1 then base else base || chr(cast(96 + n as int)) end as ident from (select c_nationkey, c_custkey, 'n' || c_nationkey || '-' || left(c_mktsegment, 4) as base, row_number() over (partition by c_nationkey, left(c_mktsegment, 4) order by c_custkey) as n from customer) where n <= 26")
def lettered_ids(spark, d):
    """Ids made unique by a letter, in order of the key; here the first 26 of each."""
    c = table(spark, d, "customer").withColumn("base", F.concat(F.lit("n"), "c_nationkey", F.lit("-"), F.left("c_mktsegment", F.lit(4))))
    n = M.occurrence(c, ["base"], ["c_custkey"], "n").filter("n < 26")
    return n.select("c_nationkey", "c_custkey", F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat("base", F.char(F.col("n") + 97))).alias("ident"))


@query("with n as (select n_nationkey as k, n_name as name, row_number() over (order by n_nationkey) - 1 as i, count(*) over () as n from nation) select a.name as base, b.name as partner, 'pair-' || lpad(cast(a.i + 1 as varchar), 3, '0') as ident from n a join n b on b.i = (a.i + 1) % a.n")
def cyclic_pairs(spark, d):
    """Each row of a small table with the next, the last with the first, under running ids."""
    n = table(spark, d, "nation").withColumn("i", F.row_number().over(Window.orderBy("n_nationkey")) - 1)
    size = n.agg(F.count("*").alias("size"))
    a = n.join(F.broadcast(size)).select(F.col("n_name").alias("base"), F.col("i"), ((F.col("i") + 1) % F.col("size")).alias("j"))
    b = n.select(F.col("n_name").alias("partner"), F.col("i").alias("j"))
    return a.join(F.broadcast(b), "j").select("base", "partner", F.concat(F.lit("pair-"), F.lpad((F.col("i") + 1).cast("string"), 3, "0")).alias("ident"))


@query("with s as (select l_returnflag as grp, avg(l_quantity) as m, quantile_cont(l_quantity, 0.025::double) as lo, quantile_cont(l_quantity, 0.975::double) as hi from lineitem group by 1) select grp, not (lo <= m + 1e-9 and m <= hi + 1e-9) as faulty from s")
def interval_faults(spark, d):
    """Groups whose mean doesn't lie in its interval, with a tolerance."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("grp")).agg(F.avg("l_quantity").alias("m"), F.percentile("l_quantity", F.lit(0.025)).alias("lo"), F.percentile("l_quantity", F.lit(0.975)).alias("hi"))
    return s.select("grp", (~((F.col("lo") <= F.col("m") + 1e-9) & (F.col("m") <= F.col("hi") + 1e-9))).alias("faulty"))


@query("with x as (select c_custkey % 50 as topic, c_custkey // 50 as variant, c_acctbal as v from customer) select topic, round(max(v) filter (where variant = 0), 2) as base, round(max(v) filter (where variant = 1), 2) as partner from x group by topic having max(v) filter (where variant = 0) is not null and max(v) filter (where variant = 1) is not null")
def variants_of_one_base(spark, d):
    """Rows of one base beside each other, by variant."""
    c = table(spark, d, "customer").select((F.col("c_custkey") % 50).alias("topic"), F.floor(F.col("c_custkey") / 50).alias("variant"), "c_acctbal")
    a, b = c.filter("variant = 0").select("topic", F.round("c_acctbal", 2).alias("base")), c.filter("variant = 1").select("topic", F.round("c_acctbal", 2).alias("partner"))
    return a.groupBy("topic").agg(F.max("base").alias("base")).join(b.groupBy("topic").agg(F.max("partner").alias("partner")), "topic")


# --- content -------------------------------------------------------------------------------------------------------------


@query("select doc_id, year, source, row_number() over (partition by year order by source, doc_id) as place from documents where corpus = 'literature'")
def literature_list(spark, d):
    """Literature by year, then by source; the place within the year."""
    t = table(spark, d, "documents").filter("corpus = 'literature'").select("doc_id", "year", "source")
    return t.withColumn("place", F.row_number().over(Window.partitionBy("year").orderBy("source", "doc_id")).cast("long"))


@query("select doc_id, split_part(text, ',', 1) as term, year from documents where corpus = 'dictionary' and text is not null and contains(text, ',')")
def dictionary_list(spark, d):
    """Lexicon entries by their term."""
    return table(spark, d, "documents").filter("corpus = 'dictionary' and text is not null and contains(text, ',')").select("doc_id", F.substring_index("text", ",", 1).alias("term"), "year")


def interview_by_id(spark, d, ident: str) -> DataFrame:
    """One interview by its id; no row for an id that there isn't."""
    return _talks(spark, d).filter(F.col("id") == ident).select("id", "date_time", "method", "language", "n_questions")


@query(_TALKS + " select id, date_time, method, language, n_questions from i where id = (select max(id) from i)")
def interview_by_parameter(spark, d):
    """The detail query with a parameter, here the last id."""
    return interview_by_id(spark, d, _talks(spark, d).agg(F.max("id")).first()[0])


@query("select distinct point_id, label, row_number() over (order by point_id) as place from (select distinct point_id, label from shared_space where source_dataset = 'miviludes_criteria')")
def criteria_list(spark, d):
    """The criteria, a small set, in their order."""
    c = table(spark, d, "shared_space").filter("source_dataset = 'miviludes_criteria'").select("point_id", "label").distinct()
    return c.withColumn("place", F.row_number().over(Window.orderBy("point_id")).cast("long"))


def titled(rows: DataFrame, titles: DataFrame, key: str, title: str) -> DataFrame:
    """rows with a title from a small table; a key that it doesn't know is an error when the result is read."""
    j = rows.join(F.broadcast(titles), key, "left")
    return j.withColumn(title, F.when(F.col(title).isNotNull(), F.col(title)).otherwise(F.raise_error(F.concat(F.lit("unknown key "), key)).cast("double")))


@query("select distinct d.source, t.target_share as title from documents d join mix_targets t using (source)")
def titled_sources(spark, d):
    """Sources of the mixture with their share, which must be known."""
    known = table(spark, d, "mix_targets").select("source", F.col("target_share").alias("title"))
    return titled(table(spark, d, "documents").select("source").distinct().join(F.broadcast(known.select("source")), "source", "left_semi"), known, "source", "title")


# --- selections and what is left to do --------------------------------------------------------------------------------


@query("""with p as (select document_id, sha256(string_agg(page_number || ':' || coalesce(text, ''), chr(10) order by page_number)) as digest from (select distinct on (document_id, page_number) document_id, page_number, text from page_record where document_id is not null and page_number is not null order by document_id, page_number, written_at) group by 1), s as (select distinct document_id, pages_jsonl_sha256 as stored from stage1_text_integrity) select document_id, p.digest, case when p.digest is null then 'gone' when stored is null then 'new' when stored = p.digest then 'same' else 'changed' end as state from p full join s using (document_id)""")
def verified_rebuild(spark, d):
    """Digests of documents rebuilt from their pages beside the stored ones."""
    p = M.first_of(table(spark, d, "page_record").filter("document_id is not null and page_number is not null"), ["document_id", "page_number"], [F.col("written_at")])
    line = F.concat_ws(":", "page_number", F.coalesce("text", F.lit("")))
    digest = p.groupBy("document_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", line.alias("t")))), lambda x: x["t"]), "\n"), 256).alias("digest"))
    s = table(spark, d, "stage1_text_integrity").select("document_id", F.col("pages_jsonl_sha256").alias("stored")).distinct()
    state = F.when(F.col("digest").isNull(), "gone").when(F.col("stored").isNull(), "new").when(F.col("stored") == F.col("digest"), "same").otherwise("changed")
    return digest.join(s, "document_id", "full").select("document_id", "digest", state.alias("state"))


@query("""with a as (select document_id, chunk_index, archive_line, 'first' as run from (select distinct document_id, chunk_index, archive_line from expression_translations_embedded) where archive_line % 2 = 0), b as (select document_id, chunk_index, archive_line, 'second' from (select distinct document_id, chunk_index, archive_line from expression_translations_embedded) where archive_line % 3 = 0), u as (select * from a union all select * from b),
r as (select *, row_number() over (partition by document_id, run order by md5(run || ':' || archive_line), archive_line) as k from u where document_id is not null) select document_id, run, archive_line, document_id || '-' || run || '-' || k as row_id from r where k <= 3""")
def review_packet(spark, d):
    """Rows of two runs put together, at most three of each document and run, drawn by hash, under ids."""
    e = table(spark, d, "expression_translations_embedded").filter("document_id is not null").select("document_id", "archive_line").distinct()
    u = e.filter("archive_line % 2 = 0").withColumn("run", F.lit("first")).unionByName(e.filter("archive_line % 3 = 0").withColumn("run", F.lit("second")))
    k = F.row_number().over(Window.partitionBy("document_id", "run").orderBy(F.md5(F.concat_ws(":", "run", "archive_line")), "archive_line"))
    return u.withColumn("k", k).filter("k <= 3").select("document_id", "run", "archive_line", F.concat_ws("-", "document_id", "run", "k").alias("row_id"))


@query("select p_partkey, len(list_filter(['a', 'promo', '3'], lambda m: contains(lower(p_name || ' ' || p_type), m))) > 0 as routed from part")
def routed_titles(spark, d):
    """Titles that hold one of the markers."""
    t = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    return table(spark, d, "part").select("p_partkey", F.exists(F.array(*[F.lit(m) for m in ("a", "promo", "3")]), lambda m: F.contains(t, m)).alias("routed"))


@query("""with p as (select distinct document_id, page_number from page_record where document_id is not null), r as (select distinct document_id, page_number from integrity_regions) select p.document_id, count(*) as pages, count(r.page_number) as done, count(*) - count(r.page_number) as pending from p left join r using (document_id, page_number) group by p.document_id""")
def pending_by_document(spark, d):
    """How many pages of each document are done and how many are left."""
    keys = ["document_id", "page_number"]
    p = table(spark, d, "page_record").filter("document_id is not null").select(*keys).distinct()
    r = table(spark, d, "integrity_regions").select(*keys).distinct().withColumn("is_done", F.lit(1))
    g = p.join(r, keys, "left").groupBy("document_id").agg(F.count("*").alias("pages"), F.count("is_done").alias("done"))
    return g.withColumn("pending", F.col("pages") - F.col("done"))


@query("""with c as (select distinct document_id, chunk_index, lower(text) as t from chunk where text is not null), w as (select document_id, chunk_index, unnest(regexp_extract_all(t, '\\p{L}+')) as term from c) select term, count(*) as occurrences, count(distinct document_id || ':' || chunk_index) as chunks, count(distinct document_id) as documents from w where term in (select distinct lower(label) from shared_space where source_dataset in ('concept_backbone', 'conceptnet_concepts', 'structural_concepts') and label is not null) group by term""")
def term_counts(spark, d):
    """How often the terms of the reference lists occur in the chunks, each time counting."""
    c = table(spark, d, "chunk").filter("text is not null").select("document_id", "chunk_index", F.lower("text").alias("t")).distinct()
    terms = table(spark, d, "shared_space").filter(F.col("source_dataset").isin("concept_backbone", "conceptnet_concepts", "structural_concepts") & F.col("label").isNotNull()).select(F.lower("label").alias("term")).distinct()
    w = c.select("document_id", "chunk_index", F.explode(F.regexp_extract_all("t", F.lit(r"\p{L}+"), F.lit(0))).alias("term")).join(terms, "term", "left_semi")
    return w.groupBy("term").agg(F.count("*").alias("occurrences"), F.countDistinct(F.concat_ws(":", "document_id", "chunk_index")).alias("chunks"), F.countDistinct("document_id").alias("documents"))


@query("select cell, folded, kept from (select source_dataset as cell, lower(label) as folded, first(label order by point_id, label) as kept from (select distinct point_id, source_dataset, label from shared_space where label is not null and source_dataset is not null) group by 1, 2)")
def first_spellings(spark, d):
    """The first spelling of each name within its cell."""
    s = table(spark, d, "shared_space").filter("label is not null and source_dataset is not null").select("point_id", F.col("source_dataset").alias("cell"), "label").distinct()
    return s.groupBy("cell", F.lower("label").alias("folded")).agg(F.min_by("label", F.struct("point_id", "label")).alias("kept"))


@query()
def kept_expressions(spark, d):
    """Expressions of each document in order: kept, repeated, or over their chunk's number (a fold; tested by a loop)."""
    e = table(spark, d, "expression_translations_embedded").filter("document_id is not null").select("document_id", "chunk_index", "archive_line", "text_fr").distinct()
    return M.kept_in_order(e, ["document_id"], "chunk_index", "archive_line", "text_fr")
