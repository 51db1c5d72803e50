"""Problem 3: raw transcripts as clean, ordered speaker turns.

A finite-state parser reads a transcript line by line: a header until speech begins, then blocks that a label, a blank
line (in units without labels) or a separator starts. Blocks get roles from their labels or from turn_roles, lose
times, fillers and sounds, are put in order, and neighbours of one role are one turn. Units are independent, so the
whole is one pass without a shuffle; only repeated rows are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilathe.session import table

INTERVIEWER, PARTICIPANT, NOTES = "interviewer", "participant", "notes"

# Labels that tell the role, in six languages.
ROLES = {
    INTERVIEWER: "interviewer int i q question intervieweur intervieweuse enquêteur enquêtrice entrevistador entrevistadora intervistatore intervistatrice interviewerin frage f pergunta pregunta domanda moderator moderatorin researcher",
    PARTICIPANT: "interviewee r respondent respondant participant participante enquêté enquêtée interviewé interviewée répondant répondante réponse entrevistado entrevistada intervistato intervistata befragte befragter interviewte interviewter antwort answer partecipante risposta respuesta resposta teilnehmer teilnehmerin",
}
ROLE_OF = {w: role for role, words in ROLES.items() for w in words.split()}
# Letters that tell the role only beside other labels: (role beside a known interviewer, beside a known
# participant).
BESIDE = {"p": (PARTICIPANT, INTERVIEWER), "a": (PARTICIPANT, None), "d": (None, INTERVIEWER), "b": (PARTICIPANT, None), "e": (PARTICIPANT, INTERVIEWER)}
NOTE_LABELS = ("interview notes", "notes", "note", "transcriber", "transcriber's note")

# Murmurs and fillers that are no speech by themselves, and those of two words.
FILLERS = set(
    "uh um umm er erm uhm uhh hmm hm mm mmm mmh mhm mh ah oh eh ehm hum huh aha ajá aham euh heu ben bah bof äh ähm öh hem halt este pues cioè boh beh hã ahn né pois hmpf tja"
    " uh-huh mm-hm mm-hmm hm-hm mh-mh mhm-mhm mm-mm".split()
)
PHRASES = ["you know", "i mean", "tu vois", "o sea", "quer dizer", "sort of", "kind of"]
# Words that sounds and transcribers' remarks in round brackets are made of.
SOUNDS = set(
    "laughter laughs laughing coughs cough sighs sigh pause silence long short phone rings door slams steps crosstalk inaudible unclear noise applause"
    " rires rire toux soupir inaudible bruit de fond silence lacht lachen hustet seufzt unverständlich pause gelächter telefon klingelt"
    " risas risa tose suspira pausa inaudible ininteligible ruido silencio ride risate tossisce sospira incomprensibile rumore silenzio"
    " risos riso tosse suspiro inaudível ruído silêncio".split()
)

_TIME = r"(?:[\[(<]?\s*(?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?\s*[\])>]?|[\[(<]\s*\d+m\s?\d+s\s*[\])>]|\d+m\d+s)"
_LABEL = (
    r"(?:interview\s+notes?|transcriber(?:'s note)?|notes?|speaker[ _]?\w{1,2}|voice ?\d{1,2}|spk ?\d{1,2}|s\d{1,2}|[a-z]|int\."
    r"|[^\W\d_]{3,16}\.?)"
)
_LINE = re.compile(rf"^\s*(?:(?P<t1>{_TIME})\s*(?:-->\s*(?:{_TIME})?)?\s*)?(?:\*\*|__|<)?(?P<label>{_LABEL})(?:\s*(?P<t2>{_TIME}))?(?P<sep>\s?:(?:\*\*|__)?|(?:\*\*|__)\s?:|>\s?:?|\s[-–—]\s)\s*(?:(?P<t3>{_TIME})\s*(?:-->)?\s*)?(?P<rest>.*)$", re.IGNORECASE)
_LEADING_TIME = re.compile(rf"^\s*(?P<t>{_TIME})\s*(?:-->\s*(?:{_TIME})?)?\s*(?P<rest>.*)$", re.DOTALL)
_TIMES = re.compile(r"[\[(<]\s*(?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?\s*[\])>]|(?<![\d:])\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,3})?(?:\s*-->)?|[\[(<]\d+m\s?\d+s[\])>]")
_SEPARATOR = re.compile(r"^\s*[-–—_=*~]{2,}\s*$")
_HEADER = re.compile(r"^\s*(?:interview\b\s*[-–—:]?.*\d{4}|transcript\b.*|audio\s*file.*|recording\b.*|transcription\b.*|\S+\.(?:wav|mp3|m4a)\s*)$", re.IGNORECASE)
_NOTE = re.compile(r"^\s*[\[(]\s*(?:transcriber|note|anm|nota|n\.d|ndr|transkri)[^\])]*[\])]\s*$", re.IGNORECASE)
_MARKS = re.compile(r"\[[^\]]*\]|\(\([^)]*\)\)|\{[^}]*\}|<[^>]*>|(?<!\*)\*[^*\n]{1,40}\*(?!\*)")
_ROUND = re.compile(r"\(([^()]*)\)")
_DASHED = re.compile(r"(?:\.\.\.|…|[–—-])\s*(" + "|".join(map(re.escape, sorted(FILLERS, key=len, reverse=True))) + "|" + "|".join(PHRASES) + r")\s*(?:\.\.\.|…|[–—-])", re.IGNORECASE)
_PHRASE = re.compile(r"\b(?:" + "|".join(PHRASES) + r")\b", re.IGNORECASE)


def seconds(stamp: str) -> float:
    """A time as seconds."""
    m = re.search(r"(\d+)m\s?(\d+)s", stamp)
    if m:
        return int(m[1]) * 60 + int(m[2])
    parts = re.findall(r"\d+", stamp)
    fraction = 0.0
    if re.search(r"[.,]\d{1,3}\D*$", stamp) and len(parts) > 2:
        fraction = float("0." + parts.pop())
    total = 0
    for p in parts:
        total = total * 60 + int(p)
    return total + fraction


def person(label: str) -> str:
    """A label without case, signs and spelling variants: speakers by number or letter."""
    plain = re.sub(r"[\s._]+", " ", label.lower()).strip()
    m = re.fullmatch(r"(?:speaker|voice|spk|s) ?0*(\w{1,2})", plain)
    return f"#{m[1] or '0'}" if m else plain


def known_role(name: str) -> str | None:
    """The role a label tells: a known word, or one misspelt by a letter or two."""
    if name in ROLE_OF:
        return ROLE_OF[name]
    if name.startswith(NOTE_LABELS[0]) or name in NOTE_LABELS:
        return NOTES
    if len(name) >= 7:
        for word, role in ROLE_OF.items():
            if len(word) >= 7 and abs(len(word) - len(name)) <= 2 and word[:4] == name[:4] and word[-2:] == name[-2:] and _near(word, name):
                return role
    return None


def _near(a: str, b: str) -> bool:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= 2


def is_label(name: str) -> bool:
    return name.startswith("#") or known_role(name) is not None or name in BESIDE


def clean(text: str) -> str:
    """text without times, sounds and standalone fillers."""
    text = _TIMES.sub(" ", text)
    text = _MARKS.sub(" ", text)
    text = _ROUND.sub(lambda m: " " if all(w in SOUNDS or w.isdigit() or w == "s" for w in re.findall(r"[^\W_]+", m[1].lower())) else m[0], text)
    text = text.replace("**", "")
    text = _DASHED.sub(" ", text)
    words = []
    for w in _PHRASE.sub(" ", text).split() if _only_fillers(text) else text.split():
        bare = w.strip(".,;:!?…–—-").lower()
        if bare in FILLERS and bare not in ("este", "pues", "pois", "halt", "ben", "né") or not bare and not re.search(r"\w", w) and w in ("-", "–", "—", "...", "…", ","):
            continue
        words.append(w)
    out = re.sub(r"\s+([,.;:!?])(?=\s|$)", r"\1", " ".join(words))
    return re.sub(r"^\s*[,.;:]\s*", "", out)


_PHRASE_WORDS = sorted({w for p in PHRASES for w in p.split()})


def _only_fillers(text: str) -> bool:
    # A word that no phrase can take part of is there after the phrases are gone, too.
    for w in text.split():
        low = w.lower()
        if low.strip(".,;:!?…–—-'’\"") not in FILLERS and re.search(r"\w", w) and not any(p in low for p in _PHRASE_WORDS):
            return False
    rest = _PHRASE.sub(" ", text)
    return all(w.strip(".,;:!?…–—-'’\"").lower() in FILLERS for w in rest.split() if re.search(r"\w", w))


def is_speech(text: str) -> bool:
    """Whether anything is left beside times, sounds, murmurs and fillers."""
    text = _MARKS.sub(" ", _TIMES.sub(" ", text)).replace("**", "")
    text = _ROUND.sub(lambda m: " " if all(w in SOUNDS or w.isdigit() or w == "s" for w in re.findall(r"[^\W_]+", m[1].lower())) else m[0], text)
    return bool(re.search(r"\w", text)) and not _only_fillers(text)


def parse(text: str, roles: list[str] | None) -> list[tuple[str, str]]:
    """(role, clean text) of the turns of a unit."""
    lines = text.replace("\r\n", "\n").split("\n")
    matches = []
    for line in lines:
        m = _LINE.match(line)
        matches.append(m if m and is_label(person(m["label"])) and not (m["sep"].strip() in "-–—" and known_role(person(m["label"])) is None) else None)
    labelled = sum(m is not None for m in matches)
    blocks = _labelled(lines, matches) if labelled >= 1 and (labelled >= 2 or not roles) else _unlabelled(lines, roles)
    turns: list[tuple[str, list[str]]] = []
    for role, body in blocks:
        words = clean(body)
        if turns and turns[-1][0] == role:
            turns[-1][1].append(words)
        else:
            turns.append((role, [words]))
    return [(role, " ".join(parts)) for role, parts in turns]


def _labelled(lines: list[str], matches: list) -> list[tuple[str, str]]:
    blocks: list[list] = []  # name, time, text
    current, skipping = None, False
    for line, m in zip(lines, matches):
        if m:
            stamp = m["t1"] or m["t3"] or m["t2"]
            current = [person(m["label"]), seconds(stamp) if stamp else None, [m["rest"]]]
            blocks.append(current)
            skipping = False
        elif _SEPARATOR.match(line) or _HEADER.match(line) or _NOTE.match(line):
            continue
        elif re.match(r"^\s*[\[(]\s*transcriber", line, re.IGNORECASE):
            skipping = not re.search(r"[\])]\s*$", line)
        elif skipping:
            skipping = not re.search(r"[\])]\s*$", line)
        elif current is not None and line.strip():
            current[2].append(line)
    names = {b[0] for b in blocks}
    known = {n: known_role(n) for n in names}
    has = {r for r in known.values() if r}
    for n in names:
        if known[n] is None and n in BESIDE:
            with_i, with_p = BESIDE[n]
            if INTERVIEWER in has and with_i and not (n == "a" and "b" in names):
                known[n] = with_i
            elif PARTICIPANT in has and with_p:
                known[n] = with_p
    spoken = [(n, t, "\n".join(parts)) for n, t, parts in blocks if known[n] != NOTES and is_speech("\n".join(parts))]
    if spoken and all(t is not None for _, t, _ in spoken):
        spoken.sort(key=lambda b: b[1])
    told = {known[n] for n, _, _ in spoken if known[n]}
    first = next((n for n, _, _ in spoken if known[n] is None), None)
    if first is not None:
        # Labels that tell nothing: who speaks first is the interviewer, unless a told label is that.
        opens = spoken[0][0] == first or INTERVIEWER not in told
        for n in names:
            if known[n] is None:
                known[n] = INTERVIEWER if n == first and opens else PARTICIPANT
    return [(known[n], body) for n, _, body in spoken]


def _unlabelled(lines: list[str], roles: list[str] | None) -> list[tuple[str, str]]:
    blocks: list[list[str]] = [[]]
    for line in lines:
        if line.strip(" \t"):
            blocks[-1].append(line)
        elif blocks[-1]:
            blocks.append([])
    out = []
    bodies = ["\n".join(b) for b in blocks if b]
    speech = [b for b in bodies if not _SEPARATOR.match(b) and not _HEADER.match(b.split("\n")[0])]
    use = bodies if roles and len(bodies) == len(roles) else speech
    last = INTERVIEWER
    for k, body in enumerate(use):
        role = roles[k] if roles and k < len(roles) else None
        role = role.strip().lower() if isinstance(role, str) else None
        if role not in (INTERVIEWER, PARTICIPANT):
            # No role is given: the first to speak is the interviewer, the others follow the block before.
            role = last if out else INTERVIEWER
        if _SEPARATOR.match(body) or _NOTE.match(body) or (_HEADER.match(body) and k < 2) or not is_speech(body):
            continue
        last = role
        out.append((role, body))
    return out


def speaker_turns(units: DataFrame) -> DataFrame:
    """(document_id, chunk_index, turn_no, speaker_role, text) of units (document_id, chunk_index, text, turn_roles).

    Rows repeated with one key are one unit if their text is the same. Null and empty texts have no turns, nor have
    units of nothing but headers, notes, fillers or sounds. turn_roles may be null, empty, shorter than the text or
    hold nulls. Texts of any length are read whole."""
    units = units.select("document_id", "chunk_index", "text", "turn_roles").filter("text is not null").dropDuplicates(["document_id", "chunk_index", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, c, no, role, text) for d, c, t, r in zip(*(x.to_pylist() for x in batch.columns)) for no, (role, text) in enumerate(parse(t, r))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()])], ["document_id", "chunk_index", "turn_no", "speaker_role", "text"])

    return units.mapInArrow(run, "document_id string, chunk_index int, turn_no int, speaker_role string, text string")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaker_turns(table(spark, sf_dir, "transcript_unit")).select("document_id", "chunk_index", "turn_no", "speaker_role").distinct()


def p3_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns with their clean text."""
    return speaker_turns(table(spark, sf_dir, "transcript_unit"))


QUERIES = {"p3_found": p3_found, "p3_turns": p3_turns}
