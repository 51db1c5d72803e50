"""Byte-level BPE as a lazily determinised finite-state transducer.

The merge table is compiled into a byte trie. A state of the transducer holds, for every place inside the bytes read
so far at which a later token could still begin, the trie node reached from there and the tokens that lead up to it;
tokens that all those places share are final and are emitted, so the lookahead is bounded by the longest token. States
and transitions are made when first met and kept. Two neighbouring tokens are admissible if merging their joined bytes
by rank gives the same two tokens back; a sequence of admissible neighbours is the BPE result.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: how this public vocabulary splits text before merging.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The same pattern for the standard library's engine. It may differ only on texts with a character of _OTHER.
_FAST = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
)


#: Characters outside these ranges may be classed differently by the two engines (numbers that are no decimal digits,
#: control characters taken for space); texts that hold one go through the exact engine.
_OTHER = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u02ff\u0370-\u052f\u2000-\u206f\u20a0-\u20bf\u2190-\u22ff\u2500-\u25ff\ue000-\uf8ff\ufffd]")


@lru_cache(1)
def _exact():
    import regex

    return regex.compile(SPLIT_PATTERN)


def split(text: str) -> list[str]:
    """The pieces of text that are merged on their own; joined they give the text."""
    return (_exact() if _OTHER.search(text) else _FAST).findall(text)


class BpeTransducer:
    """Ids of byte strings under a rank table {token bytes: id}."""

    ROOT = 0

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, i in ranks.items():
            node = 0
            for b in token:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = i
        self._pairs: dict[tuple[int, int], bool] = {}
        # A state is (last emitted token or -1, ((trie node, tokens after the emitted ones), ...)); the entry of node
        # ROOT is the tokenisation of what was read.
        self.states: list[tuple] = [(-1, ((0, ()),))]
        self.number = {self.states[0]: 0}
        self.next: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def merge(self, data: bytes) -> list[int]:
        """The definition: merge the neighbouring pair of least rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def admissible(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        ok = self._pairs.get((a, b))
        if ok is None:
            ok = self._pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return ok

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, entries = self.states[state]
        moved, whole = [], None
        for node, tokens in entries:
            child = self.children[node].get(byte)
            if child is None:
                continue
            t = self.token_at[child]
            if whole is None and t >= 0 and self.reachable(t) and self.admissible(tokens[-1] if tokens else last, t):
                whole = (*tokens, t)
            if self.children[child]:
                moved.append((child, tokens))
        assert whole is not None, "every byte is a token, so some last token is admissible"
        moved.append((self.ROOT, whole))
        shared = 0
        shortest = min(len(t) for _, t in moved)
        while shared < shortest and len({t[shared] for _, t in moved}) == 1:
            shared += 1
        emitted = whole[:shared]
        new = (emitted[-1] if emitted else last, tuple((n, t[shared:]) for n, t in moved))
        at = self.number.get(new)
        if at is None:
            at = self.number[new] = len(self.states)
            self.states.append(new)
            self.next.append({})
        self.next[state][byte] = (at, emitted)
        return at, emitted

    @lru_cache(None)
    def reachable(self, t: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        return self.merge(self.bytes_of[t]) == [t]

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        out: list[int] = []
        state, nexts = 0, self.next
        for b in data:
            step = nexts[state].get(b) or self._step(state, b)
            state = step[0]
            if step[1]:
                out.extend(step[1])
        out.extend(self.states[state][1][-1][1])
        if len(self.states) > 400_000:  # bounded memory: forget and determinise anew
            self.states, self.next = self.states[:1], [{}]
            self.number = {self.states[0]: 0}
        return tuple(out)


#: A space that is followed by white space or the end: it doesn't begin a piece of its own.
_LOOSE = re.compile(r" (?:\s|\Z)")


def chunks_of(text: str) -> list[str]:
    """Text cut at single spaces before a character that isn't white space, where no piece of split() ever crosses.
    Each chunk but the first lacks the space it begins with; the first is marked by a space."""
    chunks = text.split(" ")
    if _LOOSE.search(text):
        joined = chunks[:1]
        for c in chunks[1:]:
            if c and not c[0].isspace():
                joined.append(c)
            else:
                joined[-1] += " " + c
        chunks = joined
    chunks[0] = " " + chunks[0]
    return chunks


class _Chunks(dict):
    """Numbers of the chunks met so far; their ids lie one after another in `flat`."""

    def __init__(self, transducer: BpeTransducer):
        super().__init__()
        self.transducer, self.flat, self.ends = transducer, array("i"), array("q", [0])

    def __missing__(self, chunk: str) -> int:
        text = chunk[1:] if chunk[:1] == " " else " " + chunk
        for piece in split(text):
            self.flat.extend(self.transducer.encode_bytes(piece.encode("utf-8", "surrogatepass")))
        self.ends.append(len(self.flat))
        n = self[chunk] = len(self)
        return n

    def shrink(self) -> None:
        """Forgets all when large, between batches; memory stays bounded for any vocabulary."""
        if len(self) > 400_000 or len(self.flat) > 4_000_000:
            self.clear()
            self.flat, self.ends = array("i"), array("q", [0])


class Tokenizer:
    """Encoding and streaming decoding with a rank file (lines of base64 token and id)."""

    def __init__(self, path: str = DEFAULT_PATH):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.transducer = BpeTransducer(ranks)
        self.chunks = _Chunks(self.transducer)

    def _numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The chunk numbers of all texts in order, and how many each text has."""
        self.chunks.shrink()
        cut = [chunks_of(t) if t else () for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        numbers = np.fromiter(map(self.chunks.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        return numbers, sizes

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the offsets at which each text's begin and the last ends. Null and empty
        texts have no ids."""
        numbers, sizes = self._numbers(texts)
        ends = np.frombuffer(self.chunks.ends, np.int64)
        starts, lengths = ends[numbers], ends[numbers + 1] - ends[numbers]
        after = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(starts - after[:-1], lengths) + np.arange(after[-1])
        ids = np.array(self.chunks.flat, dtype=np.int32)[at]
        del ends
        return ids, after[np.concatenate([[0], np.cumsum(sizes)])]

    def count_batch(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        numbers, sizes = self._numbers(texts)
        lengths = np.diff(np.array(self.chunks.ends))[numbers]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return np.diff(total[np.concatenate([[0], np.cumsum(sizes)])])

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text piece by piece as ids arrive; a character whose bytes lie in several tokens comes with its last byte."""
        machine = Utf8Machine()
        for i in ids:
            piece = machine.feed(self.transducer.bytes_of[i])
            if piece:
                yield piece
        rest = machine.finish()
        if rest:
            yield rest

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


class Utf8Machine:
    """Incremental UTF-8: feed() returns the characters completed by the bytes given; malformed bytes give U+FFFD."""

    def __init__(self):
        self.need, self.code, self.least, self.most = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        if self.need == 0 and data.isascii():
            return data.decode("ascii")
        out = []
        for b in data:
            if self.need:
                if self.least <= b <= self.most:
                    self.code, self.need = self.code << 6 | b & 0x3F, self.need - 1
                    self.least, self.most = 0x80, 0xBF
                    if not self.need:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.need, self.least, self.most = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.code = 2, b & 0x0F
                self.least, self.most = 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                self.need, self.code = 3, b & 0x07
                self.least, self.most = 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out)

    def finish(self) -> str:
        rest = "�" if self.need else ""
        self.__init__()
        return rest


@lru_cache(4)
def load(path: str = DEFAULT_PATH) -> Tokenizer:
    """One tokenizer per process and path."""
    return Tokenizer(path)
