"""Byte-level BPE: exact encoding by per-prefix dynamic programming, and decoding.

For every prefix of a pre-token the encoder stores the one token that ends its
exact BPE encoding. Candidates come from a suffix automaton over the vocabulary
(all tokens that end at a position); a candidate is right if the token stored for
the prefix before it may stand next to it, which a walk over the two merge trees
decides. Back-pointers give the ids. The work is linear in the text and needs no
priority queue of merges.

Defined results: null text counts as the empty text and gives no ids; a special
token's string in a text becomes its id, as the tokenizers library does it; texts
may be of any length (nothing is truncated or padded); repeated rows are encoded
each; other columns are ignored, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Unicode White_Space, spelled out: libraries differ on the separators U+001C to U+001F.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the pre-token pattern of the public byte-level vocabulary.
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
NEVER = 1 << 40
PIECES_KEPT, PIECE_LENGTH, PAIRS_KEPT, HEAD = 400_000, 48, 1_000_000, 6


def printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens and merges of a tokenizers file of the byte-level BPE kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_byte = printable_bytes()
        model = spec["model"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        of_text = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.bytes_of = {i: bytes(as_byte[c] for c in t) for t, i in of_text.items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = of_text[left], of_text[right], of_text[left + right]
            self.rank.setdefault((a, b), r)
            if whole not in self.parts:
                self.parts[whole], self.made[whole] = (a, b), r
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()


class SuffixAutomaton:
    """All substrings of the vocabulary; each state knows the tokens among its strings."""

    def __init__(self, tokens: dict[bytes, int]):
        self.link, self.length, self.go = [-1], [0], {}
        for token in tokens:
            last = 0
            for c in token:
                last = self._extend(last, c)
        self.ends: dict[int, list[tuple[int, int]]] = {}
        for token, i in tokens.items():
            state = 0
            for c in token:
                state = self.go[state << 8 | c]
            self.ends.setdefault(state, []).append((len(token), i))
        self.found: dict[int, tuple[tuple[int, int], ...]] = {}

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the strings that are no longer than p's and one byte."""
        copy = self._state(self.length[p] + 1, self.link[q])
        for b in range(256):
            if (to := self.go.get(q << 8 | b)) is not None:
                self.go[copy << 8 | b] = to
        while p != -1 and self.go.get(p << 8 | c) == q:
            self.go[p << 8 | c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.go.get(last << 8 | c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, 0), last
        while p != -1 and (p << 8 | c) not in self.go:
            self.go[p << 8 | c] = new
            p = self.link[p]
        if p != -1:
            q = self.go[p << 8 | c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def tokens_ending(self, state: int) -> tuple[tuple[int, int], ...]:
        """(length, id) of the tokens that are suffixes of the state's longest string, longest first."""
        found = self.found.get(state)
        if found is None:
            own = sorted(self.ends.get(state, ()), reverse=True)
            found = self.found[state] = (*own, *(self.tokens_ending(self.link[state]) if self.link[state] > 0 else ()))
        return found


class Encoder:
    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        self.find = regex.compile(PRETOKEN).findall
        self._pairs: dict[int, bool] = {}
        self._heads: dict[bytes, tuple] = {}  # words that begin alike share their first prefixes
        whole: dict[int, bool] = {}

        def reachable(t: int) -> bool:
            """BPE gives this token for its own bytes."""
            if t not in whole:
                a, b = v.parts.get(t, (None, None))
                whole[t] = a is None or (reachable(a) and reachable(b) and self._apart(a, b, v.made[t], v.made[t]))
            return whole[t]

        self.whole = {b: i for b, i in v.id_of.items() if len(b) == 1 or i in v.parts and reachable(i)}
        self.automaton = SuffixAutomaton(self.whole)
        self.special = regex.compile("(" + "|".join(map(regex.escape, v.special)) + ")") if v.special else None
        self.ids_of_piece = _Pieces(self)
        self._words: dict[str, tuple[int, ...]] = {}
        self.as_text = {i: str(i) for i in v.bytes_of}

    def _apart(self, a: int, b: int, ends_a: int = NEVER, ends_b: int = NEVER) -> bool:
        """No merge joins a's right edge with b's left edge before each has grown to its end.

        Both trees are walked back in time, the later merge first. Two edge tokens
        meet from the rank that made the later one up to the ranks that used them up;
        at one and the same rank the pair further left goes first.
        """
        rank, parts, made = self.vocabulary.rank, self.vocabulary.parts, self.vocabulary.made
        while True:
            m = rank.get((a, b))
            if m is not None and m < ends_a and m <= ends_b:
                return False
            ra, rb = made.get(a, -1), made.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                ends_a, a = ra, parts[a][1]
            else:
                ends_b, b = rb, parts[b][0]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS_KEPT:
                self._pairs.clear()
            known = self._pairs[key] = self._apart(a, b)
        return known

    def pretoken(self, data: bytes) -> list[int]:
        """Ids of one pre-token: the last token of each prefix, then the way back."""
        whole = self.whole.get(data)
        if whole is not None:
            return [whole]
        head = data[:HEAD]
        start = self._heads.get(head)
        if start is None:
            if len(self._heads) >= PIECES_KEPT:
                self._heads.clear()
            start = self._heads[head] = self._advance(head, [0], [0], 0, 0)
        last, size, *_ = self._advance(data[HEAD:], [*start[0]], [*start[1]], *start[2:])
        ids, i = [], len(data)
        while i:
            ids.append(last[i])
            i -= size[i]
        ids.reverse()
        return ids

    def _advance(self, data: bytes, last: list[int], size: list[int], state: int, matched: int) -> tuple[list[int], list[int], int, int]:
        """The last token of each longer prefix: ``last`` and ``size`` hold those so far."""
        automaton, pairs = self.automaton, self._pairs
        step, link, length, known = automaton.go.get, automaton.link, automaton.length, automaton.found
        i = len(last) - 1
        for c in data:
            i += 1
            to = step(state << 8 | c)
            while to is None:
                state = link[state]
                matched = length[state]
                to = step(state << 8 | c)
            state = to
            matched += 1
            for n, token in known.get(state) or automaton.tokens_ending(state):
                if n > matched:
                    continue
                if n < i:
                    fits = pairs.get(last[i - n] << 20 | token)
                    if not (self.compatible(last[i - n], token) if fits is None else fits):
                        continue
                last.append(token)
                size.append(n)
                break
            else:
                raise ValueError(f"no token ends at byte {i}")
        return last, size, state, matched

    def plain(self, text: str) -> tuple[int, ...]:
        """Ids of a text without special tokens, pre-token by pre-token."""
        out: list[int] = []
        for word in self.find(text):
            ids = self._words.get(word)
            if ids is None:
                ids = tuple(self.pretoken(word.encode()))
                if len(word) <= PIECE_LENGTH:
                    if len(self._words) >= PIECES_KEPT:
                        self._words.clear()
                    self._words[word] = ids
            out += ids
        return tuple(out)

    def _unspecial(self, text: str) -> list[int]:
        if len(self.ids_of_piece) >= PIECES_KEPT:
            self.ids_of_piece.clear()
        first, *rest = text.split(" ")
        try:
            return [*self.plain(first), *chain.from_iterable(map(self.ids_of_piece.__getitem__, rest))]
        except _Irregular:
            return list(self.plain(text))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.special is None or not any(s in text for s in self.vocabulary.special):
            return self._unspecial(text)
        parts = self.special.split(text)
        return [*chain.from_iterable([self.vocabulary.special[x]] if i % 2 else self._unspecial(x) for i, x in enumerate(parts) if x)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class _Irregular(Exception):
    """A space that is followed by white space, where a text can't be cut."""


class _Pieces(dict):
    """Ids of what stands between one space and the next, the space before it included.

    A space before a character that isn't white space always begins a pre-token, so
    a text can be cut there and pieces that occur often are encoded once.
    """

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if not piece or piece[0].isspace():
            raise _Irregular
        ids = self.encoder.plain(" " + piece)
        if len(piece) <= PIECE_LENGTH:
            self[piece] = ids
        return ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file; its tables are bounded by the vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded text of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [own.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(own.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs``: number of ids, digest of the ids and of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = own.encode(text.as_py())
                joined = ",".join(map(own.as_text.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows) if rows else ((), (), ()), (pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
