"""Byte-level BPE encoding and decoding by rank files.

Bytes are read as Latin-1 text, so an Aho-Corasick automaton over the vocabulary finds the longest token at each place. Encoding goes forward by
longest match and steps back to a shorter token when two neighbours could not both survive the merges; whether a pair can is remembered. A place
is given up once at most, so time is linear in the length of a piece, and the tokens are those that merging by rank gives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tellerlake.llm.common import Remembered, map_texts

#: White space as the Rust library behind tiktoken knows it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: Texts below this character are split by `re` with its letters, numbers and white space spelled out; others by `regex`, which takes twice the time.
WIDE = 0x250

#: What a task remembers of pieces and of pairs, and the longest piece that is remembered.
PIECE_BYTES, PAIR_BYTES, PIECE_LENGTH = 96 << 20, 32 << 20, 64


def spelled(pattern: str, letters: str, numbers: str) -> str:
    """The pattern with its classes spelled out: libraries differ on the separators 1C to 1F."""
    names = {r"\p{L}": letters, r"\p{N}": numbers, r"\s": SPACE}

    def one(found: re.Match) -> str:
        held = found[0]
        if held == r"\S":
            return f"[^{SPACE}]"
        if held in names:
            return f"[{names[held]}]"
        for name, value in names.items():
            held = held.replace(name, value)
        return held

    return re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\[sS]", one, pattern)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """The function that cuts a text into the pattern's matches."""
    of = lambda kind: "".join(rf"\u{i:04x}" for i in range(WIDE) if unicodedata.category(chr(i))[0] == kind)
    wide, narrow = regex.compile(spelled(pattern, r"\p{L}", r"\p{N}")).findall, spelled(pattern, of("L"), of("N"))
    if r"\p" in narrow:
        return wide
    quick, plain = re.compile(narrow).findall, re.compile(rf"[\x00-\u{WIDE - 1:04x}]*").fullmatch
    return lambda text: quick(text) if plain(text) else wide(text)


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.pieces = splitter(pattern)
        size = max(self.ranks.values()) + 1
        self.token = [b""] * size
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(size)]  # the last merge of a token; a byte is its own halves
        self.joined: dict[tuple[int, int], int] = {}
        self.size = [0] * size
        self.automaton = ahocorasick.Automaton()
        reachable = set()
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            self.token[rank], self.size[rank] = token, len(token)
            if len(token) > 1:
                cuts = ((token[:i], token[i:]) for i in range(1, len(token)))
                pairs = ((self.ranks[a], self.ranks[b]) for a, b in cuts if a in reachable and b in reachable)
                pair = next((x for x in pairs if self._compatible(*x, rank)), None)
                if pair is None:
                    continue  # no order of merges makes it; only a piece that equals it is given its rank
                self.halves[rank] = pair
                self.joined[pair] = rank
            reachable.add(token)
            if len(token) > 1:
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        self.shorter: list[int] = [-1] * size  # the longest other token that begins a token
        for token in reachable:
            self.shorter[self.ranks[token]] = next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in reachable), -1)
        self.digits = [str(i) for i in range(size)]
        self.fits: Remembered = Remembered(PAIR_BYTES)
        self.known: Remembered = Remembered(PIECE_BYTES)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves these neighbours as they are: no merge across their border comes before the ones that made them."""
        pair = left, right
        seen = self.fits.get(pair)
        if seen is None:
            seen = self.fits.recall(pair)
            if seen is None:
                seen = self._compatible(left, right, len(self.token))
            self.fits.keep(pair, seen, 220)
        return seen

    def _compatible(self, left: int, right: int, bound: int) -> bool:
        while True:
            if self.joined.get((left, right), bound) < bound:
                return False
            inner, outer = self.halves[left][1], self.halves[right][0]
            if left > right and inner != left:
                bound, left = left, inner
            elif outer != right:
                bound, right = right + 1, outer
            elif inner != left:
                bound, left = left, inner
            else:
                return True

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        size, fits, end = self.size, self.fits, len(piece)
        longest = list(map(self.single.__getitem__, piece))
        for last, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[last - size[rank] + 1] = rank  # later ends are longer
        open_places = bytearray(b"\x01") * (end + 1)
        out: list[int] = []
        at, before, token = 0, -1, longest[0]
        while True:
            stop = at + size[token]
            if open_places[stop]:
                fit = before < 0 or fits.get((before, token))
                if fit or fit is None and self.compatible(before, token):
                    out.append(token)
                    if stop == end:
                        return tuple(out)
                    at, before, token = stop, token, longest[stop]
                    continue
            if self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                open_places[at] = 0
                token = out.pop()
                before = out[-1] if out else -1
                at -= size[token]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, piece by piece; pieces up to a length are remembered, as many as fit in a number of bytes."""
        pieces, known, own = self.pieces(text), self.known, {}
        for piece in set(pieces):
            ids = known.get(piece)
            if ids is None:
                ids = known.recall(piece) or self.encode_piece(piece.encode())
                if len(piece) <= PIECE_LENGTH:
                    known.keep(piece, ids, 220 + len(piece) + 8 * len(ids))
            own[piece] = ids
        return list(chain.from_iterable(map(own.__getitem__, pieces)))

    def forget(self) -> None:
        """Give back what was remembered: a worker outlives its task."""
        self.known.forget()
        self.fits.forget()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def listed(self, ids: list[int]) -> str:
        return " ".join(map(self.digits.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns and `ids` (array of int) of each whole text; null and empty texts have no ids."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    return map_texts(docs, text, {c: c for c in keep}, fields, lambda texts: {"ids": [codec(path, pattern).encode(t.decode()) for t in texts]}, lambda: codec(path, pattern).forget())


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns, `n_tokens`, and SHA-256 of the ids as written and of the decoded bytes, a row for each row."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def work(texts: list[bytes]) -> dict[str, list]:
        c, out = codec(path, pattern), {f.name: [] for f in fields}
        for t in texts:
            ids = c.encode(t.decode())
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(c.listed(ids).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(c.decode(ids)).hexdigest())
        return out

    return map_texts(docs, text, {c: c for c in keep}, fields, work, lambda: codec(path, pattern).forget())
