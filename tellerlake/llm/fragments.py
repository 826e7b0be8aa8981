"""BPE encoding and decoding by forced boundaries.

Two neighbouring bytes that stand side by side in no token of the vocabulary can never end up in one token, so a text may be cut between them. Each
match of the splitting pattern falls into such fragments; a fragment is encoded by merging on its own, and the ids are put together again. Short
fragments are merged by looking for the lowest rank; long ones keep the places of each rank, so that time stays near linear in their length.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellerlake.llm.bpe import splitter
from tellerlake.llm.common import Remembered, map_texts

SHORT = 48
#: What one worker remembers of encoded matches, and the longest match that is remembered.
REMEMBERED_BYTES, REMEMBERED_LENGTH = 48 << 20, 64


def shown_bytes() -> dict[str, int]:
    """The characters that stand for bytes in the file: printable Latin-1 for itself, the other bytes in order from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class FragmentCodec:
    """Encoder and decoder of one byte-level file of the `tokenizers` library. Files with normalizers, prefix blanks, dropout, byte fallback or added
    tokens that look at their surroundings are refused, as are merges that make a token twice."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        bare = not any(t[x] for t in spec["added_tokens"] for x in ("single_word", "lstrip", "rstrip", "normalized"))
        if model["type"] != "BPE" or not plain or not bare or spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space"):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        byte, vocab = shown_bytes(), model["vocab"]
        raw = lambda token: bytes(map(byte.__getitem__, token))
        self.token = [b""] * (1 + max(chain(vocab.values(), (t["id"] for t in spec["added_tokens"]))))
        for token, i in vocab.items():
            self.token[i] = raw(token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.token[i] = content.encode()
        self.cuts = re.compile("(%s)" % "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = splitter(pattern)
        self.single = [vocab.get(char) for char, _ in sorted(byte.items(), key=lambda x: x[1])]
        if None in self.single:
            raise ValueError(f"bytes without a token: {path}")
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        self.sides: list[tuple[int, int]] = []
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = vocab[left], vocab[right]
            self.rank[pair] = len(self.made)
            self.made.append(vocab[left + right])
            self.sides.append(pair)
        if len(set(self.made)) < len(self.made):
            raise ValueError(f"a token is made by two merges: {path}")
        self.inside = np.zeros(1 << 16, bool)
        for i in vocab.values():
            held = np.frombuffer(self.token[i], np.uint8).astype(np.int32)
            self.inside[held[:-1] << 8 | held[1:]] = True
        self.together = self.inside.tobytes()
        self.first_rank = np.full(1 << 16, -1, np.int32)
        for a, left in enumerate(self.single):
            for b, right in enumerate(self.single):
                self.first_rank[a << 8 | b] = self.rank.get((left, right), -1)
        self.known: Remembered = Remembered(REMEMBERED_BYTES)

    def fragments(self, piece: bytes) -> list[bytes]:
        """The piece cut wherever two bytes stand together in no token."""
        if len(piece) > SHORT:
            held = np.frombuffer(piece, np.uint8).astype(np.int32)
            cuts = (np.flatnonzero(~self.inside[held[:-1] << 8 | held[1:]]) + 1).tolist()
        else:
            cuts = [i for i in range(1, len(piece)) if not self.together[piece[i - 1] << 8 | piece[i]]]
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)], strict=True)] if cuts else [piece]

    def merge_short(self, fragment: bytes) -> list[int]:
        ids, find, none = list(map(self.single.__getitem__, fragment)), self.rank.get, len(self.made)
        ranks = [find(pair, none) for pair in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            ids[i] = self.made[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = find((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = find((ids[i], ids[i + 1]), none)
        return ids

    def merge_long(self, fragment: bytes) -> array:
        """Merges rank by rank: a merge makes only pairs of higher rank, so each rank's places are complete when its turn comes."""
        held = np.frombuffer(fragment, np.uint8).astype(np.int32)
        end = len(held)
        ids = array("i", np.array(self.single, np.int32)[held].tobytes())
        after, before = array("i", range(1, end + 1)), array("i", range(-1, end))
        ranks = self.first_rank[held[:-1] << 8 | held[1:]]
        order = np.argsort(ranks, kind="stable").astype(np.int32)
        values, begins = np.unique(ranks[order], return_index=True)
        places = {int(r): array("i", part.tobytes()) for r, part in zip(values, np.split(order, begins[1:]), strict=True) if r >= 0}
        turns = list(places)
        heapq.heapify(turns)
        find = self.rank.get
        while turns:
            r = heapq.heappop(turns)
            (left, right), new = self.sides[r], self.made[r]
            for p in np.unique(np.frombuffer(places.pop(r), np.int32)).tolist():
                q = after[p]
                if ids[p] != left or q >= end or ids[q] != right:
                    continue
                ids[p], ids[q] = new, -1
                n, o = after[q], before[p]
                after[p] = n
                if n < end:
                    before[n] = p
                for a, b in ((o, p), (p, n)):
                    if a >= 0 and b < end and (later := find((ids[a], ids[b]))) is not None:
                        if later not in places:
                            places[later] = array("i")
                            heapq.heappush(turns, later)
                        places[later].append(a)
        out = np.frombuffer(ids, np.int32)
        return array("i", out[out >= 0].tobytes())

    def encode_piece(self, piece: bytes) -> array:
        out = array("i")
        for fragment in self.fragments(piece):
            out.extend(self.merge_short(fragment) if len(fragment) <= SHORT else self.merge_long(fragment))
        return out

    def ordinary(self, text: str) -> array:
        """Ids of a text without special strings. Matches up to a length are remembered, as many as fit in a number of bytes."""
        known, out = self.known, array("i")
        for piece in self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = known.recall(piece) or self.encode_piece(piece.encode()).tobytes()
                if len(piece) <= REMEMBERED_LENGTH:
                    known.keep(piece, ids, 200 + 4 * len(piece) + len(ids))
            out.frombytes(ids)
        return out

    def encode(self, text: str) -> array:
        """Ids of a whole text; the strings of added tokens stand for these tokens."""
        if self.cuts is None or not any(s in text for s in self.special):
            return self.ordinary(text)
        out = array("i")
        for i, part in enumerate(self.cuts.split(text)):
            if i % 2:
                out.append(self.special[part])
            else:
                out.extend(self.ordinary(part))
        return out

    def decode(self, ids) -> str:
        """The text of ids, added tokens included; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def codec(path: str, pattern: str) -> FragmentCodec:
    return FragmentCodec(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns and `ids` (array of int) of each whole text, a row for each row.

    Null and empty texts have no ids; repeated rows stay; other columns are left out, and a kept column called `ids` is refused. A text of n bytes takes
    some 30 n bytes of memory while it is encoded, a single unbroken fragment included."""
    refuse(keep, ("ids",))
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    return map_texts(docs, text, {c: c for c in keep}, fields, lambda texts: {"ids": [codec(path, pattern).encode(t.decode()).tolist() for t in texts]})


def decode_texts(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """The rows with `name`, the text of their ids (null ids: null), after all other columns, `ids` left out."""
    rest = [c for c in encoded.columns if c != ids]
    refuse(tuple(rest), (name,))
    schema = T.StructType([encoded.schema[c] for c in rest] + [T.StructField(name, T.StringType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            texts = [None if i is None else codec(path, pattern).decode(i) for i in batch.column(len(rest)).to_pylist()]
            yield pa.record_batch([*batch.columns[: len(rest)], pa.array(texts, pa.string())], schema=arrow)

    return encoded.select(*rest, F.col(ids).cast("array<int>")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns, `n_tokens`, SHA-256 of the ids (little-endian, 32 bits each) and of the decoded text, a row for each row.

    Null texts count as empty; repeated rows stay; a kept column with the name of a result is refused. No shuffle."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    refuse(keep, tuple(f.name for f in fields))

    def work(texts: list[bytes]) -> dict[str, list]:
        own, out = codec(path, pattern), {f.name: [] for f in fields}
        for t in texts:
            ids = own.encode(t.decode())
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(np.frombuffer(ids, np.int32).astype("<u4")).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
        return out

    return map_texts(docs, text, {c: c for c in keep}, fields, work)


def refuse(columns: tuple[str, ...], names: tuple[str, ...]) -> None:
    if both := sorted({c.lower() for c in columns} & {n.lower() for n in names}):
        raise ValueError(f"columns with the name of a result: {both}")
