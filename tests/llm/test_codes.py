"""Vector codes against plain integer arithmetic, and BPE by fragments against the library."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tellerlake.llm import fragments, gnat
from tellerlake.llm.common import Remembered

JSON = P.path("byte_bpe_50k.json")
PIECES = ["a", "b", " ", "  ", "\n", "é", "ß", "中", "1", "22", "'s", "'ll", "!", "\x1c", "\x85", "\xa0", " ", "\t", "the", "tion", "😀", "​", "᠎", "<|endoftext|>", "<|endof", "\r", "\x00", "﻿"]


def brute_codes(rows, parts, entries, rounds, scale):
    """{row number: (code, error, label_error)} and the digest of the codebooks, in Python integers."""
    rows = [(i, [math.floor(x * scale) for x in v], label) for i, v, label in rows]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for c in cut:
                met.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [tuple(sum(x) // len(met[e]) for x in zip(*met[e], strict=True)) if e in met else y for e, y in enumerate(books[p])]
    coded = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in c) for c in coded]
    out = [(rows[k][0], "".join(f"{e:02x}" for _, e in c), errors[k], sum(e for e, r in zip(errors, rows, strict=True) if r[2] == rows[k][2])) for k, c in enumerate(coded)]
    return sorted(out, key=str), hashlib.sha256(",".join(str(x) for book in books for y in book for x in y).encode()).hexdigest()


def compressed(made):
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in made.rows.collect()), key=str), made.digest()


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_codes_equal_plain_arithmetic(spark, monkeypatch, broadcast):
    monkeypatch.setattr(gnat, "BROADCAST_LABELS", broadcast)
    rng = random.Random(8)
    usable = [(i if i % 7 else None, [rng.choice([-1.5, -0.3, 0.0, 0.001, 0.3, rng.gauss(0, 1)]) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(150)]
    usable += usable[:20]
    odd = [(900, None, 1), (901, [], 1), (902, [1.0, None] * 4, 1), (903, [math.nan] * 8, 1), (904, [math.inf] * 8, 1), (905, [1.0] * 4, 1), (906, [1.0] * 7, 1)]
    frame = spark.createDataFrame([(i, v, label, "x") for i, v, label in usable + odd], "vec_id long, embedding array<double>, label int, code string").repartition(5)
    made = gnat.compress(frame, parts=4, entries=9, rounds=3, scale=64)
    assert compressed(made) == brute_codes(usable, 4, 9, 3, 64)


def test_few_rows_and_empty_tables(spark):
    frame = spark.createDataFrame([(2, [0.5] * 8, 1), (1, [0.25] * 8, None)], "vec_id long, embedding array<float>, label int")
    assert compressed(gnat.compress(frame)) == brute_codes([(2, [0.5] * 8, 1), (1, [0.25] * 8, None)], 8, 16, 6, 4096)
    assert gnat.compress(frame.limit(0)).rows.collect() == []
    with pytest.raises(Exception, match="2\\^27"):
        gnat.compress(spark.createDataFrame([(1, [1e30] * 8, 1)], "vec_id long, embedding array<double>, label int")).rows.collect()


def test_tree_finds_the_nearest_and_leaves_entries_out():
    rng = np.random.default_rng(4)
    for spread in (2, 5, 1000):
        for n in (1, 3, 4, 5, 16, 200):
            entries = rng.integers(-spread, spread, (n, 3))
            x = np.concatenate((entries, rng.integers(-2 * spread, 2 * spread, (500, 3))))
            apart = gnat.squared(x, entries)
            index, best = gnat.assign(x, entries, gnat.Node.of(entries, np.arange(n)))
            assert (index == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()
    seen = []
    entries, tree = rng.integers(-1000, 1000, (200, 3)), None
    tree = gnat.Node.of(entries, np.arange(200))
    measured = gnat.squared
    try:
        gnat.squared = lambda x, points: seen.append(len(x) * len(points)) or measured(x, points)
        gnat.assign(entries, entries, tree)
    finally:
        gnat.squared = measured
    assert sum(seen) < 200 * 200 / 2


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    letters = "".join(rng.choice("abcdefghijklmnop") for _ in range(20_000))
    return ["", " ", "  x", "x" * 5000, "word " * 3000, letters, *("".join(rng.choice(PIECES) for _ in range(rng.randint(1, 40))) for _ in range(1500))]


def test_fragments_equal_the_library(odd):
    own, theirs = fragments.FragmentCodec(JSON, P.PATTERN), Tokenizer.from_file(JSON)
    for text in odd:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(ids) == theirs.decode(ids, skip_special_tokens=False) == text
    assert own.decode([own.single[0xC3]]) == theirs.decode([own.single[0xC3]], skip_special_tokens=False)


def test_cuts_are_forced_and_both_merges_agree(odd):
    own = fragments.FragmentCodec(JSON, P.PATTERN)
    inside = {pair for token in own.token[:50256] for pair in zip(token, token[1:])}
    for text in odd[:400]:
        data = text.encode()
        if not data:
            continue
        cut = own.fragments(data)
        assert b"".join(cut) == data and len(cut) == 1 + sum(pair not in inside for pair in zip(data, data[1:]))
        for f in (f for f in cut if len(f) > 1):
            assert list(own.merge_short(f)) == list(own.merge_long(f))


def test_a_word_of_a_megabyte_ends_and_is_not_remembered():
    own = fragments.FragmentCodec(JSON, P.PATTERN)
    rng = random.Random(9)
    text = "".join(rng.choice("etaoinshr") for _ in range(1_000_000))
    assert own.decode(own.encode(text)) == text
    assert not own.known
    memory = Remembered(1000)
    for i in range(100):
        memory.keep(i, i, 100)
        assert len(memory) + len(memory.old) <= 10
    assert memory.get(99) == 99 and memory.recall(94) == 94 and memory.recall(1) is None


def test_rows_and_digests(spark, documents):
    docs = documents((1, None), (2, "The thing\n\nthat <|endoftext|>is"), (2, "The thing\n\nthat <|endoftext|>is"), (None, "é")).withColumnRenamed("lang", "n_tokens")
    theirs = Tokenizer.from_file(JSON)
    want = []
    for i, t in ((1, ""), (2, "The thing\n\nthat <|endoftext|>is"), (2, "The thing\n\nthat <|endoftext|>is"), (None, "é")):
        ids = theirs.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted((tuple(r) for r in fragments.round_trip(docs, JSON, P.PATTERN).collect()), key=str) == sorted(want, key=str)
    encoded = fragments.encode_texts(docs, JSON, P.PATTERN)
    assert {(r.doc_id, r.text) for r in fragments.decode_texts(encoded, JSON, P.PATTERN).collect()} == {(1, ""), (2, "The thing\n\nthat <|endoftext|>is"), (None, "é")}
    assert fragments.round_trip(documents(), JSON, P.PATTERN).collect() == []
    with pytest.raises(ValueError, match="n_tokens"):
        fragments.round_trip(docs, JSON, P.PATTERN, keep=("doc_id", "n_tokens"))
