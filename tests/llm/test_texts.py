"""Tokens, byte-level BPE, licences, benchmark passages and quality, against the libraries or brute force."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tellerlake.llm import bpe, contamination, licenses, quality, tokens

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
PIECES = ["a", "b", " ", "  ", "\n", "é", "ß", "中", "1", "22", "'s", "'ll", "!", "\x1c", "\x85", "\xa0", "\u2003", "\t", "the", "tion", "😀", "\u200b", "\u180e", "<|endoftext|>", "\r"]


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    return ["", " ", "  x", "x" * 5000, "word " * 3000, *("".join(rng.choice(PIECES) for _ in range(rng.randint(1, 40))) for _ in range(1500))]


def test_token_counts_equal_the_library(odd):
    t = Tokenizer.from_file(JSON)
    assert tokens.SegmentCounter(JSON).count(odd) == [len(e) for e in t.encode_batch(odd, add_special_tokens=False)]


def test_token_counts_of_rows(spark, documents):
    rows = tokens.token_counts(documents((1, None), (2, ""), (3, "é the the"), (3, "é the the"), (None, "x y")), JSON, 2).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == [(0, 3, 2, False), (1, 0, 0, False), (2, 0, 0, False), (3, 10, 3, True), (3, 10, 3, True)]
    assert tokens.token_counts(documents(), JSON, 2).collect() == []


def test_byte_bpe_equals_the_library(odd):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own, theirs = bpe.Codec(RANKS, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in odd:
        ids = own.encode(text)
        assert ids == theirs.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_memory_is_bounded_in_bytes(monkeypatch):
    """A word of 5 MB is not remembered, and many words are forgotten again; the answers stay those of the libraries."""
    monkeypatch.setattr(bpe, "PIECE_BYTES", 100_000)
    monkeypatch.setattr(bpe, "PAIR_BYTES", 20_000)
    monkeypatch.setattr(tokens, "SEGMENT_BYTES", 100_000)
    rng, counter, own = random.Random(3), tokens.SegmentCounter(JSON), bpe.Codec(RANKS, P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    theirs, library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(JSON)
    for _ in range(6):
        text = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 12))) for _ in range(2000))
        assert own.encode(text) == theirs.encode_ordinary(text)
        assert counter.count([text]) == [len(library.encode(text, add_special_tokens=False))]
        assert len(own.known) + len(own.known.old) <= 450 and len(own.fits) + len(own.fits.old) <= 90 and len(counter.known) + len(counter.known.old) <= 560
    long = "ab" * 2_500_000
    assert own.decode(own.encode(long)) == long.encode() and counter.count(["x " + long])[0] > 1_000_000
    assert max(map(len, [*own.known, *own.known.old])) <= 64 and max(map(len, [*counter.known, *counter.known.old])) <= 64


def test_byte_bpe_rows(spark, documents):
    docs = documents((1, None), (2, "The thing\n\nthat is"), (2, "The thing\n\nthat is")).withColumnRenamed("lang", "n_tokens")
    rows = bpe.round_trip(docs, RANKS, P.PATTERN).collect()
    assert {(r.doc_id, r.decoded_sha256) for r in rows} == {(1, hashlib.sha256(b"").hexdigest()), (2, hashlib.sha256(b"The thing\n\nthat is").hexdigest())}
    assert [r.ids for r in bpe.encode_texts(docs, RANKS, P.PATTERN).where("doc_id = 1").collect()] == [[]]


def places(words, phrase):
    n = len(phrase.split())
    return [i for i in range(len(words) - n + 1) if words[i : i + n] == phrase.split()]


def test_license_places_equal_brute_force():
    rng = random.Random(2)
    words = "under the mit license apache version 2 cc by nc x".split()
    for _ in range(500):
        text = " ".join(rng.choice(words) for _ in range(60))
        at = sorted(p for phrase in licenses.BASE for p in places(text.split(), phrase))
        got = licenses.scan(text.title().encode())
        assert (got["n_base"], got["first_word"], got["last_word"]) == (len(at), at[0] if at else None, at[-1] if at else None)
        assert got["base_labels"] == ",".join(sorted({label for phrase, label in licenses.BASE.items() if places(text.split(), phrase)}))


@pytest.mark.parametrize(("expression", "order", "labels", "grade"), [
    ("MIT OR GPL-3.0-only AND Apache-2.0", ["mit", "gpl-3", "apache-2", "and", "or"], {"mit", "gpl-3", "apache-2"}, 1.0),
    ("(MIT OR GPL-3.0-only) AND GPL-2.0", ["mit", "gpl-3", "or", "gpl-2", "and"], {"mit", "gpl-3", "gpl-2"}, 0.4),
    ("GPL-2.0 WITH Classpath-exception-2.0", ["gpl-2", "classpath-exception-2.0", "with"], {"gpl-2", "gpl-2-with-classpath-exception-2.0"}, 0.5),
    ("MIT AND", ["mit"], {"mit"}, 1.0), ("((MIT", ["mit"], {"mit"}, 1.0), (") MIT", [], set(), 0.0),
])
def test_license_expressions(expression, order, labels, grade):
    assert licenses.postfix(expression, 0) == order
    assert licenses.evaluate(order) == (labels, pytest.approx(grade))


def test_license_rows(spark, documents):
    rows = {r.doc_id: r for r in licenses.license_scan(documents((1, None), (2, "x\nSPDX-License-Identifier: (MIT OR Unknown-1)\ny"), (3, ""))).collect()}
    assert rows[2].labels == "mit,unknown-1" and rows[2].score == 1.0 and rows[2].base_labels == ""
    assert rows[1].labels == rows[3].labels == "" and rows[1].first_word is None


def test_tiles_cover_reordered_passages(spark, documents, prose):
    bench = spark.createDataFrame([(7, prose(1, 30)), (8, prose(2, 30)), (9, None), (10, "too short")], "item_id long, text string")
    moved = prose(5, 40) + " " + prose(1, 15, 15) + " " + prose(6, 9) + " " + prose(1, 15)
    docs = documents((1, moved.upper()), (2, prose(3, 200)), (3, None), (4, prose(2, 10)), (5, prose(2, 30)), (5, prose(2, 30)))
    got = contamination.contaminated_pairs(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.coverage, r.n_tiles) for r in got) == [(1, 7, 1.0, 2), (5, 8, 1.0, 1), (5, 8, 1.0, 1)]
    small = contamination.contaminated_pairs(docs, bench, block_bytes=10).collect()
    assert sorted(small) == sorted(got)
    assert sorted(r.doc_id for r in contamination.drop_contaminated(docs, bench).collect()) == [2, 3, 4]
    assert contamination.contaminated_pairs(docs, bench.limit(0)).collect() == []


def brute_tiles(text, item, shortest):
    """Greedy string tiling, a whole search for each tile."""
    a, b, total = [False] * len(text), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and not a[t + n] and not b[p + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        if best[0] < shortest:
            return total
        n, p, t = best
        a[t : t + n], b[p : p + n] = [True] * n, [True] * n
        total += n


def test_tiling_equals_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        item, text = ([rng.choice("abcd") for _ in range(n)] for n in (20, 60))
        seeds = contamination.Seeds([(1, " ".join(item).encode())], 3)
        found = seeds.found([" ".join(text).encode()])[0]
        assert (found[0][1] if found else 0.0) == pytest.approx(brute_tiles(text, item, 3) / 20)


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.quality_scores(docs, quality.train(docs, labels)).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0").toPandas()
    assert (scored.predicted == scored.quality).mean() > 0.95


def test_quality_votes_equal_brute_force():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 100 + 10 * (i % 2), 200).astype(np.uint8)) for i in range(60)]
    labels = np.arange(60) % 2.0
    model = quality.fit(np.stack([quality.frequencies(t) for t in texts]), labels, 0.7)
    v = model.vectors(np.stack([quality.frequencies(t) for t in texts[:10]]))
    for score, row in zip(model.scores(texts[:10]), v @ model.references.T, strict=True):
        near = np.argsort(-row)[: quality.NEIGHBOURS]
        w = np.maximum(row[near], 0).astype(float) ** quality.SHARPNESS
        assert score == pytest.approx((w * labels[near]).sum() / w.sum(), abs=1e-4)
    assert model.scores([b""]) == [0.7]


def test_quality_without_labels(spark, documents):
    docs = documents((1, None), (2, "abc"))
    model = quality.train(docs, spark.createDataFrame([(2, None)], "doc_id long, quality int"))
    assert [r.score for r in quality.quality_scores(docs, model).collect()] == [0.5, 0.5]
    assert quality.accepted_documents(docs.withColumnRenamed("lang", "score"), model).columns == ["doc_id", "text", "score", "source", "n_chars"]
