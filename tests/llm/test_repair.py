"""Conversation repair against a plain version that tries every edit."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from tellerlake.llm import queries, repair

PLAIN = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        s = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        kept = out.setdefault(conv, [])
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        kept += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    return {conv: sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for conv, kept in out.items()}


def brute_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines) of one conversation's damaged rows."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(PLAIN)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    @lru_cache(maxsize=None)
    def best(i, last, budget):
        """Least (cost, audit, lines) from row i on after a row of role `last`, with so many insertions left."""
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        follows = {"": "us", "s": "u", "u": "a", "a": "u"}[last]
        name = {"u": "user", "a": "assistant", "s": "system"}
        if budget:
            for to in follows.replace("s", ""):
                c, audit, lines = best(i, to, budget - 1)
                found.append((c + 5, "I" + audit, (f"{name[to]}:", *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            c, audit, lines = best(i + 1, last, budget)
            found.append((c + 2, "D" + audit, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                if role[:1] and role[:1] in follows:
                    c, audit, lines = best(i + 1, role[0], budget)
                    found.append((c + more, "K" + audit, (f"{role}:{text}", *lines)))
                for to in follows.replace("s", ""):
                    c, audit, lines = best(i + 1, to, budget)
                    found.append((c + 1 + more, "R" + audit, (f"{name[to]}:{text}", *lines)))
        return min(found, default=(10**9, "", ()))

    return gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, *best(0, "", len(rows) + 2)


def odd_rows(rng, conv, n):
    texts = ["One.", "Two", "Three!", "Four? \n", " \t", "", "Five\x85", None, "Six.", "Seven.", "Eight."]
    return [(conv, rng.choice([None, i, i, i + 1]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "Unknown", "", None, "users"]), rng.choice(texts)) for i in range(n)]


def checked(spark, rows, want):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS place", "2 AS cost")
    turns = repair.ordered(repair.damaged(frame)).cache()
    found = repair.report(turns).cache()
    repaired = {}
    for r in repair.repaired_rows(turns, found).orderBy("place").collect():
        repaired.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    hashed = {r.conv_id: r.repaired_sha256 for r in repair.digests(turns, found).collect()}
    got = {r.conv_id: r for r in found.collect()}
    assert got.keys() == want.keys() == hashed.keys()
    for conv, r in got.items():
        *numbers, lines = want[conv]
        assert tuple(r)[1:] == tuple(numbers), (conv, r, want[conv])
        assert repaired.get(conv, []) == list(lines)
        assert hashed[conv] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_equals_trying_every_edit(spark):
    rng = random.Random(3)
    rows = [r for conv in [None, *range(250)] for r in odd_rows(rng, conv, rng.randint(1, 9))]
    checked(spark, rows, {conv: brute_repair(kept) for conv, kept in brute_damage(rows).items()})


def test_blocks_of_a_long_conversation(spark, monkeypatch):
    """Conversations of several blocks have the answer of one search; the block is small here so that brute force can follow."""
    monkeypatch.setattr(repair, "BLOCK_ROWS", 4)
    rng = random.Random(4)
    rows = [r for conv in range(25) for r in odd_rows(rng, conv, rng.randint(3, 24))]
    checked(spark, rows, {conv: brute_repair(kept) for conv, kept in brute_damage(rows).items()})


def test_search_in_blocks_equals_one_search():
    rng = random.Random(6)
    for _ in range(300):
        codes = "".join(rng.choice("xsuaouaSUAO") for _ in range(rng.randint(1, 14)))
        cost, audit, _ = repair.search(codes, repair.BEGIN, repair.ACCEPTED, True)
        for size in (1, 3, 5):
            cut = [codes[i : i + size] for i in range(0, len(codes), size)]
            assert repair.chained([repair.ways(c, i == 0, i + 1 == len(cut)) for i, c in enumerate(cut)]) == (cost, audit)


def test_long_texts_and_long_conversations_end(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"Row {i}.") for i in range(2000)] + [(4, 0, "user", "x" * 3_000_000 + "." + " " * 1_000_000), (4, 1, "assistant", "y.")]
    turns = repair.ordered(repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).cache()
    got = {r.conv_id: r for r in repair.report(turns).collect()}
    assert got[4].cost == 0 and got[4].audit == "KK"
    assert len(got[1].audit.replace("I", "")) == len(brute_damage(rows)[1])
    assert {r.conv_id for r in repair.digests(turns, repair.report(turns)).collect()} == {1, 4}


def test_empty_table(spark):
    turns = repair.ordered(repair.damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))
    found = repair.report(turns)
    assert found.collect() == repair.repaired_rows(turns, found).collect() == repair.digests(turns, found).collect() == []


def test_query_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {conv: brute_repair(kept) for conv, kept in brute_damage(rows).items()}
    got = {r.conv_id: r.asDict() for r in queries.QUERIES["op11_conversation_repair"](spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == want.keys()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    for conv, (*numbers, lines) in want.items():
        assert [got[conv][n] for n in names] == numbers
        assert got[conv]["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


if __name__ == "__main__":
    pytest.main([__file__])
