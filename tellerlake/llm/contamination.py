"""Benchmark passages in documents, by greedy string tiling.

Benchmark items are read in blocks of bounded bytes; a block's word 5-grams are the seeds that every executor gets. A document that shares seeds
with an item is tiled against it: the longest common runs of words that no tile covers yet (found by running Karp-Rabin hashes of five words and
grown along their diagonal) are marked again and again, so reordered passages count in full. Coverage is the share of the item's words in tiles.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellerlake.llm.common import FOLD, filter_texts, grams, map_texts, word_hashes

SHORTEST = 5
COVERAGE = 0.5
BLOCK_BYTES = 8 << 20
FILTER_BITS = 20


def tiles(places: list[tuple[int, int]], shortest: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, place in the item, place in the text) from places (text, item) at which `shortest` equal words begin."""
    queue, run = [], None
    for diagonal, p in sorted((t - p, p) for t, p in places):
        if run and run[0] == diagonal and p == run[2] + 1:
            run[2] = p
            continue
        if run:
            queue.append((-(run[2] - run[1] + shortest), run[1], run[1] + run[0]))
        run = [diagonal, p, p]
    if run:
        queue.append((-(run[2] - run[1] + shortest), run[1], run[1] + run[0]))
    heapq.heapify(queue)
    in_item, in_text, out = set(), set(), []
    while queue:
        length, p, t = heapq.heappop(queue)
        free, begin = [], None
        for i in range(-length + 1):
            ok = i < -length and p + i not in in_item and t + i not in in_text
            if ok and begin is None:
                begin = i
            elif not ok and begin is not None:
                free.append((begin, i - begin))
                begin = None
        if free == [(0, -length)]:
            out.append((-length, p, t))
            in_item.update(range(p, p - length))
            in_text.update(range(t, t - length))
        else:
            for i, n in free:
                if n >= shortest:
                    heapq.heappush(queue, (-n, p + i, t + i))
    return out


class Seeds:
    """The 5-grams of a block of items: sorted hashes, each with its (item, place) entries."""

    def __init__(self, items: list[tuple[int, bytes]], shortest: int = SHORTEST):
        hashes, rows, self.lengths = [], [], {}
        for n, (_, text) in enumerate(items):
            words, _ = word_hashes([text], FOLD)
            self.lengths[n] = len(words)
            for place, h in enumerate(grams(words, shortest).tolist()):
                hashes.append(h)
                rows.append((n, place))
        order = np.argsort(np.array(hashes, np.uint64), kind="stable")
        self.hashes = np.array(hashes, np.uint64)[order]
        self.rows = [rows[i] for i in order]
        self.ids, self.shortest = [i for i, _ in items], shortest
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[self.hashes & np.uint64((1 << FILTER_BITS) - 1)] = True

    def found(self, texts: list[bytes]) -> list[list[tuple[int, float, int, int]]]:
        """For each text (item number, coverage, tiles, longest tile) of the items that share a seed with it."""
        words, bounds = word_hashes(texts, FOLD)
        own = grams(words, self.shortest)
        maybe = np.flatnonzero(self.seen[(own & np.uint64(len(self.seen) - 1)).astype(np.int64)])
        text = np.searchsorted(bounds, maybe, "right") - 1
        inside = maybe + self.shortest <= bounds[text + 1]  # runs that end in the text they begin in
        maybe, text = maybe[inside], text[inside]
        left, right = np.searchsorted(self.hashes, own[maybe], "left"), np.searchsorted(self.hashes, own[maybe], "right")
        places: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for t, d, a, b in zip((maybe - bounds[text]).tolist(), text.tolist(), left.tolist(), right.tolist(), strict=True):
            for item, p in self.rows[a:b]:
                places.setdefault((d, item), []).append((t, p))
        out: list[list[tuple[int, float, int, int]]] = [[] for _ in texts]
        for (d, item), at in places.items():
            made = tiles(at, self.shortest)
            out[d].append((item, sum(x[0] for x in made) / self.lengths[item], len(made), max(x[0] for x in made)))
        return out


def blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """Items in blocks of about `limit` bytes, one at a time on the driver."""
    held, size = [], 0
    for row in benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where(F.col(text).isNotNull()).toLocalIterator():
        held.append((row.i, row.t.encode()))
        size += len(held[-1][1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and item whose words are covered by tiles to at least `coverage`: kept columns, `item_id`, `coverage`, `n_tiles`,
    `longest`, `contaminated` (true). Null texts and items, and items under five words, match nothing; repeated rows are judged one by one."""
    made = [T.StructField("item_id", benchmark.schema[item].dataType), T.StructField("coverage", T.DoubleType()), T.StructField("n_tiles", T.IntegerType()), T.StructField("longest", T.IntegerType())]
    fields = [T.StructField("found", T.ArrayType(T.StructType(made)))]
    parts = []
    for held in blocks(benchmark, item, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Seeds(held))

        def work(texts: list[bytes], shared=shared) -> dict[str, list]:
            ids = shared.value.ids
            return {"found": [[{"item_id": ids[n], "coverage": c, "n_tiles": k, "longest": m} for n, c, k, m in found if c >= coverage] for found in shared.value.found(texts)]}

        parts.append(map_texts(docs, text, {c: c for c in keep}, fields, work))
    if not parts:
        parts = [map_texts(docs.limit(0), text, {c: c for c in keep}, fields, lambda texts: {"found": [[] for _ in texts]})]
    return reduce(DataFrame.unionByName, parts).select(*keep, F.explode("found").alias("found")).select(*keep, "found.*", F.lit(True).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents, all columns as they are, that no item covers; one pass for each block of items."""
    for held in blocks(benchmark, item, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Seeds(held))

        def keeps(texts: list[bytes], shared=shared) -> list[bool]:
            return [all(c < coverage for _, c, _, _ in found) for found in shared.value.found(texts)]

        docs = filter_texts(docs, text, keeps)
    return docs
