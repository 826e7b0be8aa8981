"""Product-quantised vector codes, with the nearest codebook entry found by a GNAT.

Vectors become integers and are cut into parts; a codebook of a few entries is learnt for each part by rounds of assignment and averaging, all in
integers. A geometric near-neighbour access tree over the entries answers each assignment: a node holds split points and, for every child, the range of
the distances from each split point to the child's entries. A query that lies further outside such a range than its best distance cannot find anything
nearer in that child, nor anything as near. Ranges, query distances and the comparison are rounded outwards, so only what is strictly further is
left out; what remains is compared by exact integer distance, ties by index.

Codebooks are bounded (parts x entries); each round sends one row of sums per part and entry out of each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellerlake.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Split points of a node; fewer entries than this are a leaf.
DEGREE = 4
#: Up to so many labels their sums are broadcast; more are joined on the label and one of SALTS.
BROADCAST_LABELS, SALTS = 100_000, 32
ROWS = 4096


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def squared(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer points."""
    apart = x[:, None, :] - points[None, :, :]
    return (apart * apart).sum(axis=2)


@dataclass
class Node:
    splits: np.ndarray  # indexes of the entries that split this node
    children: list[Node | None]
    low: np.ndarray  # [split, child]: no entry of the child is nearer to the split point
    high: np.ndarray  # [split, child]: nor further

    @staticmethod
    def of(entries: np.ndarray, members: np.ndarray) -> Node:
        """Split points far from each other (first the smallest index, then always the one furthest from all chosen), the rest with its nearest one."""
        if len(members) <= DEGREE:
            return Node(members, [], np.empty((0, 0)), np.empty((0, 0)))
        apart = squared(entries[members], entries[members])
        chosen = [0]
        while len(chosen) < DEGREE:
            gap = apart[:, chosen].min(axis=1)
            gap[chosen] = -1
            chosen.append(int(gap.argmax()))
        owner = apart[:, chosen].argmin(axis=1)
        rest = np.setdiff1d(np.arange(len(members)), chosen)
        low, high, children = np.zeros((DEGREE, DEGREE)), np.zeros((DEGREE, DEGREE)), []
        for j in range(DEGREE):
            below = rest[owner[rest] == j]
            children.append(Node.of(entries, members[below]) if len(below) else None)
            if len(below):
                root = np.sqrt(apart[below][:, chosen].astype(np.float64))
                low[:, j], high[:, j] = down(down(root)).min(axis=0), up(up(root)).max(axis=0)
        return Node(members[chosen], children, low, high)

    def search(self, entries: np.ndarray, x: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        """Improve the best squared distance and index of the given rows by the entries of this node."""
        apart = squared(x[rows], entries[self.splits])
        for at, i in enumerate(self.splits.tolist()):
            d = apart[:, at]
            better = (d < best[rows]) | ((d == best[rows]) & (i < index[rows]))
            best[rows[better]], index[rows[better]] = d[better], i
        if not self.children:
            return
        root = np.sqrt(apart.astype(np.float64))
        least, most = down(down(root)), up(up(root))
        for j, child in enumerate(self.children):
            if child is not None:
                radius = up(up(np.sqrt(best[rows].astype(np.float64))))[:, None]
                out = (down(least - self.high[:, j]) > radius) | (down(self.low[:, j] - most) > radius)
                alive = rows[~out.any(axis=1)]
                if len(alive):
                    child.search(entries, x, alive, best, index)


def assign(x: np.ndarray, entries: np.ndarray, tree: Node) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row (ties: the smallest index) and the squared distance."""
    best, index = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(entries))
    if len(x):
        tree.search(entries, x, np.arange(len(x)), best, index)
    return index, best


def usable(vectors: DataFrame, vector: str, parts: int, scale: int, kept: dict[str, Column]) -> DataFrame:
    """Kept columns and `v`, the integers floor(scale * component), of vectors without null or non-finite components."""
    v = vectors.select(*(c.alias(name) for name, c in kept.items()), F.col(vector).cast("array<double>").alias("v")).where("v is not null and size(v) > 0")
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).where(F.size("v") % parts == 0)
    fits = F.forall("v", lambda x: F.abs(x * scale) < float(1 << 27))
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("long"))
    return v.withColumn("v", F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a component times {scale} is not below 2^27"))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def codes(batch: pa.RecordBatch, books: np.ndarray, trees: list[Node]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of rows: where the block begins, its parts, their entries and squared distances (rows x parts)."""
    parts, _, width = books.shape
    x = matrix(batch.column(batch.num_columns - 1), parts * width).reshape(-1, parts, width)
    for begin in range(0, len(x), ROWS):
        block = x[begin : begin + ROWS]
        found = [assign(block[:, p], books[p], trees[p]) for p in range(parts)]
        yield begin, block, np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def learn(known: DataFrame, start: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks (parts x entries x width) after the rounds. An entry becomes the floor of the mean of its parts; one that has none stays."""
    parts, entries, width = start.shape
    sums = ", ".join(f"s{i} long" for i in range(width))
    books = start
    for _ in range(rounds):

        def add(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            trees = [Node.of(b, np.arange(entries)) for b in books]
            count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
            for batch in batches:
                for _, block, index, _ in codes(batch, books, trees):
                    for p in range(parts):
                        count[p] += np.bincount(index[:, p], minlength=entries)
                        np.add.at(total[p], index[:, p], block[:, p])
            at = np.flatnonzero(count.ravel())
            columns = [at, count.ravel()[at], *total.reshape(-1, width)[at].T]
            yield pa.record_batch([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], names=["entry", "n", *(f"s{i}" for i in range(width))])

        partial = known.select("v").mapInArrow(add, f"entry long, n long, {sums}")
        books = books.copy()
        for row in partial.groupBy("entry").agg(*(F.sum(c).alias(c) for c in ["n", *(f"s{i}" for i in range(width))])).collect():  # parts x entries rows at most
            books[row.entry // entries, row.entry % entries] = [row[f"s{i}"] // row.n for i in range(width)]
    return books


@dataclass
class Compressed:
    rows: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components of the codebooks by part, entry and place, as decimals between commas."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Compressed:
    """`vec_id`, `label`, `code` (two hexadecimal digits a part), `error` (squared distances to the entries, summed over the parts) and `label_error`
    (the errors of all rows with the label, nulls together), a row for each usable vector, beside the codebooks.

    Left out are vectors that are null, empty or hold null or non-finite components, and, as they cannot share codebooks, those whose length is no
    multiple of `parts` or not the most frequent one (the larger of equally frequent ones). A component of 2^27 / scale or more raises an error: sums of
    squares would leave 64 bits. Codebooks start from the rows with the smallest ids; rows of one id stand in the order of their integers, rows without
    id after all others, and fewer rows than `entries` make smaller codebooks. Repeated rows all count. Ties go to the lower index. An empty table has
    an empty result and empty codebooks. Other columns are left out, so their names do not matter."""
    known = written(usable(vectors, vector, parts, scale, {"vec_id": F.col(ident), "label": F.col(label)}), "vectors")
    lengths = known.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = lengths.n if lengths else parts
    known = known.where(F.size("v") == length)
    first = np.array([r.v for r in known.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()], np.int64).reshape(-1, parts, length // parts)
    start = np.ascontiguousarray(first.transpose(1, 0, 2))
    books = learn(known, start, rounds) if len(first) else start

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Node.of(b, np.arange(books.shape[1])) for b in books]
        for batch in batches:
            for begin, block, index, apart in codes(batch, books, trees):
                code = [bytes(row).hex() for row in index.astype(np.uint8)]
                held = batch.slice(begin, len(block))
                yield pa.record_batch([held.column(0), held.column(1), pa.array(code, pa.string()), pa.array(apart.sum(axis=1), pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = {c: known.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    coded = written(known.mapInArrow(encode, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long"), "codes")
    return Compressed(with_sums(coded, "label", "error", "label_error"), books)


def with_sums(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """The rows with the sum of `value` over all rows of equal `by`, nulls together. No group meets in one task: sums are combined before the shuffle and
    broadcast if they are few, else joined on the group and a salt."""
    sums = written(rows.groupBy(F.col(by).alias("group")).agg(F.sum(value).alias(name)), "sums")
    if sums.count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(sums), F.col(by).eqNullSafe(F.col("group")), "left").drop("group")
    salted = sums.withColumn("own", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, F.col(by).eqNullSafe(F.col("group")) & (F.col("salt") == F.col("own")), "left").drop("group", "own", "salt")
