"""Count-min sketches that count to two, and sets of hashes, as bits of bounded size gathered from all partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tellerlake.llm.common import scramble

DEPTH = 2
BLOCK = 1 << 20
SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))
#: Cells of a sketch row (the upper bound is 64 MB a row once merged).
LEAST_CELLS, MOST_CELLS = 1 << 20, 1 << 29


def width_for(hashes: int) -> int:
    """Cells for a number of hashes: eight for each, within the bounds."""
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << max(0, 8 * hashes - 1).bit_length()))


def cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    return scramble(hashes ^ SEEDS[row]) & np.uint64(width - 1)


class Bits:
    """Merged sketch rows: the bits of the cells that count enough."""

    def __init__(self, width: int, blocks: Iterator[tuple[int, bytes]]):
        self.width, self.bits = width, [np.zeros(width // 8, np.uint8) for _ in range(DEPTH)]
        for block, bits in blocks:
            row, at = divmod(block * BLOCK, width)
            self.bits[row][at // 8 : at // 8 + len(bits)] = np.frombuffer(bits, np.uint8)

    def __contains__(self, hash_: int) -> bool:
        return bool(self.has(np.array([hash_], np.uint64))[0])

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for row in range(DEPTH):
            cell = cells(hashes, row, self.width)
            out &= (self.bits[row][(cell >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1 == 1
        return out


def gathered(rows: DataFrame, hashes_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], width: int, least: int) -> Bits:
    """The hashes that occur at least `least` (1 or 2) times, and a few others. Each partition sends the cells it hit; blocks of cells are merged apart,
    and what returns to the driver is bounded by the width."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(hashes_of(batches))
        hashes = np.concatenate(found) if found else np.empty(0, np.uint64)
        for row in range(DEPTH):
            cell = np.sort(cells(hashes, row, width))
            cut = np.searchsorted(cell, np.arange(0, width + BLOCK, BLOCK, dtype=np.uint64))
            for i in np.flatnonzero(np.diff(cut)).tolist():
                inside = (cell[cut[i] : cut[i + 1]] & np.uint64(BLOCK - 1)).astype(np.uint32)
                yield pa.record_batch([pa.array([row * (width // BLOCK) + i], pa.int32()), pa.array([inside.tobytes()], pa.binary())], names=["block", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, inside in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                once, twice = held.setdefault(block, (np.zeros(BLOCK // 8, np.uint8), np.zeros(BLOCK // 8, np.uint8)))
                cell, n = np.unique(np.frombuffer(inside, np.uint32), return_counts=True)
                new, more = np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)
                new[cell] = True
                more[cell[n > 1]] = True
                new, more = np.packbits(new), np.packbits(more)
                twice |= more | (once & new)
                once |= new
        for block, bits in held.items():
            yield pa.record_batch([pa.array([block], pa.int32()), pa.array([bits[least - 1].tobytes()], pa.binary())], names=["block", "bits"])

    parts = rows.mapInArrow(count, "block int, cells binary")
    merged = parts.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block").mapInArrow(merge, "block int, bits binary")
    return Bits(width, ((r.block, r.bits) for r in merged.collect()))  # one job; at most DEPTH * width bits


def first_half(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[np.ndarray]:
    """The first eight bytes of 16-byte keys."""
    for batch in batches:
        yield np.frombuffer(b"".join(batch.column(column).to_pylist()), np.uint64)[::2]
