"""Byte-balanced Arrow batches, words, shingle hashes and tables written between stages."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tellerlake.session import scratch

SLICE_BYTES = 1 << 20
#: Bytes of text whose words are hashed at once: some eight arrays of 64 bits for each byte are in memory together.
WORDS_BYTES = 1 << 18
#: Rows of an Arrow batch that holds whole texts: batches of the usual size take hundreds of MB of an executor.
ARROW_ROWS = 1024

#: A-Z to a-z; everything that is neither a letter, a digit nor beyond ASCII to a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Tab, line feed, vertical tab, form feed and carriage return to a blank.
PLAIN = bytes(32 if 9 <= b <= 13 else b for b in range(256))
ADJACENT_SPACE = re.compile(r"[\s\u180e][\s\u180e]")
SAFE_BOUNDARY = re.compile(r"(?<=[^\s\u180e]) ")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: later stages do not depend on the executors that made them."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Arrow batches of at most so many rows for the jobs that run inside; the session's own setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, own)


def whole_texts(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches of at most `ARROW_ROWS` rows from here on: frames that carry whole texts run after their query has returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)
    return spark


def give_back() -> None:
    """Memory that a task has freed goes back to the system: Python workers outlive their tasks, and each keeps what its largest one took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # not in every C library
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about `limit` bytes of the column (a longer row stands alone). What the pieces took is given back
    after the last one."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if begin < batch.num_rows:
            yield batch.slice(begin)
    give_back()


def map_texts(docs: DataFrame, text: str, keep: dict[str, str], fields: list[T.StructField], work: Callable[[list[bytes]], dict[str, list]], done: Callable[[], None] | None = None) -> DataFrame:
    """Kept columns ({output: input}) beside what `work` makes of the whole texts of a slice (UTF-8; null as empty). `done` is called when a task ends."""
    chosen = docs.select(*(docs[c].alias(f"k{i}") for i, c in enumerate(keep.values())), docs[text].cast("binary").alias("text"))
    schema = T.StructType([T.StructField(name, docs.schema[c].dataType) for name, c in keep.items()] + fields)
    names, at = list(keep), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        try:
            for part in slices(batches, at):
                made = work([t or b"" for t in part.column(at).to_pylist()])
                columns = [part.column(i) for i in range(at)] + [made[f.name] for f in fields]
                yield pa.record_batch([c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], names=[*names, *(f.name for f in fields)])
        finally:
            if done:
                done()
            give_back()

    return chosen.mapInArrow(run, schema)


def filter_texts(docs: DataFrame, text: str, keeps: Callable[[list[bytes]], list[bool]]) -> DataFrame:
    """The rows, all columns as they are, whose whole text `keeps` accepts (null as empty). No shuffle."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            texts = part.column(at).cast(pa.large_binary() if pa.types.is_large_string(part.column(at).type) else pa.binary()).to_pylist()
            yield part.filter(pa.array(keeps([t or b"" for t in texts]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def segments(text: str) -> list[str]:
    """Cut a text before blanks that stand between other characters, where byte-level patterns always cut; all but the first lack their blank."""
    return SAFE_BOUNDARY.split(text) if ADJACENT_SPACE.search(text) else text.split(" ")


def folded_words(text: bytes) -> list[bytes]:
    """Words of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(FOLD).split()


class Remembered(dict):
    """Results by key within a bound of bytes (by the caller's estimates): when half is used, what was not asked for since is forgotten."""

    def __init__(self, limit: int):
        super().__init__()
        self.half, self.held, self.old = limit // 2, 0, {}

    def keep(self, key, value, size: int) -> None:
        if self.held + size > self.half:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += size
        self[key] = value

    def forget(self) -> None:
        self.clear()
        self.old, self.held = {}, 0

    def recall(self, key):
        """The result of an earlier half, or None."""
        return self.old.get(key)


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return np.random.default_rng(101).integers(1, 1 << 64, 256, dtype=np.uint64)


@lru_cache(maxsize=2)
def powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


BASE = 0x9E3779B97F4A7C17
INVERSE = pow(BASE, -1, 1 << 64)


def scramble(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, after `table` is applied (blanks then separate words), and where each text's words begin.

    A word is a polynomial over its bytes: the difference of two running sums over all bytes, shifted to the word's begin."""
    data = np.frombuffer(b" ".join([*texts, b""]).translate(table), np.uint8)
    edge = np.diff((data != 32).view(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bits = max(19, (len(data) - 1).bit_length())
    total = np.cumsum(byte_values()[data] * powers(BASE, bits)[: len(data)])
    before = np.where(begin > 0, total[begin - 1], np.uint64(0))
    hashes = scramble((total[end - 1] - before) * powers(INVERSE, bits)[begin])
    return hashes, np.searchsorted(begin, np.cumsum([0, *(len(t) + 1 for t in texts)]))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (none in shorter lists), by doubling."""
    join = lambda a, b, n, m: a[: len(b) - n] * np.uint64(pow(BASE, m, 1 << 64)) + b[n:]  # noqa: E731  a of n words, then b of m
    if len(words) < k:
        return np.empty(0, np.uint64)
    out, size, part, length = None, 0, words, 1
    while True:
        if k & length:
            out, size = (part, length) if out is None else (join(out, part, size, length), size + length)
        if size == k:
            return scramble(out)
        part, length = join(part, part, length, length), 2 * length
