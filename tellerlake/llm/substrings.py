"""Removal of passages that repeat across or within documents.

A window is `size` consecutive words. Every window is represented by the smallest hash among its runs of `GRAM` words, so equal windows have equal
representatives and a text has about one for every twelve words. Partitions add their representatives to count-min sketches (counters that stop at
two), the sketches are merged block by block, and the merged one overestimates how often a window occurs: what it counts once is unique. Only windows
estimated repeated are grouped in a second pass, by exact keys: first runs of neighbouring windows that share a representative, then, in a last pass
over representatives that different runs share, each window. A key is the hash of the representative and that of the run or window. Nothing repeated
is lost; a full sketch only lets more windows pass to grouping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellerlake.llm.common import PLAIN, WORDS_BYTES, grams, scramble, slices, word_hashes, written
from tellerlake.llm.sketches import first_half, gathered, width_for

SIZE = 35
GRAM = 12
PLACE_BITS = 30
#: Bytes of text for each representative, about.
OCTETS_A_REPRESENTATIVE = 64


def least_of(values: np.ndarray, n: int) -> np.ndarray:
    """The smallest of every n neighbours, by doubling."""
    held, length = values, 1
    while 2 * length <= n:
        held, length = np.minimum(held[:-length], held[length:]), 2 * length
    return np.minimum(held[: len(held) - (n - length)], held[n - length :]) if n > length else held


def representatives(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Representative hash, first window and number of windows of each run of windows of one text that share a representative's place.

    Places compare by the upper bits of their hash, equal ones from the left, so equal windows choose alike."""
    if len(words) < size:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    gram = min(GRAM, size)
    hashes, low = grams(words, gram), np.uint64((1 << PLACE_BITS) - 1)
    place = (least_of((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), size - gram + 1) & low).astype(np.int64)
    whole = np.zeros(len(words) + 1, bool)  # windows that end within the text they begin in
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        whole[a : max(a, b - size + 1)] = True
    window = np.flatnonzero(whole[: len(place)])
    if not len(window):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.flatnonzero(np.r_[True, np.diff(place[window]) != 0])
    return hashes[place[window[cut]]], window[cut], np.diff(np.r_[cut, len(window)])


def runs_of(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, ...]:
    """Words and text bounds of a batch (text first), and its runs: representatives, first windows, numbers of windows."""
    words, bounds = word_hashes([t or b"" for t in part.column(0).to_pylist()], PLAIN)
    return words, bounds, *representatives(words, bounds, size)


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def candidate_runs(texts: DataFrame, size: int, seen) -> DataFrame:
    """Runs whose representative is estimated repeated: text key, representative, hash of the run, its place and number of windows. At most as many
    windows share a representative's place as the first and the last one cover together, so these two and the number name the run."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0, WORDS_BYTES):
            words, bounds, hashes, begin, n = runs_of(part, size)
            take = seen.value.has(hashes)
            hashes, begin, n = hashes[take], begin[take], n[take]
            if len(n):
                windows, text = grams(words, size), np.searchsorted(bounds, begin, "right") - 1
                run = scramble(scramble(windows[begin] + n.astype(np.uint64)) + windows[begin + n - 1])
                yield pa.record_batch([part.column(1).take(pa.array(text)), signed(hashes), signed(run), pa.array((begin - bounds[text]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["key", "rep", "run", "begin", "n"])

    return texts.mapInArrow(find, "key binary, rep long, run long, begin int, n int")


def candidate_windows(texts: DataFrame, size: int, mixed) -> DataFrame:
    """The windows, one by one, of representatives that different runs share: text key, representative, hash of the window, place."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0, WORDS_BYTES):
            words, bounds, hashes, begin, n = runs_of(part, size)
            take = mixed.value.has(hashes)
            hashes, begin, n = hashes[take], begin[take], n[take]
            if len(n):
                ends = np.cumsum(n)
                at = np.arange(ends[-1]) + np.repeat(begin - (ends - n), n)
                text = np.repeat(np.searchsorted(bounds, begin, "right") - 1, n)
                yield pa.record_batch([part.column(1).take(pa.array(text)), signed(np.repeat(hashes, n)), signed(grams(words, size)[at]), pa.array((at - bounds[text]).astype(np.int32))], names=["key", "rep", "window", "begin"])

    return texts.mapInArrow(find, "key binary, rep long, window long, begin int")


def repeated_spans(texts: DataFrame, size: int = SIZE) -> DataFrame:
    """`key`, `spans` (array of first window, windows) of the texts (columns text, key) that hold windows which also start elsewhere."""
    spark = texts.sparkSession
    octets = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    width = width_for(octets // OCTETS_A_REPRESENTATIVE)
    of_texts = lambda batches: (runs_of(part, size)[2] for part in slices(batches, 0, WORDS_BYTES))
    of_values = lambda batches: (b.column(0).to_numpy().view(np.uint64) for b in batches)
    seen = spark.sparkContext.broadcast(gathered(texts.select("text"), of_texts, width, 2))
    found = written(candidate_runs(texts, size, seen), "runs")
    copies = written(found.groupBy("rep", "run").agg(F.count("*").alias("copies")), "copies")
    mixed = spark.sparkContext.broadcast(gathered(copies.groupBy("rep").agg(F.count("*").alias("runs")).where("runs > 1").select("rep"), of_values, width, 1))
    single = written(candidate_windows(texts, size, mixed), "windows")
    again = single.groupBy("rep", "window").agg(F.count("*").alias("places")).where("places > 1").select("rep", "window")
    edges = single.join(again, ["rep", "window"]).select("key", "begin", F.lit(1).alias("n"))
    whole = found.join(copies.where("copies > 1").select("rep", "run"), ["rep", "run"]).select("key", "begin", "n")
    return whole.unionByName(edges).groupBy("key").agg(F.collect_set(F.struct("begin", "n")).alias("spans"))


def without_repeats(docs: DataFrame, size: int = SIZE, text: str = "text", names: tuple[str, str, str] = ("n_words", "n_removed", "kept")) -> DataFrame:
    """Documents, all columns as they are, with the number of words, the words removed and the words kept (joined by one blank).

    Words are the pieces between blanks, tabs, line feeds, vertical tabs, form feeds and carriage returns. Nulls and texts under `size` words lose
    nothing; each row counts as a text of its own, so repeated rows lose all they share. Columns that `names` clash with are the caller's to rename.
    Only texts that hold repeated windows, and a few others, are shuffled to meet them.
    """
    inputs, at = [docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)], len(docs.columns)
    own = [c.lower() for c in docs.columns].index(text.lower())  # a text travels once, as the column it is
    keyed = docs.select(*inputs, docs[text].cast("binary").alias("text")).withColumn("key", F.unhex(F.md5("text")))
    spans = written(repeated_spans(keyed.select("text", "key"), size), "spans")
    named = docs.sparkSession.sparkContext.broadcast(gathered(spans.select("key"), first_half, width_for(spans.count()), 1))

    def rows_named(batches: Iterator[pa.RecordBatch], wanted: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(at)
            holds = np.zeros(len(key), bool)
            known = key.is_valid().to_numpy(zero_copy_only=False)  # null texts have no key
            holds[known] = named.value.has(next(first_half(iter([batch.select(["key"]).filter(key.is_valid())]))))
            yield batch.filter(pa.array(holds == wanted))

    shown = [f"c{i}" for i in range(at)]
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)] + [T.StructField("words", T.LongType()), T.StructField("removed", T.LongType()), T.StructField("kept", T.BinaryType())])

    def stripped(part: pa.RecordBatch, held: list) -> pa.RecordBatch:
        total, removed, kept = [], [], []
        for t, spans in zip(part.column(own).cast(pa.binary()).to_pylist(), held, strict=True):
            words = (t or b"").split()
            total.append(len(words))
            edge = np.zeros(len(words) + 1, np.int64)
            for s in spans or ():
                edge[s["begin"]] += 1
                edge[s["begin"] + s["n"] + size - 1] -= 1
            stay = np.cumsum(edge[:-1]) == 0
            kept.append(b" ".join([w for w, k in zip(words, stay.tolist(), strict=True) if k] if spans else words))
            removed.append(int(len(words) - stay.sum()))
        return pa.record_batch([*(part.column(i) for i in range(at)), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=[f.name for f in schema])

    def chosen(wanted: bool) -> DataFrame:
        """The rows that may hold repeats as they are, for the join; all others with what they keep, in one function: a second one in the same stage
        would need a Python worker of its own for each task, and an executor keeps it."""

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = rows_named(batches, wanted)
            yield from rows if wanted else (stripped(part, [None] * part.num_rows) for part in slices(rows, own, WORDS_BYTES))

        named_rows = keyed.select(*shown, "key")
        return named_rows.mapInArrow(some, named_rows.schema if wanted else schema)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (stripped(part, part.column(at).to_pylist()) for part in slices(batches, own, WORDS_BYTES))

    joined = chosen(True).join(spans.hint("merge"), "key", "left").select(*shown, "spans")  # a broadcast would put both functions into one stage
    out = joined.mapInArrow(strip, schema).unionByName(chosen(False)).withColumn("kept", F.col("kept").cast("string"))
    return out.toDF(*docs.columns, *names)
