"""Near duplicates by improved consistent weighted sampling over TF-IDF weighted word shingles.

A text is the set of its five-word shingles (letters and digits, A-Z lower-cased), each weighted by its count times an idf between 1 and 2 taken over
all documents. Each of a shingle's three random variates is looked up by bits of its hash of their own, so two shingles share samples only if 45 bits
agree, and unrelated texts stay unlike at any length. Bands of samples name buckets. Bands are four samples long, so that few texts which only
share a passage or a template meet by chance, however many there are. In a bucket texts are compared with one leader, the text that shares most buckets
with others (near copies agree most with the copy nearest to their common source). While texts of a bucket are not all connected, they meet its next
`HUBS` by that rank and `OTHERS` by hash, other ones each turn, until a turn links nothing new. Of these pairs, linear in the rows whatever the size of a
bucket, those that agree in at least `PROMISING` samples (by a byte of each) are read; the rest is left to the exact join. Texts of buckets that are still mixed are then joined exactly: two texts that reach the threshold share a shingle among the rarest fifth of each,
in a place that leaves enough weight behind it, so every pair of them that is not yet connected is compared or cannot be a link. Pairs of leaders
whose samples hardly agree are not read. A link is a weighted Jaccard similarity of at least 0.8. Equal texts are one key
throughout.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tellerlake.llm.common import ARROW_ROWS, BASE, FOLD, WORDS_BYTES, arrow_rows, give_back, grams, scramble, slices, word_hashes, written
from tellerlake.llm.components import components, regrouped
from tellerlake.llm.sketches import first_half, gathered, width_for

SHINGLE = 5
THRESHOLD = 0.8
HASHES, BANDS = 88, 22
AGREEING, PROMISING = 53, 66
HUBS, OTHERS = 4, 4
PLACES, CHUNK = 1 << 15, 2048
IDF_BUCKETS, IDF_BLOCK = 1 << 20, 1 << 14
SEED = 20260
SLACK = 1 + 1e-6  # of bounds on sums of weights, which are not added in one order


def shingles(texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles and their counts, of each text; a text of fewer than five words is one shingle, one without words none."""
    words, bounds = word_hashes([t or b"" for t in texts], FOLD)
    hashes, out = grams(words, SHINGLE), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out.append(np.unique(hashes[a : b - SHINGLE + 1] if b - a >= SHINGLE else grams(words[a:b], b - a) if b > a else hashes[:0], return_counts=True))
    return out


def weights(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return counts * idf[(hashes & np.uint64(IDF_BUCKETS - 1)).astype(np.int64)].astype(np.float64)


@lru_cache(maxsize=1)
def variates() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of r, 1 - beta and ln c, for each place and hash."""
    rng = np.random.default_rng(SEED)
    shape = (PLACES, HASHES)
    r, c = (-np.log(1 - rng.random(shape, np.float32)) - np.log(1 - rng.random(shape, np.float32)) + np.float32(1e-6) for _ in range(2))
    beta = rng.random(shape, np.float32)
    return r, 1 - beta, np.log(c)


def samples(found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Samples of texts (shingles and weights, none empty). The smallest value of ln a names its sample (shingle and level), so values are compared,
    not shingles."""
    r, low, least_c = variates()
    hashes, weight = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    at, level = [((hashes >> np.uint64(b)) & np.uint64(PLACES - 1)).astype(np.int64) for b in (49, 34, 19)], np.log(weight).astype(np.float32)
    ends = np.cumsum([len(f[0]) for f in found])
    least = np.full((len(found), HASHES), np.inf, np.float32)
    for i in range(0, len(hashes), CHUNK):
        x, y, z = (a[i : i + CHUNK] for a in at)
        step, above = r[x], low[y]
        value = np.floor(level[i : i + CHUNK, None] / step + (1 - above))
        value += above
        value *= step
        np.subtract(least_c[z], value, out=value)
        first, last = np.searchsorted(ends, (i, i + len(x) - 1), "right")  # texts that the chunk touches
        begins = np.maximum(np.r_[0, ends][first : last + 1] - i, 0)
        least[first : last + 1] = np.minimum(least[first : last + 1], np.minimum.reduceat(value, begins, axis=0))
    return least


def bands(drawn: np.ndarray) -> np.ndarray:
    """Bucket names: hashes of the samples of each band."""
    rows = scramble(drawn.view(np.uint32).astype(np.uint64).reshape(len(drawn), BANDS, -1) + np.uint64(1))
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(drawn), 1))
    for j in range(rows.shape[2]):
        out = scramble(out * np.uint64(BASE) + rows[:, :, j])
    return out.view(np.int64)


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """1 + ln((n+1)/(df+1)) / ln(n+1) of each hashed shingle over all texts; partial counts are merged block by block."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(IDF_BUCKETS, np.uint32), 0
        for part in slices(batches, 0, WORDS_BYTES):
            for hashes, _ in shingles(part.column(0).to_pylist()):
                held[np.unique(hashes & np.uint64(IDF_BUCKETS - 1)).astype(np.int64)] += 1
                n += len(hashes) > 0
        for b in range(IDF_BUCKETS // IDF_BLOCK if n else 0):
            yield pa.record_batch([pa.array([b], pa.int32()), pa.array([n if b == 0 else 0], pa.int64()), pa.array([zlib.compress(held[b * IDF_BLOCK : (b + 1) * IDF_BLOCK].tobytes(), 1)], pa.binary())], names=["block", "n", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for b, n, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = total.setdefault(b, [0, np.zeros(IDF_BLOCK, np.int64)])
                held[0] += n
                held[1] += np.frombuffer(zlib.decompress(counts), np.uint32)
        for b, (n, counts) in total.items():
            yield pa.record_batch([pa.array([b], pa.int32()), pa.array([n], pa.int64()), pa.array([counts.tobytes()], pa.binary())], names=["block", "n", "counts"])

    schema = "block int, n long, counts binary"
    n, df = 0, np.zeros(IDF_BUCKETS, np.int64)
    for row in texts.mapInArrow(partial, schema).repartition(16, "block").mapInArrow(merge, schema).collect():  # IDF_BUCKETS counts
        n += row.n
        df[row.block * IDF_BLOCK : (row.block + 1) * IDF_BLOCK] = np.frombuffer(row.counts, np.int64)
    return (1 + np.log((n + 1) / (df + 1)) / max(np.log(n + 1), 1e-9)).astype(np.float32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of (sorted shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def alike(pairs: DataFrame, sampled: DataFrame) -> DataFrame:
    """The pairs (a, b) that agree in at least `AGREEING` samples: at similarity 0.8 all but some in a hundred thousand."""
    left, right = (sampled.select(F.col("key").alias(c), F.col("drawn").alias(f"drawn_{c}")) for c in "ab")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "drawn_a", "drawn_b")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, HASHES) for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= AGREEING))

    return written(joined.mapInArrow(agree, "a binary, b binary"), "alike")


def promising(met: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows (key, component, marks, lead: array of key, component, marks) of different components that agree in a byte of at least
    `PROMISING` samples, each once. A row meets all that lead its bucket at once, so no row is made for each of them."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = batch.column("lead")
            at, (b, other, marks) = pc.list_parent_indices(lead), lead.flatten().flatten()
            apart = pc.not_equal(batch.column("component").take(at), other)
            at, b, marks = (c.filter(apart) for c in (at, b, marks))
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, HASHES) for c in (batch.column("marks").take(at), marks))
            yield pa.record_batch([batch.column("key").take(at), b], names=["key", "b"]).filter(pa.array((x == y).sum(axis=1) >= PROMISING))

    found = met.select("key", "component", "marks", "lead").mapInArrow(agree, "key binary, b binary")
    return found.select(F.greatest("key", "b").alias("a"), F.least("key", "b").alias("b")).distinct()


def texts_of(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """`key`, `text` of the keys. Texts that no key names are left out before they are shuffled."""
    wanted = written(keys.distinct(), "wanted")
    named = keys.sparkSession.sparkContext.broadcast(gathered(wanted, first_half, width_for(wanted.count()), 1))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(named.value.has(next(first_half(iter([batch]), 1)))))

    held = texts.where("text is not null").mapInArrow(some, "text binary, key binary").join(wanted, "key", "left_semi").dropDuplicates(["key"])
    return written(held.select("key", "text"), "texts")


def verified(pairs: DataFrame, held: DataFrame, idf, threshold: float) -> DataFrame:
    """The pairs (a, b) of keys whose texts reach the threshold."""
    joined = pairs.join(held.select(F.col("key").alias("a"), F.col("text").alias("left")), "a").join(held.select(F.col("key").alias("b"), F.col("text").alias("right")), "b").select("left", "right", "a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, None
        for part in slices(batches, 0, WORDS_BYTES):
            keep = []
            for left, right, b in zip(shingles(part.column(0).to_pylist()), part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True):
                if b != last:
                    h, n = shingles([right])[0]
                    last, other = b, (h, weights(h, n, idf.value))
                keep.append(similarity((left[0], weights(*left, idf.value)), other) >= threshold)
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(joined.mapInArrow(compare, "a binary, b binary"), "links")


def prefixes(held: DataFrame, idf, threshold: float) -> DataFrame:
    """`element`, `place`, `total` beside `key`, `component`: the rarest shingles of each text, each occurrence by itself, with the weight before them
    and that of the text, as far as the weight before them is what a link may leave unshared. The order (idf, then hash) is the same in all texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0, WORDS_BYTES):
            out: list[tuple[np.ndarray, ...]] = []
            for i, (h, n) in enumerate(shingles(part.column(0).to_pylist())):
                each = weights(h, np.ones_like(n), idf.value)
                order = np.lexsort((h, -each))
                h, n, each = h[order], n[order], each[order]
                before, total = np.cumsum(n * each) - n * each, float((n * each).sum())
                limit = (1 - threshold) * total * SLACK
                most = np.where(before <= limit, np.minimum(n, ((limit - before) // each).astype(np.int64) + 1), 0)
                at = np.repeat(np.arange(len(h)), most)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(most) - most, most)
                element = scramble(h[at] + nth.astype(np.uint64) * np.uint64(BASE))
                out.append((np.full(len(at), i), element.view(np.int64), before[at] + nth * each[at], np.full(len(at), total)))
            row, element, place, total = (np.concatenate(c) for c in zip(*out, strict=True))
            kept = [part.column(c).take(pa.array(row)) for c in (1, 2)]
            yield pa.record_batch([pa.array(element), pa.array(place), pa.array(total), *kept], names=["element", "place", "total", "key", "component"])

    return held.select("text", "key", "component").mapInArrow(work, "element long, place double, total double, key binary, component binary")


def unconnected(held: DataFrame, idf, threshold: float) -> DataFrame:
    """All pairs (a, b) of different components among the texts (text, key, component) that may reach the threshold, and few others.

    Before the first element that two linked texts share lies only what one of them has alone: in both together at most (1 - t) of their union, in one
    of them at most half of that. So one side is found by its first elements, and a pair whose remaining weights are too small is no link."""
    marks = written(prefixes(held, idf, threshold), "marks")
    several = marks.groupBy("element").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("element")
    marks = written(marks.join(several, "element", "left_semi"), "marks")
    marks = marks.withColumn("reach", (F.col("total") - F.col("place")) * ((1 + threshold) / threshold * SLACK) - F.col("total"))  # largest total it can be linked to here
    early = marks.where(F.col("place") <= F.col("total") * ((1 - threshold) / (2 * threshold) * SLACK))
    sides = [m.groupBy("element", F.col("component").alias(c)).agg(F.max("reach").alias(f"reach_{c}"), F.min("total").alias(f"total_{c}")) for m, c in ((early, "x"), (marks, "y"))]
    sides = sides[0].join(sides[1], "element").where("x <> y and reach_x >= total_y and reach_y >= total_x")
    left, right = (m.select("element", F.col("component").alias(c), F.col("key").alias(k), F.col("reach").alias(f"reach_{k}"), F.col("total").alias(f"total_{k}")) for m, c, k in ((early, "x", "a"), (marks, "y", "b")))
    met = sides.join(left, ["element", "x"]).where("reach_a >= total_y and reach_y >= total_a").join(right, ["element", "y"]).where("reach_a >= total_b and reach_b >= total_a")
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def linked(texts: DataFrame, threshold: float) -> DataFrame:
    """`key`, `component` of the texts (columns text, key; equal texts have one key) that are linked to others.

    Whole texts go to Python in small batches: pairs of them in batches of the usual size take hundreds of MB of an executor."""
    with arrow_rows(texts.sparkSession, ARROW_ROWS):
        return _linked(texts, threshold)


def _linked(texts: DataFrame, threshold: float) -> DataFrame:
    idf = texts.sparkSession.sparkContext.broadcast(inverse_frequencies(texts.select("text")))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0, WORDS_BYTES):
            found = [(h, weights(h, n, idf.value)) for h, n in shingles(part.column(0).to_pylist())]
            some = [i for i, f in enumerate(found) if len(f[0])]
            if some:
                drawn = samples([found[i] for i in some])
                names = bands(drawn)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, names.size + 1, BANDS, dtype=np.int32)), pa.array(names.ravel()))
                yield pa.record_batch([part.column(1).take(pa.array(some)), pa.array([d.tobytes() for d in drawn], pa.binary()), pa.array([d[::4].tobytes() for d in drawn.view(np.uint8)], pa.binary()), lists], names=["key", "drawn", "marks", "bands"])
        variates.cache_clear()  # 35 MB that no other task of the worker needs
        give_back()

    sampled = written(texts.mapInArrow(sample, "key binary, drawn binary, marks binary, bands array<long>").dropDuplicates(["key"]), "samples")
    members = sampled.select("key", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    buckets = written(members.join(shared, "band"), "buckets")
    buckets = written(buckets.join(buckets.groupBy("key").agg(F.sum("n").alias("hub")), "key").select("band", "key", "hub", "n"), "buckets")
    first = buckets.groupBy("band").agg(F.max(F.struct("hub", "key")).alias("first")).select("band", F.col("first.key").alias("first"))
    tested = written(buckets.join(first, "band").where("key <> first").select(F.greatest("key", "first").alias("a"), F.least("key", "first").alias("b")).distinct(), "pairs")
    near = alike(tested, sampled)
    found = components(verified(near, texts_of(near.select(F.explode(F.array("a", "b")).alias("key")), texts), idf, threshold))
    held, compared, buckets = None, near, buckets.where("n > 2").drop("n")  # of two, both have been compared
    for turn in count(1):
        placed = buckets.drop("component").join(found, "key", "left").withColumn("component", F.coalesce("component", "key"))
        mixed = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"))
        mixed = mixed.where("x <> y").select("band")
        buckets = placed.join(mixed, "band", "left_semi")
        if held is None:
            buckets = written(buckets.join(sampled.select("key", "marks"), "key"), "buckets")
            held = texts_of(buckets.select("key"), texts)
        else:
            buckets = written(buckets, "buckets")
        ranks = (F.desc("hub"), F.desc("key")), (F.xxhash64("key", "band", F.lit(turn)), F.col("key"))
        lead = [buckets.withColumn("place", F.row_number().over(Window.partitionBy("band").orderBy(*by))).where(F.col("place") <= most) for by, most in zip(ranks, (1 + turn * HUBS, OTHERS), strict=True)]
        lead = lead[0].where(F.col("place") > 1 + (turn - 1) * HUBS).unionByName(lead[1])
        lead = lead.groupBy("band").agg(F.collect_list(F.struct("key", "component", "marks")).alias("lead"))  # at most HUBS + OTHERS
        pairs = promising(buckets.join(lead, "band"))
        pairs = written(pairs.join(compared, ["a", "b"], "left_anti"), "pairs")
        new = verified(pairs, held, idf, threshold)
        compared = compared.unionByName(pairs)
        if new.isEmpty():
            break
        found = regrouped(found, new)
    rest = held.join(buckets.select("key", "component").distinct(), "key")
    pairs = written(unconnected(rest, idf, threshold).join(compared, ["a", "b"], "left_anti"), "pairs")
    new = verified(pairs, held, idf, threshold)
    return found if new.isEmpty() else regrouped(found, new)


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """Columns by place (c0, c1, ...) with the text, its key and whether it holds a word."""
    plain = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)), docs[text].cast("binary").alias("text"))
    worded = F.length(F.regexp_replace(F.col("text").cast("string"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", "")) > 0
    return plain.withColumns({"key": F.unhex(F.md5("text")), "worded": F.coalesce(worded, F.lit(False))})


def classes(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", keep: tuple[str, ...] = ("doc_id",), order: str = "doc_id") -> DataFrame:
    """Kept columns, `class_id` (the smallest `order` of the class) and `class_size`, a row for each row. Texts without words are classes of their
    own (class_id is their own `order`); equal texts are of one class."""
    rows = keyed(docs.select(*keep, docs[order].alias("__order"), docs[text].alias("__text")), "__text")
    found, n = linked(rows.select("text", "key"), threshold), len(keep)
    named = rows.select(*(f"c{i}" for i in range(n)), F.col(f"c{n}").alias("order"), "key", "worded").join(found, "key", "left")
    named = named.withColumn("class", F.when(F.col("worded"), F.coalesce("component", "key")))
    sizes = named.where("class is not null").groupBy("class").agg(F.min("order").alias("least"), F.count("*").alias("size"))
    out = named.join(sizes, "class", "left").select(*(f"c{i}" for i in range(n)), F.when(F.col("class").isNull(), F.col("order")).otherwise(F.col("least")), F.coalesce("size", F.lit(1)))
    return out.toDF(*keep, "class_id", "class_size")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Documents, all columns as they are, one for each class: that with the smallest `order` (rows without it come last), of equal ones the one
    with the smallest digest of the text; of rows that share both, any one. Texts without words all stay."""
    place, n = f"c{docs.columns.index(order)}", len(docs.columns)
    rows = keyed(docs, text)
    found = linked(rows.select("text", "key"), threshold)
    named = rows.where("worded").select(F.col(place).alias("order"), "key").join(found, "key", "left").withColumn("class", F.coalesce("component", "key"))
    rank = F.struct(F.col("order").isNull().alias("late"), "order", "key")
    firsts = named.groupBy("class").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select("class", F.col("first.order").alias("first_order"), F.col("first.key").alias("first_key"))
    gone = named.join(firsts, "class").where(~(F.col("order").eqNullSafe(F.col("first_order")) & (F.col("key") == F.col("first_key")))).select("order", "key").distinct()
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    gone = gone.select(name("order").alias("gone_order"), F.col("key").alias("gone_key"))
    kept = rows.withColumn("name", name(place)).join(gone, (F.col("name") == F.col("gone_order")) & (F.col("key") == F.col("gone_key")) & F.col("worded"), "left_anti")
    kept = kept.withColumn("own", F.when(F.col("worded"), F.lit(0)).otherwise(F.monotonically_increasing_id()))
    return kept.drop("text", "worded").dropDuplicates(["name", "key", "own"]).select(*(f"c{i}" for i in range(n))).toDF(*docs.columns)
