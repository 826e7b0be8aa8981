"""Positions and running sums in the order of a whole table, by range partitions.

Rows are dealt to partitions by ranges of (keys, order) that Spark samples, so a partition holds about the same number of rows however the values are
bunched, and a hot key is spread over as many partitions as its rows need. Each partition is put in order and summed on its own. Only a key that begins
in an earlier partition needs an opening balance, and in each partition at most one key does: the balances are no more rows than partitions. The rows
are written once in between, because the ranges must be the same for the balances and for the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellerlake.session import written

PLACE_BITS = 33


def range_count(df: DataFrame) -> int:
    """As many ranges as the session shuffles to: ranges that are joined for being small would be sorted by fewer cores."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows by ranges, in order within each partition, with `_part` and `_place` (from 0 in the partition)."""
    by = [*(F.col(k).asc() for k in keys), *order]
    placed = df.repartitionByRange(range_count(df), *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return placed.select(*df.columns, F.shiftright("_at", PLACE_BITS).alias("_part"), F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1).alias("_place"))


def changes(columns: list[pa.Array], before: list | None) -> np.ndarray:
    """Where a row's keys differ from those of the row before it (`before`: the last row of the batch before)."""
    n = len(columns[0]) if columns else 0
    out = np.zeros(n, bool)
    for i, column in enumerate(columns):
        here, earlier = column.slice(1), column.slice(0, n - 1)
        unlike = pc.fill_null(pc.not_equal(here, earlier), False).to_numpy(zero_copy_only=False)
        out[1:] |= unlike | (pc.is_null(here).to_numpy(zero_copy_only=False) != pc.is_null(earlier).to_numpy(zero_copy_only=False))
        out[0] |= before is None or before[i] != column[0].as_py()
    return out


def local_sums(n_keys: int, n_sums: int):
    """Arrow function over batches (keys, sums, payload): every sum becomes the running one of its key within the partition, its own row included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, [0] * n_sums
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.columns[:n_keys]
            new = changes(keys, last) if keys else np.zeros(batch.num_rows, bool)
            starts, run_of = np.flatnonzero(new), np.cumsum(new)
            columns = list(batch.columns)
            for j in range(n_sums):
                total = np.cumsum(batch.column(n_keys + j).to_numpy(zero_copy_only=False))
                opening = np.concatenate(([carried[j]], -np.where(starts > 0, total[starts - 1], 0)))
                held = total + opening[run_of]
                carried[j] = int(held[-1])
                columns[n_keys + j] = pa.array(held, pa.int64())
            last = [k[-1].as_py() for k in keys]
            yield pa.record_batch(columns, schema=batch.schema)

    return run


def same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    pairs = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    return reduce(lambda a, b: a & b, pairs, F.col(f"{left}._part") == F.col(f"{right}._part"))


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Sequence[str], prefix: str = "cum_") -> DataFrame:
    """Add `cum_<s>`: the sum of the integer column s over the rows of the same keys up to and with this one, in `order`.

    Nulls count 0; null keys are one key. Rows of equal keys and order stand in any order: give an `order` that tells them apart."""
    keys, order = list(keys), list(order)
    sums = list(dict.fromkeys(sums))
    wide = in_ranges(df, keys, order)
    fields = [T.StructField(f"_s{i}", T.LongType(), False) for i in range(len(sums))]
    chosen = wide.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                         *[F.coalesce(F.col(s).cast("bigint"), F.lit(0)).alias(f"_s{i}") for i, s in enumerate(sums)], *df.columns, "_part")
    schema = T.StructType([*(T.StructField(f"_k{i}", df.schema[k].dataType) for i, k in enumerate(keys)), *fields, *df.schema.fields, T.StructField("_part", T.LongType())])
    laid = written(chosen.mapInArrow(local_sums(len(keys), len(sums)), schema).drop(*[f"_k{i}" for i in range(len(keys))]), "running")
    added = [F.sum(F.coalesce(F.col(s).cast("bigint"), F.lit(0))).alias(f"_o{i}") for i, s in enumerate(sums)]
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = laid.groupBy("_part", *keys).agg(*added)
    opening = ends.select("_part", *keys, F.count(F.lit(1)).over(earlier).alias("_n"), *[F.sum(f"_o{i}").over(earlier).alias(f"_o{i}") for i in range(len(sums))]).where("_n > 0")
    joined = laid.alias("l").join(F.broadcast(opening.alias("o")), same_keys("l", "o", keys), "left")
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns],
                         *[(F.col(f"l._s{i}") + F.coalesce(F.col(f"o._o{i}"), F.lit(0))).alias(f"{prefix}{s}") for i, s in enumerate(sums)])


def positions(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the position (from 1) of every row in the order of the whole table."""
    laid = written(in_ranges(df, [], order), "positions")
    sizes = laid.groupBy("_part").agg((F.max("_place") + 1).alias("_n"))  # a row for each partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return laid.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_place") + 1).alias(name))


def cumulate_groups(groups: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str], descending: bool = False) -> DataFrame:
    """Add `cum_<s>`: running sum in `value` order, the row itself included, for groups unique per (keys, value)."""
    return running_sums(groups, keys, [F.desc(value) if descending else F.asc(value)], sums)


def global_rank(df: DataFrame, score: str, row_id: str) -> DataFrame:
    """Add `rank`: position by (score descending, row_id ascending) over the whole table. Missing scores come last."""
    return positions(df, [F.desc_nulls_last(score), F.asc(row_id)])


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], method: str = "cont") -> DataFrame:
    """Exact percentiles per key without collecting a group: count equal values, accumulate, look up the ranks.

    `cont` interpolates between the two closest ranks, `disc` returns an existing value. Adds `n_values`."""
    keys = list(keys)
    groups = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cum = cumulate_groups(groups, keys, "_v", ["_n"]).withColumn("_before", F.col("cum__n") - F.col("_n"))
    # An attached total turns ranks into per-row tests, so one combinable aggregation finishes the job.
    totals = cum.groupBy(*keys).agg(F.sum("_n").alias("n_values"))
    one = [F.lit(1).alias("_one")]
    on = reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys], F.col("c._one") == F.col("t._one"))
    joined = cum.select("*", *one).alias("c").join(totals.select("*", *one).alias("t"), on).select("c.*", "t.n_values")

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("cum__n")), F.col("_v")))

    aggs = [F.max("n_values").alias("n_values")]
    for name, p in probs.items():
        if method == "disc":
            aggs.append(at_rank(F.greatest(F.ceil(F.lit(p) * F.col("n_values")) - 1, F.lit(0))).alias(name))
        else:
            rank = F.lit(p) * (F.col("n_values") - 1)
            aggs += [at_rank(F.floor(rank)).alias(f"_lo_{name}"), at_rank(F.ceil(rank)).alias(f"_hi_{name}")]
    out = joined.groupBy(*keys).agg(*aggs)
    if method == "cont":
        for name, p in probs.items():
            rank = F.lit(p) * (F.col("n_values") - 1)
            lo, hi = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
            out = out.withColumn(name, lo + (hi - lo) * (rank - F.floor(rank)))
        out = out.drop(*[c for c in out.columns if c.startswith(("_lo_", "_hi_"))])
    return out


def column_percentiles(df: DataFrame, columns: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """One row: `<column>_<name>` for the interpolated percentiles of several numeric columns, in one pass."""
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in columns]))
    found = exact_percentiles(df.select(pair.alias("_p")).select("_p.*"), ["_column"], "_value", probs)
    return found.agg(*[F.max(F.when(F.col("_column") == c, F.col(p))).alias(f"{c}_{p}") for c in columns for p in probs])
