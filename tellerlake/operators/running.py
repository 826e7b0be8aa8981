"""Sums over `[T - d, T)` and running totals that never put a hot key's whole history into one task.

Rows are dealt by ranges of (history, key, time), so partitions hold about the same number of rows whatever the keys. Inside a partition, which is in
order, every frame is the difference of two places of one running sum: no row is multiplied, whatever the number of frames. Only the key a partition
begins with may have earlier rows elsewhere. Its sum so far is an opening balance (at most one row per partition, broadcast); only where a frame of such
a row begins before the partition does, its begin is looked up in a second pass over the keys that cross partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellerlake.operators.ordering import changes, range_count, running_sums
from tellerlake.session import written

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR

LIMB_BITS = 30
#: Rows that a partition of a timeline holds at most, about: it is in memory as a whole (some 1 KB a row with all features).
RANGE_ROWS = 1 << 18
ORDER = ("_h", "_k", "_at")


def epoch_us(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (the session zone is UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def attach_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame (a global aggregate) to every row."""
    return df.withColumn("_one_row", F.lit(1)).join(F.broadcast(one.withColumn("_one_row", F.lit(1))), "_one_row").drop("_one_row")


def settled(one: DataFrame) -> DataFrame:
    """A one-row frame as a constant: whatever uses it several times does not compute it again."""
    return one.sparkSession.createDataFrame(one.limit(1).collect(), one.schema)


def sized(side: DataFrame, rows: int) -> DataFrame:
    """A side for a join: broadcast if it was counted to hold no more than `rows` rows, else as it is, for Spark to shuffle."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side


def key_text(keys: Sequence[Column]) -> Column:
    """One text for several keys; nulls are equal to each other and to nothing else."""
    texts = [c.cast("string") for c in keys]
    return F.concat(F.lit(""), *[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("~")) for t in texts])


def no_history(value: Column) -> Column:
    return F.coalesce(value, F.lit(0)).cast("bigint")


def frames_within(cells: Sequence[Sequence[tuple[int, int | None]]], n_sums: int, n_latest: int):
    """Arrow function over one partition in order: (h, k, at, read, sums, latest, payload).

    For every row that reads: its cells (sum of a slot over `[at - back, at)`, or over everything before `at`) and the last values of `latest` before
    `at`, as far as the partition knows them; `_start` is the first `at` of the key that the partition begins with. Rows of the keys it begins and ends
    with, which may go on elsewhere, keep their own sums in `_own`, whether they read or not. One more row per partition, with `_read` null, holds the
    totals and last values of the key that it ends with, and the key that it begins with."""
    width = max((len(c) for c in cells), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        given, columns = table.column_names, [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
        del held, table  # one copy stays
        h, at, read = columns[0].to_numpy(), columns[2].to_numpy(), columns[3].to_numpy(zero_copy_only=False).astype(bool)
        n, place = len(h), np.arange(len(h))
        new = changes(columns[:2], None)
        begin = np.maximum.accumulate(np.where(new, place, 0))
        tie = new.copy()
        tie[1:] |= at[1:] != at[:-1]
        now = np.maximum.accumulate(np.where(tie, place, 0))  # the first row of the key at this time
        times = np.unique(at)
        group = (np.cumsum(new) - 1) * (len(times) + 1)
        line = group + np.searchsorted(times, at)
        totals = [np.concatenate(([0], np.cumsum(c.to_numpy()))) for c in columns[4 : 4 + n_sums]]
        out = np.zeros((width, n), np.int64)
        for number, own in enumerate(cells):
            a, b = np.searchsorted(h, [number, number + 1])
            low = {}
            for j, (slot, back) in enumerate(own):
                if back not in low:
                    low[back] = begin[a:b] if back is None else np.searchsorted(line, group[a:b] + np.searchsorted(times, at[a:b] - back))
                out[j, a:b] = totals[slot][now[a:b]] - totals[slot][low[back]]
        latest, ends = [], []
        for c in columns[4 + n_sums : 4 + n_sums + n_latest]:
            filled = np.maximum.accumulate(np.where(c.is_valid().to_numpy(zero_copy_only=False), place, -1))
            before = np.where(now > 0, filled[now - 1], -1)
            latest.append(c.take(pa.array(before, mask=before < begin)))
            ends.append(c.take(pa.array([filled[-1] if filled[-1] >= begin[-1] else None], pa.int64())))
        edge = (begin == 0) | (begin == begin[-1])
        kept = np.flatnonzero(read | edge)
        rows = pa.array(kept)
        none = lambda kind, size: pa.nulls(size, kind)
        payload = columns[4 + n_sums + n_latest :]
        listed, names = pa.list_(pa.int64()), [*given[:4], "_start", *(f"c{j}" for j in range(width)), *given[4 + n_sums : 4 + n_sums + n_latest],
                                               "_own", "_totals", "_fh", "_fk", *given[4 + n_sums + n_latest :]]
        counts = np.where(edge[kept], n_sums, 0)
        flat = np.stack([c.to_numpy()[kept] for c in columns[4 : 4 + n_sums]], axis=1)[edge[kept]].ravel() if n_sums else np.zeros(0, np.int64)
        own = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(flat, pa.int64()), mask=pa.array(~edge[kept]))
        start = pa.array(np.full(n, at[0]), mask=begin > 0)
        made = [*(c.take(rows) for c in (*columns[:4], start, *(pa.array(x) for x in out), *latest)), own, none(listed, len(rows)), none(pa.int32(), len(rows)),
                none(pa.string(), len(rows)), *(c.take(rows) for c in payload)]
        yield from pa.table(made, names=names).to_batches(max_chunksize=1 << 16)
        last = n - 1
        sums = [int(t[n] - t[begin[last]]) for t in totals]
        tail = [columns[0].slice(last), columns[1].slice(last), none(pa.int64(), 1), none(pa.bool_(), 1), none(pa.int64(), 1), *(none(pa.int64(), 1) for _ in range(width)), *ends,
                none(listed, 1), pa.array([sums], listed), columns[0].slice(0, 1), columns[1].slice(0, 1), *(none(c.type, 1) for c in payload)]
        yield from pa.table(tail, names=names).to_batches()

    return run


def laid_out(timeline: DataFrame, cells: Sequence[Sequence[tuple[int, int | None]]], sums: Sequence[str], latest: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """What `frames_within` makes of a timeline (`_h`, `_k`, `_at`, `_read`, sums, latest, payload), written, with `_part`."""
    source = timeline.select(F.col("_h").cast("int"), "_k", F.col("_at").cast("bigint"), "_read", *[no_history(F.col(s)).alias(s) for s in sums], *latest, *payload)
    width = max((len(c) for c in cells), default=0)
    number = lambda name: T.StructField(name, T.LongType())
    schema = T.StructType([T.StructField("_h", T.IntegerType()), T.StructField("_k", T.StringType()), number("_at"), T.StructField("_read", T.BooleanType()), number("_start"),
                           *(number(f"c{j}") for j in range(width)), *(source.schema[c] for c in latest), T.StructField("_own", T.ArrayType(T.LongType())), T.StructField("_totals", T.ArrayType(T.LongType())),
                           T.StructField("_fh", T.IntegerType()), T.StructField("_fk", T.StringType()), *(source.schema[c] for c in payload)])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    ranged = source.repartitionByRange(max(range_count(source), -(-timeline.count() // RANGE_ROWS)), *ORDER).sortWithinPartitions(*ORDER, *latest)
    return written(ranged.mapInArrow(frames_within(cells, len(sums), len(latest)), schema).withColumn("_part", F.spark_partition_id()), "timeline")


def opening_balances(laid: DataFrame, n_sums: int, latest: Sequence[str]) -> DataFrame | None:
    """`_opart`, the sums `_o*` and last values `_l*` before the partition of the key it begins with, and `_oh`, `_ok`; None if no key goes over a border.

    One row per partition comes to the driver, whatever the number of rows; keys are in order, so a key's partitions follow each other."""
    out, key, sums, last = [], None, [0] * n_sums, [None] * len(latest)
    for end in sorted(laid.where("_read IS NULL").select("_part", "_h", "_k", "_fh", "_fk", "_totals", *latest).collect(), key=lambda r: r["_part"]):
        first, ends, values = (end["_fh"], end["_fk"]), (end["_h"], end["_k"]), [end[c] for c in latest]
        if first == key:
            out.append((end["_part"], *key, *sums, *last))
        if first != key or ends != key:
            sums, last = [0] * n_sums, [None] * len(latest)
        key, sums = ends, [a + b for a, b in zip(sums, end["_totals"], strict=True)]
        last = [b if b is not None else a for a, b in zip(last, values, strict=True)]
    schema = T.StructType([T.StructField("_opart", T.IntegerType()), T.StructField("_oh", T.IntegerType()), T.StructField("_ok", T.StringType()),
                           *(T.StructField(f"_o{i}", T.LongType()) for i in range(n_sums)), *(T.StructField(f"_l{i}", laid.schema[c].dataType) for i, c in enumerate(latest))])
    return laid.sparkSession.createDataFrame(out, schema) if out else None


def with_opening(laid: DataFrame, opening: DataFrame) -> DataFrame:
    return laid.where("_read").join(F.broadcast(opening), (F.col("_part") == F.col("_opart")) & F.col("_start").isNotNull(), "left")


def accumulate_before(timeline: DataFrame, keys: Sequence[str], at: str, sums: Sequence[str] = (), latest: Sequence[str] = ()) -> DataFrame:
    """Replace each of `sums` by its sum, and each of `latest` by its last value, over the rows of the same key with a strictly smaller `at`.

    `at` is a non-null BIGINT; sums are integers; a `latest` value grows with `at` (say, a struct that begins with it), and of those at one time the
    greatest is last. Rows with equal `at` never see each other. Without earlier values the result is NULL."""
    sums, latest = list(sums), list(latest)
    payload = [c for c in timeline.columns if c not in {*sums, *latest}]
    line = timeline.select(F.lit(0).alias("_h"), key_text([F.col(k) for k in keys]).alias("_k"), F.col(at).alias("_at"), F.lit(True).alias("_read"),
                           *[F.col(s).alias(f"s{i}") for i, s in enumerate(sums)], *[F.col(s).isNotNull().cast("bigint").alias(f"n{i}") for i, s in enumerate(sums)],
                           *[F.col(c).alias(f"l{i}") for i, c in enumerate(latest)], *[F.col(c).alias(f"p{i}") for i, c in enumerate(payload)])
    slots = [*[f"s{i}" for i in range(len(sums))], *[f"n{i}" for i in range(len(sums))]]
    last = [f"l{i}" for i in range(len(latest))]
    laid = laid_out(line, [[(i, None) for i in range(len(slots))]], slots, last, [f"p{i}" for i in range(len(payload))])
    opening = opening_balances(laid, len(slots), last)
    done = laid.where("_read") if opening is None else with_opening(laid, opening)
    total = lambda i: F.col(f"c{i}") if opening is None else F.col(f"c{i}") + no_history(F.col(f"_o{i}"))
    made = {s: F.when(total(len(sums) + i) > 0, total(i)) for i, s in enumerate(sums)}
    made |= {c: F.col(f"l{i}") if opening is None else F.coalesce(F.col(f"l{i}"), F.col(f"_l{i}")) for i, c in enumerate(latest)}
    return done.select(*[F.col(f"p{payload.index(c)}").alias(c) if c in payload else made[c].alias(c) for c in timeline.columns])


@dataclass(frozen=True)
class History:
    """What to total over one key's past. Output columns are `{name}_{measure}_{frame}` and `{name}_{latest}`.

    `frames` maps a label to its length (None = everything before). `sums` maps a measure to a numeric column
    expression, exact when it is an integer or a decimal without fraction. `latest` maps a name to a struct whose leading field is
    the time; the newest one strictly before T is returned, and the caller applies its own lower bound.
    """

    name: str
    keys: Sequence[str]
    frames: dict[str, int | None]
    sums: dict[str, Column] = field(default_factory=dict)
    latest: dict[str, Column] = field(default_factory=dict)


def limbs(value: Column) -> list[Column]:
    """A whole decimal in three integers, so that running sums stay in 64 bits."""
    rest, out = value.cast("decimal(38,0)"), []
    base = F.lit(1 << LIMB_BITS).cast("decimal(10,0)")
    for _ in range(2):
        low = F.pmod(rest, base)
        out.append(low.cast("bigint"))
        rest = ((rest - low) / base).cast("decimal(38,0)")
    return [*out, rest.cast("bigint")]


def from_limbs(parts: Sequence[Column]) -> Column:
    total = parts[0].cast("decimal(38,0)")
    for i, p in enumerate(parts[1:], 1):
        total = (total + p.cast("decimal(19,0)") * F.lit(1 << LIMB_BITS * i).cast("decimal(19,0)")).cast("decimal(38,0)")
    return total


class _Plan:
    """Where each measure of each history stands: slots are columns of the timeline, cells are columns of the result of a row and history."""

    def __init__(self, source: DataFrame, histories: Sequence[History]):
        kinds = {f.name: f.dataType for f in source.select(*[c.alias(f"{n}.{m}") for n, h in enumerate(histories) for m, c in {**h.sums, **h.latest}.items()]).schema.fields}
        self.columns: list[Column] = []
        self.slots: list[list[int]] = []
        self.cells: list[list[tuple[int, int | None]]] = []
        self.of: dict[tuple[int, str, str], list[int]] = {}
        self.latest = [(n, m, c, kinds[f"{n}.{m}"].simpleString()) for n, h in enumerate(histories) for m, c in h.latest.items()]
        for n, h in enumerate(histories):
            own, cells = [], []
            for m, c in h.sums.items():
                parts = limbs(c) if isinstance(kinds[f"{n}.{m}"], T.DecimalType) else [c.cast("bigint")]
                at = range(len(own), len(own) + len(parts))
                own += [len(self.columns) + i for i in range(len(parts))]
                self.columns += parts
                for label, back in h.frames.items():
                    self.of[n, m, label] = list(range(len(cells), len(cells) + len(parts)))
                    cells += [(i, back) for i in at]
            self.slots.append(own)
            self.cells.append(cells)
        self.n_slots = max((len(s) for s in self.slots), default=0)
        self.n_cells = max((len(c) for c in self.cells), default=0)

    def timeline(self, df: DataFrame, row_id: str | None, at: str, histories: Sequence[History], reads: bool, counts: bool) -> DataFrame:
        """A row for each history of each row with a time: `_row`, `_h`, `_k`, `_at`, `_read`, slots `s*`, latest `l*`."""
        named = df.select(*([F.col(row_id).alias("_row")] if row_id else []), F.col(at).cast("bigint").alias("_at"), *[key_text([F.col(k) for k in h.keys]).alias(f"_k{n}") for n, h in enumerate(histories)],
                          *([c.alias(f"_x{i}") for i, c in enumerate(self.columns)] + [c.alias(f"_y{i}") for i, (_, _, c, _) in enumerate(self.latest)] if counts else []))
        spots = []
        for n in range(len(histories)):
            values = [f"_x{self.slots[n][j]}" if counts and j < len(self.slots[n]) else "CAST(0 AS BIGINT)" for j in range(self.n_slots)]
            last = [f"_y{i}" if counts and own == n else f"CAST(NULL AS {kind})" for i, (own, _, _, kind) in enumerate(self.latest)]
            carried = [f"{v} AS s{j}" for j, v in enumerate(values)] + [f"{v} AS l{i}" for i, v in enumerate(last)]
            spots.append(f"struct({', '.join([f'{n} AS _h', f'_k{n} AS _k', *carried])})")
        out = named.where("_at IS NOT NULL").select(*(["_row"] if row_id else []), "_at", F.lit(reads).alias("_read"), F.expr(f"inline(array({', '.join(spots)}))"))
        return out


def prior_windows(probes: DataFrame, row_id: str, at: str, histories: Sequence[History], facts: DataFrame | None = None) -> DataFrame:
    """Totals over `[T - d, T)` for every row of `probes`; one output row per `row_id` (unique in `probes`).

    Without `facts` a row's history is the other rows of `probes`. Rows at exactly T and later rows never count, nor do rows without a time.
    Empty frames give 0 for every measure: keep a count among the measures to tell "none" from "zero".
    All histories share one timeline, so the number of shuffles does not grow with the number of features.
    """
    plan = _Plan(probes if facts is None else facts, histories)
    slots, last = [f"s{j}" for j in range(plan.n_slots)], [f"l{i}" for i in range(len(plan.latest))]
    if facts is None:
        timeline = plan.timeline(probes, row_id, at, histories, reads=True, counts=True)
    else:
        past = plan.timeline(facts, None, at, histories, reads=False, counts=True)
        timeline = plan.timeline(probes, row_id, at, histories, reads=True, counts=False).unionByName(past, allowMissingColumns=True)
    laid = laid_out(timeline, plan.cells, slots, last, ["_row"])
    opening = opening_balances(laid, plan.n_slots, last)
    cell_names = [f"c{j}" for j in range(plan.n_cells)]
    if opening is not None:
        opened = with_opening(laid, opening)
        cells = []
        for j in range(plan.n_cells):
            extra = F.lit(0).cast("bigint")
            for n, own in enumerate(plan.cells):
                if j < len(own):
                    slot, back = own[j]
                    reaches = F.lit(True) if back is None else F.col("_at") - back < F.col("_start")
                    extra = F.when((F.col("_h") == n) & F.col("_opart").isNotNull() & reaches, F.col(f"_o{slot}")).otherwise(extra)
            cells.append((F.col(f"c{j}") + extra).alias(f"c{j}"))
        rows = opened.select("_row", "_h", *cells, *[F.coalesce(c, f"_l{i}").alias(c) for i, c in enumerate(last)])
        rows = rows.unionByName(_begins(laid, opened, opening, plan, slots), allowMissingColumns=True)
    else:
        rows = laid.where("_read").select("_row", "_h", *cell_names, *last)
    rows = rows.unionByName(probes.where(F.col(at).isNull()).select(F.col(row_id).alias("_row")), allowMissingColumns=True)
    # Narrow rows are moved to their row id once; the wide aggregate then needs no further shuffle.
    own = lambda n, c: F.when(F.col("_h") == n, F.col(c))
    aggs = []
    for n, h in enumerate(histories):
        for m in h.sums:
            for label in h.frames:
                parts = [F.coalesce(F.sum(own(n, f"c{j}")), F.lit(0)) for j in plan.of[n, m, label]]
                aggs.append((from_limbs(parts) if len(parts) > 1 else parts[0]).alias(f"{h.name}_{m}_{label}"))
        aggs += [F.max(own(n, f"l{i}")).alias(f"{h.name}_{m}") for i, (k, m, _, _) in enumerate(plan.latest) if k == n]
    return rows.repartition("_row").groupBy(F.col("_row").alias(row_id)).agg(*aggs)


def _begins(laid: DataFrame, opened: DataFrame, opening: DataFrame, plan: _Plan, slots: Sequence[str]) -> DataFrame:
    """What to take off again: for rows whose frames begin before their partition does, the key's sum before the begin of the frame."""
    backs = [sorted({back for _, back in own if back is not None}) for own in plan.cells]
    of_row = F.array().cast("array<bigint>")
    for n, own in enumerate(backs):
        if own:
            of_row = F.when(F.col("_h") == n, F.filter(F.array(*[F.lit(b).cast("bigint") for b in own]), lambda b: F.col("_at") - b < F.col("_start"))).otherwise(of_row)
    asked = opened.where("_opart IS NOT NULL").select("_row", "_h", "_k", "_at", F.explode(of_row).alias("_back"))
    asked = asked.withColumn("_at", F.col("_at") - F.col("_back")).withColumn("_kind", F.lit(0))
    keys = F.broadcast(opening.select(F.col("_oh").alias("_h"), F.col("_ok").alias("_k")).distinct())  # no more rows than partitions
    known = laid.where("_own IS NOT NULL").join(keys, ["_h", "_k"], "left_semi").select("_h", "_k", "_at", F.lit(1).alias("_kind"), *[F.col("_own")[i].alias(c) for i, c in enumerate(slots)])
    both = asked.unionByName(known, allowMissingColumns=True)
    found = running_sums(both, ["_h", "_k"], [F.asc("_at"), F.asc("_kind")], slots).where("_kind = 0")
    cells = []
    for j in range(plan.n_cells):
        value = F.lit(0).cast("bigint")
        for n, own in enumerate(plan.cells):
            if j < len(own) and own[j][1] is not None:
                value = F.when((F.col("_h") == n) & (F.col("_back") == own[j][1]), -F.col(f"cum_s{own[j][0]}")).otherwise(value)
        cells.append(value.alias(f"c{j}"))
    return found.select("_row", "_h", *cells)
