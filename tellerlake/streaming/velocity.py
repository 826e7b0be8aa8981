"""Prior counts and the time since the previous transaction from keyed state.

Each customer's state is a sorted list of the event times of the last days, beside the newest time of all. A batch merges its times into the list and
reads its frames from it, so a late row finds its own predecessor and a batch computes only the customers it brings (Spark looks through the others for
those that have expired). Times older than the frames and the allowed lateness are cut off; the whole list of a customer who sends nothing for long
expires by its timeout, and the newest time stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tellerlake.operators.running import DAY, HOUR, SECOND, epoch_us

FRAMES = {"1h": HOUR, "24h": 24 * HOUR, "7d": 7 * DAY}
LATENESS = 30 * DAY
IDLE_MS = 400 * 24 * 3_600_000
NONE = np.iinfo(np.int64).min
#: Keyed state is kept in the RocksDB store; a clock that always runs would otherwise start batches without rows for ever.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def merge_times(times: np.ndarray, before: int | None, arrived: np.ndarray, keep: int) -> tuple[np.ndarray, int | None, dict[str, np.ndarray]]:
    """The list and the newest time before it after a batch, and the features of the arrived times: counts per frame, and `previous` (NONE: none)."""
    every = np.sort(np.concatenate((times, arrived)))
    now = np.searchsorted(every, arrived)
    out = {f: now - np.searchsorted(every, arrived - back) for f, back in FRAMES.items()}
    known = np.full(len(arrived), NONE) if before is None else np.where(before < arrived, before, NONE)
    out["previous"] = np.maximum(np.where(now > 0, every[now - 1], NONE), known)
    cut = int(np.searchsorted(every, every[-1] - keep))
    return every[cut:], int(every[cut - 1]) if cut else before, out


STATE = "times binary, before long, newest long, expires long"


def customer_times(lateness: int, idle_ms: int):
    """State function of one customer: `row_id`, counts, seconds since the previous transaction and `late`: the row's frame reaches back to times that have
    been cut off or expired, so its counts may be low. State travels with the rows, in batches of many customers."""
    longest = max(FRAMES.values())
    keep = longest + lateness

    def work(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, before, newest, expires = state.get if state.exists else (None, None, None, None)
        if state.hasTimedOut:
            state.update((None, None, newest, None))
            return
        arrived = list(frames)
        arrived = arrived[0] if len(arrived) == 1 else pd.concat(arrived, ignore_index=True)
        now = state.getCurrentProcessingTimeMs()
        if held is not None and expires <= now:
            held = None
        t = arrived["at_us"].to_numpy(np.int64)
        times = np.frombuffer(held, np.int64) if held is not None else np.empty(0, np.int64)
        kept, before, found = merge_times(times, before if held is not None else newest, t, keep)
        whole = NONE if newest is None else newest - keep if held is not None else newest + 1  # the list knows every time from here on
        state.update((kept.tobytes(), before, int(max(t.max(), t.max() if newest is None else newest)), now + idle_ms))
        state.setTimeoutDuration(idle_ms)
        previous = found.pop("previous")
        out = {"row_id": arrived["row_id"], **{f"customer_tx_count_{f}": n.astype(np.float64) for f, n in found.items()}}
        out["seconds_since_prev_tx"] = np.where(previous != NONE, (t - previous) / SECOND, np.nan)
        yield pd.DataFrame({**out, "late": t - longest < whole})

    return work


@contextmanager
def keyed_state(spark: SparkSession):
    """The settings of a query with keyed state; the session's own come back afterwards."""
    own = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)


def live_velocity(stream: DataFrame, root: str, checkpoint: str, row_id: str = "transaction_id", lateness: int = LATENESS, idle_ms: int = IDLE_MS) -> None:
    """Prior counts and seconds since the previous transaction of every arriving row, into `root`/features, a folder for each batch.

    A row counts all rows of its customer that have arrived, its own batch included, and lie in its frame, whatever the order of arrival; equal to the
    batch features for rows in time order. Rows without customer or time have no history and leave no state. A batch that is repeated replaces its
    folder, and its state is taken back by the checkpoint."""
    rows = stream.select(F.col(row_id).alias("row_id"), F.col("customer_id").cast("string").alias("customer"), epoch_us("transaction_date").alias("at_us"))
    schema = T.StructType([T.StructField("row_id", stream.schema[row_id].dataType), *(T.StructField(f"customer_tx_count_{f}", T.DoubleType()) for f in FRAMES),
                           T.StructField("seconds_since_prev_tx", T.DoubleType()), T.StructField("late", T.BooleanType())])
    kept = F.col("customer").isNotNull() & F.col("at_us").isNotNull()
    keyed = rows.where(kept).groupBy("customer").applyInPandasWithState(customer_times(lateness, idle_ms), schema, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    alone = rows.where(~kept).select("row_id", *[F.lit(0.0).alias(f"customer_tx_count_{f}") for f in FRAMES], F.lit(None).cast("double").alias("seconds_since_prev_tx"), F.lit(False).alias("late"))
    out = keyed.unionByName(alone).withColumn("seconds_since_prev_tx", F.nanvl("seconds_since_prev_tx", F.lit(None).cast("double"))).withColumnRenamed("row_id", row_id)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/features/_batch={batch_id}")

    with keyed_state(stream.sparkSession):
        out.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
