"""Clock features, split labels and local days."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed period ends of the development protocol (end exclusive).
TRAIN_END, VALIDATION_END = "2025-07-01", "2026-01-01"
FIT_END, SELECTION_END, OPERATING_END = "2025-01-01", "2025-04-01", "2025-07-01"


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.pmod(F.dayofweek(ts) + 5, F.lit(7))


def is_weekend(ts: Column) -> Column:
    """1 on Saturday and Sunday, 0 otherwise, also for a missing time."""
    return F.when(F.dayofweek(ts).isin(1, 7), 1).otherwise(0)


def labelled_period(ts: Column, ends: dict[str, str], last: str) -> Column:
    """First label whose end (exclusive) lies after `ts`, in the given order, else `last`; NULL stays NULL."""
    out = F.when(ts.isNull(), F.lit(None).cast("string"))
    for label, end in ends.items():
        out = out.when(ts < F.lit(end).cast("timestamp_ntz"), F.lit(label))
    return out.otherwise(F.lit(last))


def split_label(ts: Column, train_end: str = TRAIN_END, validation_end: str = VALIDATION_END) -> Column:
    return labelled_period(ts, {"train": train_end, "validation": validation_end}, "final_test")


def development_period(ts: Column, fit_end: str = FIT_END, selection_end: str = SELECTION_END, operating_end: str = OPERATING_END) -> Column:
    """Callers cut the sealed period off first."""
    return labelled_period(ts, {"fit": fit_end, "selection": selection_end, "operating_point": operating_end}, "exploratory_validation")


def before(ts: Column, end_exclusive: str, latest_allowed: str = VALIDATION_END) -> Column:
    """Half-open cut-off, pushed to the scan; a later end than the sealed boundary is refused."""
    datetime.date.fromisoformat(end_exclusive)
    if end_exclusive > latest_allowed:
        raise ValueError("Sealed rows must remain excluded")
    return ts < F.lit(end_exclusive).cast("timestamp_ntz")


def age_years(birth: Column, as_of: Column) -> Column:
    return F.floor(F.months_between(as_of, birth) / 12)


def local_time(utc: Column, zone: str) -> Column:
    return F.from_utc_timestamp(utc.cast("timestamp"), zone)


def local_day(utc: Column, zone: str) -> Column:
    return F.date_format(local_time(utc, zone), "yyyy-MM-dd")


def within_local_days(utc: Column, zone: str, first: str, last: str) -> Column:
    """Inclusive local days, compared on the stored UTC value so that the filter reaches the scan."""
    start = F.to_utc_timestamp(F.lit(first).cast("timestamp"), zone)
    stop = F.to_utc_timestamp(F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"), zone)
    return (utc >= start.cast("timestamp_ntz")) & (utc < stop.cast("timestamp_ntz"))


def check_window(first: str, last: str, days: int = 31) -> None:
    """Both ends are ISO days, in order, spanning at most `days` days."""
    start, stop = (datetime.datetime.strptime(d, "%Y-%m-%d").date() for d in (first, last))
    if start.isoformat() != first or stop.isoformat() != last or not 0 <= (stop - start).days < days:
        raise ValueError(f"Window {first}..{last} is not a valid range of at most {days} days")


def check_zone(zone: str) -> str:
    from zoneinfo import ZoneInfo

    ZoneInfo(zone)
    return zone
