"""Newest row, newest few rows, and key-based merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], drop_null_keys: bool = True) -> DataFrame:
    """One row per key: the greatest `order` tuple, NULLs last. Combines before the shuffle, so hot keys are cheap."""
    if drop_null_keys:
        for k in keys:
            df = df.where(F.col(k).isNotNull())
    row, rank = F.struct(*df.columns), F.struct(*order)
    return df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.max_by(row, rank).alias("_row")).select("_row.*")


def newest_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First `n` rows per key. Spark trims each key to `n` rows per input partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rank or "_rank", F.row_number().over(w)).where(F.col(rank or "_rank") <= n)
    return out if rank else out.drop("_rank")


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Global first `n`; the caller's order must end in a unique key."""
    return df.orderBy(*order).limit(n)


def insert_absent(target: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of `new` whose key is not in `target`, one per key (the earliest by `order`), ready to append."""
    first = new.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(
        F.min_by(F.struct(*new.columns), F.struct(*order)).alias("_row")).select("_row.*")
    return first.join(target.select(*keys), list(keys), "left_anti")


def upsert_latest(target: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Full outer replacement by key: the newest payload wins."""
    return keep_latest(target.unionByName(new, allowMissingColumns=True), keys, order)


def union_sections(sections: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL of labelled result sections with one column list."""
    parts = [df.withColumn("section", F.lit(name)) for name, df in sections.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def page_after(df: DataFrame, time: str, key: str, limit: int, after: tuple | None = None) -> DataFrame:
    """Keyset page, newest first: up to `limit + 1` rows (the extra one tells that another page follows)."""
    if after is not None:
        t, k = after
        df = df.where((F.col(time) < F.lit(t)) | ((F.col(time) == F.lit(t)) & (F.col(key) < F.lit(k))))
    return top_n(df, [F.desc(time), F.desc(key)], limit + 1)
