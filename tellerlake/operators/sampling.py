"""Repeatable samples and quota assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellerlake.operators.latest import newest_per_group
from tellerlake.session import cut_lineage


def seeded_order(row_id: str, seed: int) -> Column:
    return F.xxhash64(F.col(row_id), F.lit(seed))


def sample_unused(people: DataFrame, used: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """`size` random rows not used before, the same ones for the same seed."""
    free = people.join(used.select(key), key, "left_anti")
    return free.orderBy(seeded_order(key, seed), key).limit(size)


def bernoulli(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    if not 0 < fraction <= 0.05:
        raise ValueError("Smoke samples take at most 5 percent")
    return df.sample(False, fraction, seed)


def assign_quotas(candidates: DataFrame, key: str, position: str, eligible: dict[str, Column], quotas: dict[str, int]) -> DataFrame:
    """Each candidate holds at most one category; categories are filled in the given (rarest first) order.

    At most `sum(quotas)` candidates can be taken before a category's turn, so its first `sum(quotas)` eligible
    candidates always contain its picks: the stages run on that small set.
    """
    pool = sum(quotas.values())
    wanted = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in eligible.items()])))
    queue = candidates.select(key, F.col(position).alias("_position"), wanted.alias("category"))
    reach = cut_lineage(newest_per_group(queue, ["category"], [F.asc("_position"), F.asc(key)], pool))
    picked = None
    for name in eligible:
        free = reach.where(F.col("category") == name)
        if picked is not None:
            free = free.join(picked.select(key), key, "left_anti")
        taken = free.orderBy(F.asc("_position"), F.asc(key)).limit(quotas[name])
        picked = cut_lineage(taken if picked is None else picked.unionByName(taken))
    return picked.select(key, "category")


def shortfall(assigned: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Categories that could not be filled, and by how many."""
    counts = assigned.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    wanted = assigned.sparkSession.createDataFrame(list(quotas.items()), "category string, quota bigint")
    return wanted.join(counts, "category", "left").select("category", "quota", (F.col("quota") - F.coalesce("n", F.lit(0))).alias("missing")).where("missing > 0")
