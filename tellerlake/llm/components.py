"""Connected components of links between keys, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellerlake.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """`key`, `component` (the smallest key it is connected to) of every key in the links (a, b).

    Rounds of large-star and small-star: each key hands its neighbours to the smallest of them, so paths shrink to stars in a logarithmic number of
    rounds. Only whether anything but stars is left returns to the driver."""
    links = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.join(least, "a").where("b > a and b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        kept = links.select("a", "b").join(least.select(F.col("a"), "least"), "a")  # every key also hands itself down
        large = large.unionByName(kept.where("a <> least").select("a", F.col("least").alias("b"))).distinct()
        first = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(first, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(first.select("a", F.col("least").alias("b"))).distinct()
        after = written(small, "links")
        ends = after.select(F.col("a").alias("key"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(after.select(F.col("b").alias("key"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("key").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():  # only stars are left
            return after.select(F.col("a").alias("key"), F.col("b").alias("component")).unionByName(after.select(F.col("b").alias("key"), F.col("b").alias("component")).distinct())
        links = after


def regrouped(found: DataFrame, links: DataFrame) -> DataFrame:
    """`found` (key, component) after more links (a, b): only links between components are followed."""
    ends = links.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    every = written(found.unionByName(ends.join(found, "key", "left_anti").select("key", F.col("key").alias("component"))), "components")
    named = [every.select(F.col("key").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab"]
    joined = components(links.join(named[0], "a").join(named[1], "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    joined = joined.select(F.col("key").alias("component"), F.col("component").alias("whole"))
    return written(every.join(joined, "component", "left").select("key", F.coalesce("whole", "component").alias("component")), "components")
