"""Approximate nearest neighbours by cross-polytope hashing.

Fast Hadamard pseudo-rotations (three rounds of random signs and a Walsh-Hadamard transform) turn unit vectors; the signed axis nearest to the
turned vector is its bucket in a table. A query probes the nearest axes of every table. Buckets are cut into blocks, queries into others, and every
block meets the queries that probe its bucket in one task, which ranks exactly in double precision. A query whose probes held too few candidates
meets all buckets of one table, that is all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellerlake.llm.common import written

TABLES, PROBES = 8, 16
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048
SEED = 11


@lru_cache(maxsize=4)
def signs(tables: int, dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1.0, 1.0]), (tables, 3, dim))


def turned(x: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Three rounds of signs and Walsh-Hadamard transform (unscaled: only the largest axis matters)."""
    n = x.shape[1]
    for s in sign:
        x, h = x * s, 1
        while h < n:
            x = x.reshape(len(x), n // (2 * h), 2, h)
            x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(-1, n)
            h *= 2
    return x


def axes(vectors: np.ndarray, tables: int, probes: int) -> np.ndarray:
    """The nearest signed axes of each vector in each table, as bucket numbers (vectors x tables x probes)."""
    dim = 1 << max(0, vectors.shape[1] - 1).bit_length()
    x = np.zeros((len(vectors), dim))
    x[:, : vectors.shape[1]] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = np.empty((len(x), tables, probes), np.int32)
    for t, s in enumerate(signs(tables, dim)):
        both = turned(x, s)
        both = np.concatenate((both, -both), axis=1)
        out[:, t] = np.argsort(-both, axis=1, kind="stable")[:, :probes] + t * 2 * dim
    return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()).reshape(-1, dim)


def usable(vectors: DataFrame, ident: str, vector: str) -> tuple[DataFrame, int]:
    """id and vector (double) of those that take part, and their dimension: not null, finite, not zero, of the most frequent dimension (the larger of
    equally frequent ones). Of rows with the same id the greatest vector counts."""
    v = vectors.select(vectors[ident].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(finite).where(F.exists("v", lambda x: x != 0))
    dims = v.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = dims.dim if dims else 1
    return v.where(F.size("v") == dim).groupBy("id").agg(F.max("v").alias("v")), dim


def best(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    ranked = found.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def met(index: DataFrame, queries: DataFrame, sizes: DataFrame, dim: int, k: int) -> DataFrame:
    """For each query and block the k nearest: index (bucket, id, v) and queries (bucket, id, v) in blocks of bounded size."""
    asked = queries.groupBy("bucket").agg(F.count("*").alias("asked"))
    plan = sizes.join(F.broadcast(asked), "bucket").select("bucket", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("rows"), F.ceil(F.col("asked") / BLOCK_QUERIES).cast("int").alias("groups"))
    plan = F.broadcast(plan)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = index.join(plan, "bucket").select("bucket", own("rows").alias("row_block"), every("groups").alias("query_block"), "id", "v")
    right = queries.join(plan, "bucket").select("bucket", every("rows").alias("row_block"), own("groups").alias("query_block"), "id", "v")

    def rank(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = ([], [], [])
        if rows.num_rows and asked.num_rows:
            x, q = matrix(rows["v"], dim), matrix(asked["v"], dim)
            ids, own_ids = rows["id"].to_numpy(), asked["id"].to_numpy()
            x_norm, q_norm = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            unit = (x / x_norm[:, None]).T
            for begin in range(0, len(q), 256):
                rough = (q[begin : begin + 256] / q_norm[begin : begin + 256, None]) @ unit
                for i, row in enumerate(rough, begin):
                    row[ids == own_ids[i]] = -np.inf
                    least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                    near = np.flatnonzero(row >= max(least - 1e-9, -2.0))  # ties and rounding: all that may be among the k
                    exact = (x[near] * q[i]).sum(axis=1) / (x_norm[near] * q_norm[i])
                    order = np.lexsort((ids[near], -exact))[:k]
                    for a, b in zip(out, (np.full(len(order), own_ids[i]), ids[near][order], exact[order]), strict=True):
                        a.append(b)
        made = [np.concatenate(a) if a else np.empty(0) for a in out]
        return pa.table([pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.float64())], names=["query_id", "vec_id", "score"])

    by = ["bucket", "row_block", "query_block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(rank, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, ident: str = "vec_id", vector: str = "embedding", tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: the k nearest found by cosine for every usable vector that `is_query` (a condition on `id`) names, the
    query itself left out; ties go to the smaller id. An empty table has an empty result."""
    known, dim = usable(vectors, ident, vector)
    known = written(known, "vectors")
    probes = min(probes, 2 * (1 << max(0, dim - 1).bit_length()))

    def hashed(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    found = axes(matrix(batch.column(1), dim), tables, n).reshape(batch.num_rows, -1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)), pa.array(found.ravel()))
                    yield pa.record_batch([*batch.columns, lists], names=["id", "v", "buckets"])

        return run

    schema = "id long, v array<double>, buckets array<int>"
    index = known.mapInArrow(hashed(1), schema).select(F.explode("buckets").alias("bucket"), "id", "v")
    queries = known.where(is_query)
    probed = queries.mapInArrow(hashed(probes), schema).select(F.explode("buckets").alias("bucket"), "id", "v")
    sizes = written(index.groupBy("bucket").agg(F.count("*").alias("n")), "sizes")  # at most tables x 2 x dimension rows
    found = written(best(met(index, probed, sizes, dim, k), k), "found")
    enough = min(k, known.count() - 1)
    short = queries.join(found.groupBy(F.col("query_id").alias("id")).count().where(F.col("count") >= enough), "id", "left_anti")
    if enough < 1 or short.isEmpty():
        return found
    one = sizes.where(F.col("bucket") < 2 * (1 << max(0, dim - 1).bit_length()))
    rest = met(index, short.crossJoin(F.broadcast(one.select("bucket"))).select("bucket", "id", "v"), one, dim, k)
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(best(rest, k))
