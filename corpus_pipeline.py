"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, token ids.

Every stage takes the documents its predecessor kept and returns documents; the last returns the encoding of each.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellerlake.llm import bpe, contamination, neardup, quality, substrings
from tellerlake.llm.common import read, whole_texts, written
from tellerlake.session import use_utc


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' votes accept. The model learns from the labelled documents among its input."""
    return quality.accepted_documents(docs, quality.train(docs, read(whole_texts(spark), sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that with the smallest id."""
    whole_texts(spark)
    return neardup.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts; texts without any stay as they are. No document goes, even if no word is left."""
    whole_texts(spark)
    marks = ("n_words", "n_removed", "kept")
    held = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    cut = substrings.without_repeats(held, text=place["text"], names=marks)
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col(place["text"]))}
    if "n_chars" in place:
        new["n_chars"] = F.when(changed, F.length("kept").cast("long")).otherwise(F.col(place["n_chars"]))
    return cut.select(*(new.get(c, F.col(p)).alias(c) for c, p in place.items()))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return contamination.drop_contaminated(docs, read(whole_texts(spark), sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the bytes decoded from them, of each document."""
    whole_texts(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: Votes, sampling and tiling are not expressible in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(use_utc(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
