"""Quality scores by voting of the nearest labelled documents in a latent-semantic space.

Whole texts become hashed byte-trigram frequencies, weighted and projected on the leading singular vectors of a bounded sample of labelled documents.
The sample's vectors go to every executor (their number is bounded), where blocks of documents are multiplied with all of them; the most similar ones
vote with their labels, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellerlake.llm.common import filter_texts, map_texts, slices

#: Labelled documents of each class that the space is fitted on and that vote, at most: those with the smallest hash of their id.
SAMPLE_PER_CLASS = 2048
FEATURES, RUNS, DIMENSIONS = 2048, 4, 64
NEIGHBOURS, SHARPNESS = 15, 4
ACCEPTED = 0.3


def frequencies(text: bytes) -> np.ndarray:
    """Byte trigrams, hashed, and one term for each length up to `RUNS` of runs of one repeated word; texts under three bytes are padded with
    blanks, empty ones have none."""
    if not text:
        return np.zeros(FEATURES + RUNS, np.float32)
    words = text.lower().split()
    same = np.fromiter(map(eq, words, words[1:]), bool, max(0, len(words) - 1))
    runs = np.zeros(RUNS, np.float32)
    for i in range(RUNS):
        runs[i] = np.count_nonzero(same)
        same = same[1:] & same[:-1]
    b = np.frombuffer(text.ljust(3), np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(21)
    return np.concatenate((np.bincount(h.astype(np.int32), minlength=FEATURES).astype(np.float32), runs))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    references: np.ndarray
    labels: np.ndarray
    prior: float

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit(unit(np.sqrt(counts) * self.idf) @ self.basis)

    def scores(self, texts: list[bytes], block: int = 256) -> list[float]:
        """Similarity-weighted mean label of the neighbours; the prior where nothing is similar."""
        out: list[float] = []
        for i in range(0, len(texts), block):
            if not len(self.labels):
                out += [self.prior] * len(texts[i : i + block])
                continue
            x = self.vectors(np.stack([frequencies(t) for t in texts[i : i + block]]))
            cosine = x @ self.references.T
            k = min(NEIGHBOURS, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** SHARPNESS
            total = weight.sum(axis=1)
            out += np.where(total > 1e-9, (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-9), self.prior).tolist()
        return out


def fit(counts: np.ndarray, labels: np.ndarray, prior: float) -> Model:
    """Latent space by subspace iteration with a fixed start."""
    idf = (np.log((len(counts) + 1) / ((counts > 0).sum(axis=0) + 1)) + 1).astype(np.float32)
    x = unit(np.sqrt(counts) * idf)
    basis = np.random.default_rng(3).standard_normal((FEATURES + RUNS, DIMENSIONS)).astype(np.float32)
    for _ in range(6 if len(x) else 0):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    model = Model(idf, basis.astype(np.float32), np.zeros((0, DIMENSIONS), np.float32), labels, prior)
    model.references = model.vectors(counts)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", ident: str = "doc_id", text: str = "text", fold: int = 0, folds: int = 5, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Learn from labelled rows outside `fold` (crc32 of the id as text, modulo `folds`). Null labels do not count; an id with several labels has
    their mean. Without labelled documents every score is 0.5."""
    ids = labels.select(labels[ident].alias("id"), labels[label].cast("double").alias("label")).where("id is not null and label is not null")
    learned = ids.where(F.crc32(F.col("id").cast("string")) % folds != fold).groupBy("id").agg(F.avg("label").alias("label")).withColumn("order", F.xxhash64("id"))
    prior = learned.agg(F.avg("label")).first()[0]
    chosen = learned.where("label >= 0.5").orderBy("order", "id").limit(per_class).unionByName(learned.where("label < 0.5").orderBy("order", "id").limit(per_class))
    rows = docs.select(docs[text].cast("binary").alias("text"), docs[ident].alias("id")).join(F.broadcast(chosen), "id").select("text", "label", "order")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            made = [frequencies(t or b"").tobytes() for t in part.column(0).to_pylist()]
            yield pa.record_batch([part.column(1), part.column(2), pa.array(made, pa.binary())], names=["label", "order", "counts"])

    held = rows.mapInArrow(count, "label double, order long, counts binary").orderBy("order", "counts").limit(2 * per_class).collect()
    counts = np.stack([np.frombuffer(r.counts, np.float32) for r in held]) if held else np.zeros((0, FEATURES + RUNS), np.float32)
    return fit(counts, np.array([r.label for r in held]), 0.5 if prior is None else float(prior))


def quality_scores(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), accepted: float = ACCEPTED) -> DataFrame:
    """Kept columns, `score` (0 to 1) and `predicted` (1 from `accepted` on), a row for each row; null and empty texts score the prior."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = map_texts(docs, text, {c: c for c in keep}, [T.StructField("score", T.DoubleType())], lambda texts: {"score": shared.value.scores(texts)})
    return out.withColumn("predicted", (F.col("score") >= accepted).cast("int"))


def accepted_documents(docs: DataFrame, model: Model, text: str = "text", accepted: float = ACCEPTED) -> DataFrame:
    """Documents, all columns as they are, that score at least `accepted`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_texts(docs, text, lambda texts: [s >= accepted for s in shared.value.scores(texts)])
