"""Token counts of whole texts by the `tokenizers` library.

Only lengths leave the Arrow function. Texts are cut where the byte-level pattern always cuts (before a single blank), so a text of any length
becomes short segments; segments not counted before are encoded together, in batches of about the same bytes. Nulls and empty texts count 0.
"""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellerlake.llm.common import Remembered, map_texts, segments

BATCH_BYTES = 256 << 10
#: What one worker remembers of segments, and the longest segment that is remembered.
SEGMENT_BYTES, SEGMENT_LENGTH = 40 << 20, 64


class SegmentCounter:
    """Tokens of ` segment` by segment, remembered within a bound of bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), Remembered(SEGMENT_BYTES)

    def encode(self, texts: list[str]) -> list[int]:
        out, batch, held = [], [], 0
        for i, text in enumerate(texts):
            batch.append(text)
            held += len(text.encode())
            if held >= BATCH_BYTES or i + 1 == len(texts):
                out += [len(e) for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
                batch, held = [], 0
        return out

    def count(self, texts: list[str]) -> list[int]:
        cut, known, own, new = [segments(t) for t in texts], self.known, {}, []
        heads = self.encode([c[0] for c in cut])
        for segment in set().union(*(c[1:] for c in cut)):
            n = known.get(segment)
            if n is None and (n := known.recall(segment)) is None:
                new.append(segment)
            else:
                own[segment] = n
        own.update(zip(new, self.encode([" " + s for s in new]), strict=True))
        for segment in new:
            if len(segment) <= SEGMENT_LENGTH:
                known.keep(segment, own[segment], 180 + len(segment))
        lookup = own.__getitem__
        return [h + sum(map(lookup, c[1:])) for h, c in zip(heads, cut, strict=True)]


@lru_cache(maxsize=2)
def counter(path: str) -> SegmentCounter:
    return SegmentCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns, `n_bytes`, `n_tokens` and `over_limit`, a row for each row; ties and repeated rows stay as they are."""
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]

    def work(texts: list[bytes]) -> dict[str, list]:
        return {"n_bytes": [len(t) for t in texts], "n_tokens": counter(path).count([t.decode() for t in texts])}

    return map_texts(docs, text, {c: c for c in keep}, fields, work).withColumn("over_limit", F.col("n_tokens") > limit)
