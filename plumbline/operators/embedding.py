"""Vectors of texts: a pluggable encoder applied in Arrow batches, and the incremental pass over chunks that have none."""

from __future__ import annotations

import re
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Texts that an encoder gets at a time.
BATCH = 256


class Encoder(Protocol):
    """What a model has to offer; it is sent to the tasks, so it should load its weights there, at the first call."""

    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class WordBuckets:
    """The offline default: counts of words in buckets by their characters' places, brought to length one. A text without words is zero."""

    def __init__(self, dimension: int = 64):
        self.dimension, self._bucket = dimension, {}

    def _of(self, word: str) -> int:
        found = self._bucket.get(word)
        if found is None:
            if len(self._bucket) > 100_000:
                self._bucket.clear()
            found = self._bucket[word] = sum(ord(c) * k for k, c in enumerate(word, 1)) % self.dimension
        return found

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for k, t in enumerate(texts):
            np.add.at(out[k], [self._of(w) for w in re.findall("[a-z0-9]+", t.lower())], 1)
        size = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def with_instruction(query: Column, instruction: str) -> Column:
    """The query side's text: an asymmetric encoder's instruction goes before queries, never before passages."""
    return F.concat(F.lit(instruction), query) if instruction else query


def embed(rows: DataFrame, encoder: Encoder, text: str = "text", name: str = "embedding") -> DataFrame:
    """rows with a vector of the encoder's dimension for each text; a null text has none."""
    kept = [c for c in rows.columns if c != name]
    at = kept.index(text)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                part = b.slice(lo, BATCH)
                texts = part.column(at).to_pylist()
                x = np.asarray(encoder.encode([t or "" for t in texts]), np.float32)
                if x.shape != (len(texts), encoder.dimension):
                    raise ValueError(f"the encoder gave {x.shape}, not ({len(texts)}, {encoder.dimension})")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if t is None else v for t, v in zip(texts, x, strict=True)], pa.list_(pa.float32()))], names=[*kept, name])

    schema = rows.select(*kept).schema.add(name, ArrayType(FloatType()))
    return rows.select(*kept).mapInArrow(run, schema)


def embed_pending(chunks: DataFrame, encoder: Encoder, strategy: str | None = None) -> DataFrame:
    """The chunks(id, strategy, text, embedding) that have no vector yet, with one: what an incremental pass adds. A second pass over its result adds nothing."""
    waiting = chunks.where("embedding IS NULL AND text IS NOT NULL")
    return embed(waiting if strategy is None else waiting.where(F.col("strategy") == strategy), encoder)
