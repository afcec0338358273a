"""Encoders and embedding of texts.

A model is anything with ``encode(list[str]) -> array (n, d)``; it is sent to the workers once for each task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize, mean_vector

#: Texts that a task holds as strings at once, whatever the size of its batches.
SLICE = 512


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """A stand-in without a model: signed counts of hashed lower-case words."""

    def __init__(self, dim: int = 64, prefix: str = ""):
        self.dim, self.prefix = dim, prefix

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for word in (self.prefix + (text or "")).lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % self.dim] += 1 if h >> 16 & 1 else -1
        return out


class ApiEncoder:
    """Embeddings from a service: ``call(texts)`` gives (index, vector) pairs in any order."""

    def __init__(self, call: Callable[[list[str]], list[tuple[int, list[float]]]], batch_size: int = 512, prefix: str = ""):
        self.call, self.batch_size, self.prefix = call, batch_size, prefix

    def encode(self, texts: list[str]) -> np.ndarray:
        rows: list[list[float]] = []
        for i in range(0, len(texts), self.batch_size):
            rows += [v for _, v in sorted(self.call([self.prefix + t for t in texts[i : i + self.batch_size]]))]
        return np.array(rows, float)


def embed_texts(df: DataFrame, encoder: Encoder, batch_size: int = 32, normalize: bool = True, text_col: str = "text") -> DataFrame:
    """(doc_id, embedding). Texts of a slice are sorted by length, so that models pad little."""
    if not hasattr(encoder, "encode"):
        raise TypeError(f"{type(encoder).__name__} has no encode method")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                order = np.argsort([len(t) for t in texts], kind="stable")
                out = np.concatenate([np.asarray(encoder.encode([texts[j] for j in order[i : i + batch_size]]), float) for i in range(0, len(order), batch_size)])
                offsets = pa.array((np.arange(len(out) + 1) * out.shape[1]).astype(np.int32))
                vectors = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(out).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(order)).cast(pa.int64()), vectors], ["doc_id", "embedding"])

    raw = df.select("doc_id", F.col(text_col).alias("text")).mapInArrow(rows, "doc_id long, embedding array<double>")
    return raw.withColumn("embedding", l2_normalize("embedding")) if normalize else raw


def embed_chunks(df: DataFrame, encoder: Encoder, max_words: int = 254, overlap: int = 0, strategy: str = "mean", normalize: bool = True) -> DataFrame:
    """(doc_id, embedding): the mean of the vectors of a text's windows of words, or with ``first`` the first one's."""
    if strategy not in ("mean", "first"):
        raise ValueError(f"unknown strategy {strategy!r}")
    df, words = df.select("doc_id", F.split("text", r"\s+").alias("words")), F.col("words")
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(max(1, max_words - overlap))) if strategy == "mean" else F.array(F.lit(1))
    chunks = df.select("doc_id", F.explode(F.transform(starts, lambda s: F.array_join(F.slice(words, s, max_words), " "))).alias("text"))
    means = mean_vector(embed_texts(chunks, encoder, normalize=False), ["doc_id"], "embedding", "embedding")
    return means.withColumn("embedding", l2_normalize("embedding")) if normalize else means
