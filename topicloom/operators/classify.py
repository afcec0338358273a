"""Post-processing of classifier logits, and pooling of token vectors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import let

# The tokens that stand for no word.
SPECIAL_TOKENS = ("[CLS]", "[SEP]", "<s>", "</s>", "<pad>", "[PAD]", "<cls>", "<sep>")


class Classifier(Protocol):
    """A sequence classifier. problem: single_label, multi_label or regression."""

    labels: list[str]
    problem: str

    def logits(self, texts: list[str]) -> np.ndarray: ...


def classify_texts(df: DataFrame, classifier: Classifier, batch_size: int = 32, text_col: str = "text") -> DataFrame:
    """doc_id and what ``single_label``, ``multi_label`` or ``regression`` give of each text's logits; null texts count as empty."""
    if not hasattr(classifier, "logits"):
        raise TypeError(f"{type(classifier).__name__} has no logits method")
    finish = {"single_label": single_label, "multi_label": multi_label, "regression": regression}.get(classifier.problem)
    if finish is None:
        raise ValueError(f"unknown problem {classifier.problem!r}")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = list(pdf["text"].fillna(""))
            parts = [np.asarray(classifier.logits(texts[i : i + batch_size]), float) for i in range(0, len(texts), batch_size)]
            if parts:
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "logits": list(np.concatenate(parts))})

    found = df.select("doc_id", F.col(text_col).alias("text")).mapInPandas(rows, "doc_id long, logits array<double>")
    return finish(found, classifier.labels)


def regression(df: DataFrame, labels: list[str], logits: str = "logits") -> DataFrame:
    """doc_id and each output as it is."""
    return df.select("doc_id", *(F.col(logits)[i].alias(x) for i, x in enumerate(labels)))


def softmax(logits: Column | str) -> Column:
    """Shares that sum to 1, from logits less their greatest."""
    col = F.col(logits) if isinstance(logits, str) else logits
    powers = let(col, lambda u: let(F.array_max(u), lambda most: F.transform(u, lambda x: F.exp(x - most))))
    return let(powers, lambda p: let(F.aggregate(p, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(p, lambda x: x / total)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def single_label(df: DataFrame, labels: list[str], logits: str = "logits") -> DataFrame:
    """doc_id, label, score and a column for each label; the first label on ties."""
    names = F.array(*(F.lit(x) for x in labels))
    df = df.withColumn("p", softmax(logits))
    score = F.array_max("p")
    return df.select("doc_id", F.element_at(names, F.array_position("p", score).cast("int")).alias("label"), score.alias("score"), *(F.col("p")[i].alias(x) for i, x in enumerate(labels)))


def multi_label(df: DataFrame, labels: list[str], logits: str = "logits") -> DataFrame:
    """doc_id and each label's own probability."""
    return df.select("doc_id", *(sigmoid(F.col(logits)[i]).alias(x) for i, x in enumerate(labels)))


def token_labels(df: DataFrame, labels: list[str]) -> DataFrame:
    """(doc_id, pos, token, label, score) of (doc_id, tokens, mask, logits: array of arrays), without masked and special tokens."""
    names = F.array(*(F.lit(x) for x in labels))
    rows = df.select("doc_id", F.posexplode(F.arrays_zip("tokens", "mask", "logits")).alias("pos", "t")).where("t.mask = 1").where(~F.col("t.tokens").isin(*SPECIAL_TOKENS))
    rows = rows.withColumn("p", softmax(F.col("t.logits")))
    score = F.array_max("p")
    return rows.select("doc_id", "pos", F.col("t.tokens").alias("token"), F.element_at(names, F.array_position("p", score).cast("int")).alias("label"), score.alias("score"))


def mean_pool(tokens: DataFrame) -> DataFrame:
    """(doc_id, vector): masked mean of (doc_id, pos, mask, vector); without unmasked tokens near zero."""
    cells = tokens.select("doc_id", "mask", F.posexplode(F.col("vector").cast("array<double>")).alias("dim", "x"))
    means = cells.groupBy("doc_id", "dim").agg((F.sum(F.col("x") * F.col("mask")) / F.greatest(F.sum(F.col("mask").cast("double")), F.lit(1e-9))).alias("x"))
    return means.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda c: c["x"]).alias("vector"))


def cls_pool(tokens: DataFrame) -> DataFrame:
    """(doc_id, vector): each document's first token's vector."""
    return tokens.groupBy("doc_id").agg(F.min_by("vector", "pos").alias("vector"))


def chunk_windows(df: DataFrame, max_length: int = 256, overlap: int = 0, first_only: bool = False, max_positions: int | None = None) -> DataFrame:
    """(doc_id, chunk, tokens) of (doc_id, tokens incl. the two special ends): windows of ``max_length``, wrapped again.

    max_length is cut to the positions that the model has, where ``max_positions`` tells.
    """
    max_length = min(max_length, max_positions or max_length)
    if max_length < 3:
        raise ValueError("a window needs room for a token between its special ends")
    body = max_length - 2
    stride = max(1, body - overlap)
    n = F.size("tokens")
    inner = F.slice("tokens", 2, F.greatest(n - 2, F.lit(0)))
    starts = F.array(F.lit(1)) if first_only else F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)), F.lit(stride))
    wrapped = F.transform(starts, lambda s: F.concat(F.slice("tokens", 1, 1), F.slice(inner, s, body), F.slice("tokens", -1, 1)))
    return df.select("doc_id", F.posexplode(F.when(n <= max_length, F.array("tokens")).otherwise(wrapped)).alias("chunk", "tokens"))
