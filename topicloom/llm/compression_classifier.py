"""Quality classifier by compression against dictionaries of good and of bad text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytes as B


def _sizes(texts: list[bytes], good: bytes, bad: bytes, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compressed sizes with either dictionary, and sizes."""
    with_ = [zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_dict_id=False) for d in (good, bad)]
    g, b = (np.array([len(c.compress(t)) for t in texts], float) for c in with_)
    return g, b, np.array([len(t) for t in texts], float)


def _features(g: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The difference of the compressed sizes over the size and over the compressed size, the ratio, and how they shift with length."""
    size = n + 16
    log = np.log(size)
    return np.c_[(b - g) / size, (b - g) / g, g / size, log, g / size * log, (b - g) / size * log]


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries and the calibration; a few hundred kB whatever it was fitted on."""

    good: bytes = b""
    bad: bytes = b""
    level: int = 3
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.weights or not texts:
            return np.full(len(texts), 0.5)
        x = (_features(*_sizes(texts, self.good, self.bad, self.level)) - np.array(self.mean)) / np.array(self.scale)
        z = np.c_[np.ones(len(x)), x] @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = weight * (p * (1 - p) + 1e-6)
        step = np.linalg.solve((x * h[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary, or raw content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 4000, max_bytes: int = 1 << 16, dictionary_bytes: int = 1 << 16, level: int = 3, total_bytes: int = 32 << 20) -> CompressionModel:
    """Fit on at most ``sample`` labelled rows of each class, of at most ``max_bytes`` bytes each and ``total_bytes`` a class together.

    The rows are those with the least hash of their id; one half trains the dictionaries, the other the
    calibration, whose classes are weighted by their numbers among all labels. Labels other than 0 and 1,
    null ids and ids without a document are ignored. Without both classes the model scores 0.5 throughout.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(totals) < 2:
        return CompressionModel(level=level)
    order = F.xxhash64("doc_id")
    ids = known.where("y = 1").orderBy(order, "doc_id").limit(sample).unionAll(known.where("y = 0").orderBy(order, "doc_id").limit(sample))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") <= max_bytes)
    # ids has 2 * sample rows at most; sizes come first, so that the texts that follow are bounded.
    ids = ids.withColumn("h", order)
    sizes = texts.join(F.broadcast(ids), "doc_id").select("y", "h", "doc_id", F.octet_length("text").alias("n")).collect()
    held, chosen = {0: 0, 1: 0}, set()
    for y, _, doc_id, n in sorted(sizes):
        held[y] += n
        if held[y] <= total_bytes:
            chosen.add((doc_id, y))
    if not chosen:
        return CompressionModel(level=level)
    some = docs.sparkSession.createDataFrame(sorted(chosen), "doc_id long, y int")
    rows = sorted({(r["doc_id"], r["y"], r["text"].encode()) for r in texts.join(F.broadcast(some), "doc_id").collect()})
    halves: dict[tuple[int, int], list[bytes]] = {(y, k): [] for y in (0, 1) for k in (0, 1)}
    taken = {0: 0, 1: 0}
    for _, y, text in rows:
        halves[y, taken[y] % 2].append(text)
        taken[y] += 1
    if not all(halves.values()):
        return CompressionModel(level=level)
    good, bad = (_dictionary(halves[y, 0], dictionary_bytes) for y in (1, 0))
    held = [(t, y) for y in (0, 1) for t in halves[y, 1]]
    x = _features(*_sizes([t for t, _ in held], good, bad, level))
    y = np.array([y for _, y in held], float)
    share = {k: totals[k] / sum(totals.values()) / len(halves[k, 1]) for k in (0, 1)}
    weight = np.where(y == 1, share[1], share[0]) * len(y)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w = _logistic((x - mean) / scale, y, weight)
    return CompressionModel(good, bad, level, tuple(mean), tuple(scale), tuple(w))


def score(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row of ``docs``, over its whole text; a null text counts as empty.

    Rows are scored alone: repeated rows and ids give repeated results, an empty table an empty one.
    """

    def rows(batches):
        for batch in batches:
            data, offsets = B.texts_of(batch.column(1))
            s = np.empty(batch.num_rows)
            for i in range(0, batch.num_rows, 256):
                j = min(i + 256, batch.num_rows)
                s[i:j] = model.score([data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["id", "score"])

    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return thin.mapInArrow(B.released(rows), f"id {thin.schema[0].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def filter_quality(docs: DataFrame, model: CompressionModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns, unchanged."""
    at = docs.columns.index(text_col)
    text = docs.schema[at].dataType.simpleString()
    if text != "string":
        raise TypeError(f"{text_col} is {text}, not string")

    def rows(batches):
        for batch in B.slices(batches, 256):
            data, offsets = B.texts_of(batch.column(at))
            keep = model.score([data[offsets[k] : offsets[k + 1]].tobytes() for k in range(batch.num_rows)]) >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(B.released(rows), docs.schema)
