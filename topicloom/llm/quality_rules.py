"""Quality rules: counts over words and lines, and compression bands over whole texts and fixed chunks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytes as B
from .store import Store

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


#: Ends (bytes, included) of the lengths that have limits of their own.
LENGTHS = (60, 100, 200, 350, 500, 700, 1000, 1500, 2000, 3000, 5000, 10_000, 1 << 62)


@dataclass(frozen=True)
class Bands:
    """Compressed size over size must lie in a band that depends on the length.

    Short texts compress badly and long ones well whatever they say, so each length (bytes, up to and
    including) has limits of its own: below the first the text repeats itself, above the second it is
    noise. A text is also rejected where more than ``bad_share`` of its chunks of ``chunk`` bytes (the last one may
    be shorter) are outside the band of their length. The limits here are wide; ``fit_bands`` measures those of a corpus.
    """

    limits: tuple[tuple[int, float, float], ...] = ((60, 0.5, 99.0), (100, 0.4, 1.6), (200, 0.35, 1.3), (500, 0.30, 1.0), (1000, 0.28, 0.90), (2000, 0.26, 0.85), (5000, 0.22, 0.80), (1 << 62, 0.18, 0.78))
    chunk: int = 4096
    bad_share: float = 0.34
    level: int = 3

    def outside(self, size: int, ratio: float) -> bool:
        if not size:
            return False
        low, high = next((lo, hi) for n, lo, hi in self.limits if size <= n)
        return not low <= ratio <= high


def _at_ranks(values: DataFrame, wanted: dict[int, set[int]]) -> dict[tuple[int, int], float]:
    """The values at ranks from 0 within each band. values: band, key, a written table; the key is the bits of a positive double, which order as the doubles do.

    Keys are found digit by digit from the top: each pass counts the next digits of those that begin as a sought one does,
    so that what comes to the driver is bounded whatever the number of rows.
    """
    spark = values.sparkSession
    # (band, digits so far): {rank: rank among the keys that begin so}
    sought = {(band, 0): {r: r for r in ranks} for band, ranks in wanted.items() if ranks}
    if not sought:
        return {}
    last = 63
    for shift in (52, 40, 28, 16, 4, 0):
        begun = spark.createDataFrame(sorted(sought), "band int, begun long")
        own = values.withColumn("begun", F.shiftright("key", last) if last < 63 else F.lit(0).cast("long")).join(F.broadcast(begun), ["band", "begun"])
        counts: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for band, start, digits, n in own.groupBy("band", "begun", F.shiftright("key", shift).alias("digits")).count().collect():
            counts.setdefault((band, start), []).append((digits, n))
        following: dict[tuple[int, int], dict[int, int]] = {}
        for (band, start), ranks in sought.items():
            digits, n = (np.array(x) for x in zip(*sorted(counts[band, start]), strict=True))
            ends = np.cumsum(n)
            for rank, left in ranks.items():
                i = int(np.searchsorted(ends, left, "right"))
                following.setdefault((band, int(digits[i])), {})[rank] = left - int(ends[i] - n[i])
        sought, last = following, shift
    return {(band, rank): float(np.array([key], np.int64).view(np.float64)[0]) for (band, key), ranks in sought.items() for rank in ranks}


def fit_bands(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text", tail: float = 0.002, margin: float = 0.005, least: int = 50) -> Bands:
    """Bands from rows known to be good (``good`` has their ids): outside them are 2 * ``tail`` of such rows, about.

    The limits of a length are quantiles of all its good rows' ratios, exact ones, each moved outwards by ``margin`` of itself; a length with
    fewer than ``least`` rows keeps the wide limits. Every row with a good id counts, repeated ones too; only counts
    come to the driver. Null ids and null or empty texts are left out; without rows all limits stay wide.
    """
    wide = Bands()
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text <> ''")

    def ratios(batches):
        zip_ = zstandard.ZstdCompressor(level=wide.level, write_content_size=False)
        for batch in batches:
            raw = [t.encode() for t in batch.column(1).to_pylist()]
            band = np.searchsorted(LENGTHS, [len(r) for r in raw])
            ratio = np.array([len(zip_.compress(r)) / len(r) for r in raw], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(band.astype(np.int32)), pa.array(ratio.view(np.int64))], ["id", "band", "key"])

    # Texts are measured where they lie: only their ratios meet the ids.
    found = thin.mapInArrow(B.released(ratios), f"id {thin.schema[0].dataType.simpleString()}, band int, key long")
    ids = good.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    values = Store(docs.sparkSession, "bands").put(found.join(ids, "id", "left_semi").select("band", "key"), "ratios")
    sizes = {r["band"]: r["count"] for r in values.groupBy("band").count().collect() if r["count"] >= least}
    ends = {band: [q * (n - 1) for q in (tail, 1 - tail)] for band, n in sizes.items()}
    at = _at_ranks(values, {band: {min(int(x) + i, sizes[band] - 1) for x in both for i in (0, 1)} for band, both in ends.items()})

    def quantile(band: int, x: float) -> float:
        low, high = (at[band, min(int(x) + i, sizes[band] - 1)] for i in (0, 1))
        return low + (high - low) * (x - int(x))

    limits = []
    for band, end in enumerate(LENGTHS):
        low, high = next((lo, hi) for n, lo, hi in wide.limits if end <= n)
        if band in sizes:
            low, high = (quantile(band, x) * (1 + sign * margin) for x, sign in zip(ends[band], (-1, 1), strict=True))
        limits.append((end, float(low), float(high)))
    return Bands(tuple(limits))


def _repeats(start_words: np.ndarray, grams: np.ndarray, text: np.ndarray, n_words: int, n: int) -> np.ndarray:
    """Which words lie in a window of n words that its text has twice or more."""
    key = B.mix(grams ^ B.mix(text.astype(B.U64)))
    order = np.argsort(key)
    s = key[order]
    same = np.flatnonzero(s[1:] == s[:-1])
    again = np.zeros(len(key), bool)
    again[order[same]] = True
    again[order[same + 1]] = True
    edge = np.zeros(n_words + 1, np.int64)
    at = start_words[again]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier one."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def _counts(block: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    start, end, bounds = B.words_of(block, at)
    texts = len(at) - 1

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags)]
        return total[at[1:]] - total[at[:-1]]

    out = {"n_words": np.diff(bounds), "word_chars": per_text(~B.SEPARATOR[block] & ~B.CONTINUATION[block]), "n_symbols": per_text(SYMBOLS[block])}
    hashes = B.hashes(block, start, end)
    n = 5
    word_text = np.repeat(np.arange(texts), out["n_words"])
    first = np.flatnonzero(np.arange(len(start)) + n <= bounds[1:][word_text]) if len(start) else np.zeros(0, np.int64)
    grams, _ = B.grams(hashes, bounds, n, short=False)
    covered = np.r_[0, np.cumsum(_repeats(first, grams, word_text[first], len(start), n))]
    out["n_repeat_words"] = covered[bounds[1:]] - covered[bounds[:-1]]
    out["n_dup_lines"] = np.array([_dup_lines(block[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)], np.int64)
    return out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands | None = None) -> DataFrame:
    """One row for each row of ``docs``: its id, counts, ratio, bad_chunks, n_chunks, base_failed, kept.

    Words are runs of bytes other than space and U+0009 to U+000D. word_chars are their code points;
    n_symbols the characters ``# * $ % & | < >`` of the text; n_dup_lines the lines with a word that
    equal an earlier line; n_repeat_words the words in five-word windows that the text has twice or more.
    base_failed: under 10 words, or over 20 % of the words repeat so. kept: neither that nor outside the
    compression bands (the wide ones unless others are given). Every row is judged alone, so repeated rows and ids give repeated results. A null
    or empty text has no words and so is not kept. An empty table gives an empty one.
    """
    rules = bands or Bands()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def rows(batches):
        zip_ = zstandard.ZstdCompressor(level=rules.level, write_content_size=False)
        for batch in batches:
            data, offsets = B.texts_of(batch.column(1))
            parts: dict[str, list] = {k: [] for k in names}
            for _, _, block, at in B.blocks(data, offsets):
                for k, v in _counts(block, at).items():
                    parts[k].append(v)
            cols = [pa.array(np.concatenate(parts[k]) if parts[k] else np.zeros(0), pa.int64()) for k in names]
            ratios, bad, chunks = [], [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                raw = data[a:b].tobytes()
                ratios.append(len(zip_.compress(raw)) / max(1, len(raw)))
                pieces = [raw[k : k + rules.chunk] for k in range(0, len(raw), rules.chunk)] if len(raw) > rules.chunk else []
                bad.append(sum(rules.outside(len(p), len(zip_.compress(p)) / len(p)) for p in pieces))
                chunks.append(len(pieces))
            outside = [rules.outside(int(n), r) or (c and x > rules.bad_share * c) for n, r, x, c in zip(np.diff(offsets), ratios, bad, chunks, strict=True)]
            cols += [pa.array(ratios, pa.float64()), pa.array(bad, pa.int64()), pa.array(chunks, pa.int64()), pa.array([bool(x) for x in outside])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", *names, "ratio", "bad_chunks", "n_chunks", "outside"])

    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = thin.schema[0].dataType.simpleString()
    found = thin.mapInArrow(B.released(rows), f"id {kind}, " + ", ".join(f"{k} long" for k in names) + ", ratio double, bad_chunks long, n_chunks long, outside boolean")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = found.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.col("outside"))
    return found.select(F.col("id").alias(id_col), *names, "ratio", "bad_chunks", "n_chunks", "base_failed", "kept")
