"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from topicloom.llm import importance_resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, row long, bucket int, gain long, range long, score double"


def features(text, least, most):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)]


def plainly(rows, target, grams, buckets, percent, least_words, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [features(t, *grams) for _, t in rows]
    s = Counter(bucket(f) for _, fs in own for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x, *grams)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for (doc_id, _), (n, fs) in zip(rows, own, strict=True):
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= least_words), key=lambda x: (-x[4], x[0] is None, x[0]))
    for k, x in enumerate(able[: percent * len(able) // 100], 1):
        x[5] = k
    return sorted((tuple(x) for x in out), key=repr)


def cases():
    rows = [(i, " ".join(f"Word{(i * j) % 37} é{j % 5}-x" for j in range(i % 60))) for i in range(150)]
    return [*rows, (150, None), (151, ""), (152, "…–—"), (153, "ÄÖÜ äöü ÄÖÜ 中文 x_y"), (154, "long " * 30_000), (None, "a null id " * 9), (7, "again " * 25), (8, rows[8][1])]


@pytest.mark.parametrize("given", [dict(grams=(1, 1), buckets=10_000, percent=10, least_words=20, seed=2024), dict(grams=(1, 2), buckets=64, percent=50, least_words=5, seed=1), dict(grams=(2, 3), buckets=1000, percent=100, least_words=0, seed=7), dict(grams=(1, 1), buckets=10, percent=0, least_words=1, seed=3)])
def test_resample(spark, given):
    rows = cases()
    target = ["Word1 word2 é3", None, "", "x é1 x é2 中文", "word5 " * 40]
    docs = spark.createDataFrame([(d, t, 1, 2, 3, 4, 0.5) for d, t in rows], SCHEMA).repartition(4)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = importance_resampling.resample(docs, goal, **given)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert {t for c, t in got.dtypes} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plainly(rows, target, **given)


def test_empty(spark):
    docs, none = spark.createDataFrame([(1, "a b c", 1, 1, 1, 1, 0.0)], SCHEMA), spark.createDataFrame([], SCHEMA)
    assert importance_resampling.resample(none, docs).count() == 0
    (one,) = importance_resampling.resample(docs, none, percent=100, least_words=1).collect()
    assert (one.n_words, one.n_features, one.rank) == (3, 5, 1)


def test_higher_ids_rank_after_equals(spark):
    docs = spark.createDataFrame([(5, "same words here", 1, 1, 1, 1, 0.0)] * 4, SCHEMA)
    got = importance_resampling.resample(docs, docs, percent=50, least_words=1).collect()
    assert sorted(r["rank"] or 0 for r in got) == [0, 0, 1, 2]
