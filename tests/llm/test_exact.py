"""Texts made so that weak hashes of them collide: results must tell them apart."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from topicloom.llm import bm25, jaccard_join, quality_rules, repeated_spans
from topicloom.llm import bytes as B

SCHEMA = "doc_id long, text string"


def morse(n):
    """The first n letters of the Thue-Morse sequence and of its complement: polynomials modulo 2 ** 64 can not tell them apart."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


ONE, TWO = morse(2048)


def test_hashes():
    data = np.frombuffer((ONE + TWO).encode(), np.uint8)
    for size in (3, 8, 9, 200, 257, 1024, 2048):
        for lane in (0, 1):
            a, b = B.hashes(data, np.array([0, 2048]), np.array([size, 2048 + size]), lane)
            assert a != b
            one, two = B.windows(data[:2048], size, lane), B.windows(data[2048:], size, lane)
            assert len(one) == 2049 - size and one[0] != two[0]
    r = random.Random(1)
    text = "".join(r.choice("ab") for _ in range(600)).encode()
    for size in (1, 2, 5, 7, 8, 11, 16, 23, 24, 40, 64, 100, 400):
        strings = [text[i : i + size] for i in range(len(text) - size + 1)]
        got = B.windows(np.frombuffer(text, np.uint8), size)
        assert len(set(strings)) == len(set(got.tolist())) == len(set(zip(strings, got.tolist(), strict=True)))


def test_jaccard_join_tells_apart(spark):
    docs = spark.createDataFrame([(1, ONE), (2, TWO), (3, "x y " + ONE), (4, "x y " + TWO)], SCHEMA)
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicate_components(docs, words=3, num=90).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_quality_rules_tell_apart(spark):
    words = [morse(512)[k % 2][i : i + 256] for i in range(6) for k in (0, 1)]
    docs = spark.createDataFrame([(1, ONE + "\n" + TWO), (2, ONE + "\n" + TWO + "\n" + ONE), (3, " ".join(words))], SCHEMA)
    got = {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in quality_rules.quality_rules(docs).collect()}
    assert got == {1: (0, 0), 2: (1, 0), 3: (0, 0)}


def test_bm25_tells_apart(spark):
    docs = spark.createDataFrame([(1, ONE), (2, TWO), (3, ONE + " x")], SCHEMA)
    found = bm25.search(docs, docs.where("doc_id = 1")).collect()
    assert sorted(r.doc_id for r in found) == [1, 3]


@pytest.mark.parametrize("hot", [repeated_spans.HOT, 1])
def test_repeated_spans_tell_apart(spark, hot):
    docs = spark.createDataFrame([(1, "x" + ONE[:700] + "q"), (2, "y" + TWO[:700]), (3, "zz" + ONE[:450])], SCHEMA)
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    seen = Counter(b[i : i + 400] for b in texts.values() for i in range(len(b) - 399))
    for r in repeated_spans.remove_repeated(docs, hot=hot).collect():
        b, gone = texts[r.doc_id], bytearray(len(texts[r.doc_id]))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (r.n_removed, r.n_spans, r.kept_sha256) == (sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())


def test_radix_order():
    """Order and shared bytes equal those of sorting, with NULs, strings that begin others and equal ones."""
    r = random.Random(3)
    for _ in range(60):
        strings = [bytes(r.choice(b"\0ab") for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 40))]
        groups = np.array([r.randint(0, 3) for _ in strings])
        size = np.array([len(s) for s in strings])
        at = np.r_[0, np.cumsum(size)[:-1]]
        order, shared = repeated_spans._radix(np.frombuffer(b"".join(strings), np.uint8), at, size, groups)
        assert [(groups[i], strings[i]) for i in order] == sorted(zip(groups, strings, strict=True))
        for k in range(1, len(order)):
            a, b = order[k - 1], order[k]
            same = next((j for j, (x, y) in enumerate(zip(strings[a], strings[b], strict=False)) if x != y), min(size[a], size[b]))
            assert shared[k] == (same if groups[a] == groups[b] else -1)
        assert shared[0] == -1
