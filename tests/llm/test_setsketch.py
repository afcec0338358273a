"""SetSketch near duplicates: registers, the estimate, and components against all pairs."""

import random
import re

import numpy as np
import pytest

from topicloom.llm import setsketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, token string, n int, comp long, registers string"


def shingles(text, n):
    w = [x.translate(LOWER) for x in WORD.findall(text or "")]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def by_pairs(rows, n, num):
    """(n_shingles, component_id, kept) of each (id, text), in order."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least.setdefault(top(i), []).append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(((d, len(s), least[top(i)], d == least[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def cases():
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(4, 160))) for _ in range(14)]
    rows = [(i, t) for i, t in enumerate(base)]
    for t in base * 4:  # about the threshold: one to four changed words
        w = t.split(" ")
        for _ in range(r.randint(1, 4)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((len(rows), " ".join(w)))
    odd = [base[0], base[0].upper(), base[1] + "  \n", "", None, " \t ", "one", "One", "one two", "a b c d", "a b c d e", "x" * 9000, "word " * 6000, " ".join(words * 30), " ".join(words * 30 + ["end"])]
    rows += [(len(rows) + i, t) for i, t in enumerate(odd)]
    return [*rows, (3, base[3]), (3, base[7]), (None, base[2]), (None, "nothing like it at all"), (None, None)]


@pytest.mark.parametrize("words,num,hot", [(4, 80, 32), (4, 80, 2), (5, 80, 32), (3, 90, 1)])
def test_near_duplicates(spark, words, num, hot):
    rows = cases()
    docs = spark.createDataFrame([(d, t, "x", 1, 5, "r") for d, t in rows], SCHEMA).repartition(5)
    got = setsketch.near_duplicates(docs, words=words, num=num, hot=hot)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "class_size", "kept"]
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=repr)
    want = [(d, n, c, k or (d is None and c is None)) for d, n, c, k in by_pairs(rows, words, num)]
    assert found == sorted(want, key=repr)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert setsketch.near_duplicates(docs).count() == 0
    docs = spark.createDataFrame([(1, None, "", 1, 1, ""), (2, "", "", 1, 1, "")], SCHEMA)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.class_size, r.kept) for r in setsketch.near_duplicates(docs).collect()} == {(1, 0, 1, 1, True), (2, 0, 2, 1, True)}


def test_a_large_group_of_near_copies(spark):
    """Every member of a group far above the size of a hot bucket is found, and a second group that shares bands stays apart."""
    r = random.Random(3)
    words = [f"v{i}" for i in range(5000)]
    one = [r.choice(words) for _ in range(120)]
    other = one[:60] + [r.choice(words) for _ in range(60)]
    rows = []
    for k in range(600):
        w = list(one if k % 3 else other)
        w[r.randrange(len(w))] = f"new{k}"
        rows.append((k, " ".join(w)))
    got = {x.doc_id: x.component_id for x in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    assert got == {k: 0 if k % 3 == 0 else 1 for k in range(600)}


def test_registers_merge_and_do_not_depend_on_company():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 63, 900, dtype=np.uint64), rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    both = setsketch.registers_of(np.concatenate([a, b]), np.array([0, 900, 940]))
    assert (both[0] == setsketch.registers_of(a, np.array([0, 900]))[0]).all()
    assert (both[1] == setsketch.registers_of(b[::-1].copy(), np.array([0, 40]))[0]).all()
    assert (setsketch.registers_of(np.concatenate([a, b]), np.array([0, 940]))[0] == both.max(0)).all()


@pytest.mark.parametrize("similarity", [0.3, 0.8, 0.95])
def test_estimate(similarity):
    rng, n = np.random.default_rng(7), 250
    shared = round(2 * n * similarity / (1 + similarity))
    x, y = [], []
    for _ in range(300):
        s = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
        two = setsketch.registers_of(np.concatenate([s[:n], s[n - shared :]]), np.array([0, n, 2 * n]))
        x.append(two[0])
        y.append(two[1])
    x, y, sizes = np.array(x), np.array(y), np.full(300, float(n))
    best, gain = setsketch.estimate(x, y, sizes, sizes, 0.8)
    true = shared / (2 * n - shared)
    assert abs(best.mean() - true) < 0.01 and 0.7 < best.std() / np.sqrt(true * (1 - true) / setsketch.REGISTERS) < 1.3
    met = (setsketch.bands_of(x) == setsketch.bands_of(y)).any(1).mean()
    assert (met == 1) if similarity >= 0.8 else (met < 0.4)
    assert (gain < setsketch.SURE).all() if similarity == 0.8 else similarity > 0.8 or (gain > setsketch.SURE).all()


def test_query_is_the_whole_table(spark):
    from topicloom.llm import queries

    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = queries.op11_setsketch(spark, d)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_pairs(rows, 4, 80)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}
