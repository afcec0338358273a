"""Linkage by rounds of reciprocal pairs and by a spanning tree, against the kernel that merges one pair at a time."""

import numpy as np
import pytest

from topicloom.operators import agglomerate, balls
from topicloom.operators.cluster import Agglomerative
from topicloom.operators.kernels import cut_tree, linkage


def _table(spark, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in enumerate(x)], "doc_id long, reduced array<double>")


def _kernel(x, how, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    return cut_tree(linkage(d, how), len(x), k).tolist()


def _labels(df):
    rows = sorted(df.collect())
    return [r["topic"] for r in rows]


@pytest.fixture
def small(monkeypatch):
    """Cells of some 32 rows, and rounds down to 60 clusters."""
    monkeypatch.setattr(balls, "BLOCK", 32)
    monkeypatch.setattr(agglomerate, "TAIL", 60)
    monkeypatch.setattr("topicloom.operators.cluster.TAIL", 60)


@pytest.mark.parametrize("how", ["ward.D2", "single"])
def test_same_clusters_as_the_kernel(spark, small, how):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.6, (50, 3)) for c in (-3, 0, 3, 9)] + [rng.uniform(-12, 15, (20, 3))])
    rng.shuffle(x)
    assert _labels(Agglomerative(9, how).fit_predict(_table(spark, x))) == _kernel(x, how, 9)


def test_merges_are_the_dendrogram(spark, small):
    """Each height of the kernel comes once, and a merge is never below the merges of its parts."""
    x = np.random.default_rng(5).normal(size=(120, 2))
    merges = sorted(agglomerate.ward_merges(_table(spark, x)).collect(), key=lambda r: (r["height"], r["step"]))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert np.allclose([r["height"] for r in merges], [m[2] for m in linkage(d)])
    dead = set()
    for r in merges:
        assert r["comp"] > r["into"] and not {r["comp"], r["into"]} & dead
        dead.add(r["comp"])


@pytest.mark.parametrize("how", ["ward.D2", "single"])
def test_copies_and_ties(spark, small, how):
    """A third of all rows are one point and the others lie on a grid far from the origin: every cut has k clusters, and the copies stay together."""
    grid = np.array([(i, j) for i in range(8) for j in range(8)], float) + 1e6
    x = np.concatenate([grid, np.repeat([[2e6, 2e6]], 40, axis=0)])
    labels = _labels(Agglomerative(5, how).fit_predict(_table(spark, x)))
    assert sorted(set(labels)) == [0, 1, 2, 3, 4] and len(set(labels[64:])) == 1
    assert not set(labels[64:]) & set(labels[:64])


def test_few_rows(spark, small):
    none = spark.createDataFrame([], "doc_id long, reduced array<double>")
    assert agglomerate.ward_merges(none).count() == 0
    assert Agglomerative(2).fit_predict(none).count() == 0
    one = _table(spark, np.ones((1, 2)))
    assert agglomerate.ward_merges(one).count() == 0
    assert _labels(agglomerate.ward_cut(one, agglomerate.ward_merges(one), 3)) == [0]
    assert _labels(agglomerate.single_cut(one, 2)) == [0]


def test_k_over_the_number_of_points(spark, small):
    x = np.concatenate([np.zeros((70, 2)), np.ones((1, 2))])
    assert len(set(_labels(Agglomerative(71).fit_predict(_table(spark, x))))) == 71


def test_other_linkages_keep_their_cap(spark):
    with pytest.raises(ValueError, match="max_points"):
        Agglomerative(2, "average", max_points=3).fit_predict(_table(spark, np.arange(8.0).reshape(4, 2)))


def test_groups_merge_on_by_themselves(spark, small, monkeypatch):
    """A chain whose gaps grow has one reciprocal pair at a time: groups of clusters go through theirs in a few rounds, with the kernel's heights."""
    x = np.cumsum(1.03 ** np.arange(180))[:, None] * [[1.0, 0.5]]
    rounds, write = [], agglomerate.written
    monkeypatch.setattr(agglomerate, "written", lambda df, name: rounds.append(name) or write(df, name))
    merges = agglomerate.ward_merges(_table(spark, x[np.random.default_rng(2).permutation(180)])).collect()
    assert rounds.count("placed") <= 8
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert np.allclose(sorted(r["height"] for r in merges), [m[2] for m in linkage(d)])


def test_pairs_of_groups_merge(spark, small, monkeypatch):
    """Groups that cut through even clouds: pairs across them and what the groups find inside make the kernel's dendrogram."""
    monkeypatch.setattr(agglomerate, "VISITORS", 16)
    monkeypatch.setattr(agglomerate, "CHUNK", 1000)
    x = np.random.default_rng(8).normal(size=(300, 5))
    merges = agglomerate.ward_merges(_table(spark, x)).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert np.allclose(sorted(r["height"] for r in merges), [m[2] for m in linkage(d)])
