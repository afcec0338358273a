"""Clusters of a spanning tree in distributed steps against the kernels, which hold all edges in one task."""

import numpy as np
import pytest

from topicloom.operators import condense
from topicloom.operators.kernels import condensed_labels, leaf_labels, prim


def tree_of(points, least, whole=False):
    """Edges (u, v, w), u < v, in the order that both sides keep."""
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(2))
    core = np.sort(d, 1)[:, min(least, len(points) - 1)]
    edges = prim(points, core)
    if whole:
        edges[:, 2] = np.round(edges[:, 2], 1)
    edges[:, :2] = np.sort(edges[:, :2], 1)
    return edges[np.lexsort((edges[:, 1], edges[:, 0], edges[:, 2]))]


def labels(spark, points, edges, least, method):
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")
    tree = spark.createDataFrame([(int(u), int(v), float(w)) for u, v, w in edges], "u long, v long, w double")
    got = condense.tree_labels(rows, tree, least, method).collect()
    assert len(got) == len(points) == len({r.doc_id for r in got})
    return np.array([r.topic for r in sorted(got)])


def planted(seed, n, groups, spread):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, 2)) * 4
    return middles[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, 2))


@pytest.mark.parametrize("least,spread,whole", [(10, 0.5, False), (3, 0.8, False), (5, 0.6, True)])
def test_labels_are_the_kernels(spark, monkeypatch, least, spread, whole):
    """Small blocks and ranges, so that points grow over blocks and splits are united over many ranges; ``whole``: many equal and some zero weights."""
    monkeypatch.setattr(condense, "BLOCK", 40)
    monkeypatch.setattr("topicloom.operators.balls.BLOCK", 40)
    monkeypatch.setattr(condense, "RANGE", 20)
    points = planted(least, 400, 7, spread)
    edges = tree_of(points, least, whole)
    for method, kernel in (("eom", condensed_labels), ("leaf", leaf_labels)):
        want = kernel(edges, len(points), least)
        got = labels(spark, points, edges, least, method)
        assert (got == np.where(want == 0, -1, want)).all(), method


def test_leaf_below_splits(spark, monkeypatch):
    """Groups whose greatest edges are splits, so that leaves lie below the root."""
    monkeypatch.setattr(condense, "RANGE", 3)
    points = np.concatenate([np.random.default_rng(g).uniform(size=(30, 2)) * 0.2 + [5 * g, g % 3] for g in range(6)])
    edges = tree_of(points, 4)
    want = leaf_labels(edges, len(points), 4)
    assert want.max() == 6
    assert (labels(spark, points, edges, 4, "leaf") == np.where(want == 0, -1, want)).all()


def test_star_and_few(spark):
    """A hub of all edges; fewer points than a cluster needs; one point; none."""
    points = np.random.default_rng(0).normal(size=(60, 2))
    star = np.array([(0, i, 1 + i / 7) for i in range(1, 60)])
    for method, kernel in (("eom", condensed_labels), ("leaf", leaf_labels)):
        for n, least in ((60, 5), (4, 5)):
            want = kernel(star[: n - 1], n, least)
            assert (labels(spark, points[:n], star[: n - 1], least, method) == np.where(want == 0, -1, want)).all()
        assert labels(spark, points[:1], [], 3, method).tolist() == [-1]
        assert labels(spark, points[:0], [], 3, method).tolist() == []
