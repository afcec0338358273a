"""Neighbours by visited cells, and the tree made of them, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import balls
from topicloom.operators.boruvka import _jumped
from topicloom.operators.reduce import nearest_neighbors

SCHEMA = "doc_id long, reduced array<double>, cell int, bound string"


def frame(spark, points, ids=None):
    return spark.createDataFrame([(int(i), p.tolist(), 7, "x") for i, p in zip(range(len(points)) if ids is None else ids, points, strict=True)], SCHEMA)


def plainly(asked, base, k, metric, among):
    """(id, rank, neighbor, distance): asked and base are (ids, points)."""
    (ids, x), (far, y) = asked, base
    if metric == "cosine":
        x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in (x, y))
        d = 1 - np.einsum("ik,jk->ij", x, y)
    else:
        d = np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(2))
    out = {}
    for i, own in enumerate(ids):
        order = [j for j in np.lexsort((far, d[i])) if not (among and far[j] == own)][:k]
        for rank, j in enumerate(order, 1):
            out[(int(own), rank)] = (int(far[j]), pytest.approx(d[i][j], abs=1e-9))
    return out


def planted(seed=3, dims=4, n=900):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(9, dims)) * 3
    return middles[rng.integers(0, 9, n)] + 0.1 * rng.normal(size=(n, dims))


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_neighbours_are_exact(spark, monkeypatch, metric):
    monkeypatch.setattr(balls, "BLOCK", 40)
    points = planted()
    points[:30] = points[0]  # ties at distance 0, more than k of them
    points[30:35] = 0
    ids = np.random.default_rng(1).permutation(5000)[: len(points)] - 2000
    if metric == "cosine":  # where products round, equals are no ties
        points[:30] += 1e-3 * np.arange(30)[:, None] * np.arange(1, 5)
    got = nearest_neighbors(frame(spark, points, ids), 7, metric=metric).collect()
    want = plainly((ids, points), (ids, points), 7, metric, True)
    assert len(got) == len(want)
    wrong = [r for r in got if (r.neighbor, r.distance) != want[(r.id, r["rank"])]]
    # Equal cosines of zero vectors and of one direction may be told apart by their last digits.
    assert not wrong if metric == "euclidean" else all(r.distance == want[(r.id, r["rank"])][1] for r in wrong)


def test_neighbours_in_other_rows(spark, monkeypatch):
    monkeypatch.setattr(balls, "BLOCK", 30)
    base, asked = planted(5, 3, 400), np.concatenate([planted(5, 3, 50), [[99.0, 99.0, 99.0]]])
    got = {(r.id, r["rank"]): (r.neighbor, r.distance) for r in nearest_neighbors(frame(spark, asked), 12, base=frame(spark, base, np.arange(400) + 7)).collect()}
    assert got == plainly((np.arange(51), asked), (np.arange(400) + 7, base), 12, "euclidean", False)


def test_few_and_no_rows(spark):
    assert nearest_neighbors(spark.createDataFrame([], SCHEMA), 3).count() == 0
    assert nearest_neighbors(frame(spark, np.zeros((1, 2))), 3).count() == 0
    got = sorted((r.id, r["rank"], r.neighbor) for r in nearest_neighbors(frame(spark, np.ones((3, 2))), 5).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 0), (2, 2, 1)]
    assert nearest_neighbors(frame(spark, np.ones((2, 2))), 5, base=spark.createDataFrame([], SCHEMA)).count() == 0


def test_few_cells_are_visited(spark, monkeypatch):
    """On planted groups a row looks into a small share of the cells."""
    monkeypatch.setattr(balls, "BLOCK", 64)
    points = planted(11, 5, 6000)
    rows = frame(spark, points).select(F.col("doc_id").alias("id"), F.col("reduced").alias("v"))
    cells, table = balls.cells_of(rows)
    assert cells.rows.sum() == 6000 and len(cells.rows) > 40
    homes = cells.homes(11)
    asked, here = [], []
    for i, h in enumerate(homes):
        asked += [len(h)] * int(cells.rows[i])
        here.append(len(h))
    found = balls.nearest(rows, 10)
    first = found.select("id", "rank", "neighbor", "distance")
    more = balls.visits(table, first, cells, homes, 10, "euclidean").count()
    assert (sum(asked) + more) / (6000 * len(homes)) < 0.15


def test_rows_are_sent_to_regions(spark, monkeypatch):
    """A row is sent to a few regions however many cells it has to look in; a cell of many rows is several units, and no neighbour is lost."""
    monkeypatch.setattr(balls, "BLOCK", 16)
    points = np.concatenate([np.random.default_rng(4).normal(size=(1400, 6)), np.full((600, 6), 0.1)])
    rows = frame(spark, points).select(F.col("doc_id").alias("id"), F.col("reduced").alias("v"))
    found = balls.nearest(rows, 5)
    want = plainly((np.arange(2000), points), (np.arange(2000), points), 5, "euclidean", True)
    assert {(r.id, r["rank"]): (r.neighbor, r.distance) for r in found.collect()} == want
    cells, table = balls.cells_of(rows)
    first, many, _ = cells.regions()
    assert many.max() > 1 and len(cells.rows) > 30
    homes = cells.homes(6)
    every, sent = (balls.visits(table, found, cells, homes, 5, "euclidean", by_unit).count() / 2000 for by_unit in (False, True))
    assert every > 10 and sent < every / 2 and (first + many).max() <= 16


def test_pointer_jumping(spark):
    """A long chain of chosen edges ends in its pair, as a tree does."""
    chain = [(i, i - 1) for i in range(1, 300)] + [(0, 1)] + [(1000 + i, 1000) for i in range(1, 40)] + [(1000, 1001)]
    got = {r.comp: r["into"] for r in _jumped(spark.createDataFrame(chain, "comp long, other long")).collect()}
    assert got == {c: 0 if c < 1000 else 1000 for c, _ in chain}


def test_cells_do_not_cut_through_clusters():
    """Of ten clusters apart from one another each cell holds rows of one alone."""
    rng = np.random.default_rng(4)
    label = rng.integers(0, 10, 4000)
    x = rng.normal(scale=0.3 / np.sqrt(32), size=(4000, 32)) + np.eye(32)[label]
    own = balls.fit_cells(x, 20).of(x)
    assert len(set(own)) == 20
    assert all(len(set(label[own == c])) == 1 for c in set(own))
