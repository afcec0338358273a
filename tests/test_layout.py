"""The layout's curve, graph and rounds over blocks against plain versions."""

import numpy as np
import pytest

from topicloom.operators import balls, layout
from topicloom.operators.reduce import UmapReduction


def planted(n, dims=8, groups=6, seed=2):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dims)) * 2
    own = rng.integers(0, groups, n)
    return middles[own] + 0.4 * rng.normal(size=(n, dims)), own


def trust(x, y, k=10):
    """Share of each point's near places that were near before, ranks beyond k counted against it."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d, e = 1 - x @ x.T, ((y[:, None] - y[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    np.fill_diagonal(e, np.inf)
    rank = np.argsort(np.argsort(d, 1), 1) + 1
    near, n = np.argsort(e, 1)[:, :k], len(x)
    over = np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum()
    return 1 - 2 * over / (n * k * (2 * n - 3 * k - 1))


@pytest.mark.parametrize("low,a,b", [(0.0, 1.932, 0.791), (0.1, 1.577, 0.895), (0.5, 0.583, 1.334)])
def test_curve(low, a, b):
    assert layout.curve(low) == pytest.approx((a, b), abs=0.01)


def test_fuzzy_union(spark):
    """Weights of a path of four points by hand: the nearest neighbour weighs 1, a union of w and x is w + x - wx."""
    near = [(0, 1, 1, 1.0), (0, 2, 2, 3.0), (1, 1, 0, 1.0), (1, 2, 2, 2.0), (2, 1, 1, 2.0), (2, 2, 3, 2.0), (3, 1, 2, 2.0), (3, 2, 1, 4.0)]
    got = {(r.id, r.other): r.w for r in layout.fuzzy_edges(spark.createDataFrame(near, "id long, rank int, neighbor long, distance double"), 2).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 2), (2, 3), (3, 1)}
    assert got[0, 1] == got[1, 2] == got[2, 3] == 1.0
    assert all(0 <= got[e] < 0.01 for e in ((0, 2), (3, 1)))


def test_blocks_do_as_well_as_one(spark, monkeypatch):
    x, own = planted(900)
    rows = spark.createDataFrame([(i - 50, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>")
    fit = lambda: np.stack([r.reduced for r in sorted(UmapReduction(12, 2).fit_transform(rows).collect())])
    one = fit()
    monkeypatch.setattr(layout, "ROWS", 150)
    monkeypatch.setattr(layout, "PUSHERS", 200)
    monkeypatch.setattr(balls, "BLOCK", 150)
    many = fit()
    assert trust(x, one) > 0.9
    assert trust(x, many) > trust(x, one) - 0.02
    middles = np.stack([many[own == g].mean(0) for g in range(6)])
    assert (((many[:, None] - middles[None]) ** 2).sum(2).argmin(1) == own).mean() > 0.95


def test_copies_and_no_edges(spark):
    """Many equal rows make one hub; rows without edges stay; no rows give none."""
    rows = spark.createDataFrame([(i, [1.0, 2.0, 0.5 + (i % 3 if i >= 40 else 0)]) for i in range(60)], "doc_id long, embedding array<double>")
    got = UmapReduction(5, 2).fit_transform(rows).collect()
    assert len(got) == 60 and np.isfinite([r.reduced for r in got]).all()
    start = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    none = spark.createDataFrame([], "id long, other long, w double")
    assert [tuple(r) for r in layout.laid_out(start, none).collect()] == [(1, [1.0, 2.0])]
    assert layout.laid_out(start.limit(0), none).count() == 0
