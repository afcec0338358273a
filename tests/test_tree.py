"""The spanning tree over listed neighbours: its edges are Prim's, and only few points are sent to look further."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import balls, boruvka
from topicloom.operators.kernels import prim
from topicloom.operators.reduce import nearest_neighbors


@pytest.mark.parametrize("core", [True, False])
def test_few_points_search(spark, core, monkeypatch):
    monkeypatch.setattr(balls, "BLOCK", 64)
    monkeypatch.setattr(boruvka, "PILOTS", 20)
    rng = np.random.default_rng(2)
    middles = 3 * np.eye(12)[:5]
    points = np.concatenate([m + 0.4 * rng.normal(size=(120, 12)) for m in middles])
    df = spark.createDataFrame([(3 * i, p.tolist()) for i, p in enumerate(points)], "doc_id long, reduced array<double>").persist()
    near = nearest_neighbors(df, 10).persist()
    ends = {r.doc_id: r.core for r in near.groupBy(F.col("id").alias("doc_id")).agg(F.max("distance").alias("core")).collect()}
    cores = [(i, ends[i] if core else 0.0) for i in sorted(ends)]
    sent = []
    visits = boruvka._Search._visits
    monkeypatch.setattr(boruvka._Search, "_visits", lambda *a: sent.append((v := visits(*a)).count()) or v)
    got = boruvka.spanning_tree(df.join(spark.createDataFrame(cores, "doc_id long, core double"), "doc_id"), near).collect()
    want = prim(points, np.array([c for _, c in cores]))
    assert len(got) == 599 and sorted(r.w for r in got) == pytest.approx(sorted(want[:, 2]))
    if core:
        # Listed neighbours leave little but the edges between the groups; each round used to send most rows to each cell they reach.
        assert len(sent) <= 2 and sum(sent) < 3 * 600
