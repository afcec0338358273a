"""Clustering of reduced vectors (doc_id, reduced) into (doc_id, topic); noise is -1."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .agglomerate import TAIL, single_cut, ward_cut, ward_merges
from .boruvka import spanning_tree
from .condense import tree_labels
from .kernels import condensed_labels, cut_tree, leaf_labels, linkage, prim
from .reduce import TooManyRows, nearest_neighbors


def core_distances(df: DataFrame, min_pts: int, id_col: str = "doc_id", vector: str = "reduced") -> DataFrame:
    """(id, core): distance to the ``min_pts``-th nearest other row, or the farthest there is."""
    near = nearest_neighbors(df, min_pts, id_col, vector)
    return near.groupBy("id").agg(F.max("distance").alias("core"))


def mutual_reachability(df: DataFrame, min_pts: int, id_col: str = "doc_id", vector: str = "reduced") -> DataFrame:
    """(id, neighbor, distance) of each row's ``min_pts`` nearest, distances raised to either's core distance."""
    near = nearest_neighbors(df, min_pts, id_col, vector)
    core = near.groupBy("id").agg(F.max("distance").alias("core"))
    both = near.join(core, "id").join(core.select(F.col("id").alias("neighbor"), F.col("core").alias("other")), "neighbor")
    return both.select("id", "neighbor", F.greatest("distance", "core", "other").alias("distance"))


def _one_task(df: DataFrame, kernel, max_points: int) -> DataFrame:
    if (n := df.count()) > max_points:
        raise TooManyRows(f"{n} rows, over max_points ({max_points}); the tree is built in one task")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id").reset_index(drop=True)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "topic": kernel(pdf).astype(np.int32)})

    return df.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(run, "doc_id long, topic int")


@dataclass
class Hdbscan:
    """Density clusters by excess of mass, or ``leaf`` nodes. Topics begin at 1. ``knn`` names are accepted; all paths are exact.

    Beyond ``max_points`` rows the spanning tree and the condensed tree are built in distributed rounds, with the same labels.
    """

    min_pts: int = 10
    method: str = "eom"
    knn: str = "balltree"
    max_points: int = 20_000

    def __post_init__(self):
        if self.method not in ("eom", "leaf"):
            raise ValueError(f"unknown method {self.method!r}")

    def fit_predict(self, df: DataFrame, seed: int = 42) -> DataFrame:
        near = written(nearest_neighbors(df, self.min_pts), "near")
        core = near.groupBy(F.col("id").alias("doc_id")).agg(F.max("distance").alias("core"))
        rows = df.select("doc_id", "reduced").join(core, "doc_id", "left").fillna(0.0, ["core"])
        pick, least = (condensed_labels if self.method == "eom" else leaf_labels), self.min_pts

        def kernel(pdf: pd.DataFrame) -> np.ndarray:
            points = np.stack(pdf["reduced"])
            labels = pick(prim(points, pdf["core"].to_numpy()), len(points), least)
            return np.where(labels == 0, -1, labels)

        if rows.count() <= self.max_points:
            return _one_task(rows, kernel, self.max_points)
        rows = written(rows, "rows")
        points = rows.select(F.col("doc_id").cast("long").alias("id"), F.col("reduced").cast("array<double>").alias("v"))
        return tree_labels(points, spanning_tree(rows, near), least, self.method)


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest center, squared distance) of each row."""
    d = (x**2).sum(1)[:, None] + (centers**2).sum(1)[None, :] - 2 * x @ centers.T
    at = d.argmin(1)
    return at, np.maximum(d[np.arange(len(x)), at], 0)


def _sums(df: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(rows, mean) of each center's own rows, and the sum of squared distances: one pass, a row for each center to the driver."""
    k, dims = centers.shape

    def part(batches):
        n, total, cost = np.zeros(k), np.zeros((k, dims)), np.zeros(k)
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["reduced"])
                at, d = _nearest(x, centers)
                n += np.bincount(at, minlength=k)
                cost += np.bincount(at, d, k)
                np.add.at(total, at, x)
        yield pd.DataFrame({"c": range(k), "n": n, "cost": cost, "total": list(total)})

    parts = df.select("reduced").mapInPandas(part, "c int, n double, cost double, total array<double>")
    cells = parts.select("c", "n", "cost", F.posexplode("total").alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("cost").alias("cost"))
    n, total, cost = np.zeros(k), np.zeros((k, dims)), np.zeros(k)
    for r in cells.collect():
        n[r["c"]], cost[r["c"]], total[r["c"], r["i"]] = r["n"], r["cost"], r["x"]
    return n, total / np.maximum(n, 1)[:, None], float(cost.sum())


def _hashed_first(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of least hash of their doc_id, in its order; only rows of hashes that should hold n are ordered, so tasks don't send n each."""
    share = (1.05 * n + 1000) / max(rows.count(), 1)
    while share < 1:
        some = rows.where(F.xxhash64("doc_id") <= int(share * 2**64) - 2**63)
        if some.count() >= n:
            rows = some
            break
        share *= 2
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


@dataclass
class KMeansClustering:
    """The best of ``nstart`` runs; topics from 0 by their least document id.

    Runs begin with k-means++ and go on, up to convergence, over ``sample`` rows at most, taken by a hash of their id and in its
    order, so that neither partitions nor cores change them. The best then goes on over all rows.
    """

    k: int
    nstart: int = 10
    max_iter: int = 300
    sample: int = 20_000

    def _start(self, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """k-means++, the best of some candidates at each step."""
        centers = [x[rng.integers(len(x))]]
        d = ((x - centers[0]) ** 2).sum(1)
        for _ in range(self.k - 1):
            if d.sum() <= 0:
                centers.append(x[rng.integers(len(x))])
                continue
            picks = rng.choice(len(x), 2 + int(np.log2(self.k)), p=d / d.sum())
            after = [np.minimum(d, ((x - x[p]) ** 2).sum(1)) for p in picks]
            best = int(np.argmin([a.sum() for a in after]))
            centers.append(x[picks[best]])
            d = after[best]
        return np.stack(centers)

    def _run(self, x: np.ndarray, seed: int) -> tuple[float, np.ndarray]:
        centers = self._start(x, np.random.default_rng(seed))
        last = None
        for _ in range(self.max_iter):
            at, d = _nearest(x, centers)
            if last is not None and (at == last).all():
                break
            last = at
            n = np.bincount(at, minlength=self.k)
            sums = np.zeros_like(centers)
            np.add.at(sums, at, x)
            centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        return float(d.sum()), centers

    def fit_predict(self, df: DataFrame, seed: int = 42) -> DataFrame:
        rows = written(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("reduced").cast("array<double>").alias("reduced")), "vectors")
        some = _hashed_first(rows, self.sample).collect()
        if not some:
            return df.select("doc_id", F.lit(None).cast("int").alias("topic"))
        x = np.array([r["reduced"] for r in some])
        _, centers = min((self._run(x, seed + i) for i in range(self.nstart)), key=lambda r: r[0])
        if len(x) == self.sample:
            cost = np.inf
            for _ in range(self.max_iter):
                n, mean, now = _sums(rows, centers)
                if now >= cost * (1 - 1e-9):
                    break
                centers, cost = np.where(n[:, None] > 0, mean, centers), now

        def label(batches):
            for pdf in batches:
                if len(pdf):
                    yield pd.DataFrame({"doc_id": pdf["doc_id"], "topic": _nearest(np.stack(pdf["reduced"]), centers)[0].astype(np.int32)})

        out = written(rows.mapInPandas(label, "doc_id long, topic int"), "labels")
        ids = [r["topic"] for r in out.groupBy("topic").agg(F.min("doc_id").alias("m")).orderBy("m").collect()]
        new = F.element_at(F.create_map(*(F.lit(v) for pair in ((t, i) for i, t in enumerate(ids)) for v in pair)), F.col("topic"))
        return out.select("doc_id", new.alias("topic"))


@dataclass
class Agglomerative:
    """``k`` clusters of a linkage on Euclidean distances; topics from 0 by first appearance in id order.

    ``ward.D2`` and ``single`` take any number of rows: beyond ``TAIL`` they go in distributed rounds, with the same clusters. Other
    linkages need all distances at once and refuse more than ``max_points`` rows.
    """

    k: int
    linkage: str = "ward.D2"
    max_points: int = 5_000

    def fit_predict(self, df: DataFrame, seed: int = 42) -> DataFrame:
        how, k = self.linkage, self.k
        if how in ("ward.D2", "single") and df.count() > TAIL:
            rows = written(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("reduced").cast("array<double>").alias("reduced")), "rows")
            return single_cut(rows, k) if how == "single" else ward_cut(rows, ward_merges(rows), k)

        def kernel(pdf: pd.DataFrame) -> np.ndarray:
            x = np.stack(pdf["reduced"])
            d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * x @ x.T, 0))
            return cut_tree(linkage(d, how), len(x), min(k, len(x)))

        return _one_task(df.select("doc_id", "reduced"), kernel, self.max_points)
