"""Dimensionality reduction and exact neighbours."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written
from .balls import nearest
from .layout import fuzzy_edges, laid_out


def nearest_neighbors(df: DataFrame, k: int, id_col: str = "doc_id", vector: str = "reduced", metric: str = "euclidean", base: DataFrame | None = None) -> DataFrame:
    """(id, rank, neighbor, distance): the exact k nearest others of each row, or the nearest rows of ``base``, ties by id.

    Rows look in the cells of space that their k-th distance reaches, see ``balls``.
    """
    rows = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return nearest(rows(df), k, metric, None if base is None else rows(base))


@dataclass
class NoReduction:
    def fit_transform(self, df: DataFrame, seed: int = 42) -> DataFrame:
        return df.select("doc_id", F.col("embedding").cast("array<double>").alias("reduced"))

    transform = fit_transform


@dataclass
class PcaReduction:
    """Principal components of centred (with ``scale`` also scaled) vectors; each component's largest loading is positive."""

    n_components: int = 5
    scale: bool = False
    models: tuple | None = None

    def fit(self, df: DataFrame) -> PcaReduction:
        vectors = df.select("doc_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))
        scaler = StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=self.scale).fit(vectors)
        pca = PCA(k=self.n_components, inputCol="z", outputCol="p").fit(scaler.transform(vectors))
        loads = pca.pc.toArray()
        self.models = (scaler, pca, [float(np.sign(c[np.abs(c).argmax()]) or 1) for c in loads.T])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        scaler, pca, signs = self.models
        vectors = df.select("doc_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))
        out = pca.transform(scaler.transform(vectors)).select("doc_id", vector_to_array("p").alias("p"))
        flip = F.array(*(F.lit(s) for s in signs))
        return out.select("doc_id", F.zip_with("p", flip, lambda a, b: a * b).alias("reduced"))

    def fit_transform(self, df: DataFrame, seed: int = 42) -> DataFrame:
        return self.fit(df).transform(df)


class TooManyRows(ValueError):
    """A kernel that holds all points in one task refuses the table; no caller may take it for a skip."""


@dataclass
class UmapReduction:
    """Exact neighbours, their fuzzy graph, and a layout by rounds over blocks of rows, from principal components on. See ``layout``."""

    n_neighbors: int = 15
    n_components: int = 5
    min_dist: float = 0.0
    metric: str = "cosine"
    epochs: int = 60
    fitted: DataFrame | None = None
    trained: DataFrame | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        """New rows at the mean of their nearest fitted rows' places, nearer ones weighing more."""
        if self.fitted is None:
            raise ValueError("fit first")
        near = nearest_neighbors(df.select("doc_id", "embedding"), self.n_neighbors, "doc_id", "embedding", self.metric, base=self.trained)
        near = near.withColumn("w", F.exp(-F.col("distance") / F.greatest(F.avg("distance").over(W.partitionBy("id")), F.lit(1e-12))))
        cells = near.join(self.fitted.withColumnRenamed("doc_id", "neighbor"), "neighbor").select("id", "w", F.posexplode("reduced").alias("i", "x"))
        cells = cells.groupBy("id", "i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
        return cells.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("reduced")).withColumnRenamed("id", "doc_id")

    def fit_transform(self, df: DataFrame, seed: int = 42) -> DataFrame:
        df = written(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding")), "vectors")
        k = min(self.n_neighbors, df.count() - 1)
        near = nearest_neighbors(df, k, "doc_id", "embedding", self.metric)
        start = written(PcaReduction(self.n_components).fit_transform(df), "start")
        # Components in a box of 10 each way.
        wide = start.agg(F.max(F.array_max(F.transform("reduced", F.abs)))).first()[0] or 1.0
        places = start.select(F.col("doc_id").alias("id"), F.transform("reduced", lambda x: x * F.lit(10 / max(wide, 1e-12))).alias("v"))
        self.trained = df
        self.fitted = laid_out(places, fuzzy_edges(near, k), self.min_dist, self.epochs, seed).select(F.col("id").alias("doc_id"), F.col("v").alias("reduced"))
        return self.fitted
