"""Column expressions over vectors (arrays of doubles)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value made once, where it would else be made anew at each use, within a lambda for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalize(v: Column | str) -> Column:
    """v over its norm; a zero vector stays."""

    def over(u: Column) -> Column:
        return let(l2_norm(u), lambda norm: F.transform(u, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm)))

    return let(F.col(v) if isinstance(v, str) else v, over)


def mean_vector(df: DataFrame, keys: list[str], vector: str, out: str = "mean") -> DataFrame:
    """Element-wise mean by ``keys``: one row for each key and element while summing, so partial sums stay small."""
    cells = df.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    packed = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("cells"))
    return packed.select(*keys, F.transform("cells", lambda c: c["x"]).alias(out))


def topic_centroids(df: DataFrame, topic: str = "topic", vector: str = "embedding") -> DataFrame:
    """(topic, centroid): normalised mean of members' normalised vectors, without noise (-1)."""
    unit = df.where(F.col(topic) != -1).select(F.col(topic).alias("topic"), l2_normalize(F.col(vector).cast("array<double>")).alias("v"))
    return mean_vector(unit, ["topic"], "v").select("topic", l2_normalize("mean").alias("centroid"))
