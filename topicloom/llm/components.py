"""Connected components of a link table, without gathering links on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store


def connected_components(links: DataFrame, store: Store) -> DataFrame:
    """(node, root): for each node of ``links(a, b)`` the smallest node it reaches.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the links form stars. Each
    step aggregates with map-side minima, so a node with very many links costs no single task much.
    Loops and repeated links are ignored; an empty table gives an empty one.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = store.put(pairs, "links")
    before = None
    while True:
        now = pairs.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if before == now or not now["n"]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = store.put(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "links")
