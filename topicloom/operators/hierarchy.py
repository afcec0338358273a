"""Topic hierarchies from centroids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernels import linkage


def merge_tree(centroids: DataFrame, method: str = "ward.D2") -> list[tuple[int, int, int, float, list[int]]]:
    """(parent, left, right, distance, topics) of each merge; leaves are 1..K in id order, parents K + 1 on. One row for each topic is collected."""
    rows = centroids.orderBy("topic").collect()
    if len(rows) < 2:
        raise ValueError("a hierarchy needs two topics or more")
    c = np.array([r["centroid"] for r in rows])
    c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    k = len(rows)
    topics = {i + 1: [r["topic"]] for i, r in enumerate(rows)}
    out = []
    for i, (a, b, h, _) in enumerate(linkage(1 - np.clip(c @ c.T, -1, 1), method)):
        a, b = sorted((a + 1, b + 1))
        topics[k + 1 + i] = sorted(topics[a] + topics[b])
        out.append((k + 1 + i, a, b, h, topics[k + 1 + i]))
    return out


def roll_up_terms(members: DataFrame, terms: DataFrame, top_n: int = 10) -> DataFrame:
    """(parent_id, rank, term, score): sums of the members' stored scores. members: parent_id, topic."""
    sums = members.join(terms, "topic").groupBy("parent_id", "term").agg(F.sum("score").alias("score"))
    order = W.partitionBy("parent_id").orderBy(F.desc(F.round("score", 9)), "term")
    return sums.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top_n).select("parent_id", "rank", "term", "score")


def hierarchical_topics(centroids: DataFrame, terms: DataFrame, method: str = "ward.D2", top_n: int = 10) -> DataFrame:
    """(parent_id, child_left, child_right, distance, topics, terms)."""
    spark = centroids.sparkSession
    tree = spark.createDataFrame(merge_tree(centroids, method), "parent_id int, child_left int, child_right int, distance double, topics array<int>")
    best = roll_up_terms(tree.select("parent_id", F.explode("topics").alias("topic")), terms, top_n)
    best = best.groupBy("parent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("terms"))
    return tree.join(best, "parent_id", "left").select("parent_id", "child_left", "child_right", "distance", F.array_join(F.col("topics").cast("array<string>"), ", ").alias("topics"), "terms")
