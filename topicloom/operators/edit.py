"""Edits of a fitted assignment; terms and the like are derived anew from the result."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize, mean_vector, topic_centroids
from .accessors import predict
from .ctfidf import class_scores


def merge_topics(assignments: DataFrame, topics: list[int]) -> DataFrame:
    """The listed topics become the least of them; ids are not renumbered."""
    if len(set(topics)) < 2:
        raise ValueError("two topics or more are needed to merge")
    known = {r[0] for r in assignments.where(F.col("topic").isin(topics)).select("topic").distinct().collect()}
    if missing := sorted(set(topics) - known):
        raise ValueError(f"unknown topics: {missing}")
    return assignments.withColumn("topic", F.when(F.col("topic").isin(topics), min(topics)).otherwise(F.col("topic")).cast("int"))


def renumber_topics(assignments: DataFrame) -> DataFrame:
    """Ids 0, 1, ... in ascending order of the old ones; noise stays."""
    ids = assignments.where("topic <> -1").select("topic").distinct().withColumn("__new", F.row_number().over(W.orderBy("topic")) - 1)
    return assignments.join(F.broadcast(ids), "topic", "left").withColumn("topic", F.coalesce("__new", "topic").cast("int")).drop("__new").select(*assignments.columns)


def merge_plan(sums: dict[int, np.ndarray], counts: dict[int, int], target: int) -> dict[int, int]:
    """Old topic to new: merges the pair of most similar centroids until ``target`` are left, then numbers from 0."""
    ids = sorted(sums)
    into = {t: t for t in ids}
    sums, counts = dict(sums), dict(counts)
    while len(sums) > target:
        live = sorted(sums)
        c = np.array([sums[t] / counts[t] for t in live])
        norm = np.linalg.norm(c, axis=1, keepdims=True)
        c = c / np.where(norm == 0, 1, norm)
        sim = c @ c.T
        np.fill_diagonal(sim, -np.inf)
        # First greatest by columns, as a matrix stored by columns is searched.
        col, row = divmod(int(sim.T.argmax()), len(live))
        keep, gone = sorted((live[row], live[col]))
        sums[keep] = sums[keep] + sums.pop(gone)
        counts[keep] += counts.pop(gone)
        into = {t: keep if x == gone else x for t, x in into.items()}
    number = {t: i for i, t in enumerate(sorted(sums))}
    return {t: number[x] for t, x in into.items()}


def reduce_topics(df: DataFrame, nr_topics: int, vector: str = "embedding") -> DataFrame:
    """(doc_id, topic) with at most ``nr_topics`` topics. Sums by topic are all that reaches the driver."""
    if nr_topics < 1:
        raise ValueError("nr_topics must be at least 1")
    unit = df.where("topic <> -1").select("topic", l2_normalize(F.col(vector).cast("array<double>")).alias("v"))
    means = mean_vector(unit, ["topic"], "v").join(unit.groupBy("topic").agg(F.count("*").alias("n")), "topic").collect()
    counts = {r["topic"]: r["n"] for r in means}
    plan = {r["topic"]: r["topic"] for r in means}
    if len(means) > nr_topics:
        plan = merge_plan({r["topic"]: np.array(r["mean"]) * r["n"] for r in means}, counts, nr_topics)
    pairs = df.sparkSession.createDataFrame([(int(a), int(b)) for a, b in plan.items()], "topic int, new int")
    return df.select("doc_id", "topic").join(F.broadcast(pairs), "topic", "left").select("doc_id", F.coalesce("new", "topic").cast("int").alias("topic"))


def reduce_outliers(df: DataFrame, threshold: float = 0.0, vector: str = "embedding") -> DataFrame:
    """(doc_id, topic): noise goes to the nearest centroid where that is similar enough."""
    nearest = predict(df.where("topic = -1"), topic_centroids(df, "topic", vector), vector)
    moved = nearest.select("doc_id", F.when(F.col("probability") >= threshold, F.col("topic")).otherwise(-1).cast("int").alias("topic"))
    return df.where("topic <> -1").select("doc_id", "topic").unionByName(moved)


def reduce_outliers_ctfidf(dtm: DataFrame, assignments: DataFrame, threshold: float = 0.0) -> DataFrame:
    """As reduce_outliers by the cosine of a document's counts with the topics' scores; without common terms it is 0."""
    scores = class_scores(dtm, assignments.where("topic <> -1")).select("topic", "term", "score")
    noise = assignments.where("topic = -1").select("doc_id")
    words = dtm.join(noise, "doc_id")
    length = scores.groupBy("topic").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("b"))
    own = words.groupBy("doc_id").agg(F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double"))).alias("a"))
    common = words.join(scores, "term").groupBy("doc_id", "topic").agg(F.sum(F.col("n") * F.col("score")).alias("dot"))
    # Only topics with a common term are rows; among the rest, all at 0, the first stands for all.
    sims = common.join(F.broadcast(length), "topic").join(own, "doc_id")
    bottom = F.col("a") * F.col("b")
    sim = F.when(bottom == 0, 0.0).otherwise(F.col("dot") / bottom)
    met = sims.groupBy("doc_id").agg(F.max(F.struct(F.round(sim, 9).alias("sim"), (-F.col("topic")).alias("minus"))).alias("x"), F.collect_set("topic").alias("with"))
    topics = length.agg(F.array_sort(F.collect_list("topic")).alias("topics"))
    every = noise.join(met, "doc_id", "left").join(F.broadcast(topics))
    left = F.array_min(F.array_except("topics", F.coalesce("with", F.array().cast("array<int>"))))
    zero = F.when(left.isNotNull(), F.struct(F.lit(0.0).alias("sim"), (-left).alias("minus")))
    best = every.select("doc_id", F.greatest("x", zero).alias("x"))
    moved = best.select("doc_id", F.when(F.col("x.sim") >= threshold, -F.col("x.minus")).otherwise(-1).cast("int").alias("topic"))
    return assignments.where("topic <> -1").select("doc_id", "topic").unionByName(moved)


def mmr_order(candidates: np.ndarray, reference: np.ndarray, diversity: float, n: int) -> list[int]:
    """Picks by (1 - d) * relevance - d * greatest similarity to a pick, the first on ties."""
    unit = lambda v: v / np.where((k := np.linalg.norm(v, axis=-1, keepdims=True)) == 0, 1, k)
    c, r = unit(candidates), unit(reference)
    relevance = c @ r
    picked = [int(relevance.argmax())]
    nearest = c @ c[picked[0]]
    while len(picked) < min(n, len(c)):
        value = (1 - diversity) * relevance - diversity * nearest
        value[picked] = -np.inf
        picked.append(int(value.argmax()))
        nearest = np.maximum(nearest, c @ c[picked[-1]])
    return picked


def apply_mmr(terms: DataFrame, term_vectors: DataFrame, reference: DataFrame, diversity: float = 0.1, top_n: int = 10) -> DataFrame:
    """terms re-ranked for diversity; scores stay, noise stays. term_vectors: term, vector; reference: topic, vector."""
    if not 0 <= diversity <= 1:
        raise ValueError("diversity must be between 0 and 1")
    import pandas as pd

    wide = terms.where("topic <> -1").join(term_vectors, "term").join(reference.withColumnRenamed("vector", "ref"), "topic").select("topic", "rank", "term", "score", "vector", "ref")

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        order = mmr_order(np.stack(pdf["vector"]), np.asarray(pdf["ref"][0]), diversity, top_n)
        return pdf.loc[order, ["topic", "term", "score"]].assign(rank=np.arange(1, len(order) + 1, dtype=np.int32))[["topic", "rank", "term", "score"]]

    done = wide.groupBy("topic").applyInPandas(rank, "topic int, rank int, term string, score double")
    return done.unionByName(terms.where("topic = -1").select("topic", "rank", "term", "score"))
