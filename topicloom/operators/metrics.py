"""Quality, coherence and stability of topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import dot, mean_vector
from .ctfidf import topic_sizes

EPSILON = 2.220446049250313e-16


def cohesion(df: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """(topic, cohesion): mean product of members' vectors, as they are, with their centroid."""
    rows = df.where("topic <> -1").select("topic", F.col(vector).cast("array<double>").alias("v"))
    return rows.join(F.broadcast(centroids), "topic").groupBy("topic").agg(F.avg(dot("v", "centroid")).alias("cohesion"))


def _pairs(topics: DataFrame) -> DataFrame:
    """All pairs of topics, a before b; topics are few."""
    a, b = (topics.select(*(F.col(c).alias(f"{c}_{k}") for c in topics.columns)) for k in "ab")
    return a.join(F.broadcast(b), F.col("topic_a") < F.col("topic_b"))


def separation(centroids: DataFrame) -> DataFrame:
    """(separation): mean cosine of pairs of centroids; null with fewer than two."""
    return _pairs(centroids).agg(F.avg(dot("centroid_a", "centroid_b")).alias("separation"))


def jaccard_overlap(terms: DataFrame, top_n: int = 10) -> DataFrame:
    """(topic_a, topic_b, jaccard) of the sets of best terms, without noise."""
    sets = terms.where((F.col("topic") != -1) & (F.col("rank") <= top_n)).groupBy("topic").agg(F.collect_set("term").alias("terms"))
    both = F.size(F.array_intersect("terms_a", "terms_b"))
    return _pairs(sets).select("topic_a", "topic_b", (both / F.size(F.array_union("terms_a", "terms_b"))).alias("jaccard"))


def distribution(assignments: DataFrame) -> DataFrame:
    """(n_docs, n_noise, noise_ratio, n_topics, entropy, cv) in one row."""
    sizes = topic_sizes(assignments).withColumn("p", F.col("size") / F.sum("size").over(W.partitionBy()))
    spread = sizes.agg(F.count("*").alias("n_topics"), (-F.sum(F.col("p") * F.log(F.col("p") + EPSILON))).alias("h"), (F.stddev_samp("size") / F.avg("size")).alias("cv"))
    whole = assignments.agg(F.count("*").alias("n_docs"), F.count_if(F.col("topic") == -1).alias("n_noise"))
    entropy = F.when(F.col("n_topics") == 1, 1.0).otherwise(F.col("h") / F.log(F.col("n_topics").cast("double")))
    return whole.join(spread).select("n_docs", "n_noise", (F.col("n_noise") / F.col("n_docs")).alias("noise_ratio"), "n_topics", entropy.alias("entropy"), "cv")


def silhouette(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(doc_id, topic, silhouette) on the distance 1 - product, without noise.

    Sums of a topic's vectors give the mean distance to its members, so no pair of documents is formed.
    """
    rows = df.where("topic <> -1").select("doc_id", "topic", F.col(vector).cast("array<double>").alias("v"))
    means = mean_vector(rows, ["topic"], "v").join(topic_sizes(rows), "topic")
    packed = means.agg(F.collect_list(F.struct("topic", "mean", F.col("size").cast("double").alias("n"))).alias("all"))
    seen = rows.join(F.broadcast(packed)).withColumn("d", F.transform("all", lambda c: F.struct(c["topic"].alias("topic"), c["n"].alias("n"), dot(F.col("v"), c["mean"]).alias("m"))))
    own = F.filter("d", lambda c: c["topic"] == F.col("topic"))[0]
    a = F.when(own["n"] > 1, (own["n"] - own["m"] * own["n"]) / (own["n"] - 1)).otherwise(0.0)
    b = F.array_min(F.transform(F.filter("d", lambda c: c["topic"] != F.col("topic")), lambda c: 1 - c["m"]))
    s = F.when(F.greatest("a", "b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return seen.withColumns({"a": a, "b": b}).select("doc_id", "topic", s.alias("silhouette"))


def coherence(dtm: DataFrame, terms: DataFrame, n_docs: int, measure: str = "npmi", top_n: int = 10) -> DataFrame:
    """(topic, coherence): mean over pairs of best terms, from documents that have both. Topics with one term get null.

    npmi is -1 for terms that never meet and 1 for terms that always do; ``cv`` is ln((d12 + 1) / (d1 + 1)), 1 ranking higher.
    """
    if measure not in ("npmi", "cv"):
        raise ValueError(f"unknown measure {measure!r}")
    best = terms.where((F.col("topic") != -1) & (F.col("rank") <= top_n)).select("topic", "rank", "term")
    some = dtm.join(F.broadcast(best.select("term").distinct()), "term").select("doc_id", "term").distinct()
    df = some.groupBy("term").agg(F.count("*").alias("d"))
    x, y = best.alias("x"), best.alias("y")
    pairs = x.join(y, (F.col("x.topic") == F.col("y.topic")) & (F.col("x.rank") < F.col("y.rank"))).select("x.topic", F.col("x.term").alias("t1"), F.col("y.term").alias("t2"))
    wanted = pairs.select("t1", "t2").distinct()
    # Documents with t1 meet the few terms asked with it, never all terms of their own.
    ask = some.withColumnRenamed("term", "t1").join(F.broadcast(wanted), "t1")
    met = ask.join(some.withColumnRenamed("term", "t2"), ["doc_id", "t2"], "left_semi").groupBy("t1", "t2").agg(F.count("*").alias("d12"))
    full = pairs.join(met, ["t1", "t2"], "left").fillna(0, ["d12"])
    full = full.join(df.select(F.col("term").alias("t1"), F.col("d").alias("d1")), "t1").join(df.select(F.col("term").alias("t2"), F.col("d").alias("d2")), "t2")
    n = F.lit(float(n_docs))
    p12 = F.col("d12") / n
    npmi = F.when(F.col("d12") == 0, -1.0).when(p12 == 1, 1.0).otherwise(F.log(p12 / (F.col("d1") / n * (F.col("d2") / n))) / -F.log(p12))
    value = npmi if measure == "npmi" else F.log((F.col("d12") + 1.0) / (F.col("d1") + 1.0))
    return best.select("topic").distinct().join(full.groupBy("topic").agg(F.avg(value).alias("coherence")), "topic", "left")


def adjusted_rand(runs: DataFrame) -> DataFrame:
    """(run_a, run_b, ari) for each pair of runs of (run, doc_id, topic); noise is a class."""
    a, b = runs.select("doc_id", F.col("run").alias("run_a"), F.col("topic").alias("x")), runs.select("doc_id", F.col("run").alias("run_b"), F.col("topic").alias("y"))
    key = ["run_a", "run_b"]
    cells = a.join(b, "doc_id").where("run_a < run_b").groupBy(*key, "x", "y").agg(F.count("*").alias("n"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    index = cells.groupBy(*key).agg(two("n").alias("index"), F.sum("n").alias("all"))
    rows = cells.groupBy(*key, "x").agg(F.sum("n").alias("r")).groupBy(*key).agg(two("r").alias("rows"))
    cols = cells.groupBy(*key, "y").agg(F.sum("n").alias("c")).groupBy(*key).agg(two("c").alias("cols"))
    df = index.join(rows, key).join(cols, key)
    expected = F.col("rows") * F.col("cols") / (F.col("all") * (F.col("all") - 1) / 2.0)
    most = (F.col("rows") + F.col("cols")) / 2
    return df.select(*key, F.when(most - expected == 0, 1.0).otherwise((F.col("index") - expected) / (most - expected)).alias("ari"))


def document_stability(runs: DataFrame) -> DataFrame:
    """(doc_id, stability): share of runs that give the document its most frequent topic id."""
    votes = runs.groupBy("doc_id", "topic").agg(F.count("*").alias("n"))
    return votes.groupBy("doc_id").agg((F.max("n") / F.sum("n")).alias("stability"))


def minmax_normalized(df: DataFrame, columns: list[str], inverted: tuple[str, ...] = ("separation", "jaccard", "noise_pct")) -> DataFrame:
    """Columns over their range; 0.5 where that is nothing or a value is missing; inverted ones turned round."""
    whole = W.partitionBy()
    out = {}
    for c in columns:
        lo, hi = F.min(c).over(whole), F.max(c).over(whole)
        x = F.when(F.col(c).isNull() | lo.isNull() | (hi == lo), 0.5).otherwise((F.col(c) - lo) / (hi - lo))
        out[c] = 1 - x if c in inverted else x
    return df.withColumns(out)


def best_run(df: DataFrame, min_topics: int = 2) -> DataFrame:
    """The run of greatest silhouette among those with topics enough, else that with most topics; the first on ties."""
    enough = (F.col("n_topics") >= min_topics).cast("int")
    best = F.when(enough == 1, F.col("silhouette")).otherwise(F.col("n_topics").cast("double"))
    return df.orderBy(F.desc(enough), best.desc_nulls_last(), "run").limit(1)


def embedding_parity(a: DataFrame, b: DataFrame, threshold: float = 0.9999) -> DataFrame:
    """(n, mean_cosine, min_cosine, p01_cosine, max_abs_diff, passed) of two embeddings of the same rows."""
    both = a.select("doc_id", F.col("embedding").cast("array<double>").alias("x")).join(b.select("doc_id", F.col("embedding").cast("array<double>").alias("y")), "doc_id")
    cosine = dot("x", "y") / (F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y")))
    diff = F.array_max(F.zip_with("x", "y", lambda p, q: F.abs(p - q)))
    rows = both.select(cosine.alias("c"), diff.alias("d"))
    return rows.agg(F.count("*").alias("n"), F.avg("c").alias("mean_cosine"), F.min("c").alias("min_cosine"), F.percentile("c", F.lit(0.01)).alias("p01_cosine"), F.max("d").alias("max_abs_diff"), (F.min("c") >= threshold).alias("passed"))
