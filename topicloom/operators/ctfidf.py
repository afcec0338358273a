"""Class-based TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import topic_label
from ..sources.tables import written


def class_scores(dtm: DataFrame, assignments: DataFrame, keys: tuple[str, ...] = (), sqrt: bool = False) -> DataFrame:
    """(*keys, topic, term, n, score) of every term that a class has.

    With f a term's share of its class, A the mean words of a class (1 at least) and c the classes that have
    the term: f * ln(1 + A / c), or with ``sqrt`` the root of f instead. Each value of ``keys`` (a slice) is
    a corpus of its own. The mean counts classes without words. Noise (-1) is a class if it is among the assignments.
    """
    own = list(keys)
    cells = dtm.join(assignments.select("doc_id", *own, "topic"), "doc_id").groupBy(*own, "topic", "term").agg(F.sum("n").alias("n"))
    cells = written(cells, "cells")  # read for the totals, the classes with a term and the scores
    sums = cells.groupBy(*own, "topic").agg(F.sum("n").alias("total"))
    classes = assignments.select(*own, "topic").distinct().join(sums, [*own, "topic"], "left")
    classes = classes.withColumn("total", F.greatest(F.coalesce("total", F.lit(0)), F.lit(1)))
    mean = W.partitionBy(*own)
    classes = classes.withColumn("mean", F.avg("total").over(mean))
    df = cells.groupBy(*own, "term").agg(F.count("*").alias("c"))
    share = F.col("n") / F.col("total")
    score = (F.sqrt(share) if sqrt else share) * F.log(1 + F.col("mean") / F.greatest("c", F.lit(1)))
    return cells.join(classes, [*own, "topic"]).join(df, [*own, "term"]).select(*own, "topic", "term", "n", score.alias("score"))


def top_terms(scores: DataFrame, top_n: int = 10, keys: tuple[str, ...] = (), vocabulary: DataFrame | None = None, classes: DataFrame | None = None) -> DataFrame:
    """(*keys, topic, rank, term, score): the best terms of each class, ties by term.

    With ``vocabulary`` and ``classes``, a class with fewer terms is filled with others at 0, first by term.
    """
    order = W.partitionBy(*keys, "topic").orderBy(F.desc("score"), "term")
    if vocabulary is not None and classes is not None:
        have = scores.groupBy("topic").agg(F.count("*").alias("have"))
        short = classes.select("topic").distinct().join(have, "topic", "left").where(F.coalesce("have", F.lit(0)) < top_n).select("topic")
        # The first 2 * top_n terms hold top_n that a class with fewer lacks.
        few = vocabulary.select("term").distinct().orderBy("term").limit(2 * top_n)
        fill = short.join(F.broadcast(few)).join(scores.select("topic", "term"), ["topic", "term"], "left_anti")
        scores = scores.select("topic", "term", "score").unionByName(fill.select("topic", "term", F.lit(0.0).alias("score")))
    ranked = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    return ranked.select(*keys, "topic", F.col("rank").cast("int"), "term", "score")


def c_tf_idf(dtm: DataFrame, assignments: DataFrame, top_n: int = 10, reduce_frequent_words: bool = False) -> DataFrame:
    """(topic, rank, term, score)."""
    scores = class_scores(dtm, assignments, sqrt=reduce_frequent_words)
    return top_terms(scores, top_n, vocabulary=dtm, classes=assignments)


def l1_normalized(scores: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Scores over the sum of their class's absolute scores; 0 sums count as 1."""
    total = F.sum(F.abs("score")).over(W.partitionBy(*keys, "topic"))
    return scores.withColumn("score", F.col("score") / F.when(total == 0, 1.0).otherwise(total))


def term_lists(terms: DataFrame, n: int | None = None) -> DataFrame:
    """(topic, terms) in rank order."""
    some = terms if n is None else terms.where(F.col("rank") <= n)
    return some.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))


def topic_labels(terms: DataFrame) -> DataFrame:
    """(topic, label)."""
    return term_lists(terms, 4).select("topic", topic_label(F.col("topic"), F.col("terms")).alias("label"))


def topic_sizes(assignments: DataFrame) -> DataFrame:
    """(topic, size), without noise."""
    return assignments.where("topic <> -1").groupBy("topic").agg(F.count("*").alias("size"))
