"""Topics over time, flows between periods, and comparison of groups."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2_normalize, mean_vector
from ..sources.tables import written
from .ctfidf import class_scores, l1_normalized, top_terms


def bin_timestamps(df: DataFrame, time: str, nr_bins: int, out: str = "bin_time") -> DataFrame:
    """``df`` with bin and the median time of each of ``nr_bins`` equal stretches; the last is closed on the right."""
    kind = dict(df.dtypes)[time]
    number = F.unix_micros(F.col(time).cast("timestamp")) if kind.startswith("timestamp") else F.unix_date(time) if kind == "date" else F.col(time).cast("double")
    ends = df.select(number.alias("t")).agg(F.min("t").alias("__lo"), F.max("t").alias("__hi"))
    binned = df.withColumn("__t", number).join(F.broadcast(ends))
    width = (F.col("__hi") - F.col("__lo")).cast("double")
    nth = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("__t") - F.col("__lo")) / width * nr_bins), F.lit(nr_bins - 1)))
    binned = binned.withColumn("bin", nth.cast("int"))
    middles = binned.groupBy("bin").agg(F.percentile("__t", F.lit(0.5)).alias("__m"))
    middle = F.timestamp_micros(F.col("__m").cast("long")).cast(kind) if kind.startswith("timestamp") else F.date_from_unix_date(F.col("__m").cast("int")) if kind == "date" else F.col("__m")
    return binned.join(F.broadcast(middles), "bin").withColumn(out, middle).drop("__t", "__lo", "__hi", "__m")


def slice_scores(dtm: DataFrame, assignments: DataFrame, time: str = "year") -> DataFrame:
    """(time, topic, term, score): L1-normalised class scores of each slice by itself, without noise."""
    rows = assignments.where("topic <> -1").select("doc_id", "topic", F.col(time).alias("time"))
    return l1_normalized(class_scores(dtm, rows, ("time",)), ("time",)).select("time", "topic", "term", "score")


def evolution_tuned(scores: DataFrame) -> DataFrame:
    """Each slice's scores averaged with the tuned ones of the slice before, where the topic is in both.

    Along a run of adjacent slices y_s = x_s and y_i = (x_i + y_(i - 1)) / 2. Runs are found as gaps and islands, and
    terms that a slice lacks count as 0 in it. The number of slices must be moderate, that of terms need not.
    """
    slices = scores.select("time").distinct().withColumn("i", F.row_number().over(W.orderBy("time")))
    there = scores.select("time", "topic").distinct().join(F.broadcast(slices), "time")
    there = there.withColumn("run", F.col("i") - F.row_number().over(W.partitionBy("topic").orderBy("i")))
    there = there.withColumn("s", F.min("i").over(W.partitionBy("topic", "run")))
    # Terms of a run by slice: what has come up to a slice is carried on, halved for each slice that passes, so
    # a term's row is made for the slices from its first on, and each is a running sum of its scores' share.
    own = scores.join(there.select("time", "topic", "run", "i", "s"), ["time", "topic"])
    ends = there.groupBy("topic", "run").agg(F.max("i").alias("e"))
    share = F.col("score") * F.when(F.col("i") == F.col("s"), 1.0).otherwise(0.5)
    steps = own.groupBy("topic", "run", "term").agg(F.array_sort(F.collect_list(F.struct("i", share.alias("x")))).alias("steps")).join(ends, ["topic", "run"])
    first = F.col("steps")[0]["i"]
    none = F.struct(F.lit(0.0).cast("double").alias("now"), F.array().cast("array<double>").alias("all"))
    found = F.map_from_entries("steps")

    def step(state, i):
        now = state["now"] / 2 + F.coalesce(F.try_element_at(found, i), F.lit(0.0))
        return F.struct(now.alias("now"), F.concat(state["all"], F.array(now)).alias("all"))

    run = F.aggregate(F.sequence(first, F.col("e")), none, step, lambda state: state["all"])
    rows = steps.select("topic", "run", "term", first.alias("first"), F.posexplode(run).alias("p", "score")).withColumn("i", F.col("first") + F.col("p"))
    return rows.join(F.broadcast(slices), "i").select("time", "topic", "term", "score")


def globally_tuned(scores: DataFrame, overall: DataFrame) -> DataFrame:
    """Means of a slice's scores and the topic's over all slices; overall: topic, term, score."""
    pairs = scores.select("time", "topic").distinct().join(overall.withColumnRenamed("score", "whole"), "topic")
    both = scores.join(pairs, ["time", "topic", "term"], "full")
    return both.select("time", "topic", "term", ((F.coalesce("score", F.lit(0.0)) + F.coalesce("whole", F.lit(0.0))) / 2).alias("score"))


def topics_over_time(dtm: DataFrame, assignments: DataFrame, time: str = "year", top_n: int = 5, evolution: bool = True, overall: bool = True, nr_bins: int | None = None) -> DataFrame:
    """(time, topic, words, frequency): the best terms of each topic in each slice, and its documents.

    With ``nr_bins`` slices are that many equal stretches of time, each named by its median; every document needs a time.
    """
    if not assignments.where(F.col(time).isNull()).isEmpty():
        raise ValueError(f"some documents have no {time}")
    if nr_bins is not None:
        if nr_bins < 1:
            raise ValueError("nr_bins must be at least 1")
        assignments = bin_timestamps(assignments, time, nr_bins, "__bin").select("doc_id", "topic", F.col("__bin").alias(time))
    scores = slice_scores(dtm, assignments, time)
    if evolution:
        scores = evolution_tuned(scores)
    if overall:
        rows = assignments.where("topic <> -1").select("doc_id", "topic")
        scores = globally_tuned(scores, l1_normalized(class_scores(dtm, rows)).select("topic", "term", "score"))
    best = top_terms(scores.withColumn("score", F.round("score", 9)), top_n, ("time",))
    words = best.groupBy("time", "topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("words"))
    count = assignments.where("topic <> -1").groupBy(F.col(time).alias("time"), "topic").agg(F.count("*").alias("frequency"))
    return words.join(count, ["time", "topic"])


def period_centroids(df: DataFrame, time: str = "year", vector: str = "embedding") -> DataFrame:
    """(period, topic, count, centroid) without noise."""
    rows = df.where("topic <> -1").select(F.col(time).alias("period"), "topic", l2_normalize(F.col(vector).cast("array<double>")).alias("v"))
    count = rows.groupBy("period", "topic").agg(F.count("*").alias("count"))
    return mean_vector(rows, ["period", "topic"], "v").join(count, ["period", "topic"]).select("period", "topic", "count", l2_normalize("mean").alias("centroid"))


def flow_transitions(nodes: DataFrame, min_similarity: float = 0.7) -> DataFrame:
    """Links between topics of consecutive periods whose centroids are similar enough."""
    order = nodes.select("period").distinct().withColumn("next", F.lead("period").over(W.orderBy("period")))
    a = nodes.join(F.broadcast(order), "period").where(F.col("next").isNotNull()).select(F.col("period").alias("period_from"), F.col("topic").alias("topic_from"), F.col("centroid").alias("ca"), "next")
    b = nodes.select(F.col("period").alias("period_to"), F.col("topic").alias("topic_to"), F.col("centroid").alias("cb"))
    pairs = a.join(b, F.col("next") == F.col("period_to")).withColumn("sim", dot("ca", "cb")).where(F.col("sim") >= min_similarity)
    return pairs.select("period_from", "topic_from", "period_to", "topic_to", F.bround("sim", 4).alias("similarity"))


def flow_status(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(period, topic, count, status) by the links that enter and leave a topic, and whether its period is the first or last."""
    entering = links.groupBy(F.col("period_to").alias("period"), F.col("topic_to").alias("topic")).agg(F.count("*").alias("n_in"))
    leaving = links.groupBy(F.col("period_from").alias("period"), F.col("topic_from").alias("topic")).agg(F.count("*").alias("n_out"))
    whole = W.partitionBy()
    df = nodes.select("period", "topic", "count").join(entering, ["period", "topic"], "left").join(leaving, ["period", "topic"], "left").fillna(0, ["n_in", "n_out"])
    df = df.withColumns({"lo": F.min("period").over(whole), "hi": F.max("period").over(whole)})
    first, last, i, o = F.col("period") == F.col("lo"), F.col("period") == F.col("hi"), F.col("n_in"), F.col("n_out")
    status = (
        F.when(first & (o == 0), "disappears").when(first & (o == 1), "continues").when(first, "splits")
        .when(last & (i == 0), "emerges").when(last & (i == 1), "continues").when(last, "merges")
        .when((i == 0) & (o == 0), "isolated").when(i == 0, "emerges").when(o == 0, "disappears").when(i > 1, "merges").when(o > 1, "splits").otherwise("continues")
    )
    return df.select("period", "topic", "count", status.alias("status"))


def contingency(df: DataFrame, a: str = "topic", b: str = "grp") -> DataFrame:
    """(a, b, observed, row_total, col_total, total), cells without documents included, noise left out."""
    rows = df.where("topic <> -1") if "topic" in (a, b) else df
    cells = rows.groupBy(a, b).agg(F.count("*").alias("observed"))
    grid = rows.select(a).distinct().join(F.broadcast(rows.select(b).distinct())).join(cells, [a, b], "left").fillna(0, ["observed"])
    return grid.withColumns({"row_total": F.sum("observed").over(W.partitionBy(a)), "col_total": F.sum("observed").over(W.partitionBy(b)), "total": F.sum("observed").over(W.partitionBy())})


def compare_topics(df: DataFrame, group: str = "grp", method: str = "chi2", min_count: float = 5) -> DataFrame:
    """(topic, group, observed, expected, stat) of cells expected at least ``min_count`` times; warns where there is none.

    The counts of cells are written once, so the check for the warning costs no second pass over the rows.
    """
    if method not in ("chi2", "log_ratio"):
        raise ValueError(f"unknown method {method!r}")
    cells = contingency(df, "topic", group).withColumn("expected", F.col("row_total") * F.col("col_total") / F.col("total"))
    cells = written(cells.where(F.col("expected") >= min_count), "cells")
    if cells.isEmpty():
        warnings.warn(f"no cell of a topic and a group is expected {min_count} times; lower min_count", stacklevel=2)
    o, e = F.col("observed"), F.col("expected")
    stat = F.signum(o - e) * F.sqrt((o - e) * (o - e) / e) if method == "chi2" else F.log2(((o + 0.5) / (F.col("row_total") + 1)) / (F.col("col_total") / F.col("total")))
    return cells.select("topic", group, "observed", F.bround("expected", 1).alias("expected"), F.bround(stat, 4).alias("stat"))


def upper_gamma_share(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * lead
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * lead


def chi2_test(df: DataFrame, a: str = "topic", b: str = "grp") -> DataFrame:
    """(statistic, df, p_value) of independence; with the continuity correction on two by two tables."""
    cells = contingency(df, a, b)
    e = F.col("row_total") * F.col("col_total") / F.col("total")
    size = cells.agg(F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c")).withColumn("yates", (F.col("r") == 2) & (F.col("c") == 2))
    off = F.abs(F.col("observed") - e)
    part = cells.join(F.broadcast(size)).withColumn("x", F.pow(off - F.when(F.col("yates"), F.least(F.lit(0.5), off)).otherwise(0.0), F.lit(2.0)) / e)
    row = part.agg(F.sum("x").alias("statistic"), F.first((F.col("r") - 1) * (F.col("c") - 1)).alias("df")).first()
    p = upper_gamma_share(row["df"] / 2, row["statistic"] / 2) if row["df"] else None
    return df.sparkSession.createDataFrame([(row["statistic"], row["df"], p)], "statistic double, df long, p_value double")
