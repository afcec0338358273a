"""The numbers behind figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import display_label


def barchart(terms: DataFrame, topics: list[int] | None = None, top_n: int = 8) -> DataFrame:
    """(topic, rank, term, score) without noise."""
    if topics is not None:
        known = {r[0] for r in terms.select("topic").distinct().collect()}
        if missing := sorted(set(topics) - known):
            raise ValueError(f"unknown topics: {missing}")
        terms = terms.where(F.col("topic").isin(topics))
    return terms.where((F.col("topic") != -1) & (F.col("rank") <= top_n)).select("topic", "rank", "term", "score")


def topic_map(layout: DataFrame, assignments: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """x, y, topic, label and hover of each document of layout (doc_id, x, y), and the label's place (its members' mean)."""
    df = layout.join(assignments.select("doc_id", "topic"), "doc_id").join(labels.select("topic", display_label("label").alias("label")), "topic", "left").join(texts.select("doc_id", F.regexp_replace(F.substring("text", 1, 160), r"(.{1,80})(\s|$)", "$1<br>").alias("hover")), "doc_id")
    at = W.partitionBy("topic")
    return df.withColumns({"label_x": F.avg("x").over(at), "label_y": F.avg("y").over(at)})


def time_lines(tot: DataFrame, n_topics: int = 10, normalize: bool = True) -> DataFrame:
    """(time, topic, words, frequency, share) of the topics with most documents; shares are of all topics."""
    df = tot.withColumn("share", F.col("frequency") / F.sum("frequency").over(W.partitionBy("time"))) if normalize else tot.withColumn("share", F.col("frequency").cast("double"))
    best = tot.groupBy("topic").agg(F.sum("frequency").alias("all")).orderBy(F.desc("all"), "topic").limit(n_topics)
    return df.join(F.broadcast(best.select("topic")), "topic", "left_semi").select("time", "topic", "words", "frequency", "share")


def flow_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """links with value: similarity times the smaller topic's documents, 1 at least."""
    a = nodes.select(F.col("period").alias("period_from"), F.col("topic").alias("topic_from"), F.col("count").alias("na"))
    b = nodes.select(F.col("period").alias("period_to"), F.col("topic").alias("topic_to"), F.col("count").alias("nb"))
    return links.join(a, ["period_from", "topic_from"]).join(b, ["period_to", "topic_to"]).select("period_from", "topic_from", "period_to", "topic_to", "similarity", F.greatest(F.col("similarity") * F.least("na", "nb"), F.lit(1.0)).alias("value"))


def flow_nodes(nodes: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, period, topic, count, label): nodes numbered from 0 by period, the largest topics of a period first."""
    named = nodes.select("period", "topic", "count")
    named = named.join(labels.select("period", "topic", "label"), ["period", "topic"], "left") if labels is not None else named.withColumn("label", F.concat(F.lit("Topic "), F.col("topic").cast("string")))
    within = F.row_number().over(W.partitionBy("period").orderBy(F.desc("count"), "topic"))
    sizes = named.groupBy("period").agg(F.count("*").alias("n"))
    before = sizes.select("period", F.coalesce(F.sum("n").over(W.orderBy("period").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = named.withColumn("r", within).join(F.broadcast(before), "period")
    return ranked.select((F.col("before") + F.col("r") - 1).cast("int").alias("node"), "period", "topic", "count", "label")


def quality_panels(silhouettes: DataFrame, assignments: DataFrame, centroids: DataFrame, terms: DataFrame) -> DataFrame:
    """(panel, topic, other, value): mean silhouettes, sizes (noise too), centroid similarities and overlaps of terms.

    Pairs are given once, topic below other; other is null in the panels of single topics.
    """
    from ..functions.vectors import dot
    from .metrics import _pairs, jaccard_overlap

    none = F.lit(None).cast("int").alias("other")
    panel = lambda df, name, topic, other, value: df.select(F.lit(name).alias("panel"), F.col(topic).cast("int").alias("topic"), other, value.cast("double").alias("value"))
    return (
        panel(silhouettes.groupBy("topic").agg(F.avg("silhouette").alias("v")), "silhouette", "topic", none, F.col("v"))
        .unionByName(panel(assignments.groupBy("topic").count(), "size", "topic", none, F.col("count")))
        .unionByName(panel(_pairs(centroids), "similarity", "topic_a", F.col("topic_b").cast("int").alias("other"), dot("centroid_a", "centroid_b")))
        .unionByName(panel(jaccard_overlap(terms), "jaccard", "topic_a", F.col("topic_b").cast("int").alias("other"), F.col("jaccard")))
    )


def comparison_matrix(cells: DataFrame, group: str = "grp", top_n: int = 5) -> DataFrame:
    """Cells of the topics with the greatest mean absolute statistic."""
    best = cells.groupBy("topic").agg(F.round(F.avg(F.abs("stat")), 9).alias("m")).orderBy(F.desc("m"), "topic").limit(top_n)
    return cells.join(F.broadcast(best.select("topic")), "topic", "left_semi").select("topic", group, "stat")


def stability_matrix(ari: DataFrame) -> DataFrame:
    """(run_a, run_b, ari) both ways, null on the diagonal."""
    both = ari.unionByName(ari.select(F.col("run_b").alias("run_a"), F.col("run_a").alias("run_b"), "ari"))
    runs = both.select(F.col("run_a").alias("run")).distinct()
    return both.unionByName(runs.select(F.col("run").alias("run_a"), F.col("run").alias("run_b"), F.lit(None).cast("double").alias("ari")))


def dendrogram(tree: list[tuple[int, int, int, float, list[int]]], k: int) -> list[tuple[int, float, float]]:
    """(node, x, y): leaves in drawing order at height 0, parents midway above their children."""
    children = {p: (a, b) for p, a, b, *_ in tree}
    height = {p: h for p, _, _, h, _ in tree}
    order, stack = [], [tree[-1][0]]
    while stack:
        node = stack.pop()
        if node in children:
            stack += reversed(children[node])
        else:
            order.append(node)
    x = {leaf: float(i + 1) for i, leaf in enumerate(order)}
    for p, a, b, *_ in tree:
        x[p] = (x[a] + x[b]) / 2
    return [(n, x[n], height.get(n, 0.0)) for n in sorted(x)]


def sweep_rows(runs: DataFrame, factors: list[str], min_topics: int = 2) -> DataFrame:
    """(run, label, best): a label of each run's factors, and whether it is the best by ``best_run``."""
    from .metrics import best_run

    best = best_run(runs, min_topics).select(F.col("run").alias("best_run"))
    label = F.concat_ws(", ", *(F.concat(F.lit(f"{f}="), F.col(f).cast("string")) for f in factors))
    return runs.join(F.broadcast(best), F.col("run") == F.col("best_run"), "left").select("run", label.alias("label"), F.col("best_run").isNotNull().alias("best"))


def sweep_matrix(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """(run, metric, value) scaled so that greater is better."""
    from .metrics import minmax_normalized

    scaled = minmax_normalized(runs, metrics)
    return scaled.select("run", F.explode(F.map_from_arrays(F.array(*(F.lit(m) for m in metrics)), F.array(*metrics))).alias("metric", "value"))
