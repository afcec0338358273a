"""Reading a fit: terms, topic and document information, search, prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2_normalize
from .ctfidf import term_lists, topic_labels


def get_topics(terms: DataFrame, top_n: int | None = None) -> DataFrame:
    """(topic, rank, term, score) of the best terms of all topics."""
    return terms if top_n is None else terms.where(F.col("rank") <= top_n)


def get_topic(terms: DataFrame, topic: int) -> DataFrame:
    """(rank, term, score) of one topic; empty where it is missing."""
    return terms.where(F.col("topic") == topic).select("rank", "term", "score")


def topic_info(assignments: DataFrame, terms: DataFrame, topic: int | None = None) -> DataFrame:
    """topic, count, name, representation (five best terms; empty for noise)."""
    sizes = assignments.groupBy("topic").agg(F.count("*").alias("count"))
    five = term_lists(terms, 5).select("topic", F.array_join("terms", ", ").alias("words"))
    info = sizes.join(topic_labels(terms), "topic", "left").join(five, "topic", "left")
    info = info.select("topic", "count", F.when(F.col("topic") == -1, "-1_outliers").otherwise(F.coalesce("label", F.concat(F.col("topic").cast("string"), F.lit("_")))).alias("name"), F.when(F.col("topic") == -1, "").otherwise(F.coalesce("words", F.lit(""))).alias("representation"))
    return info if topic is None else info.where(F.col("topic") == topic)


def document_info(assignments: DataFrame, terms: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """doc_id, topic, name, top_words of each document, and the metadata's columns."""
    names = topic_info(assignments, terms).select("topic", "name", F.col("representation").alias("top_words"))
    info = assignments.select("doc_id", "topic").join(names, "topic", "left").select("doc_id", "topic", "name", "top_words")
    return info if metadata is None else info.join(metadata, "doc_id", "left")


def find_topics(terms: DataFrame, search: str, top_n: int = 5) -> DataFrame:
    """(topic, similarity): the term's own score by topic, or where none has it the number of terms that contain it."""
    hits = terms.groupBy("topic").agg(F.sum(F.when(F.col("term") == search, F.col("score")).otherwise(0.0)).alias("exact"), F.count_if(F.col("term").contains(search)).cast("double").alias("part"))
    best = F.max("exact").over(W.partitionBy())
    scored = hits.select("topic", F.when(best > 0, F.col("exact")).otherwise(F.col("part")).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "topic").limit(top_n)


def similarities(df: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """``df`` with sims: array<struct<sim, topic>> of its vector with every centroid.

    The centroids travel as one small row, so the documents are neither exchanged nor multiplied, and a
    stream of documents will do as well.
    """
    packed = centroids.agg(F.array_sort(F.collect_list(F.struct("topic", "centroid"))).alias("centroids"))
    unit = l2_normalize(F.col(vector).cast("array<double>"))
    joined = df.withColumn("__unit", unit).join(F.broadcast(packed))
    sims = F.transform("centroids", lambda c: F.struct(F.round(dot(F.col("__unit"), c["centroid"]), 9).alias("sim"), c["topic"].alias("topic")))
    return joined.withColumn("sims", sims).drop("__unit", "centroids")


def _best(sims: Column) -> Column:
    """The greatest similarity, the least topic on ties."""
    return F.array_max(F.transform(sims, lambda s: F.struct(s["sim"].alias("sim"), (-s["topic"]).alias("minus"))))


def predict(df: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """doc_id, topic (never noise) and probability: the nearest centroid in the original space."""
    best = similarities(df, centroids, vector).withColumn("__best", _best(F.col("sims")))
    return best.select("doc_id", (-F.col("__best.minus")).cast("int").alias("topic"), F.col("__best.sim").alias("probability"))


def predict_all(df: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """(doc_id, topic, similarity) with every topic."""
    return similarities(df, centroids, vector).select("doc_id", F.explode("sims").alias("s")).select("doc_id", "s.topic", F.col("s.sim").alias("similarity"))


def representative_docs(df: DataFrame, centroids: DataFrame, n: int = 3, vector: str = "embedding") -> DataFrame:
    """(topic, rank, doc_id, similarity) of the members nearest to their centroid, ties by id."""
    members = df.where("topic <> -1").select("doc_id", "topic", l2_normalize(F.col(vector).cast("array<double>")).alias("v"))
    sims = members.join(F.broadcast(centroids), "topic").select("topic", "doc_id", F.round(dot("v", "centroid"), 9).alias("similarity"))
    order = W.partitionBy("topic").orderBy(F.desc("similarity"), "doc_id")
    return sims.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= n).select("topic", "rank", "doc_id", "similarity")


def topic_lines(info: DataFrame) -> DataFrame:
    """(topic, line) for a printed summary."""
    return info.select("topic", F.concat(F.lit("Topic "), F.col("topic").cast("string"), F.lit(" ("), F.col("count").cast("string"), F.lit(" docs): "), F.col("representation")).alias("line"))


# The wording of the default prompt.
LABEL_PROMPT = (
    "You are labeling topics discovered by a text mining algorithm.\n"
    "Based on the top terms and representative documents below, provide a "
    "concise topic label of 3 to 5 words that captures the core theme.\n\n"
    "Top terms: {terms}\n\n"
    "Representative documents:\n{docs}\n\n"
    "Respond with ONLY the topic label  --  no punctuation at the end, "
    "no explanation, no quotes."
)


def label_prompts(terms: DataFrame, reps: DataFrame, texts: DataFrame, top_n_terms: int = 10, n_docs: int = 3, template: str = LABEL_PROMPT) -> DataFrame:
    """(topic, prompt) from the best terms and numbered quotes; ``{terms}`` and ``{docs}`` are filled in."""
    words = term_lists(terms.where("topic <> -1"), top_n_terms).select("topic", F.array_join("terms", ", ").alias("terms"))
    quotes = reps.where(F.col("rank") <= n_docs).join(texts.select("doc_id", "text"), "doc_id")
    quotes = quotes.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("q"))
    lines = F.array_join(F.transform("q", lambda x: F.concat(F.lit("  "), x["rank"].cast("string"), F.lit('. "'), x["text"], F.lit('"'))), "\n")
    filled = F.replace(F.replace(F.lit(template), F.lit("{terms}"), F.col("terms")), F.lit("{docs}"), F.coalesce(lines, F.lit("")))
    return words.join(quotes, "topic", "left").select("topic", filled.alias("prompt"))


def label_topics(terms: DataFrame, prompts: DataFrame, ask) -> DataFrame:
    """(topic, label) with ``ask(prompt) -> str``, one call for each topic; where it fails the old label stays."""
    import warnings

    spark, named = terms.sparkSession, []
    for topic, prompt in prompts.orderBy("topic").collect():
        try:
            named.append((topic, f"{topic}_{ask(prompt).strip()}"))
        except Exception as error:  # noqa: BLE001  a service may fail in any way
            warnings.warn(f"topic {topic} keeps its label: {error}", stacklevel=2)
    new = spark.createDataFrame(named, "topic int, named string")
    return topic_labels(terms).join(new, "topic", "left").select("topic", F.coalesce("named", "label").alias("label"))
