"""Whole fits: embed, reduce, cluster, describe; guided, zero-shot, swept and repeated ones."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.errors import IllegalArgumentException, PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stopwords import ENGLISH_STOPWORDS
from ..functions.vectors import l2_normalize, topic_centroids
from ..operators import metrics
from ..operators.accessors import predict, representative_docs
from ..operators.cluster import Hdbscan
from ..operators.ctfidf import c_tf_idf, topic_labels, topic_sizes
from ..operators.dtm import build_dtm, cvalue_dtm, pos_dtm
from ..operators.dynamics import flow_status, flow_transitions, period_centroids
from ..operators.embed import embed_texts
from ..operators.reduce import PcaReduction, TooManyRows, UmapReduction
from ..sources.tables import written


def _own_failure(error: Exception) -> bool:
    """Whether a fit failed by its own input or parameters, which is a result of that run, and not by Spark or by rows over a cap."""
    if isinstance(error, TooManyRows | PySparkException):
        return isinstance(error, IllegalArgumentException)
    return isinstance(error, ValueError | RuntimeError)


@dataclass(frozen=True)
class CValueRepresentation:
    max_n: int = 4
    threshold: float = 0.0
    min_freq: int = 2


@dataclass(frozen=True)
class PosRepresentation:
    """Words and phrases by their tags. annotate: documents (doc_id, text) to tagger rows (doc_id, sentence_id, token_id, token, lemma, upos)."""

    annotate: Callable[[DataFrame], DataFrame]
    pos: tuple[str, ...] | None = ("NOUN", "PROPN")
    patterns: tuple[tuple[str, ...], ...] = ()
    lemmatize: bool = True

    def __post_init__(self):
        if not self.pos and not self.patterns:
            raise ValueError("give pos, patterns or both")


@dataclass(frozen=True)
class TopicFit:
    """A fit as tables; edits make new ones. assignments: doc_id, topic; embeddings: doc_id, embedding; dtm: doc_id, term, n."""

    texts: DataFrame
    embeddings: DataFrame
    assignments: DataFrame
    dtm: DataFrame
    params: dict = field(default_factory=dict)
    labels_of: DataFrame | None = None

    @property
    def rows(self) -> DataFrame:
        return self.assignments.join(self.embeddings, "doc_id")

    @property
    def terms(self) -> DataFrame:
        return c_tf_idf(self.dtm, self.assignments, self.params.get("top_n_terms", 10), self.params.get("reduce_frequent_words", False))

    @property
    def centroids(self) -> DataFrame:
        return topic_centroids(self.rows)

    @property
    def sizes(self) -> DataFrame:
        return topic_sizes(self.assignments)

    @property
    def labels(self) -> DataFrame:
        return self.labels_of if self.labels_of is not None else topic_labels(self.terms)

    @property
    def representatives(self) -> DataFrame:
        return representative_docs(self.rows, self.centroids)

    def with_assignments(self, assignments: DataFrame) -> TopicFit:
        """The fit derived anew from other assignments."""
        return replace(self, assignments=assignments.select("doc_id", "topic"), labels_of=None)

    def layout(self, reducer) -> DataFrame:
        """(doc_id, x, y): the documents in two dimensions, by a reducer with two components."""
        flat = reducer.fit_transform(self.embeddings, self.params.get("seed", 42))
        return flat.select("doc_id", F.col("reduced")[0].alias("x"), F.col("reduced")[1].alias("y"))

    def transform(self, df: DataFrame) -> DataFrame:
        return predict(df, self.centroids)

    def tables(self) -> dict[str, DataFrame]:
        return {"texts": self.texts, "embeddings": self.embeddings, "assignments": self.assignments, "dtm": self.dtm, "terms": self.terms, "labels": self.labels}

    @classmethod
    def from_tables(cls, tables: dict[str, DataFrame], params: dict) -> TopicFit:
        return cls(tables["texts"], tables.get("embeddings"), tables["assignments"], tables.get("dtm"), params, tables.get("labels"))

    def summary(self) -> dict:
        one = self.assignments.agg(F.count("*").alias("n_docs"), F.count_if(F.col("topic") == -1).alias("n_noise"), F.count_distinct(F.when(F.col("topic") != -1, F.col("topic"))).alias("n_topics")).first()
        return one.asDict() | {"top_n_terms": self.params.get("top_n_terms", 10)}

    def __repr__(self) -> str:
        s = self.summary()
        return f"TopicFit({s['n_docs']} documents, {s['n_topics']} topics, {s['n_noise']} noise)"


def fit_topics(docs: DataFrame, encoder=None, embeddings: DataFrame | None = None, reducer=None, clusterer=None, representation: CValueRepresentation | PosRepresentation | None = None, language: str = "english", stopwords: Iterable[str] | None = None, extra_stopwords: Iterable[str] = (), ngram_range: tuple[int, int] = (1, 1), top_n_terms: int = 10, reduce_frequent_words: bool = False, min_df: int = 2, max_df_frac: float = 0.95, seed: int = 42, reduced: DataFrame | None = None, dtm: DataFrame | None = None) -> TopicFit:
    """docs: doc_id, text. Vectors come from ``embeddings`` (doc_id, embedding) or from ``encoder``.

    reduced (doc_id, reduced) and dtm, made by an earlier fit of the same documents, spare that work.
    """
    if embeddings is None:
        if encoder is None:
            raise ValueError("give an encoder or embeddings")
        embeddings = embed_texts(docs, encoder)
    else:
        short = docs.select("doc_id").join(embeddings.select("doc_id"), "doc_id", "left_anti")
        if not short.isEmpty():
            raise ValueError("some documents have no embedding")
    if representation is not None and not isinstance(representation, CValueRepresentation | PosRepresentation):
        raise ValueError(f"unsupported representation {type(representation).__name__}")
    if reduced is None:
        reduced = written((reducer or PcaReduction(5)).fit_transform(embeddings, seed), "reduced")
    # Written once: what a lazy fit would do again for each use of it.
    assignments = written((clusterer or Hdbscan()).fit_predict(reduced, seed).select("doc_id", "topic"), "assignments")
    stop = list(stopwords) if stopwords is not None else list(ENGLISH_STOPWORDS) if language else []
    stop += list(extra_stopwords)
    if dtm is not None:
        pass
    elif representation is None:
        dtm = build_dtm(docs, min_df, max_df_frac, stop, ngram_range)
    elif isinstance(representation, PosRepresentation):
        rows = written(representation.annotate(docs.select("doc_id", "text")), "annotations")
        dtm = pos_dtm(rows, docs, representation.pos, [list(p) for p in representation.patterns], representation.lemmatize, min_df, max_df_frac, extra_stopwords)
    else:
        dtm = cvalue_dtm(docs, representation.max_n, representation.min_freq, representation.threshold, stop, min_df, max_df_frac)
    if dtm.isEmpty():
        raise ValueError("no term is left; lower min_df or raise max_df_frac")
    params = {"top_n_terms": top_n_terms, "reduce_frequent_words": reduce_frequent_words, "seed": seed}
    return TopicFit(docs.select("doc_id", "text"), embeddings.select("doc_id", "embedding"), assignments.select("doc_id", "topic"), dtm, params)


def guided_fit(docs: DataFrame, seeds: dict[str, list[str]], encoder, embeddings: DataFrame | None = None, n_anchor_weight: int = 3, **options) -> tuple[TopicFit, DataFrame]:
    """(fit, (seed_label, topic)): seed lists join the corpus as documents of their own, and leave after clustering.

    A seed's topic is the one most of its copies are in; null where that is none but noise. Seeds have ids below all of the
    documents'.
    """
    if not seeds or not all(isinstance(k, str) and k for k in seeds):
        raise ValueError("seeds must be named")
    spark = docs.sparkSession
    names = list(seeds)
    least = min(0, docs.agg(F.min("doc_id")).first()[0] or 0)
    extra = spark.createDataFrame([(least - 1 - (i * n_anchor_weight + j), " ".join(seeds[k]), k) for i, k in enumerate(names) for j in range(n_anchor_weight)], "doc_id long, text string, seed_label string")
    every = docs.select("doc_id", "text").unionByName(extra.select("doc_id", "text"))
    vectors = None if embeddings is None else embeddings.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding")).unionByName(embed_texts(extra, encoder))
    fit = fit_topics(every, encoder, vectors, **options)
    votes = fit.assignments.where("topic <> -1").join(extra.select("doc_id", "seed_label"), "doc_id").groupBy("seed_label", "topic").agg(F.count("*").alias("n"))
    best = votes.withColumn("r", F.row_number().over(W.partitionBy("seed_label").orderBy(F.desc("n"), "topic"))).where("r = 1").select("seed_label", "topic")
    seed_map = spark.createDataFrame([(k,) for k in names], "seed_label string").join(best, "seed_label", "left")
    slug = seed_map.where(F.col("topic").isNotNull()).groupBy("topic").agg(F.min("seed_label").alias("s"))
    named = topic_labels(fit.terms).join(slug, "topic", "left").select("topic", F.when(F.col("s").isNotNull(), F.concat(F.col("topic").cast("string"), F.lit("_"), F.regexp_replace("s", "[^a-zA-Z0-9]+", "_"))).otherwise(F.col("label")).alias("label"))
    real = replace(fit, texts=docs.select("doc_id", "text"), embeddings=fit.embeddings.where(F.col("doc_id") >= least), assignments=fit.assignments.where(F.col("doc_id") >= least), dtm=fit.dtm.where(F.col("doc_id") >= least), labels_of=named)
    return real, seed_map


def zero_shot_assign(df: DataFrame, labels: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(doc_id, topic): the label vector (topic, centroid) nearest to each row, noise below the threshold."""
    unit = labels.select("topic", l2_normalize(F.col("centroid").cast("array<double>")).alias("centroid"))
    near = predict(df, unit)
    return near.select("doc_id", F.when(F.col("probability") >= threshold, F.col("topic")).otherwise(-1).cast("int").alias("topic"))


def zero_shot_topics(docs: DataFrame, labels: list[str], encoder, embeddings: DataFrame | None = None, threshold: float = 0.0, ngram_range: tuple[int, int] = (1, 2), **options) -> TopicFit:
    """Documents go to the most similar of ``labels``; ids are label places from 0, so some may be missing."""
    if len(labels) < 2:
        raise ValueError("two labels or more are needed")
    spark = docs.sparkSession
    named = spark.createDataFrame(list(enumerate(labels)), "doc_id long, text string")
    vectors = embed_texts(named, encoder).select(F.col("doc_id").cast("int").alias("topic"), F.col("embedding").alias("centroid"))
    embeddings = embed_texts(docs, encoder) if embeddings is None else embeddings
    assignments = zero_shot_assign(embeddings, vectors, threshold)
    stop = [*ENGLISH_STOPWORDS, *options.get("extra_stopwords", ())]
    slugs = named.select(F.col("doc_id").cast("int").alias("topic"), F.concat_ws("_", F.col("doc_id").cast("string"), F.regexp_replace("text", "[^a-zA-Z0-9]+", "_")).alias("label"))
    return TopicFit(docs.select("doc_id", "text"), embeddings, assignments, build_dtm(docs, stopwords=stop, ngram_range=ngram_range), {"top_n_terms": options.get("top_n_terms", 10)}, slugs)


def quality(fit: TopicFit, top_n: int = 10) -> DataFrame:
    """One row: cohesion, separation, jaccard, silhouette, n_topics, noise_pct, entropy, cv."""
    rows, centroids = fit.rows, fit.centroids
    parts = [
        metrics.distribution(fit.assignments).select("n_topics", (100 * F.col("noise_ratio")).alias("noise_pct"), "entropy", "cv"),
        metrics.silhouette(rows).agg(F.avg("silhouette").alias("silhouette")),
        metrics.cohesion(rows, centroids).agg(F.avg("cohesion").alias("cohesion")),
        metrics.separation(centroids),
        metrics.jaccard_overlap(fit.terms, top_n).agg(F.avg("jaccard").alias("jaccard")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out


def sweep_topics(docs: DataFrame, embeddings: dict[str, DataFrame], n_components: tuple[int, ...] = (5, 10), min_pts: tuple[int, ...] = (5, 10, 20), n_neighbors: tuple[int, ...] | None = None, min_topics: int = 2, make_reducer=None, seed: int = 42, encoders: dict | None = None, ngram_range: tuple[tuple[int, int], ...] = ((1, 1),), sample_size: int | None = None) -> DataFrame:
    """A row for each fit of the grid: run, its parameters, quality, and error where it failed. The first factor varies fastest.

    Reductions are by ``make_reducer``, else by UMAP where ``n_neighbors`` are given, else by principal components, which have none (the column says 15).
    encoders (name to encoder) add models whose vectors are made here. With ``sample_size``, that many documents, taken by a
    hash of their id and the seed, are fitted. Counts, vectors and reductions that runs share are made once.
    """
    spark = docs.sparkSession
    if sample_size is not None:
        docs = written(docs.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample_size), "sample")
        embeddings = {k: v.join(docs.select("doc_id"), "doc_id", "left_semi") for k, v in embeddings.items()}
    embeddings = embeddings | {k: embed_texts(docs, e) for k, e in (encoders or {}).items()}
    embeddings = {k: written(v.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding")), "vectors") for k, v in embeddings.items()}
    counted, reductions, last = {}, {}, None
    out, run = [], 0
    schema = "run int, model string, n_neighbors int, n_components int, min_pts int, ngram_max int, n_topics long, noise_pct double, entropy double, cv double, silhouette double, cohesion double, separation double, jaccard double, error string"
    for grams in ngram_range:
        for pts in min_pts:
            for dims in n_components:
                for near in n_neighbors or (15,):
                    for model, vectors in embeddings.items():
                        run += 1
                        row = {"run": run, "model": model, "n_neighbors": near, "n_components": dims, "min_pts": pts, "ngram_max": grams[1], "error": None}
                        try:
                            if grams not in counted:
                                counted[grams] = written(build_dtm(docs, stopwords=ENGLISH_STOPWORDS, ngram_range=grams), "dtm")
                            if (key := (model, near, dims)) not in reductions:
                                reducer = make_reducer(near, dims) if make_reducer else UmapReduction(near, dims) if n_neighbors else PcaReduction(dims)
                                reductions[key] = written(reducer.fit_transform(vectors, seed), "reduced")
                            fit = fit_topics(docs, embeddings=vectors, clusterer=Hdbscan(pts), seed=seed, reduced=reductions[key], dtm=counted[grams])
                            row |= quality(fit).first().asDict()
                        except Exception as error:
                            if not _own_failure(error):
                                raise
                            row["error"] = f"{type(error).__name__}: {error}"[:500]
                            last = error
                        out.append(row)
    if out and all(r["error"] for r in out):
        raise ValueError("no run succeeded") from last
    if not any((r.get("n_topics") or 0) >= min_topics for r in out):
        warnings.warn(f"no run has {min_topics} topics", stacklevel=2)
    names = [x.split(" ")[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(k) for k in names) for r in out], schema)


def stability_runs(embeddings: DataFrame, seeds: list[int], make_clusterer, reducer=None) -> DataFrame:
    """(run, doc_id, topic) of a refit for each seed; give to adjusted_rand and document_stability. Two must succeed."""
    runs, last = [], None
    for i, seed in enumerate(seeds, 1):
        try:
            reduced = (reducer or PcaReduction(5)).fit_transform(embeddings, seed)
            runs.append(written(make_clusterer().fit_predict(reduced, seed).select(F.lit(i).alias("run"), "doc_id", "topic"), "run"))
        except Exception as error:
            if not _own_failure(error):
                raise
            warnings.warn(f"run {i} failed: {type(error).__name__}: {error}", stacklevel=2)
            last = error
    if len(runs) < 2:
        raise ValueError("fewer than two runs succeeded") from last
    every = runs[0]
    for one in runs[1:]:
        every = every.unionByName(one)
    return every


def fit_topics_over_time(docs: DataFrame, embeddings: DataFrame, time: str, min_similarity: float = 0.7, **options) -> tuple[DataFrame, DataFrame]:
    """(nodes with status, links): a fit for each period, linked from each to the next by centroids."""
    periods = [r[0] for r in docs.select(time).distinct().orderBy(time).collect()]
    if len(periods) < 2:
        raise ValueError("two periods or more are needed")
    rows, last = None, None
    for period in periods:
        own = docs.where(F.col(time) == period)
        vectors = embeddings.join(own.select("doc_id"), "doc_id", "left_semi")
        try:
            fit = fit_topics(own, embeddings=vectors, **options)
            part = fit.rows.withColumn("period", F.lit(period))
        except Exception as error:
            if not _own_failure(error):
                raise
            warnings.warn(f"period {period} left out: {type(error).__name__}: {error}", stacklevel=2)
            last = error
            continue
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("no period could be fitted") from last
    nodes = written(period_centroids(rows, "period"), "nodes")
    links = flow_transitions(nodes, min_similarity)
    return flow_status(nodes, links), links


