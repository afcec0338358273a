"""More queries and their SQL: sources, encoders, classifiers, whole fits on planted clusters, figures."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import accessors as A
from ..operators import classify as CL
from ..operators import ctfidf as CT
from ..operators import dynamics as DY
from ..operators import metrics as M
from ..operators import plotdata as V
from ..operators.cluster import Hdbscan, KMeansClustering
from ..operators.embed import ApiEncoder, embed_chunks, embed_texts
from ..operators.wordpiece import SPECIAL, wordpiece_tokens
from ..operators.reduce import NoReduction
from ..sources import storage, weights
from ..sources.corpus import read_csv_corpus, sample_rows, table
from ..sources.tables import shared_dir
from ..streaming.assign import topic_counts
from . import catalogue as C
from .catalogue import SQL, query, r6
from .fit import PosRepresentation, TopicFit, fit_topics, quality, stability_runs
from .fit import fit_topics_over_time as over_periods


class Measures:
    """A stand-in for a model whose vectors SQL can give as well: characters, spaces and letters e of a text."""

    labels = ["long", "wordy", "plain"]
    problem = "single_label"

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.array([[len(t), t.count(" "), t.count("e")] for t in texts], float).reshape(-1, 3)

    def logits(self, texts: list[str]) -> np.ndarray:
        return self.encode(texts) / 1000


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


_V = "[length(text), length(text) - length(replace(text, ' ', '')), length(text) - length(replace(text, 'e', ''))]::DOUBLE[]"
_EMBEDDED = f"SELECT doc_id, round(u[1], 6) AS a, round(u[2], 6) AS b, round(u[3], 6) AS c FROM (SELECT doc_id, {C._unit('v')} AS u FROM (SELECT doc_id, {_V} AS v FROM documents))"


def _flat(df: DataFrame) -> DataFrame:
    return df.select("doc_id", *(F.round(F.col("embedding")[i], 6).alias(n) for i, n in enumerate("abc")))


# Sources and storage.


@query("SELECT doc_id, length(text) AS chars, lang FROM documents WHERE trim(text) <> ''")
def csv_corpus(spark, sf_dir):
    path = _folder(spark, "csv")
    storage.export_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    return read_csv_corpus(spark, path, "text").select(F.col("doc_id").cast("long"), F.length("text").cast("long").alias("chars"), "lang")


@query(f"WITH {C._TERMS}, {C._INFO} SELECT doc_id, topic, name FROM asg JOIN info USING (topic)")
def export_document_info(spark, sf_dir):
    b, path = C._Base(spark, sf_dir), _folder(spark, "info")
    storage.export_csv(A.document_info(b.assignments, b.terms).select("doc_id", "topic", "name"), path)
    return spark.read.csv(path, header=True, escape='"', schema="doc_id long, topic int, name string")


@query("SELECT vec_id AS doc_id, i::INT - 1 AS dim, round(embedding[i]::DOUBLE, 6) AS value FROM embeddings, range(1, 65) r(i)")
def embeddings_roundtrip(spark, sf_dir):
    path = _folder(spark, "vectors")
    storage.save_embeddings(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding")), path)
    return storage.load_embeddings(spark, path).select("doc_id", F.posexplode("embedding").alias("dim", "value")).select("doc_id", "dim", r6("value"))


@query("SELECT vec_id AS doc_id, i::INT - 1 AS dim, round(embedding[i]::DOUBLE, 6) AS value FROM embeddings, range(1, 65) r(i)")
def embeddings_roundtrip_csv(spark, sf_dir):
    path = _folder(spark, "vectors") + ".csv"
    storage.save_embeddings(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding")), path)
    return storage.load_embeddings(spark, path).select("doc_id", F.posexplode("embedding").alias("dim", "value")).select("doc_id", "dim", r6("value"))


@query("SELECT vec_id AS doc_id, i::INT - 1 AS dim, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) r(i)")
def embeddings_tensor_files(spark, sf_dir):
    path = _folder(spark, "tensors")
    weights.save_vectors(table(spark, sf_dir, "embeddings"), path, "vec_id")
    return weights.load_vectors(spark, path).select("doc_id", F.posexplode("embedding").alias("dim", "value"))


@query("SELECT 'ids' AS name, 'I64' AS dtype, count(*) AS n, 8 * count(*) AS n_bytes FROM embeddings UNION ALL SELECT 'vectors', 'F32', count(*), 4 * sum(len(embedding))::BIGINT FROM embeddings")
def embeddings_tensor_headers(spark, sf_dir):
    path = _folder(spark, "tensors")
    weights.save_vectors(table(spark, sf_dir, "embeddings"), path, "vec_id", file_rows=100)
    return weights.tensors(spark, path).groupBy("name", "dtype").agg(F.sum(F.col("shape")[0]).alias("n"), F.sum(F.col("end") - F.col("start")).alias("n_bytes"))


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(*) FILTER (WHERE inside) AS known FROM (SELECT doc_id, true AS inside FROM documents LIMIT 50)")
def sampled_rows(spark, sf_dir):
    """The sample is checked by its size and by that each row of it is a document."""
    some = sample_rows(_docs(spark, sf_dir), 50).select("doc_id")
    known = some.join(_docs(spark, sf_dir).withColumnRenamed("doc_id", "id").select("id"), F.col("doc_id") == F.col("id"), "left")
    return known.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.count("id").alias("known"))


# Encoders and classifiers.


@query(_EMBEDDED)
def embed_measures(spark, sf_dir):
    return _flat(embed_texts(_docs(spark, sf_dir), Measures()))


@query(_EMBEDDED)
def embed_service(spark, sf_dir):
    """A service that gives its answers in reverse order."""
    call = lambda texts: [(i, list(v)) for i, v in enumerate(Measures().encode(texts))][::-1]
    return _flat(embed_texts(_docs(spark, sf_dir), ApiEncoder(call, 7)))


@query(_EMBEDDED)
def embed_cached(spark, sf_dir):
    path, docs = _folder(spark, "cache"), _docs(spark, sf_dir)
    storage.embed_cached(docs, Measures(), path)
    return _flat(storage.embed_cached(docs, None, path))


@query(rf"""WITH w AS (SELECT doc_id, string_split_regex(text, '\s+') AS w FROM documents), c AS (SELECT doc_id, unnest(range(1, greatest(len(w), 1) + 1, 48)) AS s, w FROM w),
t AS (SELECT doc_id, s, array_to_string(w[s:s + 63], ' ') AS text FROM c), v AS (SELECT doc_id, {_V} AS v FROM t), m AS (SELECT doc_id, [avg(v[1]), avg(v[2]), avg(v[3])] AS v FROM v GROUP BY doc_id)
SELECT doc_id, round(u[1], 6) AS a, round(u[2], 6) AS b, round(u[3], 6) AS c FROM (SELECT doc_id, {C._unit('v')} AS u FROM m)""")
def embed_chunked(spark, sf_dir):
    return _flat(embed_chunks(_docs(spark, sf_dir), Measures(), 64, 16))


@query(rf"WITH v AS (SELECT doc_id, {_V} AS v FROM (SELECT doc_id, array_to_string(string_split_regex(text, '\s+')[1:64], ' ') AS text FROM documents)) SELECT doc_id, round(u[1], 6) AS a, round(u[2], 6) AS b, round(u[3], 6) AS c FROM (SELECT doc_id, {C._unit('v')} AS u FROM v)")
def embed_first_chunk(spark, sf_dir):
    return _flat(embed_chunks(_docs(spark, sf_dir), Measures(), 64, 16, "first"))


# A vocabulary of the benchmark's words, their last three letters and all single characters.
_VOCAB = r"""bw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark), ch AS (SELECT DISTINCT unnest(string_split(lower(text), '')) AS c FROM documents),
vocab AS (SELECT w AS piece FROM bw UNION SELECT '##' || right(w, 3) FROM bw UNION SELECT c FROM ch UNION SELECT '##' || c FROM ch WHERE c ~ '[a-m]')"""


@query(rf"""WITH RECURSIVE {_VOCAB}, d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[!-/:-@\[-`{{-~]|[^!-/:-@\[-`{{-~\s]+') AS ws FROM documents),
u AS (SELECT DISTINCT unnest(ws) AS word FROM d),
best AS (SELECT word, s, max(n) AS n FROM (SELECT word, s, unnest(range(1, len(word) - s + 2)) AS n FROM (SELECT word, unnest(range(1, len(word) + 1)) AS s FROM u)) t JOIN vocab ON piece = CASE WHEN s > 1 THEN '##' ELSE '' END || substr(word, s, n) GROUP BY word, s),
walk AS (SELECT word, 1 AS s, []::VARCHAR[] AS p FROM u UNION ALL SELECT w.word, w.s + n, list_append(p, CASE WHEN w.s > 1 THEN '##' ELSE '' END || substr(w.word, w.s, n)) FROM walk w JOIN best b ON b.word = w.word AND b.s = w.s),
done AS (SELECT word, p FROM walk WHERE s > len(word)), wp AS (SELECT word, CASE WHEN p IS NULL OR len(word) > 100 THEN ['[UNK]'] ELSE p END AS p FROM u LEFT JOIN done USING (word)),
o AS (SELECT doc_id, pos, ws[pos] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM d) q),
t AS (SELECT doc_id, string_agg(array_to_string(p, ' '), ' ' ORDER BY pos) AS t, sum(len(p)) AS n FROM o JOIN wp USING (word) GROUP BY doc_id)
SELECT doc_id, (coalesce(n, 0) + 2)::INT AS n, md5('[CLS] ' || coalesce(t || ' ', '') || '[SEP]') AS digest FROM d LEFT JOIN t USING (doc_id)""")
def wordpiece(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    chars = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split(F.lower("text"), ""))).alias("c"))
    pieces = words.select("w").union(words.select(F.concat(F.lit("##"), F.substring("w", -3, 3)))).union(chars).union(chars.where(F.col("c").rlike("[a-m]")).select(F.concat(F.lit("##"), "c")))
    vocab = pieces.distinct().select(F.col("w").alias("piece")).where("piece <> ''").union(spark.createDataFrame([(t,) for t in SPECIAL], "piece string"))
    tokens = wordpiece_tokens(_docs(spark, sf_dir), vocab.select("piece", F.pmod(F.xxhash64("piece"), F.lit(2**31 - 1)).alias("id")))
    return tokens.select("doc_id", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


_LOGITS = f"l AS (SELECT doc_id, list_transform({_V}, lambda x: x / 1000) AS l FROM documents)"


@query(f"WITH {_LOGITS}, e AS (SELECT doc_id, list_transform(l, lambda v: exp(v - list_max(l))) AS e FROM l), p AS (SELECT doc_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e) SELECT doc_id, ['long', 'wordy', 'plain'][list_position(p, list_max(p))] AS label, round(list_max(p), 6) AS score, round(p[1], 6) AS long, round(p[2], 6) AS wordy, round(p[3], 6) AS plain FROM p")
def classify_texts(spark, sf_dir):
    return CL.classify_texts(_docs(spark, sf_dir), Measures()).select("doc_id", "label", *(r6(x) for x in ("score", *Measures.labels)))


@query(f"WITH {_LOGITS} SELECT doc_id, round(l[1], 6) AS long, round(l[2], 6) AS wordy, round(l[3], 6) AS plain FROM l")
def classify_regression(spark, sf_dir):
    model = Measures()
    model.problem = "regression"
    return CL.classify_texts(_docs(spark, sf_dir), model).select("doc_id", *(r6(x) for x in Measures.labels))


# Fits. Planted clusters are found exactly without a reduction, so that SQL can follow.

_FOUND = "found AS (SELECT doc_id, (dense_rank() OVER (ORDER BY m) - 1)::INT AS topic FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY label) AS m FROM corpus))"
_FITTED = f"WITH {C._DTM}, {_FOUND},{C._scores('sc', 'found')} SELECT topic, rank, term, round(score, 6) AS score FROM ({C._top('sc', 10)})"


def _planted_fit(spark: SparkSession, sf_dir: str, **options) -> TopicFit:
    docs, vectors = C._planted_docs(spark, sf_dir)
    return fit_topics(docs, embeddings=vectors, reducer=NoReduction(), clusterer=KMeansClustering(10), **options)


@query(_FITTED)
def fit_planted(spark, sf_dir):
    return _planted_fit(spark, sf_dir).terms.select("topic", "rank", "term", r6("score"))


@query(_FITTED, name="save_load_roundtrip")
def fit_saved(spark, sf_dir):
    path = _folder(spark, "fit")
    storage.save_fit(_planted_fit(spark, sf_dir), path)
    return storage.load_fit(spark, path).terms.select("topic", "rank", "term", r6("score"))


@query(f"WITH {C._DTM}, {_FOUND}, own AS (SELECT doc_id, (CASE WHEN doc_id % 5 = 0 THEN -1 ELSE topic END)::INT AS topic FROM found),{C._scores('sc', 'own')} SELECT topic, rank, term, round(score, 6) AS score FROM ({C._top('sc', 10)})")
def fit_recomputed(spark, sf_dir):
    """A fit derived anew after documents were moved to noise."""
    fit = _planted_fit(spark, sf_dir)
    moved = fit.assignments.select("doc_id", F.when(F.col("doc_id") % 5 == 0, -1).otherwise(F.col("topic")).cast("int").alias("topic"))
    return fit.with_assignments(moved).terms.select("topic", "rank", "term", r6("score"))


_POS = C._ANN.replace("FROM documents)", "FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))", 1)


@query(f"""WITH {_POS}, {C._PHRASES}, c AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, w AS term FROM a WHERE upos IN ('NOUN', 'PROPN') UNION ALL SELECT doc_id, term FROM ph) GROUP BY ALL),
dtm AS (SELECT doc_id, term, n FROM c WHERE term IN (SELECT term FROM c GROUP BY term HAVING count(*) >= 2 AND count(*) <= floor(0.95 * (SELECT count(*) FROM corpus)))),
found AS (SELECT vec_id AS doc_id, (dense_rank() OVER (ORDER BY m) - 1)::INT AS topic FROM (SELECT vec_id, min(vec_id) OVER (PARTITION BY label) AS m FROM embeddings WHERE vec_id IN (SELECT doc_id FROM corpus))),{C._scores('sc', 'found')}
SELECT topic, rank, term, round(score, 6) AS score FROM ({C._top('sc', 10)})""")
def fit_pos(spark, sf_dir):
    """A fit whose terms are tagged words and phrases."""
    def annotate(docs: DataFrame) -> DataFrame:
        return C.annotated(docs)

    return _planted_fit(spark, sf_dir, representation=PosRepresentation(annotate, patterns=(("ADJ", "NOUN"),))).terms.select("topic", "rank", "term", r6("score"))


@query("SELECT 1 AS run_a, 2 AS run_b, 1.0::DOUBLE AS ari")
def stability(spark, sf_dir):
    """Runs from two seeds find the same planted clusters."""
    _, vectors = C._planted_docs(spark, sf_dir)
    return M.adjusted_rand(stability_runs(vectors, [42, 84], lambda: KMeansClustering(10), NoReduction())).select("run_a", "run_b", r6("ari"))


@query(f"""WITH {C._CORPUS}, h AS (SELECT doc_id, (doc_id % 2)::INT AS period, label FROM corpus), f AS (SELECT period, doc_id, min(doc_id) OVER (PARTITION BY period, label) AS m FROM h)
SELECT period, (dense_rank() OVER (PARTITION BY period ORDER BY m) - 1)::INT AS topic, count(*) AS count FROM f GROUP BY period, m""")
def fit_topics_over_time(spark, sf_dir):
    docs, vectors = C._planted_docs(spark, sf_dir)
    halves = docs.withColumn("half", (F.col("doc_id") % 2).cast("int"))
    return over_periods(halves, vectors, "half", reducer=NoReduction(), clusterer=KMeansClustering(10))[0].select("period", "topic", "count")


@query(C._CANONICAL)
def hdbscan_leaf(spark, sf_dir):
    """Planted clusters are leaves of the tree."""
    return C._canonical(Hdbscan(10, "leaf").fit_predict(C._planted(spark, sf_dir)))


def _scalar(value: str, name: str) -> str:
    return f"(SELECT round({value}, 4) FROM ({SQL[name]})) AS "


@query(f"SELECT {_scalar('avg(silhouette)', 'silhouette')} silhouette, {_scalar('avg(cohesion)', 'cohesion')} cohesion, {_scalar('avg(separation)', 'separation')} separation, {_scalar('avg(jaccard)', 'jaccard_overlap')} jaccard, {_scalar('any_value(100 * n_noise / n_docs)', 'size_distribution')} noise_pct, (SELECT any_value(n_topics) FROM ({SQL['size_distribution']})) AS n_topics")
def quality_of_fit(spark, sf_dir):
    b = C._Base(spark, sf_dir)
    fit = TopicFit(b.docs.select("doc_id", "text"), b.docs.select("doc_id", "embedding"), b.assignments.select("doc_id", "topic"), b.dtm)
    return quality(fit).select(*(F.round(c, 4).alias(c) for c in ("silhouette", "cohesion", "separation", "jaccard", "noise_pct")), "n_topics")


@query(f"SELECT topic, topic || '_' || length(prompt) AS label FROM ({SQL['llm_prompts']}) UNION ALL SELECT topic, label FROM ({SQL['topic_labels']}) WHERE topic = -1")
def llm_labels(spark, sf_dir):
    """Labels by a function of the prompt."""
    b = C._Base(spark, sf_dir)
    prompts = A.label_prompts(b.terms, A.representative_docs(b.docs, b.centroids), b.docs, template="Terms: {terms}\n{docs}")
    return A.label_topics(b.terms, prompts, lambda prompt: str(len(prompt)))


# Figures.


@query(f"WITH {C._TERMS}, {C._LABELS}, p AS (SELECT doc_id, topic, embedding[1] AS x, embedding[2] AS y FROM asg) SELECT doc_id, p.topic, round(x, 6) AS x, round(y, 6) AS y, round(avg(x) OVER (PARTITION BY p.topic), 6) AS label_x, round(avg(y) OVER (PARTITION BY p.topic), 6) AS label_y FROM p")
def v_topic_map(spark, sf_dir):
    b = C._Base(spark, sf_dir)
    layout = b.docs.select("doc_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return V.topic_map(layout, b.assignments, CT.topic_labels(b.terms), b.docs).select("doc_id", "topic", *(r6(c) for c in ("x", "y", "label_x", "label_y")))


@query(f"WITH {C._CORPUS} SELECT (row_number() OVER (ORDER BY year, count(*) DESC, topic) - 1)::INT AS node, year AS period, topic, count(*) AS count, 'Topic ' || topic AS label FROM asg WHERE topic <> -1 GROUP BY year, topic")
def v_flow_nodes(spark, sf_dir):
    return V.flow_nodes(DY.period_centroids(C._Base(spark, sf_dir).docs))


@query(f"""SELECT 'silhouette' AS panel, topic::INT AS topic, NULL::INT AS other, round(avg(silhouette), 4) AS value FROM ({SQL['silhouette']}) GROUP BY topic
UNION ALL SELECT 'size', topic, NULL, n::DOUBLE FROM (WITH {C._CORPUS} SELECT topic, count(*) AS n FROM asg GROUP BY topic)
UNION ALL SELECT 'similarity', topic, other, round(s, 4) FROM (WITH {C._CENT} SELECT a.topic, b.topic AS other, list_dot_product(a.centroid, b.centroid) AS s FROM cent a JOIN cent b ON a.topic < b.topic)
UNION ALL SELECT 'jaccard', topic_a, topic_b, round(jaccard, 4) FROM ({SQL['jaccard_overlap']})""")
def v_quality(spark, sf_dir):
    b = C._Base(spark, sf_dir)
    return V.quality_panels(M.silhouette(b.docs), b.assignments, b.centroids, b.terms).withColumn("value", F.round("value", 4))


@query(f"WITH {C._RES}, best AS (SELECT run FROM res WHERE n_topics >= 2 ORDER BY silhouette DESC NULLS LAST, run LIMIT 1) SELECT run::INT AS run, 'n_topics=' || n_topics AS label, run = (SELECT run FROM best) AS best FROM res")
def v_sweep_rows(spark, sf_dir):
    return V.sweep_rows(C._results(spark, sf_dir), ["n_topics"])


# Streams.


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, (event_id % 5)::INT AS topic, count(*) AS n FROM events GROUP BY ALL")
def stream_topic_counts(spark, sf_dir):
    """A stream of events counted by day and topic; the last rows close all windows."""
    path = _folder(spark, "counts")
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 5).cast("int").alias("topic"))
    last = events.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select("ts", F.lit(-2).alias("topic"))
    events.write.parquet(f"{path}/in")
    last.write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{path}/in")
    counted = topic_counts(stream, "ts", "1 day", "10 days")
    for _ in range(2):  # the second run sees the watermark that the first has left
        run = counted.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start(f"{path}/out")
        run.awaitTermination()
        events.limit(0).write.mode("append").parquet(f"{path}/in")
    found = spark.read.schema(counted.schema).parquet(f"{path}/out").where("topic >= 0")
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "topic", "n")

