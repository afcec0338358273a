"""Queries over the test tables, one for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stopwords import ENGLISH_STOPWORDS, load_stopwords
from ..functions.text import display_label, ngrams, tokens
from ..functions.vectors import l2_normalize, topic_centroids
from ..operators import accessors as A
from ..operators import classify as CL
from ..operators import ctfidf as CT
from ..operators import dtm as D
from ..operators import dynamics as DY
from ..operators import edit as E
from ..operators import hierarchy as H
from ..operators import metrics as M
from ..operators import plotdata as V
from ..sources.corpus import assigned, corpus, paragraphs, planted, table
from ..sources.tables import shared_dir, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def r6(name: str, alias: str | None = None):
    return F.round(name, 6).alias(alias or name)


_STOP = "[" + ", ".join(f"'{w}'" for w in ENGLISH_STOPWORDS) + "]"


def _tokens(text: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower({text}), '[^a-z0-9 ]+', ' ', 'g'), '\s+'), lambda w: length(w) >= 2 AND NOT list_contains({_STOP}, w))"


def _positions(source: str) -> str:
    """A CTE tp (doc_id, pos, term) of the tokens of ``source``."""
    return f"tp AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS term FROM (SELECT doc_id, {_tokens('text')} AS t FROM {source}))"


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / (CASE WHEN list_dot_product({v}, {v}) = 0 THEN 1 ELSE sqrt(list_dot_product({v}, {v})) END))"


_CORPUS = """
corpus AS (SELECT d.doc_id, d.text, d.lang, d.source, e.embedding::DOUBLE[] AS embedding, e.label FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id),
asg AS (SELECT doc_id, (CASE WHEN doc_id % 7 = 3 THEN -1 ELSE label END)::INT AS topic, (2015 + doc_id % 10)::INT AS year, lang AS grp, source, text, embedding FROM corpus)"""
_COUNTS = f"""
tok AS (SELECT doc_id, unnest({_tokens('text')}) AS term FROM corpus),
dtm_all AS (SELECT doc_id, term, count(*) AS n FROM tok GROUP BY ALL),
vocab AS (SELECT term, count(*) AS df FROM dtm_all GROUP BY term HAVING count(*) >= 2 AND count(*) <= floor(0.95 * (SELECT count(*) FROM corpus))),
dtm AS (SELECT * FROM dtm_all WHERE term IN (SELECT term FROM vocab))"""
_DTM = f"{_CORPUS},{_COUNTS}"
#: What needs neither vectors nor labels reads all documents.
_ALL = f"corpus AS (SELECT doc_id, text FROM documents),{_COUNTS}"


def _scores(name: str, source: str, keys: str = "", sqrt: bool = False) -> str:
    """CTEs that end in ``name`` (keys, topic, term, n, score) over the assignments ``source``."""
    k = f"{keys}, " if keys else ""
    using = f"({k}topic)"
    share = "sqrt(n / total)" if sqrt else "n / total"
    over = f"PARTITION BY {keys}" if keys else ""
    df = f"({k}term)"
    return f"""
{name}_cells AS (SELECT {k}topic, term, sum(dtm.n)::BIGINT AS n FROM dtm JOIN {source} USING (doc_id) GROUP BY ALL),
{name}_sums AS (SELECT {k}topic, sum(n) AS total FROM {name}_cells GROUP BY ALL),
{name}_classes AS (SELECT {k}topic, total, avg(total) OVER ({over}) AS mean FROM (SELECT {k}topic, greatest(coalesce(total, 0), 1)::DOUBLE AS total FROM (SELECT DISTINCT {k}topic FROM {source}) LEFT JOIN {name}_sums USING {using})),
{name}_df AS (SELECT {k}term, count(*) AS c FROM {name}_cells GROUP BY ALL),
{name} AS (SELECT {k}topic, term, n, {share} * ln(1 + mean / greatest(c, 1)) AS score FROM {name}_cells JOIN {name}_classes USING {using} JOIN {name}_df USING {df})"""


def _top(scores: str, n: int) -> str:
    return f"SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term)::INT AS rank, term, score FROM {scores} QUALIFY rank <= {n}"


_TERMS = f"""{_DTM},{_scores('sc', 'asg')},
terms AS ({_top('sc', 10)})"""
_LISTS = "lists AS (SELECT topic, list(term ORDER BY rank) AS terms FROM terms GROUP BY topic)"
_LABELS = f"""{_LISTS},
labels_ AS (SELECT topic, CASE WHEN topic = -1 THEN '-1_outliers' ELSE topic || '_' || array_to_string(terms[1:4], '_') END AS label FROM lists)"""
_INFO = f"""{_LABELS},
info AS (SELECT topic, count(*) AS count, any_value(label) AS name, CASE WHEN topic = -1 THEN '' ELSE array_to_string(any_value(terms)[1:5], ', ') END AS representation FROM asg JOIN labels_ USING (topic) JOIN lists USING (topic) GROUP BY topic)"""


def _cents(name: str, source: str, keys: str = "topic") -> str:
    """CTEs that end in ``name`` (keys, centroid) from ``source`` (keys, v)."""
    return f"""
{name}_cells AS (SELECT {keys}, pos, avg(v[pos]) AS x FROM {source}, range(1, 65) r(pos) GROUP BY ALL),
{name}_mean AS (SELECT {keys}, list(x ORDER BY pos) AS m FROM {name}_cells GROUP BY ALL),
{name} AS (SELECT {keys}, {_unit('m')} AS centroid FROM {name}_mean)"""


_UNIT = f"{_CORPUS},\nunit AS (SELECT doc_id, topic, year, embedding, {_unit('embedding')} AS v FROM asg),\nmembers AS (SELECT * FROM unit WHERE topic <> -1)"
_CENT = f"{_UNIT},{_cents('cent', 'members')}"


class _Base:
    """What many queries begin with."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.docs = assigned(corpus(spark, sf_dir))

    @cached_property
    def assignments(self) -> DataFrame:
        return written(self.docs.select("doc_id", "topic", "year", "grp"), "assignments")

    @cached_property
    def dtm(self) -> DataFrame:
        return D.build_dtm(self.docs, stopwords=ENGLISH_STOPWORDS)

    @cached_property
    def terms(self) -> DataFrame:
        return written(CT.c_tf_idf(self.dtm, self.assignments), "terms")

    @property
    def centroids(self) -> DataFrame:
        return topic_centroids(self.docs)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


# Tokens and counts.


@query(f"WITH {_positions('documents')} SELECT doc_id, (pos - 1)::INT AS pos, term AS token FROM tp")
def tokens_all(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tokens("text", ENGLISH_STOPWORDS)).alias("pos", "token"))


@query(f"""WITH {_positions('documents')}, g AS (SELECT term FROM tp UNION ALL SELECT term || ' ' || t2 FROM (SELECT term, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS t2 FROM tp) WHERE t2 IS NOT NULL)
SELECT term, count(*) AS n FROM g GROUP BY term HAVING count(*) >= 2""")
def ngrams_1_2(spark, sf_dir):
    toks = table(spark, sf_dir, "documents").select(tokens("text", ENGLISH_STOPWORDS).alias("toks"))
    grams = toks.select(F.explode(ngrams(F.col("toks"), 1, 2)).alias("term"))
    return grams.groupBy("term").agg(F.count("*").alias("n")).where("n >= 2")


@query(f"WITH {_ALL} SELECT * FROM dtm_all")
def dtm(spark, sf_dir):
    return D.counts(_texts(spark, sf_dir), ENGLISH_STOPWORDS)


@query(f"WITH {_ALL} SELECT doc_id, term, n FROM dtm")
def dtm_df_filter(spark, sf_dir):
    return D.build_dtm(_texts(spark, sf_dir), stopwords=ENGLISH_STOPWORDS)


@query(f"WITH {_ALL} SELECT term, df FROM vocab")
def vocabulary(spark, sf_dir):
    docs = _texts(spark, sf_dir)
    return D.vocabulary(D.counts(docs, ENGLISH_STOPWORDS), docs)


@query("SELECT doc_id, n_lines, n_blank FROM (SELECT doc_id, len(string_split(text, chr(10)))::INT AS n_lines, len(list_filter(string_split(text, chr(10)), lambda l: trim(l) = ''))::INT AS n_blank FROM documents WHERE trim(text) <> '')")
def corpus_scan(spark, sf_dir):
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").where(F.trim("text") != "").select("doc_id", F.size(lines).alias("n_lines"), F.size(F.filter(lines, lambda x: F.trim(x) == "")).alias("n_blank"))


# A paragraph in these texts is a line, so single newlines are doubled first.
@query(r"""WITH p AS (SELECT doc_id, trim(regexp_replace(unnest(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n')), '\s+', ' ', 'g')) AS text FROM documents)
SELECT doc_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM p WHERE length(text) >= 40 AND len(string_split(text, ' ')) BETWEEN 5 AND 400 GROUP BY doc_id""")
def paragraph_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return paragraphs(docs, 40, 5, 400).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


_WORDS = r"lower(regexp_replace(w, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'))"


@query(rf"""WITH v AS (SELECT 'frame' AS origin, unnest(string_split(text, ' ')) AS w FROM documents UNION ALL SELECT 'lines', '  ' || o_orderpriority || ' ' FROM orders UNION ALL SELECT 'tsv', c_mktsegment FROM customer)
SELECT DISTINCT origin, {_WORDS} AS word FROM v WHERE {_WORDS} <> ''""")
def stopword_load(spark, sf_dir):
    """Words of a DataFrame's column, of a text file's lines and of a column of a .tsv file."""
    import uuid

    path = f"{shared_dir(spark)}/words-{uuid.uuid4().hex}"
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    table(spark, sf_dir, "orders").select(F.concat(F.lit("  "), "o_orderpriority", F.lit(" "))).write.text(f"{path}/words.txt")
    table(spark, sf_dir, "customer").select("c_name", "c_mktsegment").write.csv(f"{path}/words.tsv", sep="\t", header=True)
    of = lambda origin, source, column=None: load_stopwords(spark, source, column).select(F.lit(origin).alias("origin"), "word")
    return of("frame", words, "w").union(of("lines", f"{path}/words.txt")).union(of("tsv", f"{path}/words.tsv", "c_mktsegment"))


def _cvalue_sql(max_n: int) -> str:
    runs = {n: " || '_' || ".join(["term", *(f"lead(term, {i}) OVER w" for i in range(1, n))]) for n in range(2, max_n + 1)}
    grams = " UNION ALL ".join(f"SELECT * FROM (SELECT {r} AS term, {n} AS n_words FROM tp WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE term IS NOT NULL" for n, r in runs.items())
    inner = " UNION ALL ".join(f"SELECT array_to_string(w[i:i+{n - 1}], '_') AS term, freq AS outer_freq FROM (SELECT w, freq, unnest(range(1, len(w) - {n - 2})) AS i FROM f WHERE n_words > {n})" for n in range(2, max_n))
    return f"""{_ALL}, {_positions('corpus')}, g AS ({grams}),
f AS (SELECT term, n_words, count(*) AS freq, string_split(term, '_') AS w FROM g GROUP BY term, n_words HAVING count(*) >= 2),
i AS ({inner}), o AS (SELECT term, avg(outer_freq) AS m FROM i GROUP BY term),
cv AS (SELECT f.term, n_words::INT AS n_words, freq, log2(n_words) * (freq - coalesce(m, 0.0)) AS cvalue FROM f LEFT JOIN o USING (term))"""


@query(f"WITH {_cvalue_sql(4)} SELECT term, n_words, freq, round(cvalue, 6) AS cvalue FROM cv WHERE cvalue >= 0")
def cvalue_terms(spark, sf_dir):
    return D.cvalue_terms(_texts(spark, sf_dir), stopwords=ENGLISH_STOPWORDS).select("term", "n_words", "freq", r6("cvalue"))


@query(f"""WITH {_cvalue_sql(2)}, two AS (SELECT * FROM (SELECT doc_id, term || ' ' || lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS term FROM tp) WHERE term IS NOT NULL),
c2 AS (SELECT doc_id, term, count(*) AS n FROM two GROUP BY ALL), v2 AS (SELECT term FROM c2 GROUP BY term HAVING count(*) >= 2 AND count(*) <= floor(0.95 * (SELECT count(*) FROM corpus)))
SELECT doc_id, term, n FROM dtm UNION ALL SELECT doc_id, term, n FROM c2 WHERE term IN (SELECT term FROM v2) AND term IN (SELECT replace(term, '_', ' ') FROM cv WHERE cvalue >= 0)""".replace("i AS (), o AS (SELECT term, avg(outer_freq) AS m FROM i GROUP BY term),", "o AS (SELECT term, 0.0 AS m FROM f WHERE false),"))
def cvalue_dtm(spark, sf_dir):
    return D.cvalue_dtm(_texts(spark, sf_dir), max_n=2, stopwords=ENGLISH_STOPWORDS)


_TAG = "CASE WHEN w LIKE '%ing' THEN 'VERB' WHEN w LIKE '%ly' THEN 'ADV' WHEN w LIKE '%e' THEN 'ADJ' ELSE 'NOUN' END"
_ANN = f"corpus AS (SELECT doc_id, text FROM documents), {_positions('corpus')}, a AS (SELECT doc_id, pos, term AS w, {_TAG.replace('w LIKE', 'term LIKE')} AS upos FROM tp)"


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagger rows with tags by suffix, in place of a tagger."""
    return annotated(_texts(spark, sf_dir))


def annotated(docs: DataFrame) -> DataFrame:
    w = F.col("token")
    rows = docs.select("doc_id", F.lit(1).alias("sentence_id"), F.posexplode(tokens("text", ENGLISH_STOPWORDS)).alias("p", "token"))
    tag = F.when(w.endswith("ing"), "VERB").when(w.endswith("ly"), "ADV").when(w.endswith("e"), "ADJ").otherwise("NOUN")
    return rows.select("doc_id", "sentence_id", (F.col("p") + 1).cast("string").alias("token_id"), "token", w.alias("lemma"), tag.alias("upos"))


_PHRASES = "ph AS (SELECT doc_id, w || '_' || w2 AS term FROM (SELECT doc_id, w, upos, lead(w) OVER s AS w2, lead(upos) OVER s AS u2 FROM a WINDOW s AS (PARTITION BY doc_id ORDER BY pos)) WHERE upos = 'ADJ' AND u2 = 'NOUN')"


@query(f"WITH {_ANN}, {_PHRASES} SELECT term, count(*) AS n FROM ph GROUP BY term")
def pos_phrases(spark, sf_dir):
    return D.pos_phrases(D.clean_annotations(annotations(spark, sf_dir)), ["ADJ", "NOUN"]).groupBy("term").agg(F.count("*").alias("n"))


@query(f"""WITH {_ANN}, {_PHRASES}, c AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, w AS term FROM a WHERE upos IN ('NOUN', 'PROPN') UNION ALL SELECT doc_id, term FROM ph) GROUP BY ALL)
SELECT doc_id, term, n FROM c WHERE term IN (SELECT term FROM c GROUP BY term HAVING count(*) >= 2 AND count(*) <= floor(0.95 * (SELECT count(*) FROM corpus)))""")
def pos_dtm(spark, sf_dir):
    return D.pos_dtm(annotations(spark, sf_dir), _texts(spark, sf_dir), patterns=[["ADJ", "NOUN"]])


# Terms, labels, accessors.


@query(f"WITH {_DTM}, lab AS (SELECT doc_id, label AS topic FROM corpus),{_scores('sc', 'lab')} SELECT topic, rank, term, round(score, 6) AS score FROM ({_top('sc', 10)})")
def ctfidf_top_terms(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return CT.c_tf_idf(D.build_dtm(docs, stopwords=ENGLISH_STOPWORDS), docs.select("doc_id", F.col("label").alias("topic"))).select("topic", "rank", "term", r6("score"))


@query(f"WITH {_DTM},{_scores('sc', 'asg', sqrt=True)} SELECT topic, rank, term, round(score, 6) AS score FROM ({_top('sc', 10)})")
def ctfidf_sqrt(spark, sf_dir):
    b = _Base(spark, sf_dir)
    return CT.c_tf_idf(b.dtm, b.assignments, reduce_frequent_words=True).select("topic", "rank", "term", r6("score"))


@query(f"WITH {_TERMS} SELECT topic, rank, term, round(score, 6) AS score FROM terms")
def ctfidf_with_noise(spark, sf_dir):
    return _Base(spark, sf_dir).terms.select("topic", "rank", "term", r6("score"))


@query(f"WITH {_DTM},{_scores('sc', 'asg')} SELECT topic, term, round(score / sum(abs(score)) OVER (PARTITION BY topic), 9) AS score FROM sc")
def ctfidf_l1(spark, sf_dir):
    b = _Base(spark, sf_dir)
    return CT.l1_normalized(CT.class_scores(b.dtm, b.assignments)).select("topic", "term", F.round("score", 9).alias("score"))


@query(f"WITH {_TERMS}, {_LABELS} SELECT topic, label FROM labels_")
def topic_labels(spark, sf_dir):
    return CT.topic_labels(_Base(spark, sf_dir).terms)


@query(f"WITH {_TERMS}, {_LABELS}, p AS (SELECT topic, trim(replace(regexp_replace(label, '^-?[0-9]+_', ''), '_', ' ')) AS l FROM labels_) SELECT topic, CASE WHEN length(l) > 20 THEN substring(l, 1, 19) || '...' ELSE l END AS label FROM p")
def display_labels(spark, sf_dir):
    return CT.topic_labels(_Base(spark, sf_dir).terms).select("topic", display_label("label", 20).alias("label"))


@query(f"WITH {_CORPUS} SELECT topic, count(*) AS size FROM asg WHERE topic <> -1 GROUP BY topic")
def topic_sizes(spark, sf_dir):
    return CT.topic_sizes(_Base(spark, sf_dir).assignments)


@query(f"WITH {_TERMS} SELECT topic, rank, term, round(score, 6) AS score FROM terms WHERE rank <= 5")
def get_topics(spark, sf_dir):
    return A.get_topics(_Base(spark, sf_dir).terms, 5).select("topic", "rank", "term", r6("score"))


@query(f"WITH {_TERMS} SELECT rank, term, round(score, 6) AS score FROM terms WHERE topic = 4")
def get_topic(spark, sf_dir):
    return A.get_topic(_Base(spark, sf_dir).terms, 4).select("rank", "term", r6("score"))


@query(f"WITH {_TERMS}, {_INFO} SELECT * FROM info")
def topic_info(spark, sf_dir):
    b = _Base(spark, sf_dir)
    return A.topic_info(b.assignments, b.terms)


@query(f"WITH {_TERMS}, {_INFO} SELECT doc_id, topic, name, representation AS top_words, asg.source FROM asg JOIN info USING (topic)")
def document_info(spark, sf_dir):
    b = _Base(spark, sf_dir)
    return A.document_info(b.assignments, b.terms, b.docs.select("doc_id", "source"))


@query(f"WITH {_TERMS}, {_INFO} SELECT topic, 'Topic ' || topic || ' (' || count || ' docs): ' || representation AS line FROM info")
def topic_lines(spark, sf_dir):
    b = _Base(spark, sf_dir)
    return A.topic_lines(A.topic_info(b.assignments, b.terms))


def _find(word: str) -> str:
    return f"""WITH {_TERMS}, h AS (SELECT topic, sum(CASE WHEN term = {word} THEN score ELSE 0 END) AS e, (count(*) FILTER (WHERE contains(term, {word})))::DOUBLE AS p FROM terms GROUP BY topic)
SELECT topic, round(CASE WHEN (SELECT max(e) FROM h) > 0 THEN e ELSE p END, 6) AS similarity FROM h ORDER BY 2 DESC, 1 LIMIT 5"""


@query(_find("(SELECT min(term) FROM terms WHERE rank = 1)"))
def find_topics_exact(spark, sf_dir):
    terms = _Base(spark, sf_dir).terms
    word = terms.where("rank = 1").agg(F.min("term")).first()[0]
    return A.find_topics(terms, word).select("topic", r6("similarity"))


@query(_find("'en'"))
def find_topics_substring(spark, sf_dir):
    return A.find_topics(_Base(spark, sf_dir).terms, "en").select("topic", r6("similarity"))


@query(f"""WITH {_TERMS}, unit AS (SELECT doc_id, topic, {_unit('embedding')} AS v FROM asg), members AS (SELECT * FROM unit WHERE topic <> -1),{_cents('cent', 'members')},
reps AS (SELECT topic, doc_id, row_number() OVER (PARTITION BY topic ORDER BY round(list_dot_product(v, centroid), 9) DESC, doc_id) AS rank FROM members JOIN cent USING (topic) QUALIFY rank <= 3),
q AS (SELECT topic, string_agg('  ' || rank || '. "' || text || '"', chr(10) ORDER BY rank) AS docs FROM reps JOIN corpus USING (doc_id) GROUP BY topic),
w AS (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS words FROM terms WHERE topic <> -1 GROUP BY topic)
SELECT topic, 'Terms: ' || words || chr(10) || docs AS prompt FROM w JOIN q USING (topic)""")
def llm_prompts(spark, sf_dir):
    b = _Base(spark, sf_dir)
    return A.label_prompts(b.terms, A.representative_docs(b.docs, b.centroids), b.docs, template="Terms: {terms}\n{docs}")


# Vectors and prediction.


@query(f"SELECT vec_id, i::INT - 1 AS dim, round(u[i], 6) AS value FROM (SELECT vec_id, {_unit('v')} AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)), range(1, 65) r(i)")
def l2_normalized(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(l2_normalize(F.col("embedding").cast("array<double>"))).alias("dim", "value")).select("vec_id", "dim", r6("value"))


@query(f"WITH {_CENT} SELECT topic, i::INT - 1 AS dim, round(centroid[i], 6) AS value FROM cent, range(1, 65) r(i)")
def centroids(spark, sf_dir):
    return _Base(spark, sf_dir).centroids.select("topic", F.posexplode("centroid").alias("dim", "value")).select("topic", "dim", r6("value"))


@query(f"WITH {_CENT} SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY round(list_dot_product(v, centroid), 9) DESC, doc_id)::INT AS rank, doc_id, round(list_dot_product(v, centroid), 6) AS similarity FROM members JOIN cent USING (topic) QUALIFY rank <= 3")
def representative_docs(spark, sf_dir):
    b = _Base(spark, sf_dir)
    return A.representative_docs(b.docs, b.centroids).select("topic", "rank", "doc_id", r6("similarity"))


_SIMS = "sims AS (SELECT unit.doc_id, unit.topic AS old, cent.topic, round(list_dot_product(v, centroid), 9) AS sim FROM unit, cent),\nbest AS (SELECT doc_id, old, topic, sim FROM sims QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, topic) = 1)"


@query(f"WITH {_CENT}, {_SIMS} SELECT doc_id, topic, round(sim, 6) AS probability FROM best")
def transform_nearest(spark, sf_dir):
    b = _Base(spark, sf_dir)
    return A.predict(b.docs, b.centroids).select("doc_id", "topic", r6("probability"))


@query(f"WITH {_CENT}, {_SIMS} SELECT doc_id, topic, round(sim, 6) AS similarity FROM sims")
def transform_similarities(spark, sf_dir):
    b = _Base(spark, sf_dir)
    return A.predict_all(b.docs, b.centroids).select("doc_id", "topic", r6("similarity"))


_ZERO = f"""{_UNIT}, cent AS (SELECT vec_id::INT AS topic, {_unit('v')} AS centroid FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 5)), {_SIMS},
zs AS (SELECT doc_id, CASE WHEN sim >= 0.1 THEN topic ELSE -1 END::INT AS topic FROM best)"""


def _zero_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fit import zero_shot_assign

    labels = table(spark, sf_dir, "embeddings").where("vec_id < 5").select(F.col("vec_id").cast("int").alias("topic"), F.col("embedding").alias("centroid"))
    return zero_shot_assign(corpus(spark, sf_dir), labels, 0.1)


@query(f"WITH {_ZERO} SELECT * FROM zs")
def zero_shot_assign(spark, sf_dir):
    return _zero_shot(spark, sf_dir)


@query(f"WITH {_DTM}, {_ZERO.replace(_CORPUS + ',', '')},{_scores('sc', 'zs')} SELECT topic, rank, term, round(score, 6) AS score FROM ({_top('sc', 10)})")
def zero_shot_terms(spark, sf_dir):
    return CT.c_tf_idf(D.build_dtm(corpus(spark, sf_dir), stopwords=ENGLISH_STOPWORDS), _zero_shot(spark, sf_dir)).select("topic", "rank", "term", r6("score"))


# Edits.


@query(f"WITH {_CENT}, {_SIMS} SELECT doc_id, (CASE WHEN old <> -1 THEN old WHEN sim >= 0.05 THEN topic ELSE -1 END)::INT AS topic FROM best")
def reduce_outliers_emb(spark, sf_dir):
    return E.reduce_outliers(_Base(spark, sf_dir).docs, 0.05)


@query(f"""WITH {_DTM}, own AS (SELECT * FROM asg WHERE topic <> -1),{_scores('sc', 'own')},
noise AS (SELECT doc_id FROM asg WHERE topic = -1), w AS (SELECT dtm.* FROM dtm JOIN noise USING (doc_id)),
lb AS (SELECT topic, sqrt(sum(score * score)) AS b FROM sc GROUP BY topic), la AS (SELECT doc_id, sqrt(sum(n * n)) AS a FROM w GROUP BY doc_id),
d AS (SELECT doc_id, topic, sum(w.n * score) AS dot FROM w JOIN sc USING (term) GROUP BY ALL),
s AS (SELECT noise.doc_id, lb.topic, CASE WHEN coalesce(a, 0) * b = 0 THEN 0 ELSE coalesce(dot, 0) / (a * b) END AS sim FROM noise CROSS JOIN lb LEFT JOIN la USING (doc_id) LEFT JOIN d ON d.doc_id = noise.doc_id AND d.topic = lb.topic)
SELECT doc_id, topic FROM own UNION ALL SELECT doc_id, (CASE WHEN round(sim, 9) >= 0 THEN topic ELSE -1 END)::INT AS topic FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(sim, 9) DESC, topic) = 1""")
def reduce_outliers_ctfidf(spark, sf_dir):
    b = _Base(spark, sf_dir)
    return E.reduce_outliers_ctfidf(b.dtm, b.assignments)


@query(f"WITH {_CORPUS} SELECT doc_id, (CASE WHEN topic IN (2, 5, 7) THEN 2 ELSE topic END)::INT AS topic FROM asg")
def merge_topics(spark, sf_dir):
    return E.merge_topics(_Base(spark, sf_dir).assignments.select("doc_id", "topic"), [5, 2, 7])


@query(f"WITH {_CORPUS}, m AS (SELECT doc_id, CASE WHEN topic IN (2, 5, 7) THEN 2 ELSE topic END AS topic FROM asg), ids AS (SELECT topic, (row_number() OVER (ORDER BY topic) - 1)::INT AS new FROM (SELECT DISTINCT topic FROM m WHERE topic <> -1)) SELECT doc_id, coalesce(new, m.topic)::INT AS topic FROM m LEFT JOIN ids USING (topic)")
def renumber_topics(spark, sf_dir):
    return E.renumber_topics(E.merge_topics(_Base(spark, sf_dir).assignments.select("doc_id", "topic"), [5, 2, 7]))


# Metrics.


@query(f"WITH {_CENT} SELECT topic, round(avg(list_dot_product(embedding, centroid)), 6) AS cohesion FROM members JOIN cent USING (topic) GROUP BY topic")
def cohesion(spark, sf_dir):
    b = _Base(spark, sf_dir)
    return M.cohesion(b.docs, b.centroids).select("topic", r6("cohesion"))


@query(f"WITH {_CENT} SELECT round(avg(list_dot_product(a.centroid, b.centroid)), 6) AS separation FROM cent a JOIN cent b ON a.topic < b.topic")
def separation(spark, sf_dir):
    return M.separation(_Base(spark, sf_dir).centroids).select(r6("separation"))


@query(f"WITH {_TERMS}, {_LISTS} SELECT a.topic AS topic_a, b.topic AS topic_b, round(len(list_intersect(a.terms, b.terms)) / len(list_distinct(a.terms || b.terms)), 6) AS jaccard FROM lists a JOIN lists b ON a.topic < b.topic WHERE a.topic <> -1")
def jaccard_overlap(spark, sf_dir):
    return M.jaccard_overlap(_Base(spark, sf_dir).terms).select("topic_a", "topic_b", r6("jaccard"))


@query(f"""WITH {_CORPUS}, s AS (SELECT topic, count(*) AS size FROM asg WHERE topic <> -1 GROUP BY topic), p AS (SELECT size, size / sum(size) OVER () AS p FROM s),
d AS (SELECT count(*) AS n_topics, -sum(p * ln(p + 2.220446049250313e-16)) AS h, stddev_samp(size) / avg(size) AS cv FROM p)
SELECT n_docs, n_noise, round(n_noise / n_docs, 6) AS noise_ratio, n_topics, round(CASE WHEN n_topics = 1 THEN 1 ELSE h / ln(n_topics) END, 6) AS entropy, round(cv, 6) AS cv FROM d, (SELECT count(*) AS n_docs, count(*) FILTER (WHERE topic = -1) AS n_noise FROM asg)""")
def size_distribution(spark, sf_dir):
    return M.distribution(_Base(spark, sf_dir).assignments).select("n_docs", "n_noise", r6("noise_ratio"), "n_topics", r6("entropy"), r6("cv"))


@query(f"""WITH {_UNIT}, size AS (SELECT topic, count(*)::DOUBLE AS n FROM members GROUP BY topic), d AS (SELECT a.doc_id, a.topic, b.topic AS other, sum(1 - list_dot_product(a.embedding, b.embedding)) AS s FROM members a, members b GROUP BY ALL),
x AS (SELECT doc_id, d.topic, max(CASE WHEN other = d.topic THEN CASE WHEN n > 1 THEN s / (n - 1) ELSE 0 END END) AS a, min(CASE WHEN other <> d.topic THEN s / n END) AS b FROM d JOIN size ON size.topic = d.other GROUP BY ALL)
SELECT doc_id, topic, round(CASE WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM x""")
def silhouette(spark, sf_dir):
    return M.silhouette(_Base(spark, sf_dir).docs).select("doc_id", "topic", r6("silhouette"))


def _coherence(value: str) -> str:
    return f"""WITH {_TERMS}, b AS (SELECT * FROM terms WHERE topic <> -1), df AS (SELECT term, count(*) AS d FROM dtm GROUP BY term),
p AS (SELECT x.topic, x.term AS t1, y.term AS t2 FROM b x JOIN b y ON x.topic = y.topic AND x.rank < y.rank),
m AS (SELECT t1, t2, count(*) AS d12 FROM (SELECT DISTINCT t1, t2 FROM p) JOIN dtm u ON u.term = t1 JOIN dtm v ON v.term = t2 AND v.doc_id = u.doc_id GROUP BY ALL),
f AS (SELECT p.topic, coalesce(d12, 0)::DOUBLE AS d12, x.d::DOUBLE AS d1, y.d::DOUBLE AS d2, (SELECT count(*) FROM corpus)::DOUBLE AS n FROM p LEFT JOIN m USING (t1, t2) JOIN df x ON x.term = t1 JOIN df y ON y.term = t2)
SELECT topic, round(avg({value}), 6) AS coherence FROM f GROUP BY topic"""


@query(_coherence("CASE WHEN d12 = 0 THEN -1 WHEN d12 = n THEN 1 ELSE ln((d12 / n) / ((d1 / n) * (d2 / n))) / -ln(d12 / n) END"))
def coherence_npmi(spark, sf_dir):
    b = _Base(spark, sf_dir)
    return M.coherence(b.dtm, b.terms, b.docs.count()).select("topic", r6("coherence"))


@query(_coherence("ln((d12 + 1) / (d1 + 1))"))
def coherence_cv(spark, sf_dir):
    b = _Base(spark, sf_dir)
    return M.coherence(b.dtm, b.terms, b.docs.count(), "cv").select("topic", r6("coherence"))


_RUNS = f"{_CORPUS}, runs AS (SELECT r AS run, doc_id, (CASE WHEN r = 2 THEN (label + doc_id % 2) % 10 ELSE label END)::INT AS topic FROM corpus, (VALUES (1), (2), (3)) v(r))"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).select("doc_id", "label").withColumn("run", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return rows.select("run", "doc_id", F.when(F.col("run") == 2, (F.col("label") + F.col("doc_id") % 2) % 10).otherwise(F.col("label")).cast("int").alias("topic"))


_ARI = f"""{_RUNS}, c AS (SELECT a.run AS run_a, b.run AS run_b, a.topic AS x, b.topic AS y, count(*) AS n FROM runs a JOIN runs b USING (doc_id) WHERE a.run < b.run GROUP BY ALL),
i AS (SELECT run_a, run_b, sum(n * (n - 1) / 2) AS i, sum(n) AS t FROM c GROUP BY ALL), r AS (SELECT run_a, run_b, sum(n * (n - 1) / 2) AS r FROM (SELECT run_a, run_b, x, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL),
k AS (SELECT run_a, run_b, sum(n * (n - 1) / 2) AS k FROM (SELECT run_a, run_b, y, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL),
ari AS (SELECT run_a, run_b, CASE WHEN (r + k) / 2 - r * k / (t * (t - 1) / 2) = 0 THEN 1 ELSE (i - r * k / (t * (t - 1) / 2)) / ((r + k) / 2 - r * k / (t * (t - 1) / 2)) END AS ari FROM i JOIN r USING (run_a, run_b) JOIN k USING (run_a, run_b))"""


@query(f"WITH {_ARI} SELECT run_a, run_b, round(ari, 6) AS ari FROM ari")
def ari(spark, sf_dir):
    return M.adjusted_rand(_runs(spark, sf_dir)).select("run_a", "run_b", r6("ari"))


@query(f"WITH {_ARI} SELECT run_a, run_b, round(ari, 6) AS ari FROM (SELECT run_a, run_b, ari FROM ari UNION ALL SELECT run_b, run_a, ari FROM ari UNION ALL SELECT r, r, NULL FROM (VALUES (1), (2), (3)) v(r))")
def v_stability(spark, sf_dir):
    return V.stability_matrix(M.adjusted_rand(_runs(spark, sf_dir))).select("run_a", "run_b", r6("ari"))


@query(f"WITH {_RUNS} SELECT doc_id, round(max(n) / 3, 6) AS stability FROM (SELECT doc_id, topic, count(*) AS n FROM runs GROUP BY ALL) GROUP BY doc_id")
def doc_stability(spark, sf_dir):
    return M.document_stability(_runs(spark, sf_dir)).select("doc_id", r6("stability"))


@query("""WITH p AS (SELECT list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) AS c, list_max(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))) AS d FROM (SELECT embedding::DOUBLE[] AS x, list_transform(embedding::DOUBLE[], lambda v: round(v, 4)) AS y FROM embeddings))
SELECT count(*) AS n, round(avg(c), 6) AS mean_cosine, round(min(c), 6) AS min_cosine, round(quantile_cont(c, 0.01), 6) AS p01_cosine, round(max(d), 6) AS max_abs_diff, min(c) >= 0.9999 AS passed FROM p""")
def embedding_parity(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    b = a.withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 4)))
    return M.embedding_parity(a, b).select("n", r6("mean_cosine"), r6("min_cosine"), r6("p01_cosine"), r6("max_abs_diff"), "passed")


# Runs of a sweep are made of customers: a run for each nation, its measures shares of these, some missing.
_RES = """res AS (SELECT (c_nationkey + 1)::INT AS run, count(DISTINCT c_custkey % 6) FILTER (c_acctbal < 0) AS n_topics, CASE WHEN c_nationkey % 7 <> 3 THEN count(*) FILTER (c_acctbal < 5000) / count(*) END AS silhouette,
CASE WHEN c_nationkey % 5 <> 4 THEN count(*) FILTER (c_mktsegment = 'BUILDING') / count(*) END AS separation, 100.0::DOUBLE * count(*) FILTER (c_acctbal < 0) / count(*) AS noise_pct FROM customer GROUP BY c_nationkey)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, share = F.col("c_nationkey"), lambda c: F.count_if(c) / F.count("*")
    runs = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.count_distinct(F.when(F.col("c_acctbal") < 0, F.col("c_custkey") % 6)).cast("int").alias("n_topics"),
        share(F.col("c_acctbal") < 5000).alias("silhouette"), share(F.col("c_mktsegment") == "BUILDING").alias("separation"), (F.lit(100.0) * F.count_if(F.col("c_acctbal") < 0) / F.count("*")).alias("noise_pct"),
    )
    return runs.select((nation + 1).cast("int").alias("run"), "n_topics", F.when(nation % 7 != 3, F.col("silhouette")).alias("silhouette"), F.when(nation % 5 != 4, F.col("separation")).alias("separation"), "noise_pct")


@query(f"WITH {_RES} SELECT run::INT AS run, n_topics::INT AS n_topics, silhouette::DOUBLE AS silhouette FROM res WHERE n_topics >= 2 ORDER BY silhouette DESC NULLS LAST, run LIMIT 1")
def sweep_best(spark, sf_dir):
    return M.best_run(_results(spark, sf_dir)).select("run", "n_topics", "silhouette")


_NORM = f"""{_RES}, norm AS (SELECT run::INT AS run, coalesce((silhouette - min(silhouette) OVER ()) / (max(silhouette) OVER () - min(silhouette) OVER ()), 0.5) AS silhouette,
1 - coalesce((separation - min(separation) OVER ()) / (max(separation) OVER () - min(separation) OVER ()), 0.5) AS separation, 1 - coalesce((noise_pct - min(noise_pct) OVER ()) / (max(noise_pct) OVER () - min(noise_pct) OVER ()), 0.5) AS noise_pct FROM res)"""


@query(f"WITH {_NORM} SELECT run, round(silhouette, 6)::DOUBLE AS silhouette, round(separation, 6)::DOUBLE AS separation, round(noise_pct, 6)::DOUBLE AS noise_pct FROM norm")
def sweep_normalized(spark, sf_dir):
    cols = ["silhouette", "separation", "noise_pct"]
    return M.minmax_normalized(_results(spark, sf_dir), cols).select("run", *(r6(c) for c in cols))


@query(f"WITH {_NORM} SELECT run, 'silhouette' AS metric, round(silhouette, 6)::DOUBLE AS value FROM norm UNION ALL SELECT run, 'separation', round(separation, 6)::DOUBLE FROM norm UNION ALL SELECT run, 'noise_pct', round(noise_pct, 6)::DOUBLE FROM norm")
def v_sweep(spark, sf_dir):
    return V.sweep_matrix(_results(spark, sf_dir), ["silhouette", "separation", "noise_pct"]).select("run", "metric", r6("value"))


# Time, flows, groups.


@query("""WITH t AS (SELECT event_id, epoch_us(ts) AS t FROM events), e AS (SELECT min(t) AS lo, max(t) AS hi FROM t),
b AS (SELECT event_id, t, least(floor((t - lo) / (hi - lo)::DOUBLE * 12), 11)::INT AS bin FROM t, e), m AS (SELECT bin, quantile_cont(t, 0.5) AS m FROM b GROUP BY bin)
SELECT event_id, bin, strftime(make_timestamp(floor(m)::BIGINT), '%Y-%m-%d %H:%M:%S.%f') AS bin_time FROM b JOIN m USING (bin)""")
def bin_timestamps(spark, sf_dir):
    binned = DY.bin_timestamps(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", 12)
    return binned.select("event_id", "bin", F.date_format("bin_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("bin_time"))


_SLICES = f"""{_DTM}, own AS (SELECT * FROM asg WHERE topic <> -1),{_scores('yr', 'own', 'year')},
raw AS (SELECT year AS time, topic, term, score / sum(abs(score)) OVER (PARTITION BY year, topic) AS score FROM yr)"""
_EVO = f"""{_SLICES}, sl AS (SELECT time, row_number() OVER (ORDER BY time) AS i FROM (SELECT DISTINCT time FROM raw)),
th AS (SELECT *, min(i) OVER (PARTITION BY topic, run) AS s FROM (SELECT time, topic, i, i - row_number() OVER (PARTITION BY topic ORDER BY i) AS run FROM (SELECT DISTINCT time, topic FROM raw) JOIN sl USING (time))),
evo AS (SELECT l.time, raw.topic, term, sum(score * pow(2.0, -(l.i - th.i + CASE WHEN th.i = th.s THEN 0 ELSE 1 END))) AS score FROM raw JOIN th USING (time, topic) JOIN th l ON l.topic = th.topic AND l.run = th.run AND l.i >= th.i GROUP BY l.time, raw.topic, term)"""


def _globally(source: str) -> str:
    return f"""{_EVO},{_scores('al', 'own')}, whole AS (SELECT topic, term, score / sum(abs(score)) OVER (PARTITION BY topic) AS score FROM al),
pr AS (SELECT time, topic, term, whole.score AS w FROM (SELECT DISTINCT time, topic FROM {source}) JOIN whole USING (topic)),
glo AS (SELECT coalesce(s.time, pr.time) AS time, coalesce(s.topic, pr.topic) AS topic, coalesce(s.term, pr.term) AS term, (coalesce(s.score, 0) + coalesce(w, 0)) / 2 AS score FROM {source} s FULL JOIN pr ON s.time = pr.time AND s.topic = pr.topic AND s.term = pr.term)"""


def _over_time(source: str) -> str:
    return f"""best AS (SELECT time, topic, term, row_number() OVER (PARTITION BY time, topic ORDER BY round(score, 9) DESC, term) AS rank FROM {source} QUALIFY rank <= 5),
tot AS (SELECT time, topic, words, frequency FROM (SELECT time, topic, string_agg(term, ', ' ORDER BY rank) AS words FROM best GROUP BY ALL) JOIN (SELECT year AS time, topic, count(*) AS frequency FROM own GROUP BY ALL) USING (time, topic))"""


@query(f"WITH {_SLICES} SELECT time, topic, term, round(score, 7) AS score FROM raw")
def topics_over_time_scores(spark, sf_dir):
    b = _Base(spark, sf_dir)
    return DY.slice_scores(b.dtm, b.assignments).select("time", "topic", "term", F.round("score", 7).alias("score"))


def _tot(name: str, ctes: str, source: str, evolution: bool, overall: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = _Base(spark, sf_dir)
        return DY.topics_over_time(b.dtm, b.assignments, evolution=evolution, overall=overall)

    query(f"WITH {ctes}, {_over_time(source)} SELECT * FROM tot", name)(run)


_tot("topics_over_time_raw", _SLICES, "raw", False, False)
_tot("topics_over_time_evolution", _EVO, "evo", True, False)
_tot("topics_over_time_global", _globally("raw"), "glo", False, True)
_tot("topics_over_time_full", _globally("evo"), "glo", True, True)


@query(f"WITH {_SLICES}, {_over_time('raw')}, big AS (SELECT topic FROM tot GROUP BY topic ORDER BY sum(frequency) DESC, topic LIMIT 4), s AS (SELECT *, frequency / sum(frequency) OVER (PARTITION BY time) AS share FROM tot) SELECT time, topic, words, frequency, round(share, 6) AS share FROM s WHERE topic IN (SELECT topic FROM big)")
def v_time_lines(spark, sf_dir):
    b = _Base(spark, sf_dir)
    tot = DY.topics_over_time(b.dtm, b.assignments, evolution=False, overall=False)
    return V.time_lines(tot, 4).select("time", "topic", "words", "frequency", r6("share"))


_FLOW = f"""{_UNIT},{_cents('cent', 'members', 'year, topic')}, nodes AS (SELECT year AS period, topic, count(*) AS count FROM members GROUP BY ALL),
nx AS (SELECT year, lead(year) OVER (ORDER BY year) AS nxt FROM (SELECT DISTINCT year FROM members)),
ln AS (SELECT a.year AS period_from, a.topic AS topic_from, b.year AS period_to, b.topic AS topic_to, round_even(list_dot_product(a.centroid, b.centroid), 4) AS similarity FROM cent a JOIN nx USING (year) JOIN cent b ON b.year = nx.nxt WHERE list_dot_product(a.centroid, b.centroid) >= 0.1)"""


@query(f"WITH {_FLOW} SELECT * FROM ln")
def flow_transitions(spark, sf_dir):
    return DY.flow_transitions(DY.period_centroids(_Base(spark, sf_dir).docs), 0.1)


@query(f"""WITH {_FLOW}, x AS (SELECT period, topic, count, (SELECT count(*) FROM ln WHERE period_to = period AND topic_to = topic) AS i, (SELECT count(*) FROM ln WHERE period_from = period AND topic_from = topic) AS o, (SELECT min(period) FROM nodes) AS lo, (SELECT max(period) FROM nodes) AS hi FROM nodes)
SELECT period, topic, count, CASE WHEN period = lo THEN CASE o WHEN 0 THEN 'disappears' WHEN 1 THEN 'continues' ELSE 'splits' END WHEN period = hi THEN CASE i WHEN 0 THEN 'emerges' WHEN 1 THEN 'continues' ELSE 'merges' END
WHEN i = 0 AND o = 0 THEN 'isolated' WHEN i = 0 THEN 'emerges' WHEN o = 0 THEN 'disappears' WHEN i > 1 THEN 'merges' WHEN o > 1 THEN 'splits' ELSE 'continues' END AS status FROM x""")
def flow_status(spark, sf_dir):
    nodes = DY.period_centroids(_Base(spark, sf_dir).docs)
    return DY.flow_status(nodes, DY.flow_transitions(nodes, 0.1))


@query(f"WITH {_FLOW} SELECT period_from, topic_from, period_to, topic_to, similarity, round(greatest(similarity * least(a.count, b.count), 1), 6)::DOUBLE AS value FROM ln JOIN nodes a ON a.period = period_from AND a.topic = topic_from JOIN nodes b ON b.period = period_to AND b.topic = topic_to")
def v_flow_links(spark, sf_dir):
    nodes = DY.period_centroids(_Base(spark, sf_dir).docs)
    return V.flow_links(nodes, DY.flow_transitions(nodes, 0.1)).withColumn("value", F.round("value", 6))


_CELLS = f"""{_CORPUS}, own AS (SELECT * FROM asg WHERE topic <> -1), grid AS (SELECT topic, grp, coalesce(n, 0) AS observed FROM (SELECT DISTINCT topic FROM own) CROSS JOIN (SELECT DISTINCT grp FROM own) LEFT JOIN (SELECT topic, grp, count(*) AS n FROM own GROUP BY ALL) USING (topic, grp)),
cells AS (SELECT *, sum(observed) OVER (PARTITION BY topic) AS r, sum(observed) OVER (PARTITION BY grp) AS c, sum(observed) OVER () AS t FROM grid), ex AS (SELECT *, r * c / t::DOUBLE AS e FROM cells)"""
_CHI = "round_even(sign(observed - e) * sqrt((observed - e) * (observed - e) / e), 4)"


@query(f"WITH {_CELLS} SELECT topic, grp, observed, round_even(e, 1) AS expected, {_CHI} AS stat FROM ex WHERE e >= 5")
def compare_chi2(spark, sf_dir):
    return DY.compare_topics(_Base(spark, sf_dir).docs)


@query(f"WITH {_CELLS} SELECT topic, grp, observed, round_even(e, 1) AS expected, round_even(log2(((observed + 0.5) / (r + 1)) / (c / t)), 4) AS stat FROM ex WHERE e >= 5")
def compare_log_ratio(spark, sf_dir):
    return DY.compare_topics(_Base(spark, sf_dir).docs, method="log_ratio")


@query(f"WITH {_CELLS} SELECT round(sum((observed - e) * (observed - e) / e), 6) AS statistic, ((count(DISTINCT topic) - 1) * (count(DISTINCT grp) - 1))::BIGINT AS df FROM ex")
def global_chi2_statistic(spark, sf_dir):
    return DY.chi2_test(_Base(spark, sf_dir).docs).select(r6("statistic"), "df")


@query(f"WITH {_CELLS}, s AS (SELECT topic, grp, {_CHI} AS stat FROM ex WHERE e >= 5), big AS (SELECT topic FROM s GROUP BY topic ORDER BY round(avg(abs(stat)), 9) DESC, topic LIMIT 5) SELECT * FROM s WHERE topic IN (SELECT topic FROM big)")
def v_comparison(spark, sf_dir):
    return V.comparison_matrix(DY.compare_topics(_Base(spark, sf_dir).docs))


@query(f"WITH {_TERMS} SELECT topic, rank, term, round(score, 6) AS score FROM terms WHERE topic <> -1 AND rank <= 8")
def v_barchart(spark, sf_dir):
    return V.barchart(_Base(spark, sf_dir).terms).select("topic", "rank", "term", r6("score"))


@query(f"""WITH {_TERMS}, m AS (SELECT CASE WHEN topic < 5 THEN 11 ELSE 12 END AS parent_id, * FROM terms WHERE topic <> -1), s AS (SELECT parent_id, term, sum(score) AS score FROM m GROUP BY ALL)
SELECT parent_id::INT AS parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY round(score, 9) DESC, term)::INT AS rank, term, round(score, 6) AS score FROM s QUALIFY rank <= 10""")
def hierarchy_term_rollup(spark, sf_dir):
    members = spark.createDataFrame([(11 if t < 5 else 12, t) for t in range(10)], "parent_id int, topic int")
    return H.roll_up_terms(members, _Base(spark, sf_dir).terms).select("parent_id", "rank", "term", r6("score"))


# Relational idioms.


@query(f"WITH {_CORPUS} SELECT topic, count(*) FILTER (WHERE grp = 'en') AS en, count(*) FILTER (WHERE grp = 'de') AS de, count(*) FILTER (WHERE grp = 'fr') AS fr, count(*) FILTER (WHERE grp = 'es') AS es FROM asg GROUP BY topic")
def contingency_pivot(spark, sf_dir):
    return _Base(spark, sf_dir).assignments.groupBy("topic").pivot("grp", ["en", "de", "fr", "es"]).count().fillna(0)


@query(f"WITH {_CORPUS} SELECT topic, source, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY topic), 6) AS pct FROM asg GROUP BY topic, source")
def share_within_topic(spark, sf_dir):
    n = _Base(spark, sf_dir).docs.groupBy("topic", "source").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy("topic")), 6))


@query(f"WITH {_CORPUS} SELECT topic, source, count(*) AS n FROM asg GROUP BY topic, source QUALIFY row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, source) <= 3")
def top_k_sources_per_topic(spark, sf_dir):
    n = _Base(spark, sf_dir).docs.groupBy("topic", "source").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(W.partitionBy("topic").orderBy(F.desc("n"), "source"))).where("r <= 3").drop("r")


@query(f"WITH {_CORPUS} SELECT grp, topic, count(*) AS n FROM asg WHERE topic <> -1 GROUP BY grp, topic QUALIFY row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, topic) = 1")
def modal_topic_per_group(spark, sf_dir):
    n = _Base(spark, sf_dir).assignments.where("topic <> -1").groupBy("grp", "topic").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(W.partitionBy("grp").orderBy(F.desc("n"), "topic"))).where("r = 1").drop("r")


@query(f"WITH {_CORPUS}, p AS (SELECT DISTINCT source, topic FROM asg WHERE topic <> -1) SELECT a.source AS a, b.source AS b, count(*) AS n FROM p a JOIN p b ON a.topic = b.topic AND a.source < b.source GROUP BY ALL")
def colab_self_join(spark, sf_dir):
    p = _Base(spark, sf_dir).docs.where("topic <> -1").select("source", "topic").distinct()
    a, b = p.select(F.col("source").alias("a"), "topic"), p.select(F.col("source").alias("b"), "topic")
    return a.join(b, "topic").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


@query(f"WITH {_CORPUS} SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM asg WHERE asg.doc_id = d.doc_id AND topic <> -1) AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def semi_anti_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(_Base(spark, sf_dir).assignments.where("topic <> -1"), "doc_id", "left_anti").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")


# Pooling and classification.

_FOUR = "SELECT vec_id AS doc_id, embedding[1:4]::DOUBLE[] AS l FROM embeddings"


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.slice("embedding", 1, 4).cast("array<double>").alias("logits"))


@query(f"WITH x AS ({_FOUR}), e AS (SELECT doc_id, list_transform(l, lambda v: exp(v - list_max(l))) AS e FROM x), p AS (SELECT doc_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e) SELECT doc_id, ['a', 'b', 'c', 'd'][list_position(p, list_max(p))] AS label, round(list_max(p), 6) AS score, round(p[1], 6) AS a, round(p[2], 6) AS b, round(p[3], 6) AS c, round(p[4], 6) AS d FROM p")
def softmax_classify(spark, sf_dir):
    return CL.single_label(_logits(spark, sf_dir), ["a", "b", "c", "d"]).select("doc_id", "label", *(r6(x) for x in ("score", "a", "b", "c", "d")))


@query(f"WITH x AS ({_FOUR}) SELECT doc_id, round(1 / (1 + exp(-l[1])), 6) AS a, round(1 / (1 + exp(-l[2])), 6) AS b, round(1 / (1 + exp(-l[3])), 6) AS c, round(1 / (1 + exp(-l[4])), 6) AS d FROM x")
def multilabel_sigmoid(spark, sf_dir):
    return CL.multi_label(_logits(spark, sf_dir), ["a", "b", "c", "d"]).select("doc_id", *(r6(x) for x in "abcd"))


@query("""WITH x AS (SELECT vec_id AS doc_id, i AS pos, ['<cls>', '[UNK]', 'two', '<pad>'][i + 1] AS token, embedding[i * 3 + 1 : i * 3 + 3]::DOUBLE[] AS l, [1, 1, (vec_id % 2)::INT, 1][i + 1] AS mask FROM embeddings, range(0, 4) r(i)),
e AS (SELECT *, list_transform(l, lambda v: exp(v - list_max(l))) AS e FROM x WHERE mask = 1 AND token NOT IN ('[CLS]', '[SEP]', '<s>', '</s>', '<pad>', '[PAD]', '<cls>', '<sep>')), p AS (SELECT *, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e)
SELECT doc_id, pos::INT AS pos, token, ['O', 'PER', 'LOC'][list_position(p, list_max(p))] AS label, round(list_max(p), 6) AS score FROM p""")
def ner_tokens(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.array(*(F.lit(t) for t in ("<cls>", "[UNK]", "two", "<pad>"))).alias("tokens"), F.array(F.lit(1), F.lit(1), (F.col("vec_id") % 2).cast("int"), F.lit(1)).alias("mask"), F.array(*(F.slice(v, i * 3 + 1, 3) for i in range(4))).alias("logits"))
    return CL.token_labels(rows, ["O", "PER", "LOC"]).select("doc_id", "pos", "token", "label", r6("score"))


def _token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eight vectors as one document's tokens."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.expr("vec_id div 8").alias("doc_id"), (F.col("vec_id") % 8).alias("pos"), F.when(F.col("vec_id") % 8 < 5, 1).otherwise(0).alias("mask"), F.col("embedding").alias("vector"))


@query("SELECT vec_id // 8 AS doc_id, i::INT - 1 AS dim, round(sum(embedding[i]::DOUBLE) FILTER (WHERE vec_id % 8 < 5) / greatest(count(*) FILTER (WHERE vec_id % 8 < 5), 1e-9), 6) AS value FROM embeddings, range(1, 65) r(i) GROUP BY ALL")
def mean_pool(spark, sf_dir):
    return CL.mean_pool(_token_vectors(spark, sf_dir)).select("doc_id", F.posexplode("vector").alias("dim", "value")).select("doc_id", "dim", r6("value"))


@query("SELECT vec_id // 8 AS doc_id, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id % 8 = 0")
def cls_pool(spark, sf_dir):
    return CL.cls_pool(_token_vectors(spark, sf_dir)).select("doc_id", F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


@query(r"""WITH x AS (SELECT doc_id, ['[CLS]'] || string_split_regex(text, '\s+') || ['[SEP]'] AS t FROM documents),
w AS (SELECT doc_id, t, t[2:len(t) - 1] AS b FROM x),
c AS (SELECT doc_id, 0 AS chunk, t FROM w WHERE len(t) <= 66 UNION ALL SELECT doc_id, (s - 1) // 48 AS chunk, ['[CLS]'] || b[s:s + 63] || ['[SEP]'] AS t FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1, 48)) AS s FROM w WHERE len(t) > 66))
SELECT doc_id, chunk::INT AS chunk, len(t)::INT AS n, md5(array_to_string(t, ' ')) AS digest FROM c""")
def chunk_windows(spark, sf_dir):
    toks = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.array(F.lit("[CLS]")), F.split("text", r"\s+"), F.array(F.lit("[SEP]"))).alias("tokens"))
    return CL.chunk_windows(toks, 66, 16).select("doc_id", "chunk", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


# Neighbours and clusters.

_PLANTED = "pl AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (SELECT vec_id, label, list_transform(list_zip(embedding::DOUBLE[], range(0, 64)), lambda z: z[1] + CASE WHEN z[2] = label THEN 3 ELSE 0 END) AS v FROM embeddings))"
_NEAR = f"{_PLANTED}, nn AS (SELECT a.vec_id AS id, b.vec_id AS neighbor, list_distance(a.v, b.v) AS d FROM pl a JOIN pl b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) <= 10), core AS (SELECT id, max(d) AS core FROM nn GROUP BY id)"


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(table(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("reduced"), "embedding", "label")


@query(f"WITH {_NEAR} SELECT id, round(core, 6) AS core FROM core")
def core_distances(spark, sf_dir):
    from ..operators.cluster import core_distances as f

    return f(_planted(spark, sf_dir), 10).select("id", r6("core"))


@query(f"WITH {_NEAR} SELECT nn.id, neighbor, round(greatest(d, a.core, b.core), 6) AS distance FROM nn JOIN core a ON a.id = nn.id JOIN core b ON b.id = neighbor")
def mutual_reachability_knn(spark, sf_dir):
    from ..operators.cluster import mutual_reachability as f

    return f(_planted(spark, sf_dir), 10).select("id", "neighbor", r6("distance"))


_CANONICAL = "SELECT vec_id AS doc_id, min(vec_id) OVER (PARTITION BY label) AS cluster FROM embeddings"


def _canonical(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.min("doc_id").over(W.partitionBy("topic")).alias("cluster"))


@query(_CANONICAL)
def hdbscan_eom_planted(spark, sf_dir):
    from ..operators.cluster import Hdbscan

    return _canonical(Hdbscan(10).fit_predict(_planted(spark, sf_dir)))


@query(_CANONICAL)
def kmeans_planted(spark, sf_dir):
    from ..operators.cluster import KMeansClustering

    return _canonical(KMeansClustering(10, nstart=8).fit_predict(_planted(spark, sf_dir)))


@query(_CANONICAL)
def agglomerative_planted(spark, sf_dir):
    from ..operators.cluster import Agglomerative

    return _canonical(Agglomerative(10).fit_predict(_planted(spark, sf_dir)))


@query(_CANONICAL)
def ward_merges_planted(spark, sf_dir):
    from ..operators.agglomerate import ward_cut, ward_merges

    rows = _planted(spark, sf_dir).select("doc_id", "reduced")
    return _canonical(ward_cut(rows, ward_merges(rows), 10))


# Kernels and whole fits, whose numbers SQL does not give.


@query()
def pca(spark, sf_dir):
    from ..operators.reduce import PcaReduction

    return PcaReduction(5).fit_transform(_planted(spark, sf_dir)).select("doc_id", F.posexplode("reduced").alias("dim", "value"))


@query()
def umap(spark, sf_dir):
    from ..operators.reduce import UmapReduction

    return UmapReduction(10, 2).fit_transform(_planted(spark, sf_dir)).select("doc_id", F.posexplode("reduced").alias("dim", "value"))


@query()
def reduce_topics(spark, sf_dir):
    return E.reduce_topics(_Base(spark, sf_dir).docs, 4)


@query()
def hierarchy_merge(spark, sf_dir):
    b = _Base(spark, sf_dir)
    return H.hierarchical_topics(b.centroids, b.terms)


@query()
def v_dendrogram(spark, sf_dir):
    tree = H.merge_tree(_Base(spark, sf_dir).centroids)
    return spark.createDataFrame(V.dendrogram(tree, len(tree) + 1), "node int, x double, y double")


@query()
def mmr(spark, sf_dir):
    from ..operators.embed import HashingEncoder, embed_texts

    terms = _Base(spark, sf_dir).terms.persist()
    words = terms.select(F.xxhash64("term").alias("doc_id"), F.col("term").alias("text")).distinct()
    vectors = embed_texts(words, HashingEncoder()).join(words, "doc_id").select(F.col("text").alias("term"), F.col("embedding").alias("vector"))
    joined = CT.term_lists(terms).select(F.col("topic").cast("long").alias("doc_id"), F.array_join("terms", " ").alias("text"))
    reference = embed_texts(joined, HashingEncoder()).select(F.col("doc_id").cast("int").alias("topic"), F.col("embedding").alias("vector"))
    return E.apply_mmr(terms, vectors, reference, 0.3, 5)


@query()
def embed_hashing(spark, sf_dir):
    from ..operators.embed import HashingEncoder, embed_chunks

    return embed_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), HashingEncoder(16), 128, 32).select("doc_id", r_vector("embedding"))


def r_vector(name: str):
    return F.transform(name, lambda x: F.round(x, 6)).alias(name)


def _planted_docs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = _planted(spark, sf_dir).select("doc_id", "embedding")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(vectors.select("doc_id"), "doc_id", "left_semi")
    return docs, vectors.join(docs.select("doc_id"), "doc_id", "left_semi")


@query()
def fit_full(spark, sf_dir):
    from .fit import fit_topics

    docs, vectors = _planted_docs(spark, sf_dir)
    return fit_topics(docs, embeddings=vectors).terms


@query()
def guided_fit(spark, sf_dir):
    from ..operators.cluster import KMeansClustering
    from ..operators.embed import HashingEncoder
    from .fit import guided_fit as f

    docs, vectors = _planted_docs(spark, sf_dir)
    return f(docs, {"first": ["the", "and"], "second": ["der", "die"]}, HashingEncoder(), vectors, clusterer=KMeansClustering(10, 2))[1]


@query()
def zero_shot_full(spark, sf_dir):
    from ..operators.embed import HashingEncoder
    from .fit import zero_shot_topics

    docs, _ = _planted_docs(spark, sf_dir)
    return zero_shot_topics(docs, ["the and of", "der die und", "que de la"], HashingEncoder()).terms


_GRID = "g AS (SELECT row_number() OVER (ORDER BY p, c, m)::INT AS run, ['planted', 'stronger', 'weaker'][m] AS model, [5, 10][c]::INT AS n_components, [5, 10, 20][p]::INT AS min_pts FROM range(1, 4) a(p), range(1, 3) b(c), range(1, 4) d(m))"


@query(f"WITH {_GRID}, n AS (SELECT count(DISTINCT label) AS n_topics FROM embeddings) SELECT run, model, n_components, min_pts, n_topics FROM g, n WHERE n_components = 10")
def sweep(spark, sf_dir):
    """All 18 fits of the default grid for three encoders; with ten components each fit finds each planted label."""
    from .fit import sweep_topics

    docs, vectors = _planted_docs(spark, sf_dir)
    raw = table(spark, sf_dir, "embeddings")
    models = {"planted": vectors} | {k: planted(raw, w).select(F.col("vec_id").alias("doc_id"), "embedding").join(docs.select("doc_id"), "doc_id", "left_semi") for k, w in (("stronger", 4.0), ("weaker", 2.8))}
    return sweep_topics(docs, models).where("n_components = 10").select("run", "model", "n_components", "min_pts", "n_topics")


@query()
def chi2_p_value(spark, sf_dir):
    return DY.chi2_test(_Base(spark, sf_dir).docs)


@query()
def stream_assign(spark, sf_dir):
    """A stream of the embeddings' files, assigned batch by batch into a table."""
    import uuid

    from ..streaming.assign import assign_stream

    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = table(spark, sf_dir, "embeddings")
    source.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{path}/in").select(F.col("vec_id").alias("doc_id"), "embedding")
    run = assign_stream(stream, _Base(spark, sf_dir).centroids).writeStream.format("parquet").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start(f"{path}/out")
    run.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("doc_id", "topic", r6("probability"))


SQL["stream_assign"] = f"WITH {_CENT}, every AS (SELECT vec_id AS doc_id, {_unit('v')} AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)), s AS (SELECT doc_id, topic, round(list_dot_product(every.v, centroid), 9) AS sim FROM every, cent) SELECT doc_id, topic, round(sim, 6) AS probability FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, topic) = 1"
