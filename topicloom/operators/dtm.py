"""Sparse document-term counts as rows (doc_id, term, n)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ngrams, tokens
from ..sources.tables import written


#: Bytes of text, times the longest n-gram, of a part of the documents whose n-grams are counted at once, so that the counts stay in a task's memory.
PART_BYTES = 8 << 20


def counts(docs: DataFrame, stopwords: Iterable[str] = (), ngram_range: tuple[int, int] = (1, 1), parts: int | None = None) -> DataFrame:
    """Counts of every n-gram of every document, made in ``parts`` of the documents, else in as many as the session exchanges by."""
    # Tokens are a column of their own: inlined, they would be made anew for each n-gram.
    # Texts are exchanged by document, so that n-grams, which are many times larger, are counted where they are made.
    toks = docs.select("doc_id", "text").repartition(*([parts] if parts else []), "doc_id").select("doc_id", tokens("text", stopwords).alias("toks"))
    # Of a plain explode a filter on the size of its array is made, which goes down to the scan and takes every text apart there, twice.
    terms = toks.select("doc_id", F.explode_outer(ngrams(F.col("toks"), *ngram_range)).alias("term")).where("term is not null")
    return terms.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def vocabulary(dtm: DataFrame, n_docs: int | DataFrame, min_df: int = 2, max_df_frac: float = 0.95) -> DataFrame:
    """(term, df) of the terms in at least ``min_df`` documents and at most that share of all of them.

    n_docs counts empty documents too; a DataFrame is counted within the same job.
    """
    df = dtm.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    if isinstance(n_docs, int):
        return df.where(F.col("df") <= int(max_df_frac * n_docs))
    total = n_docs.agg(F.floor(max_df_frac * F.count("*")).alias("most"))
    return df.join(F.broadcast(total), F.col("df") <= F.col("most")).select("term", "df")


def build_dtm(docs: DataFrame, min_df: int = 2, max_df_frac: float = 0.95, stopwords: Iterable[str] = (), ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    """Counts of the terms of the vocabulary. The counts of all terms are written once, so texts are taken apart once, and so are those that stay, whatever reads them."""
    every = written(counts(docs, stopwords, ngram_range), "counts")
    return written(every.join(vocabulary(every, docs, min_df, max_df_frac).select("term"), "term", "left_semi").select("doc_id", "term", "n"), "dtm")


def _scored(freq: DataFrame, max_n: int, threshold: float) -> DataFrame:
    """(term, n_words, freq, cvalue) of the terms (term, freq, n_words) that score ``threshold`` or more."""
    words, n = F.split("term", "_"), F.col("n_words")

    def runs_of(k: int):
        return F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), "_"))

    if max_n > 2:
        inside = F.flatten(F.array(*(F.when(n > k, runs_of(k)).otherwise(F.array().cast("array<string>")) for k in range(2, max_n))))
        nested = freq.where(n > 2).select(F.explode(inside).alias("term"), F.col("freq").alias("outer"))
        result = freq.join(nested.groupBy("term").agg(F.avg("outer").alias("outer")), "term", "left")
    else:
        result = freq.withColumn("outer", F.lit(None).cast("double"))
    score = F.log2("n_words") * (F.col("freq") - F.coalesce("outer", F.lit(0.0)))
    return result.select("term", F.col("n_words").cast("int"), "freq", score.alias("cvalue")).where(F.col("cvalue") >= threshold)


def cvalue_terms(docs: DataFrame, max_n: int = 4, min_freq: int = 2, threshold: float = 0.0, stopwords: Iterable[str] = (), lowercase_first: bool = True) -> DataFrame:
    """(term, n_words, freq, cvalue) of multi-word terms, words joined by underscores.

    A term inside longer kept terms scores log2(n) times its frequency less the mean of theirs, each
    occurrence inside one counting; others log2(n) times their frequency.
    """
    if max_n < 2:
        raise ValueError("max_n must be at least 2")
    toks = docs.select(tokens("text", stopwords, lowercase_first).alias("toks"))
    # Each place gives its longest run alone, dealt by its first two words: all runs that begin with these are counted where they meet.
    # Runs are sorted before they are dealt, as those that begin alike take little room beside one another; Spark drops such a sort but for the condition.
    size = F.size("toks")
    longest = F.when(size > 1, F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.array_join(F.slice("toks", i, F.lit(max_n)), "_")))
    runs = toks.select(F.explode_outer(longest).alias("run")).where("run is not null").sortWithinPartitions("run").where(F.spark_partition_id() >= 0)
    pair = F.substring_index("run", "_", 2)
    same = runs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pair).groupBy(pair.alias("pair"), "run").agg(F.count("*").alias("n"))
    begins = F.array_distinct(F.array(*(F.substring_index("run", "_", k) for k in range(2, max_n + 1))))
    freq = same.select("pair", "n", F.explode(begins).alias("term")).groupBy("pair", "term").agg(F.sum("n").alias("freq")).where(F.col("freq") >= min_freq).drop("pair")
    # Written once: what a term is inside of is made of the kept terms, and the texts are not taken apart again for it.
    freq = written(freq.withColumn("n_words", F.size(F.split("term", "_"))).sortWithinPartitions("term"), "phrases")
    return _scored(freq, max_n, threshold)


def cvalue_dtm(docs: DataFrame, max_n: int = 4, min_freq: int = 2, threshold: float = 0.0, stopwords: Iterable[str] = (), min_df: int = 2, max_df_frac: float = 0.95) -> DataFrame:
    """Counts of single words and of C-value terms; of all n-grams where there is no C-value term."""
    if max_n < 2:
        raise ValueError("max_n must be at least 2")
    n_docs, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, size * max_n // PART_BYTES + 1)
    # Texts are taken apart once: a term's rows meet once, and there give the documents it is in and how often it comes.
    # Rows are sorted before they are dealt, as those of a term take little room beside one another; Spark drops such a sort but for the condition.
    rows = counts(docs, stopwords, (1, max_n), parts).sortWithinPartitions("term").where(F.spark_partition_id() >= 0).repartition(max(cores, parts // 3), "term")
    of = W.partitionBy("term")
    rows = rows.select("doc_id", "term", "n", F.count("*").over(of).alias("df"), F.sum("n").over(of).alias("freq"))
    known = (F.col("df") >= min_df) & (F.col("df") <= int(max_df_frac * n_docs))
    phrase = F.col("term").contains(" ") & (F.col("freq") >= min_freq)
    every = written(rows.where(known | phrase).select("doc_id", "term", "n", "freq", known.alias("known")), "counts")
    dtm = every.where("known").select("doc_id", "term", "n")
    if max_n == 2:
        # No term is inside another one, so the score is that of the frequency alone.
        scores = phrase & (F.log2(F.lit(2)) * F.col("freq") >= threshold)
        if every.where(scores).isEmpty():
            return dtm
        return every.where(F.col("known") & (~F.col("term").contains(" ") | scores)).select("doc_id", "term", "n")
    joined = every.where(phrase).groupBy(F.replace("term", F.lit(" "), F.lit("_")).alias("term")).agg(F.first("freq").alias("freq"))
    freq = written(joined.withColumn("n_words", F.size(F.split("term", "_"))).sortWithinPartitions("term"), "phrases")
    terms = _scored(freq, max_n, threshold).select(F.replace("term", F.lit("_"), F.lit(" ")).alias("term"))
    if terms.isEmpty():
        return dtm
    return dtm.where(~F.col("term").contains(" ")).unionByName(dtm.join(terms, "term", "left_semi"))


def _phrase(pattern: list[str]) -> Column:
    """The words, joined by underscores, from a row of a sentence on whose tags are ``pattern``; null for others."""
    order = W.partitionBy("doc_id", "sentence_id").orderBy("pos")
    words, match = [F.col("word")], F.col("upos") == pattern[0]
    for i, tag in enumerate(pattern[1:], 1):
        words.append(F.lead("word", i).over(order))
        match = match & (F.lead("upos", i).over(order) == tag)
    return F.when(match, F.array_join(F.array(*words), "_"))


def pos_phrases(annotations: DataFrame, pattern: list[str]) -> DataFrame:
    """(doc_id, term) of each run within a sentence whose tags are ``pattern``, words joined by underscores."""
    return annotations.select("doc_id", _phrase(pattern).alias("term")).where("term is not null")


def clean_annotations(annotations: DataFrame, lemmatize: bool = True, stopwords: Iterable[str] = ()) -> DataFrame:
    """(doc_id, sentence_id, pos, word, upos) from tagger rows: no multi-word ids, no blank tags, words of two characters or more."""
    word = F.lower(F.coalesce("lemma", "token") if lemmatize else F.col("token"))
    kept = annotations.where(~F.col("token_id").contains("-") & (F.coalesce("upos", F.lit("")) != "")).withColumn("word", word).where(F.length("word") >= 2)
    if stop := list(stopwords):
        kept = kept.where(~F.col("word").isin(stop))
    return kept.select("doc_id", "sentence_id", F.col("token_id").cast("int").alias("pos"), "word", "upos")


def pos_dtm(annotations: DataFrame, n_docs: int | DataFrame, pos: tuple[str, ...] | None = ("NOUN", "PROPN"), patterns: list[list[str]] | None = None, lemmatize: bool = True, min_df: int = 2, max_df_frac: float = 0.95, extra_stopwords: Iterable[str] = ()) -> DataFrame:
    """Counts of words with the wanted tags and of phrases with the wanted tag sequences."""
    if not pos and not patterns:
        raise ValueError("give pos, patterns or both")
    # Annotations are read once, and exchanged by document alone: sentences and counts then stay where they are.
    clean = clean_annotations(annotations, lemmatize, extra_stopwords).repartition("doc_id")
    words = [F.when(F.col("upos").isin(*pos), F.col("word"))] if pos else []
    found = clean.select("doc_id", F.array(*words, *(_phrase(p) for p in patterns or [])).alias("terms"))
    terms = found.select("doc_id", F.explode(F.array_compact("terms")).alias("term"))
    every = written(terms.groupBy("doc_id", "term").agg(F.count("*").alias("n")), "counts")
    return written(every.join(vocabulary(every, n_docs, min_df, max_df_frac).select("term"), "term", "left_semi").select("doc_id", "term", "n"), "dtm")
