"""Stop-word lists."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The built-in English list, in its usual order.
ENGLISH_STOPWORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this",
    "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing",
    "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "both", "each", "few", "more", "most", "other", "some", "such",
    "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "can", "will", "just", "should", "now", "also", "however", "therefore",
    "thus", "hence", "whereas", "although", "though", "yet", "still", "already", "since", "either", "neither", "whether", "via", "per", "et", "al",
    "eg", "ie", "vs", "s", "t", "d", "ll", "re", "ve", "m",
)


def get_stopwords(language: str = "english") -> list[str]:
    """The built-in list of a language; a warning and an empty list for those without one."""
    if language.lower() == "english":
        return list(ENGLISH_STOPWORDS)
    warnings.warn(f"no built-in stop-words for {language!r}", stacklevel=2)
    return []


def load_stopwords(spark: SparkSession, source: str | list[str] | DataFrame, column: str | None = None) -> DataFrame:
    """(word) from a DataFrame's column, a .csv or .tsv file's, a text file's lines, or a list: distinct, trimmed, lower-cased."""
    if isinstance(source, DataFrame):
        if column is None and len(source.columns) > 1:
            raise ValueError("column is needed to pick among several")
        words = source.select(F.col(column or source.columns[0]).alias("word"))
    elif isinstance(source, str) and source.endswith((".csv", ".tsv")):
        table = spark.read.csv(source, header=True, sep="\t" if source.endswith(".tsv") else ",")
        words = table.select(F.col(column or table.columns[0]).alias("word"))
    elif isinstance(source, str):
        words = spark.read.text(source).select(F.col("value").alias("word"))
    else:
        words = spark.createDataFrame([(w,) for w in source], "word string")
    return words.select(F.lower(F.regexp_replace("word", r"^[ \t\r\n]+|[ \t\r\n]+$", "")).alias("word")).where("word <> ''").distinct()
