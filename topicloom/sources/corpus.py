"""Corpora: what operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, lang, source, embedding, label: documents that have an embedding."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    return docs.join(vectors, "doc_id")


def assigned(df: DataFrame) -> DataFrame:
    """A corpus with topic (one in seven documents is noise), year and grp."""
    topic = F.when(F.col("doc_id") % 7 == 3, -1).otherwise(F.col("label")).cast("int")
    return df.withColumns({"topic": topic, "year": (2015 + F.col("doc_id") % 10).cast("int"), "grp": F.col("lang")})


def planted(vectors: DataFrame, weight: float = 3.0) -> DataFrame:
    """vec_id, embedding, label with each vector pushed along its label's axis, which makes clusters to find."""
    shifted = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x + F.when(i == F.col("label"), F.lit(weight)).otherwise(0.0))
    return vectors.select("vec_id", l2_normalize(shifted).alias("embedding"), "label")


def read_csv_corpus(spark: SparkSession, path: str, text_col: str = "Abstract") -> DataFrame:
    """A CSV file with a header, without rows whose text is blank."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if text_col not in df.columns:
        raise ValueError(f"{path} has no column {text_col!r}")
    return df.where(F.trim(F.col(text_col)) != "")


def sample_rows(df: DataFrame, n: int, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """``n`` rows chosen by a hash of their id and the seed: the same ones whatever the partitions. Fewer where there are fewer."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n)


def paragraphs(df: DataFrame, min_chars: int = 0, min_words: int = 0, max_words: int | None = None) -> DataFrame:
    """(doc_id, para, text): blank-line separated paragraphs, lines joined by spaces, within the bounds."""
    parts = df.select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("para", "text"))
    parts = parts.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where(F.col("text") != "")
    words = F.size(F.split("text", " "))
    kept = (F.length("text") >= min_chars) & (words >= min_words)
    return parts.where(kept & (words <= max_words) if max_words is not None else kept)
