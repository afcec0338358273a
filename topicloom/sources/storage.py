"""Saving and loading embeddings and fits."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_embeddings(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, or for a path that ends in .csv one column for each element."""
    if path.endswith(".csv"):
        n = df.select(F.max(F.size("embedding"))).first()[0] or 0
        df.select("doc_id", *(F.col("embedding")[i].alias(f"v{i}") for i in range(n))).write.mode(mode).csv(path, header=True)
    else:
        df.select("doc_id", "embedding").write.mode(mode).parquet(path)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    if not path.endswith(".csv"):
        return spark.read.parquet(path)
    df = spark.read.csv(path, header=True, inferSchema=True)
    cols = [c for c in df.columns if c != "doc_id"]
    if any(dict(df.dtypes)[c] == "string" for c in cols):
        raise ValueError(f"{path} has columns that are not numbers")
    return df.select(F.col("doc_id").cast("long"), F.array(*(F.col(c).cast("double") for c in cols)).alias("embedding"))


def embed_cached(df: DataFrame, encoder, path: str, overwrite: bool = False) -> DataFrame:
    """Embeddings of ``df`` from ``path`` where they are there, else embedded and saved."""
    from ..operators.embed import embed_texts

    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if there and not overwrite:
        cached = load_embeddings(spark, path)
        if cached.count() != df.count():
            raise ValueError(f"{path} holds another number of rows than the corpus")
        return cached
    save_embeddings(embed_texts(df, encoder), path, "overwrite")
    return load_embeddings(spark, path)


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A table, as of document information, as CSV files with a header; quotes in texts are doubled."""
    df.write.mode(mode).option("escape", '"').option("quoteAll", True).csv(path, header=True)


def save_fit(fit, path: str, include_embeddings: bool = True, include_dtm: bool = True) -> None:
    """A Parquet table for each part of the fit, and metadata.json's content as a text table.

    Tables go to a folder of their own and the metadata, which names that folder, is written last: a save that breaks off leaves
    either the earlier fit or none, never parts of both. Folders of earlier saves stay until the caller removes them, as readers may hold them.
    """
    skip = {"embeddings": include_embeddings, "dtm": include_dtm}
    tables = {k: v for k, v in fit.tables().items() if skip.get(k, True)}
    folder = f"fit-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{folder}/{name}")
    meta = fit.summary() | {"tables": sorted(tables), "params": fit.params, "folder": folder}
    spark = fit.assignments.sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_fit(spark: SparkSession, path: str):
    from ..plans.fit import TopicFit

    meta = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    # Fits saved before there were folders have their tables beside the metadata.
    base = f"{path}/{meta['folder']}" if meta.get("folder") else path
    return TopicFit.from_tables({name: spark.read.parquet(f"{base}/{name}") for name in meta["tables"]}, meta["params"])
