"""Tables that cut lineage, kept where every executor can read them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used on one machine only, where the session names no shared folder, as in tests.
LOCAL = "file:///tmp/checkpoints/topicloom"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return LOCAL
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: made once, whatever reads it, and safe from the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
