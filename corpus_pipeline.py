"""From raw documents to token ids: quality, near duplicates, personal data, the mix, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as
the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import byte_bpe, compression_classifier, jaccard_join, mixing, pii
from topicloom.llm.store import Store, hand_back

#: Rows of a batch between Spark and Python, at most: texts are long, and a task holds a batch on either side.
BATCH_ROWS = 1024
#: Bytes of text that a task takes apart at once: the executors' heaps are full when the tokens are made, so the workers' share is small.
CHUNK_BYTES = 2 << 20
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _begin(spark: SparkSession) -> None:
    """Makes the session's batches no larger than BATCH_ROWS, and the plans that the driver keeps as text no longer than some kB.

    What the stage before left in the driver is handed back.
    """
    hand_back(spark)
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 16))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores 0.3 or more.

    A null or empty text is scored as an empty one; repeated rows share their fate; an empty table gives an empty one.
    """
    _begin(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("crc32(coalesce(cast(doc_id as string), '')) % 5 <> 0")
    return compression_classifier.filter_quality(docs.select(*COLUMNS), compression_classifier.fit(docs, labels), 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group linked by five-word shingles at 0.8 or more.

    Rows with a null or empty text, or one without words, all stay; a null id counts as the greatest; an empty table gives an empty one.
    """
    _begin(spark)
    return jaccard_join.keep_one(docs.select(*COLUMNS), words=5, num=80, den=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind. Null and empty texts stay so, as do repeated rows; n_chars is made anew."""
    _begin(spark)
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last time perhaps in part. Rows without words, null texts among them, are
    never taken; a null source is a source of its own; an empty table gives an empty one."""
    _begin(spark)
    docs = docs.select(*COLUMNS)
    taken = mixing.materialize(docs, mixing.mix(docs))
    return taken.withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256 and the digest of the decoded bytes of each row. A null or empty text has no ids."""
    _begin(spark)
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, chunk_bytes=CHUNK_BYTES), ranks)
    text = byte_bpe.joined(F.col("ids"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]

#: SQL cannot compress, fold merges or walk components; tests/llm/test_queries.py compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are a table in the shared folder."""
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.put(stage(spark, docs, sf_dir), name)
    return docs
