"""Bounded samples by hash."""

from pyspark.sql import functions as F

from topicloom.operators.cluster import _hashed_first


def test_tasks_dont_send_the_sample_each(spark):
    rows = spark.range(0, 40_000, 1, 8).select(F.col("id").alias("doc_id"))
    some = _hashed_first(rows, 500)
    assert "<=" in some._jdf.queryExecution().optimizedPlan().toString()
    want = [r[0] for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(500).collect()]
    assert [r[0] for r in some.collect()] == want
    assert _hashed_first(rows.limit(100), 500).count() == 100


def test_ids_of_high_hashes_are_still_taken(spark):
    high = spark.range(0, 40_000, 1, 4).select(F.col("id").alias("doc_id")).where(F.xxhash64("doc_id") > 0)
    assert high.count() > 15_000 and _hashed_first(high, 2_000).count() == 2_000
