"""What is exchanged between tasks."""

import re

from topicloom.operators.dtm import counts


def test_texts_are_exchanged_not_their_terms(spark):
    docs = spark.createDataFrame([(1, "one two one"), (2, None), (3, "two three")], "doc_id long, text string")
    df = counts(docs, ngram_range=(1, 2))
    exchanged = re.findall(r"hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())
    assert len(exchanged) == 1 and "term" not in exchanged[0]
    assert sorted(map(tuple, df.where("doc_id < 3").collect())) == [(1, "one", 2), (1, "one two", 1), (1, "two", 1), (1, "two one", 1)]


def test_texts_are_taken_apart_once(spark):
    docs = spark.createDataFrame([(1, "one two one"), (2, None), (3, " ")], "doc_id long, text string")
    df = counts(docs.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), ["two"])
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert list(map(tuple, df.collect())) == [(1, "one", 2)]
