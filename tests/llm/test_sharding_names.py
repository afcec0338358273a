"""Columns that are named as the operator's own."""

from topicloom.llm.sharding import shard_by_bytes


def test_working_names_are_kept(spark):
    rows = [(i, "word " * (i % 7), f"mine {i}", i, None, -i, 2 * i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __h string, __D long, __piece string, __n int, __kept0 long")
    got = shard_by_bytes(docs, 4)
    assert got.columns == [*docs.columns, "size", "text_crc32", "law", "shard", "slot"]
    assert sorted(tuple(r)[:7] for r in got.collect()) == rows
    plain = {r.doc_id: (r.shard, r.slot) for r in shard_by_bytes(docs.select("doc_id", "text"), 4).collect()}
    assert {r.doc_id: (r.shard, r.slot) for r in got.collect()} == plain
