"""A task takes texts as strings by slices of its batch."""

import numpy as np

from topicloom.operators.embed import SLICE, embed_texts


class _Seen:
    def encode(self, texts):
        return np.full((len(texts), 1), float(len(texts)))


def test_texts_come_by_slices(spark):
    docs = spark.range(SLICE + 100).selectExpr("id AS doc_id", "IF(id % 7 = 0, NULL, repeat('a', CAST(id % 50 AS INT))) AS text").coalesce(1)
    rows = embed_texts(docs, _Seen(), batch_size=2 * SLICE, normalize=False).collect()
    assert sorted(r.doc_id for r in rows) == list(range(SLICE + 100))
    assert sorted({r.embedding[0] for r in rows}) == [100.0, float(SLICE)]
