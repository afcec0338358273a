"""Tagged terms are counted once, whatever reads them."""

from topicloom.operators.dtm import pos_dtm


def test_annotations_are_read_once(spark):
    rows = [(d, s, str(i + 1), w, w, t) for d, s in ((1, 1), (1, 2), (2, 1)) for i, (w, t) in enumerate([("fine", "ADJ"), ("tree", "NOUN"), ("grows", "VERB"), ("tree", "NOUN")])]
    rows += [(3, 1, "1", "fine", "fine", "ADJ"), (3, 2, "1", "tree", "tree", "NOUN")]  # a phrase does not go over sentences
    tags = spark.createDataFrame(rows, "doc_id long, sentence_id int, token_id string, token string, lemma string, upos string")
    dtm = pos_dtm(tags, 4, patterns=[["ADJ", "NOUN"]])
    plan = dtm._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    assert sorted(map(tuple, dtm.collect())) == [(1, "fine_tree", 2), (1, "tree", 4), (2, "fine_tree", 1), (2, "tree", 2), (3, "tree", 1)]
