"""WordPiece against the public library's, over the same vocabulary."""

import pytest

from topicloom.operators.wordpiece import SPECIAL, embed_token_chunks, wordpiece_tokens

PIECES = [*SPECIAL, "the", "un", "##aff", "##able", "##a", "##f", "a", "e", "##e", "cafe", "##s", "x", "##x", "中", "文", "!", ",", "'", "$", "don", "t", "o", "##o", "naive", "run", "##ning", "##n", "1", "##1", "-"]
TEXTS = [
    "The unaffable CAFÉS don't, run-ning!", "naïve x\u0000x\tx​x\r\nx", "中文the中", "", None, "   ", "zzz the", "x" * 100, "x" * 101, "the " * 700, "$1,1 ǅ  e ée�", "unaffq", "한 the",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, [i], 5) for i, t in enumerate(texts)], "doc_id long, text string, tokens array<int>, word int")


def vocabulary(spark):
    return spark.createDataFrame([(p, i) for i, p in enumerate(PIECES)], "piece string, id int")


@pytest.mark.parametrize("lowercase", [True, False])
def test_like_the_library(spark, lowercase):
    from tokenizers import BertWordPieceTokenizer

    library = BertWordPieceTokenizer({p: i for i, p in enumerate(PIECES)}, lowercase=lowercase, strip_accents=lowercase)
    got = {r.doc_id: r for r in wordpiece_tokens(frame(spark, TEXTS), vocabulary(spark), lowercase).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        want = library.encode(text or "")
        assert (got[i].tokens, got[i].ids) == (want.tokens, want.ids), text


def test_cut_and_empty(spark):
    rows = wordpiece_tokens(frame(spark, ["the the the", None]), vocabulary(spark), max_length=4).orderBy("doc_id").collect()
    assert [r.tokens for r in rows] == [["[CLS]", "the", "the", "[SEP]"], ["[CLS]", "[SEP]"]]
    assert wordpiece_tokens(frame(spark, ["a"]).limit(0), vocabulary(spark)).count() == 0
    with pytest.raises(ValueError, match="SEP"):
        wordpiece_tokens(frame(spark, ["a"]), vocabulary(spark).where("piece <> '[SEP]'"))


def test_token_chunks(spark):
    """Windows of two tokens; an encoder that gives a window's length and its number of words."""

    class Lengths:
        def encode(self, texts):
            return [[len(t), len(t.split())] for t in texts]

    docs = frame(spark, ["the unaffable x", "x"])
    got = {r.doc_id: list(r.embedding) for r in embed_token_chunks(docs, Lengths(), vocabulary(spark), 4, normalize=False).collect()}
    # the un | ##aff ##able | x
    assert got[0] == pytest.approx([(6 + 9 + 1) / 3, (2 + 1 + 1) / 3])
    assert got[1] == [1, 1]
    first = {r.doc_id: list(r.embedding) for r in embed_token_chunks(docs, Lengths(), vocabulary(spark), 4, strategy="first", normalize=False).collect()}
    assert first[0] == [6, 2]


def test_a_chunk_asks_for_a_word_once(spark):
    """What meets the vocabulary and comes back is a chunk's distinct words, not the words of each document; empty and null texts stay."""
    from pyspark.sql import functions as F

    from topicloom.operators import wordpiece as WP

    texts = ["the cat the cat"] * 50 + ["", None, "dog"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    words = docs.select("doc_id", WP.basic_words(F.col("text")).alias("words"))
    for most, n in ((1000, 1), (40, 6)):
        chunks = WP._chunks(words, most).collect()
        assert len(chunks) == n and [i for c in chunks for i in c["ids"]] == list(range(53))
        assert all(len(c["words"]) <= 3 and len(c["codes"]) == 4 * sum(c["sizes"]) for c in chunks)
    vocab = spark.createDataFrame([(p, i) for i, p in enumerate([*WP.SPECIAL, "the", "c", "##at"])], "piece string, id int")
    got = {r.doc_id: r.tokens for r in WP.wordpiece_tokens(docs, vocab).collect()}
    assert len(got) == 53 and got[0] == ["[CLS]", "the", "c", "##at", "the", "c", "##at", "[SEP]"]
    assert got[50] == got[51] == ["[CLS]", "[SEP]"] and got[52] == ["[CLS]", "[UNK]", "[SEP]"]
