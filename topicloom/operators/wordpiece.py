"""WordPiece over a table: words by rules, then each distinct word of the corpus once into the longest known pieces.

A word's candidate pieces are joined with the vocabulary, the longest at each place is kept, and a fold walks from place to place. Documents beside one
another are a chunk, which asks for the pieces of each of its distinct words once, so that no row is made for each word of a document. Only texts with
other than ASCII characters go through Python for their canonical decomposition.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.vectors import l2_normalize, mean_vector
from ..sources.tables import written
from .classify import chunk_windows
from .embed import Encoder, embed_texts

# The special pieces; the blocks of CJK ideographs, each of which is a word; the length beyond which a word is unknown.
SPECIAL = ("[CLS]", "[SEP]", "[PAD]", "[UNK]")
_CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B920}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
LONGEST_WORD = 100
#: Words of a chunk of documents, about.
CHUNK = 1 << 20

_PUNCTUATION = r"!-/:-@\[-`{-~\p{P}"
_SPACE = r"\s\p{Z}\x{85}"
_WORD = rf"[{_PUNCTUATION}{_CJK}]|[^{_PUNCTUATION}{_CJK}{_SPACE}]+"
_CONTROL = r"[\p{C}\x{FFFD}&&[^\t\n\r]]"


@F.pandas_udf(StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFD", t))


def basic_words(text: Column, lowercase: bool = True) -> Column:
    """A text's words: control characters go, punctuation and ideographs stand alone; ``lowercase`` takes accents and capitals away. Null has none."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), _CONTROL, "")
    if lowercase:
        other = F.when(text.rlike(r"[^\x00-\x7F]"), text)
        text = F.lower(F.regexp_replace(F.coalesce(_decomposed(other), text), r"\p{Mn}", ""))
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def word_pieces(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, pieces) of distinct words (word): the longest known piece at each place, ``##`` before all but the first; else [UNK] alone."""
    longest = vocab.agg(F.max(F.length("piece"))).first()[0] or 1
    long = F.length("word") > LONGEST_WORD
    # All that follows is by word, so that candidates stay where their word is; a vocabulary is small enough for every task.
    words = words.repartition("word")
    starts = words.where(~long).select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    tried = starts.select("word", "at", F.explode(F.sequence(F.lit(1), F.least(F.length("word") - F.col("at") + 1, F.lit(longest)))).alias("n"))
    piece = F.concat(F.when(F.col("at") > 1, "##").otherwise(""), F.substring("word", F.col("at"), F.col("n")))
    best = tried.withColumn("piece", piece).join(F.broadcast(vocab.select("piece").distinct()), "piece").groupBy("word", "at").agg(F.max(F.struct("n", "piece")).alias("best"))
    places = best.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("at", "best"))).alias("best"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("pieces"))

    def walk(state: Column, at: Column) -> Column:
        here = F.col("best")[at]
        step = F.struct((at + here["n"]).alias("at"), F.array_append(state["pieces"], here["piece"]).alias("pieces"))
        return F.when((state["at"] == at) & here.isNotNull(), step).otherwise(state)

    end = F.aggregate(F.sequence(F.lit(1), F.length("word")), start, walk)
    whole = places.select("word", end.alias("end")).where(F.col("end.at") > F.length("word")).select("word", F.col("end.pieces").alias("pieces"))
    return words.join(whole, "word", "left").select("word", F.coalesce("pieces", F.array(F.lit("[UNK]"))).alias("pieces"))


def _chunks(texts: DataFrame, most: int) -> DataFrame:
    """(chunk, ids, sizes, words, codes) of some ``most`` words from (doc_id, words): distinct words, and the place of each word of its documents among these."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            of = np.cumsum(batch.column(1).value_lengths().to_numpy()) // most
            cuts = np.r_[0, np.flatnonzero(np.diff(of)) + 1, len(of)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(start, end - start)
                words = part.column(1).flatten().dictionary_encode()
                listed = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (part.column(0), part.column(1).value_lengths(), words.dictionary)]
                codes = np.ascontiguousarray(words.indices.to_numpy().astype(np.int32)).tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), *listed, pa.array([codes], pa.binary())], ["chunk", "ids", "sizes", "words", "codes"])

    return texts.mapInArrow(run, f"chunk {kind}, ids array<{kind}>, sizes array<int>, words array<string>, codes binary")


def _spelled(chunks: pa.Table, answers: pa.Table) -> pa.Table:
    """(doc_id, tokens, ids) of the documents of a chunk. answers: at, tokens, ids of its distinct words."""
    codes = pa.array(np.frombuffer(chunks.column("codes")[0].as_buffer(), np.int32))
    docs = chunks.column("ids").combine_chunks().flatten()
    ends = np.r_[0, np.cumsum(chunks.column("sizes").combine_chunks().flatten().to_numpy())]
    answers = answers.sort_by("at")
    out = {"doc_id": docs}
    for name in ("tokens", "ids"):
        each = answers.column(name).combine_chunks().take(codes)
        places = np.r_[0, np.cumsum(each.value_lengths().to_numpy())][ends]
        out[name] = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), each.flatten())
    return pa.table(out)


def wordpiece_tokens(df: DataFrame, vocab: DataFrame, lowercase: bool = True, max_length: int | None = None) -> DataFrame:
    """(doc_id, tokens, ids) of (doc_id, text): pieces between [CLS] and [SEP], cut to ``max_length`` with these where it is given.

    vocab: piece, id, pieces distinct. doc_id is distinct. Null and empty texts have the two ends alone; an empty table gives none. ValueError where
    the vocabulary lacks a special piece.
    """
    vocab = written(vocab.select("piece", F.col("id").cast("int").alias("id")), "vocab")
    special = {r["piece"]: r["id"] for r in vocab.where(F.col("piece").isin(*SPECIAL)).collect()}
    if missing := [t for t in SPECIAL if t not in special]:
        raise ValueError(f"the vocabulary lacks {missing}")
    chunks = written(_chunks(df.select("doc_id", basic_words(F.col("text"), lowercase).alias("words")), CHUNK), "chunks")
    asked = chunks.select(F.col("chunk").alias("of"), F.posexplode("words").alias("at", "word"))
    pieces = word_pieces(written(asked.select("word").distinct(), "distinct"), vocab)
    ids = pieces.select("word", F.posexplode("pieces").alias("i", "piece")).join(F.broadcast(vocab), "piece").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("i", "piece", "id"))).alias("pieces"))
    answers = asked.join(written(ids.select("word", F.col("pieces.piece").alias("tokens"), F.col("pieces.id").alias("ids")), "pieces"), "word").select("of", "at", "tokens", "ids")
    kind = df.schema["doc_id"].dataType.simpleString()
    body = chunks.drop("words").groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(_spelled, f"doc_id {kind}, tokens array<string>, ids array<int>")
    cut = lambda a: a if max_length is None else F.slice(a, 1, max(0, max_length - 2))
    wrap = lambda a, kind: F.concat(F.array(F.lit("[CLS]" if kind else special["[CLS]"])), cut(a), F.array(F.lit("[SEP]" if kind else special["[SEP]"])))
    return body.select("doc_id", wrap(F.col("tokens"), True).alias("tokens"), wrap(F.col("ids"), False).alias("ids"))


def embed_token_chunks(df: DataFrame, encoder: Encoder, vocab: DataFrame, max_length: int = 256, overlap: int = 0, strategy: str = "mean", normalize: bool = True, lowercase: bool = True) -> DataFrame:
    """(doc_id, embedding): the mean of the vectors of a text's windows of tokens, or with ``first`` the first one's.

    A window goes to the encoder as text, its pieces put together to words again.
    """
    if strategy not in ("mean", "first"):
        raise ValueError(f"unknown strategy {strategy!r}")
    windows = chunk_windows(wordpiece_tokens(df, vocab, lowercase).select("doc_id", "tokens"), max_length, overlap, strategy == "first")
    inner = F.slice("tokens", 2, F.size("tokens") - 2)
    chunks = windows.select("doc_id", F.regexp_replace(F.array_join(inner, " "), " ##", "").alias("text"))
    means = mean_vector(embed_texts(chunks, encoder, normalize=False), ["doc_id"], "embedding", "embedding")
    return means.withColumn("embedding", l2_normalize("embedding")) if normalize else means
