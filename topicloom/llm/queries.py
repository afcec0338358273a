"""Thin queries over the test tables, one per operator; each derives its digest columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, byte_bpe, chat, compression_classifier, importance_resampling, pii, setsketch, token_alignment
from .jaccard_join import near_duplicate_components
from .mixing import mix
from .quality_rules import fit_bands, quality_rules
from .repeated_spans import remove_repeated
from .sharding import shard_by_bytes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(_table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(byte_bpe.joined(F.col("ids")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["after"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)).cast("long") for k in pii.KINDS]
    counts = [(F.size(kinds) - c).alias(f"n_{k}") for k, c in zip(pii.KINDS, counts, strict=True)]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


#: A row is held out, and its label not learned from, if this is 0.
_FOLD = "crc32(coalesce(cast(doc_id as string), '')) % 5"


def op5_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = compression_classifier.fit(docs, labels.where(f"{_FOLD} <> 0"))
    scored = compression_classifier.score(docs, model)
    return scored.select("doc_id", F.expr(f"{_FOLD} = 0").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = bm25.search(docs, docs.where("doc_id % 100 = 0"), k=10)
    return found.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def op7_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: whether anything went, the removed runs, and what is left as text.

    kept_text is null where nothing went; what is left of a code point of which a part went is U+FFFD in it.
    """
    found = remove_repeated(_table(spark, sf_dir, "documents"), length=400, text_too=True)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["first"].cast("string"), s["after"].cast("string"))), ",")
    left = F.make_valid_utf8(F.col("kept").cast("string"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("repeats"), spans.alias("spans"), left.alias("kept_text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    found = quality_rules(docs, bands=fit_bands(docs, labels.where(f"quality = 1 and {_FOLD} <> 0")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(_table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    log = chat.messages_as_events(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    back = chat.read_back(chat.render(chat.reconstruct(log)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = chat.masked_text(F.col("formatted"), F.col("loss_spans"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = setsketch.near_duplicates(_table(spark, sf_dir, "documents"), words=4, num=80, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = token_alignment.Pair.read(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    found = token_alignment.link_counts(_table(spark, sf_dir, "documents"), pair)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    drawn = importance_resampling.resample(docs, target, grams=(1, 1), buckets=10_000, percent=10, least_words=20, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_mixing": op2_mixing,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_pii": op4_pii,
    "op5_compression_classifier": op5_compression_classifier,
    "op6_bm25": op6_bm25,
    "op7_repeated_spans": op7_repeated_spans,
    "op8_quality_rules": op8_quality_rules,
    "op9_sharding": op9_sharding,
    "op10_chat": op10_chat,
    "op11_setsketch": op11_setsketch,
    "op12_token_alignment": op12_token_alignment,
    "op13_importance_resampling": op13_importance_resampling,
}



def _linked(words: int, num: int, out: str) -> str:
    """SQL of the near-duplicate components by all pairs that share a shingle."""
    return f"""WITH RECURSIVE texts AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' ')) END) AS g FROM texts),
n AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id), met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {num} * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT links.a, root FROM reach JOIN links ON links.b = reach.doc_id),
least AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT {out} FROM documents JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)"""


#: DuckDB SQL of the queries that it can express on whole tables.
ORACLES: dict[str, str] = {
    "op11_setsketch": _linked(4, 80, "doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept"),
    "op6_bm25": """WITH words AS (SELECT doc_id, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL), dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n, (SELECT count(*) FROM words) / count(*) AS mean FROM documents),
im AS (SELECT doc_id, term, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)) * ln(1 + (n - df + 0.5) / (df + 0.5)) AS s FROM tf JOIN dl USING (doc_id) JOIN df USING (term), n),
sc AS (SELECT q.doc_id AS query_id, im.doc_id, round(sum(s), 9) AS score FROM tf q JOIN im USING (term) WHERE q.doc_id % 100 = 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, round(score, 6) AS score FROM sc QUALIFY rank <= 10""",
    # crc32 is folded byte by byte over the distinct words, with a table of 256 entries that is made by its rule.
    "op13_importance_resampling": """WITH crc AS (SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
found AS (SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
words AS (SELECT side, doc_id, unnest(words) AS word FROM found),
hexed AS (SELECT DISTINCT word, lower(hex(encode(word))) AS h FROM words),
coded AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(h)::BIGINT, 2), lambda i: (16 * (strpos('0123456789abcdef', h[i]) - 1) + strpos('0123456789abcdef', h[i + 1]) - 1)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket FROM hexed, crc),
pairs AS (SELECT side, doc_id, bucket FROM words JOIN coded USING (word)),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM pairs GROUP BY bucket), totals AS (SELECT sum(s)::DOUBLE AS a, sum(t)::DOUBLE AS b FROM counts),
gains AS (SELECT bucket, floor(1000.0::DOUBLE * ln((t + 1)::DOUBLE * (a + 10000) / ((s + 1)::DOUBLE * (b + 10000))))::BIGINT AS gain FROM counts, totals),
sums AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS g FROM pairs JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(g / n), 0)::BIGINT AS weight,
coalesce(floor(g / n), 0)::BIGINT + floor(-1000.0::DOUBLE * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM documents LEFT JOIN sums USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM ranked""",
}
