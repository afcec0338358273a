"""Alignment of two tokenizers over a corpus, and how often their ids are linked.

Plan. Each text is encoded once by both tokenizers. Places where tokens of both end cut them into groups; between two
neighbouring ends of either lies one linked pair of occurrences. Texts go in chunks of some MB: a chunk is a row of its ids,
and its distinct (a, b) pairs with their counts are asked for in stripes of B ids (id modulo the number of stripes).
Within a stripe a dense matrix of B ids by A ids is filled with np.add.at, and its row maxima tell the best counts of each B id.
The answers go back to the chunks' rows, with which they share a partitioning, and links are summed there by document.

Skew. What moves for a pair is one number for each chunk that has it, so a frequent pair, a hot source or copies cost no
task more than a chunk does. A stripe's chunks are summed in parts of PART chunks first and then put together, and its answers are made in
the same parts. A task holds one stripe's matrix (stripes are as many as keep it near BLOCK) and one chunk, whatever the corpus's size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytes as B
from .store import Store

#: Bytes of text of a chunk, unless one text is longer; texts that are encoded at once.
CHUNK, AT_ONCE = 2 << 20, 256
#: Bytes of text of a bucket of chunks, about.
BUCKET = 8 << 20
#: Bytes of a stripe's matrix, about.
BLOCK = 48 << 20
#: Chunks of a stripe that one group of a task sums up.
PART = 2048
#: How the byte-level vocabulary's pre-tokenizer splits a text. A fixed value of that file format.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Pair:
    """The two vocabularies, as their files' contents: tokenizers' JSON of a byte-level BPE (A), a sentencepiece model (B)."""

    a: str
    b: bytes

    @staticmethod
    def read(a_path: str, b_path: str) -> Pair:
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            return Pair(a.read(), b.read())


def _byte_of_letter() -> dict[str, int]:
    """Letters of a byte-level vocabulary: printable bytes stand for themselves, the others are counted on from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _coders(pair: Pair) -> tuple:
    """(A ids of a text or None where they don't give it back, B ids of texts, bytes of A's tokens, bytes of B's), once in a worker."""
    about, letters = json.loads(pair.a), _byte_of_letter()
    model, added = about["model"], {t["id"] for t in about["added_tokens"]}
    ranks = {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items() if i not in added}
    a_bytes = [b""] * (max(model["vocab"].values()) + 1)
    for piece, i in ranks.items():
        a_bytes[i] = piece
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    split = about["pre_tokenizer"] or {}
    by_rank = all(model["vocab"][m.replace(" ", "", 1)] == 256 + i for i, m in enumerate(merges)) and about["normalizer"] is None
    if by_rank and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True):
        # The order of the merges is that of the ids, so ranks say the same and are merged faster.
        coder = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

        def encode_a(text: str) -> np.ndarray | None:
            return coder.encode_to_numpy(text, disallowed_special=())  # every byte has an id, so what is merged is the text
    else:
        own = tokenizers.Tokenizer.from_str(pair.a)
        own.encode_special_tokens = True

        def encode_a(text: str) -> np.ndarray | None:
            ids = own.encode(text, add_special_tokens=False).ids
            return np.array(ids, np.int32) if b"".join([a_bytes[i] for i in ids]) == text.encode() else None

    pieces = sentencepiece.SentencePieceProcessor(model_proto=pair.b)
    b_bytes = [bytes([int(p[1:-1], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, pieces.id_to_piece(i)) for i in range(pieces.get_piece_size()))]
    return encode_a, lambda texts: pieces.encode(texts, num_threads=1), a_bytes, b_bytes


@lru_cache(maxsize=2)
def _sizes(pair: Pair) -> tuple[np.ndarray, np.ndarray]:
    _, _, a, b = _coders(pair)
    return np.array([len(x) for x in a]), np.array([len(x) for x in b])


def _encoded(texts: list[str | None], pair: Pair) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A ids, their number by text, B ids, their number by text). A text that either does not give back has none."""
    encode_a, encode_b, _, b_bytes = _coders(pair)
    a_ids, b_ids = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    n_a, n_b = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int32)
    for start in range(0, len(texts), AT_ONCE):
        some = [t or "" for t in texts[start : start + AT_ONCE]]
        for i, (text, b) in enumerate(zip(some, encode_b(some), strict=True), start):
            whole = " " + text
            if text and b"".join([b_bytes[x] for x in b]) == whole.encode() and (a := encode_a(whole)) is not None:
                n_a[i], n_b[i] = len(a), len(b)
                a_ids.append(a.astype(np.int32))
                b_ids.append(np.array(b, np.int32))
    return np.concatenate(a_ids), n_a, np.concatenate(b_ids), n_b


def _numbered(ends: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether a token ends before a byte's place, number of tokens that end before it) for places 0 to total."""
    mark = np.zeros(total + 1, bool)
    mark[ends] = True
    return mark, np.cumsum(mark, dtype=np.int64)


def _linked(a: np.ndarray, b: np.ndarray, sizes: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the A token, place of the B token) of all links of texts that lie end to end: one before each end of either."""
    a_end, b_end = np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b])
    total = int(a_end[-1]) if len(a) else 0
    (a_mark, a_number), (b_mark, b_number) = _numbered(a_end, total), _numbered(b_end, total)
    ends = np.flatnonzero(a_mark | b_mark)
    return a_number[ends] - a_mark[ends], b_number[ends] - b_mark[ends]


def _groups(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, sizes: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(groups by text, group of each A token, group of each B token), groups counted through all texts."""
    a_end, b_end = np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b])
    total = int(a_end[-1]) if len(a) else 0
    cut = _numbered(a_end, total)[0] & _numbered(b_end, total)[0]
    number = np.cumsum(cut)
    of_text = np.diff(number[np.concatenate([[0], a_end])[np.concatenate([[0], np.cumsum(n_a)])]])
    return of_text, number[a_end] - cut[a_end], number[b_end] - cut[b_end]


def _digits(most: int) -> np.ndarray:
    """The decimal digits of 0 to ``most``, right-aligned behind zero bytes, with a place for what follows."""
    width, n = len(str(most)) + 1, np.arange(most + 1)
    out = np.zeros((most + 1, width), np.uint8)
    for k in range(width - 1):
        out[:, width - 2 - k] = np.where((n >= 10**k) | (k == 0), 48 + n // 10**k % 10, 0)
    return out


def _as_text(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], digits: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(groups by text, ``a1,a2|b1;a3|b2,b3`` of each: A and B ids of its groups, in order)."""
    n_groups, of_a, of_b = _groups(a, n_a, b, n_b, sizes)
    total = int(n_groups.sum())
    # A group's A tokens come after all B tokens of those before, its B tokens after its own A tokens.
    a_until, b_until = np.cumsum(np.bincount(of_a, minlength=total)), np.cumsum(np.bincount(of_b, minlength=total))
    at_a, at_b = np.arange(len(a)) + np.concatenate([[0], b_until])[of_a], np.arange(len(b)) + a_until[of_b]
    table = np.empty((len(a) + len(b), digits.shape[1]), np.uint8)
    table[at_a], table[at_b] = digits[a], digits[b]
    table[:, -1] = ord(",")
    table[a_until + np.concatenate([[0], b_until[:-1]]) - 1 if total else [], -1] = ord("|")
    table[a_until + b_until - 1, -1] = ord(";")
    used = table > 0
    flat, ends = table[used].tobytes(), np.cumsum(np.count_nonzero(used, axis=1))
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_a + n_b)])]
    return n_groups, [flat[x : max(x, y - 1)].decode() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


def align(docs: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, a array<int>, b array<int>, groups array<struct<a: int, b: int>>.

    a holds the ids by which space+text is encoded, b those of the text by the second vocabulary, which adds the space itself; strings of special tokens are plain
    text. groups holds the number of A and B tokens of each group between places where tokens of both end. A null or empty text, and one
    that either vocabulary does not give back byte by byte, has empty arrays. Repeated rows are aligned each; an empty
    table gives an empty one. No exchange is made; other columns are not read.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches):
        sizes = _sizes(pair)
        for batch in B.slices(batches, AT_ONCE):
            a, n_a, b, n_b = _encoded(batch.column(1).to_pylist(), pair)
            n_groups, of_a, of_b = _groups(a, n_a, b, n_b, sizes)
            total = int(n_groups.sum())
            counts = pa.StructArray.from_arrays([pa.array(np.bincount(x, minlength=total), pa.int32()) for x in (of_a, of_b)], ["a", "b"])
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), v) for n, v in ((n_a, pa.array(a)), (n_b, pa.array(b)), (n_groups, counts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "a", "b", "groups"])

    return docs.mapInArrow(B.released(rows), f"doc_id {kind}, a array<int>, b array<int>, groups array<struct<a:int,b:int>>")


def _stripes(pair: Pair) -> tuple[int, int]:
    """(stripes, A ids): B id b is row b // stripes of stripe b % stripes."""
    sizes = _sizes(pair)
    return max(1, -(-len(sizes[0]) * len(sizes[1]) * 8 // BLOCK)), len(sizes[0])


def _keys(a: np.ndarray, b: np.ndarray, stripes: int, width: int, rows: int) -> np.ndarray:
    """A pair as a number, in the order of stripes, rows and columns."""
    return (b.astype(np.int64) % stripes * rows + b // stripes) * width + a


def _dtype(sizes: np.ndarray) -> type:
    return np.uint16 if len(sizes) <= 1 << 16 else np.uint32


def _narrow(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    return ids.astype(_dtype(sizes)).tobytes()


def _chunks(docs: DataFrame, pair: Pair, chunk_bytes: int) -> DataFrame:
    """Rows of two kinds. A chunk: its documents with the numbers of their tokens, and all ids. An asking row: pairs of one stripe, with counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"array<struct<doc_id:{kind},n_a:int,n_b:int>>"

    def rows(batches):
        stripes, width = _stripes(pair)
        sizes, seq, task = _sizes(pair), 0, TaskContext.get().partitionId() << 32
        per = -(-len(sizes[1]) // stripes)
        for batch in batches:
            _, offsets = B.texts_of(batch.column(1))
            for first, last, _, _ in B.blocks(np.zeros(0, np.uint8), offsets, chunk_bytes):
                part = batch.slice(first, last - first)
                a, n_a, b, n_b = _encoded(part.column(1).to_pylist(), pair)
                of_a, of_b = _linked(a, b, sizes)
                keys, counts = np.unique(_keys(a[of_a], b[of_b], stripes, width, per), return_counts=True)
                cell = per * width
                at = np.searchsorted(keys, np.arange(stripes + 1) * cell)
                asked = np.flatnonzero(np.diff(at))
                packed = [np.concatenate([np.diff(keys[at[s] : at[s + 1]], prepend=s * cell), counts[at[s] : at[s + 1]]]).astype(np.uint32).tobytes() for s in asked]
                members = pa.StructArray.from_arrays([part.column(0), pa.array(n_a), pa.array(n_b)], ["doc_id", "n_a", "n_b"])
                n = len(packed)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([task + seq] * (n + 1), pa.int64()), pa.array([None, *asked.tolist()], pa.int32()),
                        pa.ListArray.from_arrays(pa.array([0, len(part)] + [len(part)] * n, pa.int32()), members),
                        pa.array([_narrow(a, sizes[0])] + [None] * n, pa.binary()), pa.array([_narrow(b, sizes[1])] + [None] * n, pa.binary()), pa.array([None, *packed], pa.binary()),
                    ],
                    ["chunk", "stripe", "docs", "a", "b", "pairs"],
                )
                seq += 1

    return docs.mapInArrow(B.released(rows), f"chunk long, stripe int, docs {shape}, a binary, b binary, pairs binary")


def _unpacked(pairs: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(cells, counts) of an asking row."""
    both = np.frombuffer(pairs, np.uint32).astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def _runs(batches: Iterator, *keys: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """(key, rows) of runs of equal keys, one batch in memory at a time."""
    now: list = []

    def rows():
        for batch in batches:
            for part in B.slices(iter([batch]), 64):
                yield from part.to_pylist()

    stream = rows()
    now = [next(stream, None)]

    def of(key):
        while now[0] is not None and tuple(now[0][k] for k in keys) == key:
            yield now[0]
            now[0] = next(stream, None)

    while now[0] is not None:
        key = tuple(now[0][k] for k in keys)
        own = of(key)
        yield key, own
        for _ in own:
            pass


def _summed(asks: DataFrame, pair: Pair, keys: list[str], first: bool) -> DataFrame:
    """Sums of a stripe's counts (stripe, cells, sums, best): a dense matrix of B ids by A ids for each group of ``keys``.

    best tells which sums are their row's greatest. first: rows ask, else they are sums already.
    """

    def add(batches):
        stripes, width = _stripes(pair)
        per = -(-len(_sizes(pair)[1]) // stripes)
        for key, rows in _runs(batches, *keys):
            matrix = np.zeros((per, width), np.int64)
            for row in rows:
                cells, counts = _unpacked(row["pairs"]) if first else (np.frombuffer(row["cells"], np.int64), np.frombuffer(row["sums"], np.int64))
                np.add.at(matrix.reshape(-1), cells, counts)
            used = np.flatnonzero(matrix.any(1))
            own = matrix[used]
            at, col = np.nonzero(own)
            sums, best = own[at, col], own.max(1, initial=0)[at]
            cells = used[at] * width + col
            columns = [pa.array([key[0]], pa.int32())] + [pa.array([x.tobytes()], pa.binary()) for x in (cells, sums, sums == best)]
            yield pa.RecordBatch.from_arrays(columns, ["stripe", "cells", "sums", "best"])
            del matrix, own

    return asks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(B.released(add), "stripe int, cells binary, sums binary, best binary")


def _answers(asks: DataFrame, sums: DataFrame, pair: Pair, parts: int) -> DataFrame:
    """(chunk, stripe, sums, best) for the pairs of each asking row, in their order."""
    told = sums.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("pairs"), "cells", "sums", "best")
    none = [F.lit(None).cast("binary").alias(c) for c in ("cells", "sums", "best")]
    both = told.unionByName(asks.select("stripe", "part", "chunk", "pairs", *none))

    def look(batches):
        for (stripe, _), rows in _runs(batches, "stripe", "part"):
            own = next(rows)
            cells, sums, best = np.frombuffer(own["cells"], np.int64), np.frombuffer(own["sums"], np.int64), np.frombuffer(own["best"], bool)
            for row in rows:
                at = np.searchsorted(cells, _unpacked(row["pairs"])[0])
                got = [sums[at].tobytes(), np.packbits(best[at]).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), pa.array([stripe], pa.int32()), *(pa.array([x], pa.binary()) for x in got)], ["chunk", "stripe", "sums", "best"])

    # Nulls first: the sums of a stripe come before the rows that ask.
    dealt = both.repartition("stripe", "part").sortWithinPartitions("stripe", "part", F.asc_nulls_first("chunk"))
    return dealt.mapInArrow(B.released(look), "chunk long, stripe int, sums binary, best binary")


def link_counts(docs: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK, part: int = PART) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    Links are the pairs of an A and a B token of one text whose bytes overlap. The count of a pair of ids is the number of its links in
    all rows. n_best counts the links whose count is the highest of their B id, ties included, count_sum adds up their
    counts. groups is ``a1,a2|b1;a3|b2,b3``: the ids of each group of ``align``, in order.

    A null or empty text, and one that either vocabulary does not give back byte by byte, has zeros and an empty string, and its ids count
    nowhere. Repeated rows count each. An empty table gives an empty one. Other columns are not read.
    chunk_bytes and part set where work is split; they do not change results.
    """
    store = Store(docs.sparkSession, "align")
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Bucketed by chunk, so that the answers come to the chunks, and the ids are not exchanged.
    rows = store.put_bucketed(_chunks(docs, pair, chunk_bytes), "chunks", min(max(1, -(-size // BUCKET)), 1 << 14), "chunk")
    chunks = rows.where("stripe is null").select("chunk", "docs", "a", "b")
    parts = max(1, -(-chunks.count() // part))
    asks = rows.where("stripe is not null").select("stripe", F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int").alias("part"), "chunk", "pairs")
    sums = _summed(asks, pair, ["stripe", "part"], first=True)
    if parts > 1:
        sums = _summed(store.put(sums, "parts"), pair, ["stripe"], first=False)
    answers = _answers(asks, store.put(sums, "sums"), pair, parts)
    # All answers to a chunk are as many as its distinct pairs.
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("stripe", "sums", "best")).alias("answers"))

    def score(batches):
        stripes, width = _stripes(pair)
        sizes = _sizes(pair)
        per, digits = -(-len(sizes[1]) // stripes), _digits(max(map(len, sizes)))
        for batch in batches:
            for k in range(batch.num_rows):
                members = batch.column(0).slice(k, 1).flatten()
                n_a, n_b = (members.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_a", "n_b"))
                a, b = (np.frombuffer(batch.column(i + 1)[k].as_buffer(), _dtype(sizes[i])).astype(np.int32) for i in (0, 1))
                of_a, of_b = _linked(a, b, sizes)
                keys = _keys(a[of_a], b[of_b], stripes, width, per)
                pair_of = np.searchsorted(np.unique(keys), keys)
                told = sorted(batch.column(3)[k].as_py() or [], key=lambda x: x["stripe"])
                sums = [np.frombuffer(x["sums"], np.int64) for x in told]
                best = [np.unpackbits(np.frombuffer(x["best"], np.uint8), count=len(s)) for x, s in zip(told, sums, strict=True)]
                sums, best = (np.concatenate([np.zeros(0, np.int64), *x])[pair_of].astype(np.int64) for x in (sums, best))
                ends = np.concatenate([[0], np.cumsum(n_a)])
                bounds = np.searchsorted(of_a, ends)
                totals = [np.diff(np.concatenate([[0], np.cumsum(x)])[bounds]) for x in (best, sums)]
                n_groups, groups = _as_text(a, n_a, b, n_b, sizes, digits)
                numbers = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, np.diff(bounds), *totals)]
                whole = pa.RecordBatch.from_arrays([members.field("doc_id"), *numbers, pa.array(groups, pa.string())], OUT)
                yield from B.slices(iter([whole]), AT_ONCE)

    joined = chunks.join(answers, "chunk", "left").select("docs", "a", "b", "answers")
    return joined.mapInArrow(B.released(score), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in OUT[1:-1]) + ", groups string")


OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
