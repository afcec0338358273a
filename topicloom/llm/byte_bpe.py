"""Byte-level BPE encoding and decoding by a file of ranks.

1. Texts are taken apart once, in chunks of some megabytes: the matches of the pattern are numbered within a
   chunk, and each text becomes a list of numbers. Chunks are written with their distinct words, which are packed by
   buckets of a hash.
2. A bucket's words come together, and each distinct word of the corpus, however rare, is encoded once, by Spark
   itself: a higher-order fold over the word's byte array merges the adjacent pair of least rank, the leftmost on
   ties, until no pair has a rank. The rank map is a literal of the plan, read once for each bucket.
3. The words' ids go back to the chunks, packed again, and take the place of the numbers. The chunks are
   a bucketed table, so that only the words and their ids are exchanged, never the texts.

Decoding concatenates the ids' byte pieces, which are a literal array, in Spark too.

A fold takes steps in proportion to the square of a word's length, so a word of more than ``LONGEST`` bytes is merged by
the same rule with a heap, in n log n.
"""

from __future__ import annotations

import base64
import json
from collections import defaultdict
from heapq import heapify, heappop, heappush
from random import Random

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytes as B
from .store import Store, hand_back

#: Bytes of text, and distinct words, after which a chunk ends, about.
CHUNK_BYTES = 6 << 20
CHUNK_WORDS = 150_000
#: Bytes of text for each bucket of words, about.
BUCKET_BYTES = 8 << 20
#: Bytes of the longest word that is folded.
LONGEST = 256
#: Bits of an id, and of a byte's place in a word that is folded; the fold keeps both and a rank in one number.
ID_BITS, PLACE_BITS = 24, 12
#: Values that are gathered at a time, about.
GATHERED = 1 << 18
#: Characters of the longest stretch between spaces whose words are remembered.
REMEMBERED = 128


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines ``base64 rank``; it need only be on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one word."""
    if (whole := ranks.get(word)) is not None:
        return (whole,)
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heappop(heap)
        j = after[i]
        # Stale unless both parts still are what they were when the pair was ranked.
        if not alive[i] or j >= n or end[j] != stop or end[i] != j:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heappush(heap, (r, before[i], stop))
    return tuple(ranks[word[i : end[i]]] for i in range(n) if alive[i])


def _rank_map(ranks: dict[bytes, int]) -> str:
    """The rank map as JSON: bytes (id of each), rows and pairs, which give the rank of each pair of ids.

    The pair (a, b) is at place (rows[a] + b) mod len(pairs): there is a + 1 above the lower ID_BITS, which are the rank, or
    else the pair has none. A row's place is sought so that no two pairs share one.
    """
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a rank: {missing}")
    pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pairs[a].append((b, rank))
    n_ids = max(ranks.values()) + 1
    if n_ids >= 1 << ID_BITS:
        raise ValueError(f"a rank is over {(1 << ID_BITS) - 2}")
    bits = max(n_ids, 4 * sum(map(len, pairs.values())), 2).bit_length()
    mask, place = (1 << bits) - 1, Random(bits)
    at_place, rows = [0] * (1 << bits), [0] * n_ids
    for a, row in sorted(pairs.items(), key=lambda x: (-len(x[1]), x[0])):
        at = place.getrandbits(bits)
        while any(at_place[(at + b) & mask] for b, _ in row):
            at = place.getrandbits(bits)
        rows[a] = at
        for b, rank in row:
            at_place[(at + b) & mask] = a + 1 << ID_BITS | rank
    return json.dumps({"bytes": [ranks[bytes([b])] for b in range(256)], "rows": rows, "pairs": at_place}, separators=(",", ":"))


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_words(words: Column, rank_map: str) -> Column:
    """array<array<int>>: the ids of each of the words, by a fold of ranked merges. words: array<array<int>>, the bytes of each."""

    none = 1 << ID_BITS  # in the place of a rank; over all of them
    above = ID_BITS + PLACE_BITS  # the bits below a part's rank

    def one(word: Column, ranks: Column) -> Column:
        rows, pairs = ranks["rows"], ranks["pairs"]
        mask = F.size(pairs) - 1
        outside = F.size(rows)  # an id that no pair has, at both ends

        def part(a: Column, at: Column, b: Column) -> Column:
            """The id a that begins at byte ``at``, before b, as one number: the rank of the pair, at, a. So the least part is
            the leftmost of those of least rank."""
            found = F.get(pairs, (F.get(rows, a) + b).bitwiseAND(mask))
            rank = F.least(found.bitwiseXOR(F.shiftleft((a + 1).cast("long"), ID_BITS)), F.lit(none).cast("long"))
            return F.shiftleft(rank, above) + F.shiftleft(at.cast("long"), ID_BITS) + a

        def id_of(p: Column) -> Column:
            return p.bitwiseAND(none - 1).cast("int")

        def at_of(p: Column) -> Column:
            return F.shiftright(p, ID_BITS).bitwiseAND((1 << PLACE_BITS) - 1)

        def step(parts: Column, _: Column) -> Column:
            def merged(least: Column, i: Column) -> Column:
                """With the part at i, from 1 on, and the next as one, whose id is their rank."""
                best, before, after = F.shiftright(least, above).cast("int"), F.get(parts, i - 2), F.get(parts, i + 1)
                new = F.array(part(id_of(before), at_of(before), best), part(best, at_of(least), id_of(after)))
                return F.concat(F.slice(parts, 1, i - 2), new, F.slice(parts, i + 2, F.size(parts)))

            return _let(F.array_min(parts), lambda least: F.when(least >= F.lit(none << above), parts).otherwise(_let(F.array_position(parts, least).cast("int"), lambda i: merged(least, i))))

        byte = F.transform(word, lambda b: F.get(ranks["bytes"], b))
        parts = _let(F.concat(F.array(outside), byte, F.array(outside)), lambda p: F.transform(p, lambda a, i: part(a, i, F.get(p, i + 1))))
        return F.aggregate(F.slice(word, 2, F.size(word)), parts, step, lambda p: F.transform(F.slice(p, 2, F.size(p) - 2), id_of))

    # Null for a null list, so that the optimizer leaves the map a string, which is cheap to plan with; each chunk reads it once.
    literal = F.when(words.isNotNull(), F.lit(rank_map))
    return _let(F.from_json(literal, "bytes array<int>, rows array<int>, pairs array<long>"), lambda ranks: F.transform(words, lambda w: one(w, ranks)))


def _gather(source: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """source[start : start + size] of each, end to end. Places are made for some GATHERED at a time."""
    ends = np.cumsum(size)
    out = np.empty(ends[-1] if len(ends) else 0, source.dtype)
    row, done = 0, 0
    while row < len(ends):
        stop = max(int(np.searchsorted(ends, done + GATHERED, "right")), row + 1)
        n = size[row:stop]
        at = np.repeat(start[row:stop] - ends[row:stop] + n, n)
        at += np.arange(done, ends[stop - 1])
        out[done : ends[stop - 1]] = source[at]
        row, done = stop, int(ends[stop - 1])
    return out


class _Chunk:
    """Texts as lists of the numbers of their words.

    A single space between two characters that are no white space begins a match of every pattern with
    ``spaced``, so the stretches between such spaces, each with the space before it, are taken apart by themselves, and once
    for each distinct one.
    """

    def __init__(self, find, spaced: bool, ranks: dict[bytes, int], longest: int):
        self.find, self.spaced, self.ranks, self.longest = find, spaced, ranks, longest
        self.words: dict[str, int] = {}
        self.long: list[tuple[int, ...]] = []
        self.stretches: dict[str, int] = {}
        self.flat: list[int] = []
        self.start: list[int] = []
        self.ids: list = []
        self.texts: list[np.ndarray] = []
        self.bytes = 0

    def word(self, word: str) -> int:
        """The number of a word that may be long; below 0 for those that are not folded."""
        if word not in self.words and len(word.encode()) > self.longest:
            self.long.append(merge(word.encode(), self.ranks))
            return -len(self.long)
        return self.words.setdefault(word, len(self.words))

    def stretch(self, stretch: str) -> int:
        """The new number of a stretch: its words are flat[start[n] : start[n + 1]]."""
        words, flat, short = self.words, self.flat, self.longest // 4
        self.start.append(len(flat))
        for w in self.find(stretch):
            flat.append(words.setdefault(w, len(words)) if len(w) <= short else self.word(w))
        return len(self.start) - 1

    def after_space(self, pieces: list[str], known: list[int | None]) -> list[int | None]:
        """The number of the stretch of a space and each piece; None where a match might cross the space before or after."""
        stretches, words, flat, start, find, short = self.stretches, self.words, self.flat, self.start, self.find, self.longest // 4
        for i, n in enumerate(known):
            if n is not None:
                continue
            piece = pieces[i]
            n = stretches.get(piece)  # it may be new and come twice
            if n is None and piece and not piece[0].isspace() and not piece[-1].isspace():
                n = len(start)
                start.append(len(flat))
                for w in find(" " + piece):
                    flat.append(words.setdefault(w, len(words)) if len(w) <= short else self.word(w))
                if len(piece) <= REMEMBERED:
                    stretches[piece] = n
            known[i] = n
        return known

    def add(self, id_, text: str) -> None:
        self.ids.append(id_)
        self.bytes += len(text)
        if not self.spaced:
            return self.texts.append(np.array([self.stretch(text)], np.int32))
        head, *rest = text.split(" ")
        known = list(map(self.stretches.get, rest))
        if None in known:
            known = self.after_space(rest, known)
        if None in known or rest and (not head or head[-1].isspace()):
            # Pieces join the one before where the space between is not a cut.
            numbers, begun = [], head
            for p, n in zip(rest, known, strict=True):
                if n is None or not begun or begun[-1].isspace():
                    begun = f"{begun} {p}"
                else:
                    numbers.append(begun)
                    begun = " " + p
            numbers.append(begun)
            return self.texts.append(np.array([self.stretches[p[1:]] if p[1:] in self.stretches and p[0] == " " else self.stretch(p) for p in numbers if p], np.int32))
        self.texts.append(np.array([self.stretch(head), *known] if head else known, np.int32))

    def row(self, chunk: int, kind: pa.DataType, buckets: int) -> pa.RecordBatch:
        starts = np.array([*self.start, len(self.flat)], np.int64)
        words = pa.array(list(self.words), pa.string())
        data, offsets = B.texts_of(words)
        bucket = (B.hashes(data, offsets[:-1], offsets[1:]) % B.U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        number = np.empty(len(order) + 1, np.int64)
        number[order] = np.arange(len(order))
        # Words are numbered by bucket; long words come after the folded ones.
        flat = np.array(self.flat, np.int64)
        flat = np.where(flat < 0, len(order) - 1 - flat, number[np.maximum(flat, -1)])
        every = np.concatenate(self.texts) if self.texts else np.zeros(0, np.int32)
        sizes = starts[every + 1] - starts[every]
        ends = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum([len(t) for t in self.texts])]]
        codes = _gather(flat, starts[every], sizes)
        packs = []
        some, first = np.unique(bucket[order], return_index=True)
        for which, i, j in zip(some, first, np.r_[first[1:], len(order)][: len(first)], strict=True):
            own, at = B.texts_of(words.take(pa.array(order[i:j])))
            packs.append({"bucket": int(which), "words": _pack(np.diff(at)) + pa.compress(own[at[0] : at[-1]].tobytes(), "zstd", asbytes=True), "bytes": int(at[-1] - at[0])})
        row = {"chunk": [chunk], "ids": [self.ids], "ends": [_pack(ends)], "codes": [_pack(codes)], "packs": [packs], "long": [self.long]}
        return pa.RecordBatch.from_pydict(row, schema=_chunk_schema(kind))


def _chunk_schema(kind: pa.DataType) -> pa.Schema:
    pack = pa.struct([("bucket", pa.int32()), ("words", pa.binary()), ("bytes", pa.int64())])
    return pa.schema([("chunk", pa.int64()), ("ids", pa.list_(kind)), ("ends", pa.binary()), ("codes", pa.binary()), ("packs", pa.list_(pack)), ("long", pa.list_(pa.list_(pa.int32())))])


def _pack(values: np.ndarray) -> bytes:
    """Integers up to 32 bits, compressed byte by byte of their places; with their number and packed size in front."""
    planes = pa.compress(np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)
    return np.array([len(values), len(planes)], np.int64).tobytes() + planes


def _unpack(packed: bytes) -> tuple[np.ndarray, bytes]:
    """(the integers, what comes after them)."""
    n, size = (int(x) for x in np.frombuffer(packed, np.int64, 2))
    planes = pa.decompress(packed[16 : 16 + size], 4 * n, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view(np.uint32).ravel().astype(np.int64), packed[16 + size :]


def _chunks(thin: DataFrame, ranks: dict[bytes, int], pattern: str, spaced: bool, chunk_bytes: int, longest: int, buckets: int) -> DataFrame:
    def rows(batches):
        find = regex.compile(pattern).findall
        first = TaskContext.get().partitionId() << 32
        chunk, n, kind = None, 0, None
        for batch in batches:
            kind = batch.column(0).type
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for id_, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    chunk = chunk or _Chunk(find, spaced, ranks, longest)
                    chunk.add(id_, text or "")
                    if chunk.bytes >= chunk_bytes or len(chunk.words) >= CHUNK_WORDS:
                        yield chunk.row(first + n, kind, buckets)
                        chunk, n = None, n + 1
                        B.give_back()
        if chunk:
            yield chunk.row(first + n, kind, buckets)

    kind = thin.schema[0].dataType.simpleString()
    return thin.mapInArrow(B.released(rows), f"chunk long, ids array<{kind}>, ends binary, codes binary, packs array<struct<bucket: int, words: binary, bytes: long>>, long array<array<int>>")


def _words(packed: DataFrame) -> DataFrame:
    """(bucket, words, chunks, places): a bucket's distinct words, and which of them each chunk has. packed: in the order of buckets within a partition."""

    def rows(batches):
        def bucket(which: int, own: list) -> pa.RecordBatch:
            columns = []
            for _, words, size in own:
                sizes, rest = _unpack(words)
                data = pa.decompress(rest, size, "zstd", asbytes=True) if size else b""
                columns.append(pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int32).tobytes()), pa.py_buffer(data)]))
            every = pa.concat_arrays(columns).dictionary_encode()
            at = every.indices.to_numpy()
            ends = np.cumsum([len(c) for c in columns])
            places = [_pack(at[e - len(c) : e]) for c, e in zip(columns, ends, strict=True)]
            data, offsets = B.texts_of(every.dictionary)
            words = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(data[offsets[0] : offsets[-1]].astype(np.int32)))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (words, pa.array([chunk for chunk, *_ in own], pa.int64()), pa.array(places, pa.binary()))]
            return pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), *lists], ["bucket", "words", "chunks", "places"])

        now, own = None, []
        for batch in batches:
            for which, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and which != now:
                    yield bucket(now, own)
                    own = []
                now = which
                own.append(rest)
        if own:
            yield bucket(now, own)

    return packed.mapInArrow(B.released(rows), "bucket int, words array<array<int>>, chunks array<long>, places array<binary>")


def _given(coded: DataFrame) -> DataFrame:
    """(chunk, bucket, ids) for each chunk that has words of a bucket: their ids, packed. coded: bucket, chunks, places, coded."""

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = row.column(3).flatten()
                start, flat = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy()
                out = []
                for place in row.column(2).flatten().to_pylist():
                    at, _ = _unpack(place)
                    sizes = start[at + 1] - start[at]
                    out.append(_pack(sizes) + _pack(_gather(flat, start[at], sizes)))
                chunks = row.column(1).flatten()
                yield pa.RecordBatch.from_arrays([chunks, pa.array([row.column(0)[0].as_py()] * len(chunks), pa.int32()), pa.array(out, pa.binary())], ["chunk", "bucket", "given"])

    return coded.mapInArrow(B.released(rows), "chunk long, bucket int, given binary")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", spaced: bool | None = None, chunk_bytes: int = CHUNK_BYTES, longest: int = LONGEST, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, ids) of each row of ``docs``: its whole text's matches of ``pattern``, each encoded by itself.

    A null or empty text has no ids. Every row is encoded alone: repeated rows and ids give repeated results, an
    empty table an empty one. Only the two named columns are read, once. spaced says that a space between two
    characters that are no white space always begins a match; by default that is so where each way to begin with a letter, digit or
    sign has `` ?`` before it. chunk_bytes, longest and bucket_bytes set where work is split; they do not change results.
    """
    spark = docs.sparkSession
    if spaced is None:
        spaced = all(x in pattern for x in (r" ?\p{L}+", r" ?\p{N}+", r" ?[^\s\p{L}\p{N}]+"))
    rank_map = _rank_map(ranks)
    longest = min(longest, (1 << PLACE_BITS) - 2)
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    size = thin.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    parts = max(1, -(-size // max(chunk_bytes, CHUNK_BYTES)))  # small chunks share a bucket: more tasks would take more of the driver
    # Bucketed by chunk, so that what is made of the words comes to the chunks and not both to other tasks.
    store = Store(spark, "byte-bpe")
    chunks = store.put_bucketed(_chunks(thin, ranks, pattern, spaced, chunk_bytes, longest, buckets), "chunks", min(parts, 1 << 14), "chunk")
    packed = chunks.select("chunk", F.explode("packs").alias("p")).select("p.bucket", "chunk", "p.words", "p.bytes")
    words = _words(packed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "chunk").select("bucket", "chunk", "words", "bytes"))
    given = _given(words.select("bucket", "chunks", "places", fold_words(F.col("words"), rank_map).alias("coded")))

    def put(chunk: pa.Table, given: pa.Table) -> pa.Table:
        """The ids in the place of the numbers."""
        row = chunk.combine_chunks().slice(0, 1)
        sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for one in given.sort_by("bucket").column("given").to_pylist():
            size, rest = _unpack(one)
            sizes.append(size)
            flat.append(_unpack(rest)[0])
        for ids in row.column("long")[0].as_py():
            sizes.append(np.array([len(ids)]))
            flat.append(np.array(ids, np.int64))
        size, flat = np.concatenate(sizes), np.concatenate(flat).astype(np.int32)
        start = np.cumsum(size) - size
        codes, ends = _unpack(row.column("codes")[0].as_py())[0], _unpack(row.column("ends")[0].as_py())[0]
        at = np.r_[0, np.cumsum(size[codes])][ends].astype(np.int32)
        ids = row.column("ids").combine_chunks().flatten()
        return pa.table({"id": ids, "ids": pa.ListArray.from_arrays(pa.array(at), pa.array(_gather(flat, start[codes], size[codes])))})

    kind = thin.schema[0].dataType.simpleString()
    found = chunks.select("chunk", "ids", "ends", "codes", "long").groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(put, f"id {kind}, ids array<int>")
    hand_back(spark)  # the driver made lists of the rank map
    return found.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the pieces of ``ids_col`` end to end as binary; null ids give null.

    An id without a piece, or a null among the ids, is an error. A column ``decoded`` that was there is replaced; others stay.
    An empty table gives an empty one.
    """
    if encoded.schema[ids_col].dataType.simpleString() != "array<int>":
        raise TypeError(f"{ids_col} is not array<int>")
    pieces: list[str | None] = [None] * (max(ranks.values(), default=0) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<string>")
    found = F.transform(ids_col, lambda i: F.coalesce(F.get(table, i), F.raise_error("an id has no piece").cast("string")))
    return encoded.withColumn("decoded", F.unhex(F.array_join(found, "")))


def joined(ids: Column) -> Column:
    """The ids of an array in decimal, with commas between. JSON is written in one go, with no string for each id."""
    return F.trim(F.to_json(ids), F.lit("[]"))
