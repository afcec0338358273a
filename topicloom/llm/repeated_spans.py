"""Removal of byte strings that repeat anywhere in a corpus, by a depth-limited radix sort of suffixes.

A suffix is ordered through its first ``length`` bytes only (a *window*); groups that are equal to that
depth are exactly the repeated windows. A suffix that is alone in its group after a pass takes no part in the next.

1. The leading digit of a window is its anchor: of the ``ANCHOR``-byte strings inside it the one with the
   least hash, the leftmost on ties, with its place. Equal windows have equal anchors at equal places, and
   neighbouring windows mostly share theirs, so that the first pass counts one row for some 170 windows.
2. Anchors found in one place only leave. The texts of the others are cut into the stretches whose
   windows have that anchor, and stretches are dealt out by anchor.
3. Within an anchor, stretches are put into order by the bytes from the anchor to the right and by those from it to the left,
   with passes by digits of eight bytes, the most significant first. Order shows how many bytes neighbours
   share on each side, and so which windows at the same distance from the anchor are equal in all bytes.

An anchor found in more than ``HOT`` places would make one task's group; its windows are dealt out as a whole,
by a hash of 128 bits, over as many parts as they need. Equal texts are handled once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytes as B
from . import idfilter
from .store import Store

ANCHOR = 64
HOT = 1 << 14
#: Anchors so frequent that there are at most this many of them go to every task; the rest are joined by key.
FREQUENT = 50_000
#: Windows of a hot anchor that one part takes, about.
PART_WINDOWS = 400_000
#: Bytes of stretches that a task orders at once, about; an anchor's own are never split.
SORT_BYTES = 3 << 20
#: A text longer than this is searched in overlapping pieces.
PIECE = 1 << 23


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, key, place of the anchor, first and last window that has it), places from the text's start."""
    n, w = len(data), length - ANCHOR + 1
    z = np.zeros(0, np.int64)
    if n < length:
        return z, z.astype(B.U64), z, z, z
    at = np.arange(n - ANCHOR + 1)
    keys = B.windows(data, ANCHOR)
    # Least value of each run of w: the prefix and suffix minima of blocks of w meet in it.
    m = len(keys)
    rows = -(-m // w)
    packed = np.full(rows * w, B.U64(0xFFFFFFFFFFFFFFFF))
    packed[:m] = (keys & B.U64(0xFFFFFFFFFF000000)) | at.astype(B.U64)
    square = packed.reshape(rows, w)
    fore = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(m - w + 1)
    least = (np.minimum(back[: m - w + 1], fore[w - 1 : m]) & B.U64(0xFFFFFF)).astype(np.int64)
    text = np.searchsorted(offsets, starts, "right") - 1
    ok = starts + length <= offsets[text + 1]
    starts, least, text = starts[ok], least[ok], text[ok]
    if not len(starts):
        return z, z.astype(B.U64), z, z, z
    new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[new[1:], len(starts)] - 1
    base = offsets[text[new]]
    return text[new], keys[least[new]], least[new] - base, starts[new] - base, starts[last] - base


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int, piece: int):
    """anchors_of for blocks of any size."""
    for row, _, block, at in B.blocks(data, offsets, min(B.BLOCK_BYTES, piece)):
        if len(block) <= piece:
            yield row, anchors_of(block, at, length)
            continue
        parts = []
        for s in range(0, len(block) - length + 1, piece - length + 1):
            _, key, place, lo, hi = anchors_of(block[s : s + piece], np.array([0, min(piece, len(block) - s)]), length)
            parts.append((key, place + s, lo + s, hi + s))
        key, place, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield row, (np.zeros(len(key), np.int64), key, place, lo, hi)


def _rows(docs: DataFrame, length: int, piece: int) -> DataFrame:
    def rows(batches):
        kind = pa.struct([("key", pa.int64()), ("m", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])
        for batch in batches:
            data, offsets = B.texts_of(batch.column(1))
            counts, parts = np.zeros(batch.num_rows, np.int64), [[], [], [], []]
            for row, (text, *cols) in _pieces(data, offsets, length, piece):
                np.add.at(counts, text + row, 1)
                for p, c in zip(parts, cols, strict=True):
                    p.append(c)
            key, m, lo, hi = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)
            values = pa.StructArray.from_arrays([pa.array(key.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (m, lo, hi))], fields=list(kind))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values)
            digests = [hashlib.sha256(data[offsets[i] : offsets[i + 1]]).digest() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(digests, pa.binary()), lists], ["doc_id", "n_bytes", "digest", "anchors"])

    return docs.mapInArrow(B.released(rows), "doc_id long, n_bytes long, digest binary, anchors array<struct<key: long, m: int, lo: int, hi: int>>")


#: A stretch of one text (tid to seg), or many windows of a hot anchor (values to places, packed; two values to a window).
_DEALT = "key long, part int, tid long, m int, lo int, seg binary, vals binary, tids binary, places binary"


def _deal(joined: DataFrame, length: int, hot: int) -> DataFrame:
    """joined: tid, text, digest, anchors (of the text with this digest)."""
    schema = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("tid", pa.int64()), ("m", pa.int32()), ("lo", pa.int32()), ("seg", pa.binary()), ("vals", pa.binary()), ("tids", pa.binary()), ("places", pa.binary())])

    def rows(batches):
        packs: dict[tuple[int, int], list] = {}
        held = 0

        def flush():
            nonlocal held
            out = [{"key": k, "part": p, "vals": np.concatenate([x[0] for x in v]).tobytes(), "tids": np.concatenate([x[1] for x in v]).tobytes(), "places": np.concatenate([x[2] for x in v]).tobytes()} for (k, p), v in packs.items()]
            packs.clear()
            held = 0
            return pa.RecordBatch.from_pylist(out, schema=schema)

        def stretches(cold):
            return pa.RecordBatch.from_pydict(cold | {k: [None] * len(cold["key"]) for k in ("vals", "tids", "places")}, schema=schema)

        for batch in batches:
            data, offsets = B.texts_of(batch.column(1))
            tids, digests, lists = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            bounds = lists.offsets.to_numpy()
            values = lists.values
            key, m, lo, hi, c = (values.field(i).to_numpy() for i in range(5))
            cold: dict[str, list] = {k: [] for k in ("key", "part", "tid", "m", "lo", "seg")}
            size = 0
            for i, tid in enumerate(tids):
                own = data[offsets[i] : offsets[i + 1]]
                if hashlib.sha256(own).digest() != digests[i]:
                    continue  # another text with the same id
                raw = own.tobytes()
                for j in range(bounds[i], bounds[i + 1]):
                    if c[j] <= hot:
                        seg = raw[lo[j] : hi[j] + length]
                        for k, x in zip(cold, (key[j], 0, tid, m[j] - lo[j], lo[j], seg), strict=True):
                            cold[k].append(x)
                        size += len(seg)
                        continue
                    at = np.arange(lo[j], hi[j] + 1)
                    # The anchor's distance is part of the value, as it is of the digit.
                    far = B.mix((m[j] - at).astype(B.U64))
                    v = np.stack([B.mix(B.windows(own[lo[j] : hi[j] + length], length, lane) + far) for lane in (0, 1)], axis=1)
                    parts = -(-int(c[j]) * (length - ANCHOR + 1) // PART_WINDOWS)
                    which = ((v[:, 0] >> B.U64(32)) % B.U64(parts)).astype(np.int64)
                    for p in np.unique(which):
                        take = which == p
                        packs.setdefault((int(key[j]), int(p)), []).append((v[take].ravel(), np.full(take.sum(), tid, np.int64), at[take].astype(np.int32)))
                    held += 28 * len(at)
                if size > 8 << 20:
                    yield stretches(cold)
                    cold, size = {k: [] for k in cold}, 0
                if held > 32 << 20:
                    yield flush()
            if cold["key"]:  # also where the last rows are other texts
                yield stretches(cold)
        if packs:
            yield flush()

    return joined.mapInArrow(B.released(rows), _DEALT)


def _again(*keys: np.ndarray) -> np.ndarray:
    """Which rows of the keys occur more than once."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        s = k[order]
        same &= s[1:] == s[:-1]
    out = np.zeros(len(order), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _runs(tids: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tid, first byte, byte after the last) of what windows at these places cover."""
    order = np.lexsort((places, tids))
    tids, places = tids[order], places[order]
    if not len(tids):
        return tids, places, places
    new = np.flatnonzero(np.r_[True, (tids[1:] != tids[:-1]) | (places[1:] > places[:-1] + 1)])
    return tids[new], places[new], places[np.r_[new[1:], len(places)] - 1] + length


def _radix(data: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orders the strings data[at : at + size] within groups by passes of eight bytes, the first bytes first.

    Gives the order and, for each string in it, how many bytes it shares with the one before; -1 at a group's
    first. A string comes before those that it begins. Strings alone in what is left of their group leave after each pass.
    """
    most = int(size.max(initial=0))
    eights = np.ndarray(len(data) + most + 1, ">u8", np.concatenate([data, np.zeros(most + 8, np.uint8)]), strides=(1,))
    order = np.lexsort((size, group))
    n = len(order)
    shared = np.full(n, most, np.int64)
    own = group[order]
    shared[np.flatnonzero(np.r_[True, own[1:] != own[:-1]][:n])] = -1
    live = np.arange(n)
    part = np.cumsum(shared < 0)
    depth = 0
    while True:
        # Groups of one leave.
        alone = np.r_[True, part[1:] != part[:-1]][: len(part)]
        alone &= np.r_[alone[1:], True][: len(part)]
        live, part = live[~alone], part[~alone]
        if not len(live) or depth >= most:
            break
        now = order[live]
        left = np.clip(size[now] - depth, 0, 8).astype(B.U64)
        # Bytes after a string's end count as zeros; sizes settle what is left over.
        digit = eights[at[now] + np.minimum(depth, size[now])].astype(B.U64)
        digit = np.where(left > 0, digit & ~(B.U64(0xFFFFFFFFFFFFFFFF) >> (np.minimum(left, 7) * B.U64(8))) | np.where(left == 8, digit & B.U64(0xFF), B.U64(0)), B.U64(0))
        s = np.lexsort((digit, part))
        order[live], digit = now[s], digit[s]
        apart = np.flatnonzero((part[1:] == part[:-1]) & (digit[1:] != digit[:-1])) + 1
        differ = digit[apart] ^ digit[apart - 1]
        same = np.zeros(len(apart), np.int64)
        for k in range(1, 8):
            same += differ < B.U64(1 << (64 - 8 * k))
        shared[live[apart]] = depth + same
        cut = np.zeros(len(part), np.int64)
        cut[apart] = 1
        part = np.cumsum(cut + np.r_[0, (part[1:] != part[:-1])])
        depth += 8
    ends = size[order]
    shared[1:] = np.minimum(shared[1:], np.minimum(ends[1:], ends[:-1]))
    return order, shared


def _order(segs: list[bytes], keys: np.ndarray, tids: np.ndarray, m: np.ndarray, lo: np.ndarray, length: int):
    """(tid, first byte, byte after the last) of the runs of equal windows of stretches with whole anchors. m: place of the anchor in the stretch."""
    sizes = np.array([len(s) for s in segs], np.int64)
    data = np.frombuffer(b"".join(segs), np.uint8)
    base = np.r_[0, np.cumsum(sizes)[:-1]]
    n = len(segs)
    group = np.unique(keys, return_inverse=True)[1]
    right, left = sizes - m, m
    fore, same_fore = _radix(data, base + m, right, group)
    back, same_back = _radix(data[::-1], len(data) - base - m, left, group)
    far = int(left.max(initial=0))
    hit = np.zeros((n, far + 3), bool)
    a, b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    # A window that begins ``away`` bytes before the anchor: stretches agree on it if they do on both sides of the anchor.
    for away in range(far + 1):
        some = np.flatnonzero((left >= away) & (right >= length - away))
        if len(some) < 2:
            continue
        a[fore] = np.cumsum(same_fore < length - away)
        b[back] = np.cumsum(same_back < away)
        hit[some[_again(a[some] * (n + 1) + b[some])], away + 1] = True
    edge = np.diff(hit.astype(np.int8), axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    # Hits from begin to end - 1 bytes before the anchor.
    anchor = lo[row] + m[row]
    return tids[row], anchor - end + 1, anchor - begin + length


def _sorted_out(dealt: DataFrame, length: int, buckets: int) -> DataFrame:
    """(tid, spans) of repeated stretches. dealt: by key and part, in that order within a partition.

    What a task finds goes out packed, one row for each bucket of texts, so that the stretches of a text that
    many tasks found a byte each of make no rows of their own.
    """

    def rows(batches):
        kept: list[tuple] = []
        found: list[tuple[np.ndarray, ...]] = []
        held = 0

        def out():
            tid, first, after = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            order = np.argsort(tid % buckets, kind="stable")
            tid, first, after = tid[order], first[order], after[order]
            some, at = np.unique(tid % buckets, return_index=True)
            at = np.r_[at, len(tid)]
            cols = [pa.array([x[i:j].astype(np.int64).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()) for x in (tid, first, after)]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *cols], ["bucket", "tids", "firsts", "afters"])

        def solve(rows):
            cold = [r for r in rows if r[5] is not None]
            if cold:
                key, _, tid, m, lo, seg = list(zip(*cold, strict=True))[:6]
                found.append(_order(list(seg), np.array(key, np.int64), np.array(tid, np.int64), np.array(m, np.int64), np.array(lo, np.int64), length))
            hot: dict[tuple, list] = {}
            for r in rows:
                if r[5] is None:
                    hot.setdefault((r[0], r[1]), []).append(r[6:])
            for own in hot.values():
                vals, tids, places = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*own, strict=True), (B.U64, np.int64, np.int32), strict=True))
                keep = _again(vals[::2], vals[1::2])
                found.append(_runs(tids[keep], places[keep].astype(np.int64), length))

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held > SORT_BYTES and r[:2] != kept[-1][:2]:
                    solve(kept)
                    kept, held = [], 0
                    if sum(len(x[0]) for x in found) > 500_000:
                        yield out()
                kept.append(r)
                held += len(r[5] or b"") + len(r[6] or b"")
        if kept:
            solve(kept)
        if found:
            yield out()

    def union(batches):
        parts: list[list[np.ndarray]] = [[], [], []]
        for batch in batches:
            for p, column in zip(parts, batch.columns[1:], strict=True):
                p += [np.frombuffer(x, np.int64) for x in column.to_pylist()]
        if not parts[0]:
            return
        tid, first, after = (np.concatenate(p) for p in parts)
        order = np.lexsort((first, tid))
        tid, first, after = tid[order], first[order], after[order]
        _, start = np.unique(tid, return_index=True)
        # Ends run on within a text only: texts are set apart by more than any place.
        far = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(tid)])) << 40
        reach = np.maximum.accumulate(after + far)
        new = np.flatnonzero(np.r_[True, first[1:] + far[1:] > reach[:-1]])
        last = np.r_[new[1:], len(tid)] - 1
        tid, first, after = tid[new], first[new], (reach[last] - far[last])
        own, at = np.unique(tid, return_index=True)
        values = pa.StructArray.from_arrays([pa.array(first), pa.array(after)], names=["first", "after"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[at, len(tid)].astype(np.int32)), values)
        yield pa.RecordBatch.from_arrays([pa.array(own), lists], ["tid", "spans"])

    packed = dealt.mapInArrow(B.released(rows), "bucket int, tids binary, firsts binary, afters binary")
    return packed.repartition(buckets, "bucket").mapInArrow(B.released(union), "tid long, spans array<struct<first: long, after: long>>")


def _cut(joined: DataFrame, text_too: bool) -> DataFrame:
    """joined: tid, text, digest, spans. Adds what is left of each text without the spans."""

    def rows(batches):
        for batch in batches:
            data, offsets = B.texts_of(batch.column(1))
            out: dict[str, list] = {k: [] for k in ("tid", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
            for i, (tid, digest, spans) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                if hashlib.sha256(raw).digest() != digest:
                    continue
                merged = [(x["first"], x["after"]) for x in spans]
                kept = b"".join(raw[a:b] for a, b in zip([0, *(x[1] for x in merged)], [*(x[0] for x in merged), len(raw)], strict=True))
                row = (tid, len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), [{"first": a, "after": b} for a, b in merged], kept if text_too else None)
                for k, x in zip(out, row, strict=True):
                    out[k].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("tid", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))), ("kept", pa.binary())]))

    return joined.mapInArrow(B.released(rows), "tid long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first: long, after: long>>, kept binary")


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, text_too: bool = False, hot: int = HOT, piece: int = PIECE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept.

    A byte goes if a string of ``length`` bytes that covers it also starts at another place of any text.
    spans are the longest removed runs (byte offsets, end exclusive); kept, with text_too, the bytes that
    stay, null where nothing went. ids are integers and may repeat or be null: each row is judged by its own text.
    Equal texts of at least ``length`` bytes go wholly. A null text counts as empty; texts shorter than
    ``length`` stay. An empty table gives an empty one. No other column is read. hot and piece set where work is split;
    they do not change results.
    """
    spark = docs.sparkSession
    store = Store(spark, "repeats")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = store.put(_rows(docs, length, piece), "rows")
    texts = rows.groupBy("digest").agg(F.count("*").alias("copies"), F.first(F.struct("doc_id", "n_bytes", "anchors")).alias("x")).select("digest", "copies", "x.*")
    texts = store.put(texts.withColumn("tid", F.monotonically_increasing_id()), "texts")
    own = texts.select("tid", F.explode("anchors").alias("a")).select("tid", "a.*")
    again = store.put(own.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "again")
    # At most FREQUENT anchors can have so large a share of all; their rows need no exchange by key.
    many = max(hot, (again.agg(F.sum("c")).first()[0] or 0) // FREQUENT)
    frequent = F.broadcast(again.where(F.col("c") > many).select("key", F.col("c").alias("often")))
    own = own.join(frequent, "key", "left")
    left = own.where("often is null").drop("often").join(again.where(F.col("c") <= many), "key").unionByName(own.where("often is not null").withColumnRenamed("often", "c"))
    left = left.groupBy("tid").agg(F.collect_list(F.struct("key", "m", "lo", "hi", "c")).alias("anchors"))
    left = store.put(left.join(texts.select("tid", "digest", F.col("doc_id").alias("rep")), "tid"), "anchored")

    def with_text(of: DataFrame) -> DataFrame:
        some = idfilter.where_passes(docs, idfilter.bits_of(of, "rep"))
        return some.join(of, F.col("doc_id").eqNullSafe(F.col("rep")))

    dealt = _deal(with_text(left).select("tid", "text", "digest", "anchors"), length, hot)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = dealt.repartition(parts, "key", "part").sortWithinPartitions("key", "part")
    spans = _sorted_out(dealt, length, parts)
    spans = store.put(spans.join(texts.where("copies = 1").select("tid", "digest", F.col("doc_id").alias("rep")), "tid"), "spans")
    cut = store.put(_cut(with_text(spans).select("tid", "text", "digest", "spans"), text_too).dropDuplicates(["tid"]), "cut")

    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    empty = hashlib.sha256(b"").hexdigest()
    none = F.array().cast("array<struct<first: long, after: long>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("after")))
    result = texts.select("tid", "digest", "copies", "n_bytes").join(cut, "tid", "left").select(
        "digest",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(empty)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.when(gone, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
    return rows.select("doc_id", "n_bytes", "digest").join(result, "digest").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")
