"""Sharding by a histogram sort, in DataFrame functions alone.

The sort key is a hash of the text, then a hash of the id for texts too frequent for one shard. Each
round counts rows and exact bytes below candidate boundaries: the first splits the key space evenly, the
next split only the cells in which a wanted splitter lies, until every splitter is within the tolerance
or its cell is one key. Then rows are exchanged once. Only counts of cells reach the driver: at most
2 ** STEP for each splitter and round, whatever the input's size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .store import Store

STEP = 12
#: Key bits: the text's hash, then the id's.
BITS = 120
HALF = 60
#: Bytes of one task's share of a shard, about.
TASK_BYTES = 128 << 20


@dataclass(frozen=True)
class Splitters:
    """Keys (h, d) from which shards 1, 2, ... begin, and the bytes and rows of all."""

    keys: tuple[tuple[int, int], ...]
    n_bytes: int
    n_rows: int
    rounds: int


#: Columns that the operator adds and takes away again.
_WORKING = ("__h", "__d", "__piece", "__n", "__base")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key_id = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    low = F.lit((1 << HALF) - 1)
    added = {"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary")), "__h": F.xxhash64(text).bitwiseAND(low), "__d": F.xxhash64(key_id, F.lit(17)).bitwiseAND(low)}
    return docs.withColumns(added)


def _digits(depth: int) -> Column:
    """The first ``depth`` bits of the key as a number within its half."""
    half, left = ("__h", HALF - depth) if depth <= HALF else ("__d", BITS - depth)
    return F.shiftrightunsigned(half, left)


def find_splitters(keyed: DataFrame, shards: int, weight: str = "size", tolerance: float = 0.002, group_tolerance: float = 0.02) -> Splitters:
    """Splitters whose ``weight`` below is within ``tolerance`` of an even share, where keys allow it.

    A text is cut by ids only where its nearer end is not within ``group_tolerance``.
    """
    total = keyed.agg(F.sum(weight).alias("w"), F.count("*").alias("n")).first()
    whole, n = int(total["w"] or 0), int(total["n"])
    slack = tolerance * whole / shards
    # Of each splitter: its aim, the weight below its cell, and the cell's digits.
    todo = [{"aim": whole * i / shards, "below": 0, "h": None, "d": None} for i in range(1, shards)] if n else []
    done: list[tuple[float, tuple[int, int]]] = []
    depth = rounds = 0
    while todo and depth < BITS:
        step = min(STEP, BITS - depth)
        before, depth, rounds = depth, depth + step, rounds + 1
        rows = keyed
        if before:
            cells = {(s["h"], s["d"]) for s in todo}
            if before < HALF:
                rows = keyed.where(F.shiftrightunsigned("__h", HALF - before).isin([h for h, _ in cells]))
                group = [F.shiftrightunsigned("__h", HALF - before).alias("p"), F.lit(0).cast("long").alias("q")]
            else:
                test = F.lit(False)
                for h, d in cells:
                    test = test | ((F.col("__h") == h) & (F.shiftrightunsigned("__d", BITS - before) == (d or 0)))
                rows = keyed.where(test)
                group = [F.col("__h").alias("p"), F.shiftrightunsigned("__d", BITS - before).alias("q")]
        else:
            group = [F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q")]
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for p, q, c, w in rows.groupBy(*group, _digits(depth).alias("c")).agg(F.sum(weight).alias("w")).collect():
            found.setdefault((p, q), []).append((c, int(w)))
        later = []
        for s in todo:
            below, cells = s["below"], sorted(found[(s["h"] or 0), (s["d"] or 0)])
            for c, w in cells:
                if below + w >= s["aim"]:
                    break
                below += w
            in_h = depth <= HALF
            left = HALF - depth if in_h else BITS - depth

            def key(cell: int) -> tuple[int, int]:
                return (cell << left, 0) if in_h else (s["h"], cell << left)  # noqa: B023

            if s["aim"] - below <= slack:
                done.append((s["aim"], key(c)))
            elif below + w - s["aim"] <= slack:
                done.append((s["aim"], key(c + 1)))
            elif depth >= BITS or depth == HALF and min(s["aim"] - below, below + w - s["aim"]) <= group_tolerance * whole / shards:
                done.append((s["aim"], key(c) if s["aim"] - below <= below + w - s["aim"] else key(c + 1)))
            else:
                later.append({"aim": s["aim"], "below": below, "h": c if in_h else s["h"], "d": None if depth <= HALF else c})
        todo = later
    keys = [k for _, k in sorted(done)]
    return Splitters(tuple(keys), whole, n, rounds)


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.002, group_tolerance: float = 0.02) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard and slot added (columns of those names are replaced).

    size is the text's UTF-8 bytes plus 1, a null text's 1. Shards hold near equal sums of size. Equal
    texts share a shard unless that would move a boundary by more than ``group_tolerance`` of a shard; then
    rows of one text are split by their ids. Rows that repeat both text and id cannot be told apart and
    stay together. slot numbers the rows of a shard from 0 without gaps. An empty table gives an empty
    one. Reruns give the same shards. Columns may have any other name, those of the operator's own working columns too.
    """
    if clash := [c for c in docs.columns if c.lower() in _WORKING]:
        prefix = "__kept"
        while any(c.lower().startswith(prefix) for c in docs.columns):
            prefix += "_"
        away = {c: f"{prefix}{i}" for i, c in enumerate(clash)}
        out = shard_by_bytes(docs.withColumnsRenamed(away), shards, away.get(id_col, id_col), away.get(text_col, text_col), tolerance, group_tolerance)
        return out.withColumnsRenamed({v: k for k, v in away.items()})
    spark = docs.sparkSession
    store = Store(spark, "sharding")
    docs = docs.drop(*(c for c in docs.columns if c in ("size", "text_crc32", "law", "shard", "slot")))
    columns = docs.columns
    keyed = _keyed(docs, id_col, text_col)
    # The rounds read keys and sizes, not texts.
    thin = store.put(keyed.select("__h", "__d", "size"), "keys")
    cuts = find_splitters(thin, shards, "size", tolerance, group_tolerance)
    pieces = max(1, -(-cuts.n_bytes // (shards * TASK_BYTES)), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    kind = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("d", T.LongType())]))
    bounds = F.array(*(F.struct(F.lit(h).cast("long").alias("h"), F.lit(d).cast("long").alias("d")) for h, d in cuts.keys)).cast(kind)
    passed = F.filter(bounds, lambda b: (b["h"] < F.col("__h")) | ((b["h"] == F.col("__h")) & (b["d"] <= F.col("__d"))))
    place = {"shard": F.size(passed), "__piece": F.pmod("__d", F.lit(pieces)).cast("int")}
    counted = thin.withColumns(place).groupBy("shard", "__piece").count()
    before = W.partitionBy("shard").orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    bases = counted.select("shard", "__piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    order = W.partitionBy("shard", "__piece").orderBy("__h", "__d", "text_crc32", "size")
    numbered = keyed.withColumns(place).withColumn("__n", F.row_number().over(order)).join(bases, ["shard", "__piece"])
    return numbered.select(*columns, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__base") + F.col("__n") - 1).cast("long").alias("slot"))
